"""Stretches of words that repeat with a period, found by Baier's grouping.

A run is a stretch of words with smallest period q, of at least ``times`` periods and ``least`` words, that
no neighbouring word extends. Every run has a root that is the longest Lyndon word where it starts, under an order
of the words or under its reverse. The first phase of Baier's suffix sorter groups suffixes by just that
word, so it is run once for each order, without the second phase. Roots of one group that follow each other
are extended to both sides by their longest common extensions.

Words that can't be in a run never get to the sorter: every three words of a run recur within it, so a text is first
cut, over and over, into stretches whose every three words recur within the stretch. Tasks hold one text at a time.

Edge cases: a null or empty text has no words and no runs, and collapses to an empty text. Rows are judged
one by one, so repeated ids or rows give as many results. Only the named columns are read, and others don't
come back. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.batches import sliced

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Multipliers that mix three words into one number; equal numbers of other words only cut less.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def lyndon_groups(word: list[int]) -> tuple[list[int], list[int]]:
    """For each position the length of the longest Lyndon word that starts there, and a number that equal ones share.

    Groups begin as the positions of a symbol. From the highest group down, each of its members passes the group's
    word to the nearest position before it that is in a lower group: that position's own word grows by it, as many
    times as it gets it, and moves to a new group just above its old one.
    """
    n = len(word)
    order = sorted(range(n), key=word.__getitem__)
    place = [0] * n
    first = [0] * n
    size = [0] * n
    length = [1] * n
    start = 0
    for at, i in enumerate(order):
        if word[i] != word[order[start]]:
            start = at
        place[i], first[i] = at, start
        size[start] += 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        group = first[order[end]]
        members = order[group : end + 1]
        if end > group:
            members.sort()
        passed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and first[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                passed[j] = passed.get(j, 0) + 1
        end = group - 1
        own = length[group]
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in passed.items():
            by_times.setdefault(times, {}).setdefault(first[j], []).append(j)
        grown = {old: length[old] for groups in by_times.values() for old in groups}
        for times in sorted(by_times, reverse=True):
            for old, moved in by_times[times].items():
                last = old + size[old]
                for j in moved:
                    last -= 1
                    at, other = place[j], order[last]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                size[old] -= len(moved)
                for j in moved:
                    first[j] = last
                size[last] = len(moved)
                length[last] = grown[old] + times * own
    return [length[g] for g in first], first


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements agree from the beginning on, looked at in blocks that double."""
    done, step, most = 0, 16, min(len(a), len(b))
    a, b = a[:most], b[:most]
    while done < most:
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = min(done + step, most), 2 * step
    return most


def _from_roots(ids: np.ndarray, order: list[int], least: int, times: int) -> set[tuple[int, int, int]]:
    lengths, groups = map(np.asarray, lyndon_groups(order))
    n = len(ids)
    at = np.flatnonzero(np.arange(n) + (times - 1) * lengths <= n)
    p, ok = lengths[at], np.ones(len(at), bool)
    # A run holds at least times - 1 whole roots in a row; the first of a row stands for it.
    for k in range(1, times - 1):
        ok &= groups[at + k * p] == groups[at]
    behind = at - p
    ok &= (behind < 0) | (groups[np.maximum(behind, 0)] != groups[at])
    found = set()
    for i, q in zip(at[ok].tolist(), p[ok].tolist(), strict=True):
        left = _common(ids[:i][::-1], ids[: i + q][::-1])
        right = _common(ids[i + q :], ids[i:])
        if left + q + right >= max(least, times * q):
            found.add((i - left, left + q + right, q))
    return found


def _stretches(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Bounds of the stretches of at least ``shortest`` words whose every three words recur within them."""
    if len(ids) < shortest:
        return []
    wide = ids.astype(np.uint64)
    mixed = wide[:-2] * _MIX[0] + wide[1:-1] * _MIX[1] + wide[2:] * _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    at, part = np.arange(len(mixed)), np.zeros(len(mixed), np.int64)
    while len(at):
        key = mixed[at] + part.astype(np.uint64) * _MIX[1]
        by_key = np.argsort(key, kind="stable")
        same = key[by_key[1:]] == key[by_key[:-1]]
        recurs = np.zeros(len(at), bool)
        recurs[by_key[1:][same]] = True
        recurs[by_key[:-1][same]] = True
        kept = np.flatnonzero(recurs)
        breaks = np.ones(len(kept), bool)
        breaks[1:] = (np.diff(at[kept]) != 1) | (part[kept][1:] != part[kept][:-1])
        number = np.cumsum(breaks) - 1
        long = np.bincount(number, minlength=1)[number] >= shortest - 2 if len(kept) else np.zeros(0, bool)
        again = len(at) == int(long.sum()) and len(np.unique(part)) == len(np.unique(number[long]))
        at, part = at[kept[long]], number[long]
        if again:
            break
    if not len(at):
        return []
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(at)] - 1
    return list(zip(at[starts].tolist(), (at[ends] + 3).tolist(), strict=True))


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """start, length and period of every run, by start, then period. ``least`` is at least 5, ``times`` at least 3."""
    found = []
    for start, end in _stretches(ids, least):
        part = np.unique(ids[start:end], return_inverse=True)[1]
        there = _from_roots(part, part.tolist(), least, times) | _from_roots(part, (part.max() - part).tolist(), least, times)
        found += [(start + s, n, q) for s, n, q in there]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _judged(text: str | None, least: int, times: int) -> tuple[int, list[dict], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    number = {}
    ids = np.fromiter(map(lambda w, of=number, new=count(): of[w] if w in of else of.setdefault(w, next(new)), words), np.int64, len(words))
    runs = runs_of(ids, least, times)
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edges[s + q] += 1
            edges[s + n] -= 1
        words = compress(words, (np.cumsum(edges[:-1]) == 0).tolist())
    return len(ids), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row.

    Words are what blanks, tabs and line breaks of ASCII part. ``collapsed`` is the text without the words
    that some run has after its first period, joined by single blanks.
    """
    if least < 5 or times < 3:
        raise ValueError("least must be 5 or more, and times 3 or more")
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            n, runs, collapsed = zip(*(_judged(t.as_py(), least, times) for t in batch.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return found.mapInArrow(judge, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
