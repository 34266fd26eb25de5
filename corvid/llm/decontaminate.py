"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item. A document's words stream
through it; at each word its state tells the longest run that ends there and that some item has.
Runs of ``window`` words or more are contamination, and so is a whole item of fewer words.

The items are put on the driver and broadcast in shards of at most ``shard_words`` words, one shard at a
time, so what is broadcast doesn't grow with the benchmark. A Python worker builds a shard's automaton
once and keeps it for its later tasks. One shard is one pass over the documents. Of more shards each is
a pass over the texts that writes the hits only, by digest of the text, and ends before the next shard is
sent; they are joined to the documents in the last pass. No text is written in between.

Edge cases: a null or empty text has no words. An item without words takes no part; an item with a
null id takes hits, but isn't counted or listed. Repeated items count once. Each document row
gives one row, repeated or not, and all its other columns are kept. Columns of the input that are
named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.batches import sliced
from corvid.llm.skew import spread_join
from corvid.storage import fresh_path, stored

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_RESULTS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))]
_NAMES = [f.name for f in _RESULTS]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "_digest binary, _shard bigint, _spans array<struct<start:bigint,end:bigint>>, _items array<bigint>"
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and all that isn't ASCII; A-Z in lower case."""
    return raw.translate(_SPLIT).split()


class Automaton:
    """Suffix automaton of several word sequences.

    State 0 is the start. ``window`` words or a whole shorter item make a window.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        # The states whose windows an item has, and the items of each.
        n = len(self.step)
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short = [False] * n
        for (item, words), _ in zip(items, ends, strict=True):
            state = 0
            for w in words:
                state = self.step[state][w]
                at = self._holding(state, window) if len(words) >= window else -1
                if at >= 0 and item is not None:
                    self.items[at].add(item)
            if words and len(words) < window:
                self.short[state] = True
                if item is not None:
                    self.items[state].add(item)
        self.holding = [self._holding(s, window) for s in range(n)]
        # The nearest state, itself included, that a whole short item ends in.
        self.whole = [0] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if s:
                self.whole[s] = s if self.short[s] else self.whole[self.link[s]]
        self.least = min((min(len(w), window) for _, w in items if w), default=1 << 30)

    def _holding(self, state: int, window: int) -> int:
        """The state of the last ``window`` words of ``state``'s runs; -1 if they are shorter."""
        if self.length[state] < window:
            return -1
        while self.length[self.link[state]] >= window:
            state = self.link[state]
        return state

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside windows, ascending and apart, and the items of those windows."""
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = run = 0
        for i, w in enumerate(words):
            after = step[state].get(w)
            if after is not None:
                run += 1
            else:
                while after is None and state:
                    state = link[state]
                    after = step[state].get(w)
                if after is None:
                    run = 0
                    continue
                run = length[state] + 1
            state = after
            if run < least:
                continue
            reach = 0
            if run >= window:
                reach = window
                found |= self.items[self.holding[state]]
            at = self.whole[state]
            if at == state and run < length[state]:
                at = self.whole[link[state]]
            while at > 0:
                reach = max(reach, length[at])
                found |= self.items[at] if self.short[at] else set()
                at = self.whole[link[at]]
            if reach:
                begin = i + 1 - reach
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, found


def _shards(items: DataFrame, item_id: str, text: str, shard_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in shards of at most ``shard_words`` words, or one item. One partition at a time."""
    shard, size = [], 0
    for row in items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).dropDuplicates().toLocalIterator():
        words = words_of((row.t or "").encode())
        if not words:
            continue
        if shard and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row.i, words))
        size += len(words)
    yield shard


#: The automaton that this Python worker built last, by the name of its shard.
_BUILT: dict[str, Automaton] = {}


def _built(name: str, shard, window: int) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shard.value, window)
    return _BUILT[name]


def _looker(spark: SparkSession, shard: list, window: int):
    """What gives a text's spans and items by the automaton of ``shard``, once called in a task; and its broadcast."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(shard)
    return lambda: _built(name, sent, window).hits, sent


def find_contamination(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """``docs`` with n_words, hit_spans (of words, end exclusive), n_hit and items; see ``_scanned`` for ``more``."""
    return _scanned(docs, items, None, **more)


def remove_contamination(docs: DataFrame, items: DataFrame, most_coverage: float = 0.5, **more) -> DataFrame:
    """``docs`` without contaminated spans; documents covered beyond ``most_coverage`` go.

    What a removed span leaves is joined by one space. Documents without hits stay as they are.
    """
    return _scanned(docs, items, most_coverage, **more)


def _scanned(docs: DataFrame, items: DataFrame, most_coverage: float | None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 200_000) -> DataFrame:
    """``docs`` with the results; or, if ``most_coverage`` is given, without the spans."""
    spark = docs.sparkSession
    docs = docs.drop(*_NAMES) if most_coverage is None else docs
    shards = _shards(items, item_id, item_text, shard_words)
    shard, after = next(shards), next(shards, None)
    if after is None:
        return _judged(docs, text, most_coverage, _looker(spark, shard, window)[0])
    folder = fresh_path(spark, "shard-hits")
    while shard is not None:
        looker, sent = _looker(spark, shard, window)
        _hits_of(docs, text, looker).write.mode("append").parquet(folder)
        sent.destroy()
        shard, after = after, next(shards, None)
    # Each text once for each shard, however many rows have it; then all its shards together.
    once = spark.read.schema(_HITS).parquet(folder).groupBy("_digest", "_shard").agg(F.first("_spans").alias("_spans"), F.first("_items").alias("_items"))
    # Under names that no column of the input has.
    spans, ids, key, doc = (f"{x}-{uuid.uuid4().hex}" for x in ("spans", "items", "digest", "doc"))
    hits = stored(once.groupBy(F.col("_digest").alias(key)).agg(F.flatten(F.collect_list("_spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("_items"))).alias(ids)), "hits")
    keyed = docs.select(F.struct(*docs.columns).alias(doc), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias(key))
    found = spread_join(keyed, hits, key, "left")
    return _judged(found.select(*[F.col(f"`{doc}`").getField(c).alias(c) for c in docs.columns], f"`{spans}`", f"`{ids}`"), text, most_coverage, None)


def _hits_of(docs: DataFrame, text: str, looker) -> DataFrame:
    """Digest, spans and items of the texts that one shard hits; the shard by a number of its own."""
    number = uuid.uuid4().int >> 65

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, seen = looker(), set()
        for batch in sliced(batches):
            rows: dict[str, list] = {"_digest": [], "_shard": [], "_spans": [], "_items": []}
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                own, ids = look(words_of(raw or b""))
                digest = hashlib.sha256(raw or b"").digest() if own else b""
                if own and digest not in seen:
                    seen.add(digest)
                    for column, x in zip(rows.values(), (digest, number, [{"start": a, "end": b} for a, b in own], sorted(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows["_digest"], pa.binary()), pa.array(rows["_shard"], pa.int64()), pa.array(rows["_spans"], _SPANS), pa.array(rows["_items"], pa.list_(pa.int64()))], names=list(rows))

    return docs.select(text).mapInArrow(scan, _HITS)


def _judged(docs: DataFrame, text: str, most_coverage: float | None, looker) -> DataFrame:
    """The last pass, over documents as they came or, without ``looker``, with their hits behind."""
    names = docs.columns if looker else docs.columns[:-2]
    plain = T.StructType([docs.schema[n] for n in names])
    where = names.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = looker() if looker else None
        for batch in sliced(batches):
            n_words, spans, n_hit, found, changed = [], [], [], [], {}
            known = None if look else [batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()]
            for j, raw in enumerate(batch.column(where).cast(pa.binary()).to_pylist()):
                words = words_of(raw or b"")
                own, ids = look(words) if look else (merged([(s["start"], s["end"]) for s in known[0][j] or ()]), known[1][j] or ())
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in own))
                if most_coverage is None:
                    spans.append([{"start": a, "end": b} for a, b in own])
                    found.append(sorted(ids))
                elif own and n_hit[-1] <= most_coverage * len(words):
                    changed[j] = without(raw.decode(), own)
            columns = [batch.column(i) for i in range(len(names))]
            if most_coverage is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*names, *_NAMES])
                continue
            if changed:
                columns[where] = pa.array([changed.get(j, t) for j, t in enumerate(columns[where].to_pylist())], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([h <= most_coverage * n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, plain if most_coverage is not None else T.StructType([*plain.fields, *_RESULTS]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, ascending; those that touch merge."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    flat = raw.translate(_SPLIT)
    where, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        where.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : where[a][0]].rstrip())
        at = where[b - 1][1]
    out.append(raw[at:].lstrip())
    return b" ".join(x for x in out if x).decode()
