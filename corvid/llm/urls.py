"""URL filters: rules first, then a likelihood ratio of two character models.

Rules name a host, with all its subdomains, and the beginning of a path; the longest that fits
decides. The URLs that they allow and block are the texts of two Markov models over characters, of
orders up to 5, each order smoothed by the one below. Other URLs are judged by the difference of
their log-likelihoods for each character, by counts over every ruled URL. The threshold is calibrated
on a fifth of the ruled URLs, each judged by the counts over the other four fifths.

The models are a table of exact counts, one row for each run of characters, and grow with the input.
URLs are scored in chunks of bounded length: each asks for the counts of its distinct runs, so that
no run, however common, has more rows in the join than there are chunks. Nothing of the models
passes through the driver but how many characters each kind has.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the models. Without ruled URLs of both kinds nothing tells them apart and the verdict is
allow. Each row gives one row; other columns are kept; those named like the results are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.learn import fold
from corvid.storage import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules in force.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDERS = 6
# Symbols of exact runs: the mark before a text, the mark behind it, and the bytes.
_SYMBOLS = 258
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits as a struct of rule and verdict; null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        then = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _cells(text: bytes, cells: int) -> np.ndarray:
    """The counter of each run of 1 to ``ORDERS`` bytes that ends at each byte: orders x bytes.

    The text starts after ``ORDERS - 1`` marks and ends with another.
    """
    raw = np.frombuffer(b"\x02" * (ORDERS - 1) + text + b"\x03", np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.empty((ORDERS, len(raw) - ORDERS + 1), np.int64)
    run = np.zeros(len(raw) - ORDERS + 1, np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            run = run + raw[ORDERS - 1 - k : len(raw) - k] * power
            power *= _BASE
            mixed = (run + np.uint64(k + 1)) * _MIX
            mixed ^= mixed >> np.uint64(32)
            out[k] = (mixed * _BASE >> np.uint64(20)) % np.uint64(cells)
    return out


@dataclass
class Models:
    """The models over hashed counters, for one text in memory; tables are scored by exact runs.

    ``counts`` is kinds x cells, allowed first; ``marks`` how many characters each kind has.
    """

    counts: np.ndarray
    marks: np.ndarray
    weight: float = 4.0

    def ratio(self, text: bytes) -> float:
        """Log-likelihood of ``text`` as allowed less that as blocked, for each character."""
        if not self.marks.all():
            return 0.0
        at = _cells(text, self.counts.shape[1])
        return float(_ratios(self.counts[:, at], self.marks, np.zeros(1, np.int64), self.weight)[0])


def _ratios(seen: np.ndarray, marks: np.ndarray, firsts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """The ratio of each text; ``seen`` is kinds x orders x bytes, of texts that start at ``firsts``."""
    logs = []
    for kind in (0, 1):
        p = np.full(seen.shape[2], 1 / 257)
        before = np.full(seen.shape[2], marks[kind])
        for k in range(ORDERS):
            p = (np.minimum(seen[kind, k], before) + weight * p) / (before + weight)
            # The runs before each byte are those that end at the byte before it.
            before = np.r_[0, seen[kind, k][:-1]]
            before[firsts] = 0
        logs.append(np.log(p))
    return np.add.reduceat(logs[0] - logs[1], firsts) / np.diff(np.r_[firsts, seen.shape[2]])


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The exact number of each run of 1 to ``ORDERS`` symbols, orders x bytes, and where texts start in it.

    Each text starts after ``ORDERS - 1`` marks and ends with another, as in ``_cells``.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + ORDERS) - 1
    symbols = np.zeros(ends[-1] + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[((ends - sizes - ORDERS + 1)[:, None] + np.arange(ORDERS - 1)).ravel()] = False
    at = np.flatnonzero(inside)
    symbols[at] = 1
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 2
    out = np.empty((ORDERS, len(at)), np.int64)
    run = np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        run += symbols[at - k] * _SYMBOLS**k
        out[k] = run * ORDERS + k
    return out, np.cumsum(sizes + 1) - sizes - 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], slice]]:
    """The chunks of a batch of texts and their chunks: number, texts and rows."""
    chunk = batch.column(1).to_numpy()
    cuts = [*np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(chunk[a]), [t.encode() for t in batch.column(0).slice(a, b - a).to_pylist()], slice(a, b)


def _pieces(*columns: np.ndarray, names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most]) for c in columns], names=names)


def in_chunks(pages: DataFrame, text: str, name: str, cells: int) -> DataFrame:
    """``pages`` with the number of a chunk: texts that follow each other and have about ``cells`` runs."""
    names, most = pages.columns, max(1, cells // ORDERS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, done = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes = np.array([len(t.encode()) + 1 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], np.int64)
            before = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(low + before // most)], names=[*names, name])

    return pages.mapInArrow(number, T.StructType([*pages.schema.fields, T.StructField(name, T.LongType())]))


def train(pages: DataFrame, text: str, chunk: str, kind: str, kinds: int = 2) -> DataFrame:
    """How often each run is in the texts of each ``kind`` from 0; rows of no kind don't count."""
    columns = [f"n{k}" for k in range(kinds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2).to_numpy()
            for _, texts, rows in _slices(batch):
                runs, firsts = _runs(texts)
                run, at = np.unique(runs, return_inverse=True)
                each = np.tile(np.repeat(of[rows], np.diff(np.r_[firsts, runs.shape[1]])), ORDERS)
                held = np.bincount(at.ravel() * kinds + each, minlength=len(run) * kinds).reshape(-1, kinds)
                yield from _pieces(run, *held.T, names=["run", *columns])

    rows = pages.where(F.col(kind).isNotNull()).select(text, chunk, kind).mapInArrow(count, "run bigint, " + ", ".join(f"{c} bigint" for c in columns))
    return rows.groupBy("run").agg(*[F.sum(c).alias(c) for c in columns])


def with_ratios(pages: DataFrame, counts: DataFrame, marks: list[int], text: str, chunk: str, models: dict[str, list[tuple[int, ...]]]) -> DataFrame:
    """``pages`` with a ratio for each of ``models``; each chunk meets the counts of its own runs only.

    A model names the kinds that it counts as allowed and those that it counts as blocked.
    """
    names = pages.columns
    known_marks = {name: np.array([sum(marks[k] for k in of) for of in kinds]) for name, kinds in models.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts, _ in _slices(batch):
                run = np.unique(_runs(texts)[0])
                yield from _pieces(np.full(len(run), number), run, names=["asking", "run"])

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        # A chunk that two tasks have read has asked twice.
        run, first = np.unique(known["run"].to_numpy(), return_index=True)
        runs, firsts = _runs([t.encode() for t in rows[text].to_pylist()])
        at = np.minimum(np.searchsorted(run, runs), max(len(run) - 1, 0))
        found = run[at] == runs if len(run) else np.zeros(runs.shape, bool)
        seen = []
        for k in range(len(marks)):
            n = known[f"n{k}"].to_numpy()[first]
            seen.append(np.where(found, n[at], 0) if len(run) else np.zeros(runs.shape, np.int64))
        out = rows.select(names)
        for name, kinds in models.items():
            of = known_marks[name]
            ratios = _ratios(np.stack([sum(seen[k] for k in x) for x in kinds]), of, firsts) if of.all() else np.zeros(len(firsts))
            out = out.append_column(name, pa.array(ratios, pa.float64()))
        return out

    asked = pages.select(text, chunk).mapInArrow(ask, "asking bigint, run bigint")
    known = asked.join(counts, "run")
    return pages.groupBy(chunk).cogroup(known.groupBy("asking")).applyInArrow(answer, T.StructType([*pages.schema.fields, *(T.StructField(name, T.DoubleType()) for name in models)]))


def calibrated(scored: DataFrame, ratio: str, verdict: str, steps: int = 100, most: int = 5) -> float:
    """The threshold with the least mean error over both verdicts, from a histogram of ratios."""
    step = F.round(F.greatest(F.least(F.col(ratio), F.lit(float(most))), F.lit(float(-most))) * steps).cast("int")
    seen = {(r.step, r.verdict): r.n for r in scored.groupBy(step.alias("step"), F.col(verdict).alias("verdict")).agg(F.count("*").alias("n")).collect()}
    total = {v: sum(n for (_, w), n in seen.items() if w == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    error = lambda t: sum(n for (s, v), n in seen.items() if v == "allow" and s < t) / total["allow"] + sum(n for (s, v), n in seen.items() if v == "block" and s >= t) / total["block"]
    errors = {t: error(t) for t in sorted({s + d for s, _ in seen for d in (0, 1)} | {0})}
    best = min(errors.values())
    fine = [t for t, e in errors.items() if e == best]
    return (fine[0] + fine[-1]) / 2 / steps - 0.5 / steps


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, cells: int = 1 << 20) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ratio.

    A task handles the texts of about ``cells`` runs at once; the results don't depend on it.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "ratio")]
    # Columns that may be named like those in between go by other names until the end.
    away = {c: f"{c}-{uuid.uuid4().hex}" for c in kept if c.startswith("_")}
    pages, kept, url = pages.withColumnsRenamed(away), [away.get(c, c) for c in kept], away.get(url, url)
    located = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = ruled(F.col("host"), F.col("path"), rules)
    # 0 and 1 are the four fifths that are allowed and blocked, 2 and 3 the fifth.
    kind = (judged["verdict"] == "block").cast("int") + F.when(fold("_text", 5) == 0, 2).otherwise(0)
    known = located.withColumn("_text", F.concat("host", "path")).withColumn("_kind", kind)
    known = stored(in_chunks(known, "_text", "_chunk", cells), "urls")
    sizes = {r["_kind"]: r.n for r in known.where("_kind IS NOT NULL").groupBy("_kind").agg(F.sum(F.octet_length("_text") + 1).alias("n")).collect()}
    marks = [sizes.get(k, 0) for k in range(4)]
    counts = train(known, "_text", "_chunk", "_kind", 4)
    models = {"ratio": [(0, 2), (1, 3)], "_unseen": [(0,), (1,)]}
    scored = stored(with_ratios(known, counts, marks, "_text", "_chunk", models), "ratios")
    fifth = scored.where("_kind >= 2").withColumn("verdict", F.when(F.col("_kind") == 2, "allow").otherwise("block"))
    least = calibrated(fifth, "_unseen", "verdict")
    method = F.when(F.col("ratio") >= least, F.lit("allow")).otherwise(F.lit("block"))
    # The rule's struct doesn't go through Python.
    out = scored.withColumn("_judged", judged)
    return out.select(*kept, "host", "path", F.col("_judged.rule").alias("rule"), F.coalesce("_judged.verdict", method).alias("verdict"), "ratio").withColumnsRenamed({v: k for k, v in away.items()})
