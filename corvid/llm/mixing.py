"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. In the ideal mixture all sources that still have some go
on at once, by their shares; ``T(v)`` is how many blocks it has placed when each source has had ``v``
for each share, or all of its own. Block ``j`` of a source with ``k`` shares is released at slot
``floor(T(j / k))`` and due by slot ``ceil(T((j + 1) / k))``; of the released blocks, the one due first
takes the slot. So at every slot each source is less than one block off the ideal mixture, however
many there are and whenever others run out. Every document is placed exactly once.

Slots follow from each other, so one task lays them out in order, from the sources' sizes only. It
holds a few numbers for each source and writes its plan, a row for each block, as a table. Ranks within
sources, which may hold any part of the rows, come from a sort over all partitions and the counts of
each. Only what Spark broadcasts, if it is small, passes through the driver.

Edge cases: a null source is a source of its own. Repeated rows each get a place; equal and null ids are
placed next to each other in their source, and may be any part of it. Columns of the input that are named like the results are replaced.
An empty table stays empty.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, batched

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import stored

_NULL = "\u0000null"


def target_shares(counts: dict[str, int], power: float = 0.5, total: int = 1000) -> dict[str, int]:
    """Whole shares of about ``total``, at least 1 each, as the counts to the ``power``."""
    weights = {s: n**power for s, n in counts.items()}
    whole = sum(weights.values())
    return {s: max(1, round(total * w / whole)) for s, w in weights.items()}


def in_order(blocks: dict[str, int], shares: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Source and block of each slot, from the first."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    ends = sorted((blocks[s] / shares[s], blocks[s], shares[s]) for s in names)
    times = [t for t, _, _ in ends]
    # What sources have placed that ran out by then, and the shares of the others.
    gone = [0, *accumulate(n for _, n, _ in ends)]
    live = [0, *accumulate(k for _, _, k in reversed(ends))][::-1]

    def placed(j: int, k: int, up: int) -> int:
        i = bisect_right(times, j / k)
        return gone[i] + (j * live[i] + up * (k - 1)) // k

    done = dict.fromkeys(names, 0)
    coming = [(0, s) for s in names]
    ready: list[tuple[int, str]] = []
    for t in range(gone[-1]):
        while coming and coming[0][0] <= t:
            _, s = heapq.heappop(coming)
            heapq.heappush(ready, (placed(done[s] + 1, shares[s], 1), s))
        _, s = heapq.heappop(ready)
        yield s, done[s]
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(coming, (placed(done[s], shares[s], 0), s))


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of as many slots as there are shares."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t, (s, _) in enumerate(in_order(shares, shares)):
        slots[s].append(t)
    return slots


def _plan(counts: DataFrame, shares: dict[str, int] | None, block: int, most_sources: int) -> DataFrame:
    """For each source and block its slot and the position of its first document."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        if not sizes:
            return
        given = target_shares(sizes, total=max(1000, 1000 * len(sizes) // most_sources)) if shares is None else {s: max(1, shares.get(s, 1)) for s in sizes}
        first = 0
        for some in batched(enumerate(in_order({s: -(-n // block) for s, n in sizes.items()}, given)), 10_000):
            rows = []
            for t, (s, j) in some:
                rows.append((s, j, t, first))
                first += min(block, sizes[s] - j * block)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["_stream", "block", "slot", "_first"])

    return counts.select("_stream", "n").repartition(1).mapInArrow(lay, "_stream string, block bigint, slot bigint, _first bigint")


def mix_sources(docs: DataFrame, shares: dict[str, int] | None = None, doc_id: str = "doc_id", source: str = "source", block: int = 16, most_sources: int = 256) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``slot`` (of the block) and ``position``.

    Without ``shares`` the target weights go as the square roots of the sources' sizes, in 1,000
    shares; beyond ``most_sources``, which those are enough for, shares grow with the sources. Sources
    that ``shares`` doesn't name get one share each.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("block", "slot", "position")]
    # Columns that may be named like those in between go by other names until the end.
    away = {c: f"{c}-{uuid.uuid4().hex}" for c in names if c.startswith("_")}
    docs, names = docs.withColumnsRenamed(away), [away.get(c, c) for c in names]
    doc_id, source = away.get(doc_id, doc_id), away.get(source, source)
    stream = F.coalesce(F.col(source).cast("string"), F.lit(_NULL))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one source with equal ids are told apart by number, so that they too can be cut.
    order = [F.col("_stream"), F.xxhash64(doc_id), F.col(doc_id), F.col("_number")]
    numbered = docs.select(*names, stream.alias("_stream"), F.monotonically_increasing_id().alias("_number"))
    laid = stored(numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_number").withColumn("_id", F.monotonically_increasing_id()), "mixing")
    part = F.shiftrightunsigned("_id", 33)
    # One row for each partition and each source that begins or ends in one.
    pieces = laid.groupBy("_stream", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_stream").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select("_stream", "_part", "n", "_low", before.alias("_before")), "pieces")
    # Stored, so that their sizes are known: they are broadcast only if they are small.
    plan = stored(_plan(pieces.groupBy("_stream").agg(F.sum("n").alias("n")), shares, block, most_sources), "plan")

    ranked = laid.withColumn("_part", part).join(pieces.drop("n"), ["_stream", "_part"]).withColumn("_rank", F.col("_id") - F.col("_low") + F.col("_before"))
    placed = ranked.withColumn("block", F.floor(F.col("_rank") / block).cast("bigint")).join(plan, ["_stream", "block"])
    return placed.withColumn("position", F.col("_first") + F.col("_rank") % block).select(*names, "block", "slot", "position").withColumnsRenamed({v: k for k, v in away.items()})
