"""Interval operators: containment, suppression, merging, conflicts and shifts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Points and ranges by the cells of ``width`` that they lie in, so that a join has a key."""
    cell = lambda x: F.floor(x / width).cast("bigint")
    return points.withColumn("_cell", cell(F.col(at))), ranges.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with each range ``[start, end)`` of the same keys that holds them."""
    left, right = _bucketed(points, ranges, at, start, end, width)
    return left.join(right, [*keys, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def outside(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points that no range of the same keys holds. Ranges are merged first, so few meet a point."""
    merged = merge_ranges(ranges, keys, start, end)
    left, right = _bucketed(points, merged, at, start, end, width)
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_cell").alias("_r_cell"), F.col(start).alias("_r_start"), F.col(end).alias("_r_end"))
    same = (F.col("_cell") == F.col("_r_cell")) & (F.col(at) >= F.col("_r_start")) & (F.col(at) < F.col("_r_end"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, same, "left_anti").drop("_cell")


def merge_ranges(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of the ranges of each key; those that touch merge."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.select(*keys, start, end).withColumn("_new", new).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def outermost(spans: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Spans that no earlier or longer span of the same key holds."""
    order = Window.partitionBy(*keys).orderBy(F.col(start), F.desc(end), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(order)).where(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def conflicts(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two edits can't both be applied: an insertion conflicts with a range that it touches."""
    insert_a, insert_b = start_a == end_a, start_b == end_b
    return F.when(insert_a & insert_b, start_a == start_b).when(insert_a, (start_b <= start_a) & (start_a <= end_b)).when(insert_b, (start_a <= start_b) & (start_b <= end_a)).otherwise((start_a < end_b) & (start_b < end_a))


def apply_in_order(edits: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Edits of each key in order of place, each kept if it starts behind the last one kept.

    Edits stream through sorted partitions, so that a key of any size needs no memory of its own.
    """

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reach = None, 0
        for batch in batches:
            kept = []
            for k, a, b in zip(batch[key].tolist(), batch[start].tolist(), batch[end].tolist(), strict=True):
                if k != now or a >= reach:
                    now, reach = k, b
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch[kept]

    rows = edits.select(key, start, end, tie).repartition(key).sortWithinPartitions(key, start, end, tie)
    return rows.mapInPandas(greedy, rows.schema)
