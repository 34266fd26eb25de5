"""Joins where one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", ways: int = 16, most: int = 1_000_000) -> DataFrame:
    """``many`` joined with ``few``, of which each key is kept ``ways`` times, or more if it is hot.

    The rows of a key are dealt to ``ways`` tasks by a hash of all their columns; those of a key with more than
    ``ways * most`` rows to so many that no task has over ``most``. There are no more such keys than
    there are rows for ``ways * most`` of them, so they are broadcast. Where a row goes depends on the row
    only, so none is lost or doubled if a task is run again and reads its input in another order; rows that are equal
    in every column go together, so a table that may repeat one row very often should count it first.
    ``few`` is small beside ``many``.
    """
    hot = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > ways * most).select(key, F.ceil(F.col("_n") / most).alias("_ways"))
    of = lambda df: df.join(F.broadcast(hot), key, "left").withColumn("_ways", F.coalesce("_ways", F.lit(ways)).cast("bigint"))
    # Maps have no hash; a table of maps alone would be dealt by its key.
    told = [f.name for f in many.schema if "map<" not in f.dataType.simpleString()]
    left = of(many.withColumn("_row", F.xxhash64(*told))).withColumn("_way", F.pmod("_row", "_ways")).drop("_row", "_ways")
    right = of(few).withColumn("_way", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ways") - 1))).drop("_ways")
    return left.join(right, [key, "_way"], how).drop("_way")
