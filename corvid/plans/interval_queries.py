"""Suppression, ranges and edits: events are findings, and their times places in a user's file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators.intervals import apply_in_order, conflicts, merge_ranges, outermost, outside
from corvid.plans.registry import query
from corvid.sources.tables import table

HOUR = 3_600_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS pos FROM events)"
_R = f"r AS (SELECT user_id, pos AS start, pos + {HOUR} AS stop FROM e WHERE event_type = 'error')"
_S = "s AS (SELECT event_id, user_id, pos AS start, pos + floor(value * 60000000)::BIGINT AS stop FROM e)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a span of as many minutes as its value."""
    return events(spark, sf_dir).select("event_id", "user_id", F.col("pos").alias("start"), (F.col("pos") + F.floor(F.col("value") * 60000000)).alias("stop"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour from each error on."""
    return events(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("pos").alias("start"), (F.col("pos") + HOUR).alias("stop"))


@query(f"WITH {_E}, {_R} SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND e.pos >= r.start AND e.pos < r.stop)")
def suppression_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no suppression of their file covers."""
    return outside(events(spark, sf_dir), _ranges(spark, sf_dir), ["user_id"], "pos", "start", "stop", width=6 * HOUR).select("event_id", "user_id")


@query(f"""WITH {_E}, {_R}, n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY user_id, island""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed ranges of each file, merged."""
    return merge_ranges(_ranges(spark, sf_dir), ["user_id"], "start", "stop")


@query(f"""WITH {_E}, {_S} SELECT event_id, user_id, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) WHERE reach IS NULL OR stop > reach""")
def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreachable spans that no other holds."""
    return outermost(_spans(spark, sf_dir), ["user_id"], "start", "stop", "event_id")


@query(f"""WITH {_E}, s AS (SELECT event_id, user_id, pos AS start, pos + CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 6000000)::BIGINT END AS stop FROM e)
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id
WHERE CASE WHEN a.start = a.stop AND b.start = b.stop THEN a.start = b.start WHEN a.start = a.stop THEN b.start <= a.start AND a.start <= b.stop WHEN b.start = b.stop THEN a.start <= b.start AND b.start <= a.stop ELSE a.start < b.stop AND b.start < a.stop END""")
def fix_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of edits of one file that exclude each other; sign-ups are insertions.

    Edits meet in the cells of time that they lie in, and a pair counts in the first cell of both.
    """
    length = F.when(F.col("event_type") == "signup", F.lit(0).cast("bigint")).otherwise(F.floor(F.col("value") * 6000000))
    edits = events(spark, sf_dir).select("event_id", "user_id", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"))
    cell = lambda x: F.floor(x / HOUR).cast("bigint")
    cells = edits.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))))
    a, b = (cells.select("user_id", "cell", *[F.col(c).alias(f"{c}_{x}") for c in ("event_id", "start", "stop")]) for x in "ab")
    first = F.col("cell") == F.greatest(cell(F.col("start_a")), cell(F.col("start_b")))
    both = a.join(b, ["user_id", "cell"]).where((F.col("event_id_a") < F.col("event_id_b")) & first & conflicts(F.col("start_a"), F.col("stop_a"), F.col("start_b"), F.col("stop_b")))
    return both.select("user_id", F.col("event_id_a").alias("first_id"), F.col("event_id_b").alias("second_id"))


@query(f"""WITH RECURSIVE {_E}, {_S}, g(user_id, start, stop, event_id) AS (
SELECT user_id, unnest(min(row(start, stop, event_id))::STRUCT(start BIGINT, stop BIGINT, event_id BIGINT)) FROM s GROUP BY user_id
UNION ALL SELECT user_id, unnest(m) FROM (SELECT g.user_id, min(row(s.start, s.stop, s.event_id))::STRUCT(start BIGINT, stop BIGINT, event_id BIGINT) AS m FROM g JOIN s ON s.user_id = g.user_id AND s.start >= g.stop AND (s.start, s.stop, s.event_id) > (g.start, g.stop, g.event_id) GROUP BY g.user_id, g.event_id))
SELECT * FROM g""")
def apply_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits that are applied: in order of place, each that starts behind the last."""
    return apply_in_order(_spans(spark, sf_dir), "user_id", "start", "stop", "event_id")


@query(f"""WITH {_E} SELECT event_id, pos + coalesce(sum(CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT WHEN event_type = 'error' THEN -floor(value)::BIGINT ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shifted FROM e""")
def offset_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after all edits before them: purchases insert, errors delete."""
    delta = F.when(F.col("event_type") == "purchase", F.floor("value")).when(F.col("event_type") == "error", -F.floor("value")).otherwise(0)
    before = F.sum(delta).over(Window.partitionBy("user_id").orderBy("pos", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events(spark, sf_dir).select("event_id", (F.col("pos") + F.coalesce(before, F.lit(0))).cast("bigint").alias("shifted"))
