"""Document versions: latest, debounced, retained, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators.versions import token_changes
from corvid.plans.registry import query
from corvid.sources.tables import table


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each document; late arrivals of older ones don't matter."""
    newest = F.max(F.struct("ts", "event_id")).alias("newest")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(newest).select("user_id", "event_type", "newest.event_id", "newest.ts")


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*)::BIGINT AS n_edits FROM i GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of edits with pauses under half an hour: each causes one analysis."""
    edits = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    runs = edits.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.max("ts").alias("final"), F.count("*").alias("n_edits"))
    return runs.select("user_id", F.unix_micros("first").alias("start"), F.unix_micros("final").alias("last"), "n_edits")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that were used in the last week of the table."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    # A literal, so that files without such rows aren't read.
    least = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).cast("string")).first()[0]
    return rows.where(F.lit(least).cast(rows.schema["ts"].dataType) <= F.col("ts")).select("event_id")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM conversations), c AS (SELECT conv_id, turn, token, count(*) AS n FROM w GROUP BY ALL),
p AS (SELECT conv_id, turn + 1 AS turn, token, n FROM c WHERE EXISTS (SELECT 1 FROM conversations v WHERE v.conv_id = c.conv_id AND v.turn = c.turn + 1))
SELECT conv_id, turn, token, (coalesce(c.n, 0) - coalesce(p.n, 0))::BIGINT AS delta FROM c FULL JOIN p USING (conv_id, turn, token) WHERE coalesce(c.n, 0) <> coalesce(p.n, 0)""")
def token_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each token's count changes from one version of a document to the next."""
    return token_changes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
