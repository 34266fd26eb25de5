"""Changes of tokens between versions: repeated, missing and null versions, and what one task holds."""

import duckdb

from corvid.operators.versions import token_changes
from corvid.plans.catalog import ORACLE_SQL
from corvid.plans.version_queries import token_delta

ROWS = [
    (1, 1, "a b b"), (1, 2, "b c"), (1, 2, "c c a"), (1, 3, None), (1, 4, "a"), (1, 6, "a A"), (2, 1, "x y"), (2, 2, ""), (2, 3, "1 2é z"),
    (None, 1, "n"), (None, 2, "m"), (3, None, "k k"), (3, None, "k"), (3, 1, "k"), (4, 1, "same same"), (4, 2, "same, same."), (4, 2, None),
]


def test_odd_versions(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(ORACLE_SQL["token_delta"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in token_delta(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_tokens_are_not_shuffled(spark):
    """No aggregate over tokens: only versions are dealt out and sorted."""
    versions = spark.createDataFrame(ROWS, "conv_id long, turn long, text string")
    plan = token_changes(versions)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
