"""Streams of edits, run to the end over files."""

import datetime

from corvid.streaming.documents import debounced, latest_versions, unseen

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "uri string, version long, text string, ts timestamp"


def stream(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, v, t, T0 + datetime.timedelta(milliseconds=ms)) for u, v, t, ms in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_older_versions_change_nothing(spark, tmp_path):
    edits = stream(spark, tmp_path, [[("a", 1, "x", 0), ("b", 5, "y", 0), ("a", 2, "z", 5)], [("a", 1, "late", 9), ("b", 6, None, 9), ("c", None, "q", 9)]])
    got = {tuple(r) for r in run(latest_versions(edits), "update", "latest", tmp_path).collect()}
    assert got == {("a", 2, "z"), ("b", 5, "y"), ("b", 6, None)}


def test_runs_of_edits_are_analysed_once(spark, tmp_path):
    rows = [("a", 1, "x", 0), ("a", 2, "y", 300), ("a", 3, "z", 1500), ("b", 9, "q", 100), ("a", 4, "end", 60_000), ("b", 1, "end", 90_000)]
    edits = stream(spark, tmp_path, [rows[:4], rows[4:], [("z", 1, "tick", 200_000)]])
    got = {(r.uri, r.version, r.n_edits) for r in run(debounced(edits), "append", "runs", tmp_path).collect()}
    assert {("a", 2, 2), ("a", 3, 1), ("b", 9, 1)} <= got


def test_equal_edits_come_once(spark, tmp_path):
    edits = stream(spark, tmp_path, [[("a", 1, "x", 0), ("a", 2, "x", 10)], [("a", 3, "x", 20), ("b", 1, "x", 20)]])
    assert run(unseen(edits), "append", "unseen", tmp_path).count() == 2
