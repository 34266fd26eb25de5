"""Operators on small relations: edge cases and properties."""

import random
import time

from pyspark.sql import functions as F

from corvid.functions.shell import logical_lines
from corvid.functions.text import lines, match_starts
from corvid.operators.fixpoint import chain_ends, reachable
from corvid.operators.intervals import apply_in_order, conflicts, merge_ranges, outside
from corvid.sources.tables import source_files


def test_lines_count_bytes_and_skip_nulls(spark):
    files = spark.createDataFrame([(1, "é\nb"), (2, ""), (3, None), (4, "x\n")], "id int, text string")
    got = {tuple(r) for r in lines(files, "id").collect()}
    assert got == {(1, 1, 0, "é"), (1, 2, 3, "b"), (2, 1, 0, ""), (4, 1, 0, "x"), (4, 2, 2, "")}


def test_match_starts(spark):
    df = spark.createDataFrame([("éabxxab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(match_starts(F.col("t"), "ab")).collect()] == [[1, 5], [], None]


def test_ranges_that_touch_merge_and_suppression_only_grows(spark):
    random.seed(1)
    data = [(random.randint(0, 2), a, a + random.randint(0, 9)) for a in (random.randint(0, 99) for _ in range(60))]
    ranges = spark.createDataFrame(data, "k int, start long, stop long")
    merged = sorted(map(tuple, merge_ranges(ranges, ["k"], "start", "stop").collect()))
    for (k, _, stop), (k2, start2, _) in zip(merged, merged[1:]):
        assert k != k2 or start2 > stop
    points = spark.createDataFrame([(k, p) for k in range(4) for p in range(110)], "k int, p long")
    left = {tuple(r) for r in outside(points, ranges, ["k"], "p", "start", "stop", width=16).select("k", "p").collect()}
    assert left == {(k, p) for k in range(4) for p in range(110) if not any(k == j and a <= p < b for j, a, b in data)}


def test_edits_are_applied_in_order_and_again_change_nothing(spark):
    random.seed(2)
    data = [(i % 3, a, a + random.randint(0, 20), i) for i, a in enumerate(random.randint(0, 300) for _ in range(90))]
    want = []
    for k in range(3):
        reach = -1
        for row in sorted((r for r in data if r[0] == k), key=lambda r: r[1:]):
            if row[1] >= reach:
                want.append(row)
                reach = row[2]
    edits = spark.createDataFrame(data, "k int, start long, stop long, id long")
    once = apply_in_order(edits, "k", "start", "stop", "id")
    assert sorted(map(tuple, once.collect())) == sorted(want)
    assert sorted(map(tuple, apply_in_order(once, "k", "start", "stop", "id").collect())) == sorted(want)


def test_insertions_conflict_where_they_touch(spark):
    cases = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 2), (3, 3, 1, 3), (1, 3, 3, 5), (1, 4, 3, 5)], "a int, b int, c int, d int")
    assert [r[0] for r in cases.select(conflicts(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, True, False, True]


def test_closure_with_cycles_and_without_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert sorted(r.node for r in reachable(roots, edges).collect()) == [1, 2, 3]
    assert [r.node for r in reachable(roots, edges.where("a > 9")).collect()] == [1]


def test_chains_that_circle_have_no_end(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 5), (8, 8)], "node int, next int")
    assert {r.node: r.end for r in chain_ends(links).collect()} == {1: 3, 2: 3, 5: None, 6: None, 7: None, 8: None}


def test_source_files_skip_ignored_folders(spark, tmp_path):
    for name in ("a.sh", "b/c.sh", "b/node_modules/d.sh", "e.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    assert sorted(r.content for r in source_files(spark, str(tmp_path), "*.sh").collect()) == ["a.sh", "b/c.sh"]


def test_lines_of_long_texts_take_linear_time(spark):
    rows = [(1, "some words of a line\n" * 200_000), (2, None), (3, ""), (4, "\n"), (5, "é\nb"), (5, "é\nb")]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("line", F.lit("clash"))
    assert lines(df.limit(0), "k").count() == 0
    began = time.monotonic()
    got = lines(df, "k").groupBy("k").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.max("start_byte").alias("at")).orderBy("k").collect()
    assert time.monotonic() - began < 20
    assert [tuple(r) for r in got] == [(1, 200_001, 200_001, 4_200_000), (3, 1, 1, 0), (4, 2, 2, 1), (5, 4, 2, 3)]
    script = spark.createDataFrame([("a", "echo 'a b' \"c\" # d\n" * 100_000)], "path string, content string")
    began = time.monotonic()
    assert logical_lines(script).count() == 100_001 and time.monotonic() - began < 30
