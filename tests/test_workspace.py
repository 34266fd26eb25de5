"""Paths, patterns, kept-up closures, nearest names and compound findings against plain versions."""

import fnmatch
import itertools
import posixpath
import random
import re

from pyspark.sql import functions as F

from corvid.operators import paths, patterns, upkeep
from corvid.plans.lookup_queries import nearest


def test_paths(spark):
    random.seed(4)
    texts = ["", "/", ".", "..", "a", "/..", "../..", *("/".join(random.choices(["a", "b", "..", ".", "", "c.sh"], k=random.randint(1, 7))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.select("t", paths.normalized(F.col("t")).alias("n")).collect()}
    want = lambda t: (posixpath.normpath(t) if t else ".").replace("//", "/")
    assert all(n == ("" if want(t) == "." else want(t)) for t, n in got.items())
    files = spark.createDataFrame([("p/a.sh",), ("p/q/b.sh",), ("./b.sh",), ("r/c.sh",)], "path string")
    edges = spark.createDataFrame([("p/a.sh", t, k) for t, k in (("q/../q/b.sh", "literal"), ("b.sh", "literal"), ("c.sh", "literal"), ("none.sh", "literal"), ("$x", "dynamic"), ("/p/a.sh", "literal"))], "path string, target string, kind string")
    assert sorted(r.target for r in paths.resolved_sources(edges, files, ("r",)).collect()) == ["$x", "./b.sh", "/p/a.sh", "none.sh", "p/q/b.sh", "r/c.sh"]


def test_patterns_as_by_all_words(spark):
    random.seed(6)
    made = {"".join(random.choices(["a", "b", "*", "?", "[ab]", "[!a]", "\\*", "*"], k=random.randint(0, 4))) for _ in range(45)}
    # Python knows no escapes: a star that stands for itself is a class to it.
    regex = {p: re.compile(fnmatch.translate(p.replace("\\*", "[*]"))) for p in made}
    words = ["".join(w) for n in range(7) for w in itertools.product("ab*c", repeat=n)]
    matched = {p: {w for w in words if r.match(w)} for p, r in regex.items()}
    pairs = [(p, q) for p in made for q in made]
    got = {tuple(r) for r in patterns.covered(spark.createDataFrame(pairs, "inner string, outer string")).collect()}
    assert got == {(p, q) for p, q in pairs if matched[p] <= matched[q]}


def test_patterns_that_are_not_decided(spark):
    pairs = [("@(a|b)", "*"), ("$x", "*"), ("[[:alpha:]]", "*"), ("$x", "$x"), (None, "*"), ("[b-d]", "[a-e]"), ("[b-d]", "[a-c]"), ("x" * 60, "x*"), ("", "*")]
    got = {tuple(r) for r in patterns.covered(spark.createDataFrame(pairs, "inner string, outer string")).collect()}
    assert got == {("$x", "$x"), ("[b-d]", "[a-e]"), ("x" * 60, "x*"), ("", "*")}


def plain_closure(edges):
    known = set(edges)
    while True:
        new = {(a, d) for a, b in known for c, d in known if b == c} - known
        if not new:
            return known
        known |= new


def test_closures_are_kept_up_over_edits(spark):
    random.seed(8)
    df = lambda rows: spark.createDataFrame(sorted(rows), "a long, b long")
    edges = {(random.randrange(14), random.randrange(14)) for _ in range(16)}
    held, now = upkeep.closure_of(df(edges)), df(edges)
    for _ in range(4):
        removed = set(random.sample(sorted(edges), 4)) | {(99, 98)}
        added = {(random.randrange(14), random.randrange(14)) for _ in range(3)}
        held, now = upkeep.kept_up(held, now, df(removed), df(added))
        edges = (edges - removed) | added
        assert {tuple(r) for r in now.collect()} == edges
        assert {tuple(r) for r in held.collect()} == plain_closure(edges)


def test_nearest_in_blocks(spark):
    random.seed(9)
    known = sorted({"".join(random.choices("abc", k=random.randint(1, 6))) for _ in range(60)})
    asked = ["abcabc", "zzz", ""]
    rows = spark.createDataFrame([(n,) for n in known], "candidate string"), spark.createDataFrame([(n,) for n in asked], "name string")
    one, many = (sorted(map(tuple, nearest(rows[1], rows[0], 3, most).collect())) for most in (10_000, 7))
    assert one == many and len(one) == 9


def test_pairs_of_a_dense_closure_are_taken_once(spark):
    edges = spark.createDataFrame([(i, (i * k + 1) % 40) for i in range(40) for k in range(1, 20)], "a long, b long")
    closure = upkeep.closure_of(edges)
    assert closure.count() == 1600
    assert upkeep._up_to(closure, edges.distinct()).count() <= 1600
    removed, added = edges.where("a % 2 = 0"), spark.createDataFrame([(0, 100), (100, 101), (101, 0)], "a long, b long")
    held, now = upkeep.kept_up(closure, edges, removed, added)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, upkeep.closure_of(now).collect()))
