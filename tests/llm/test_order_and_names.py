"""Results that don't hang on the order of rows, on repeats, or on names of other columns."""

import random

from pyspark.sql import functions as F

from corvid.llm import decontaminate, mixing, secrets, skew, urls, warc


def test_no_payload_is_lost_in_any_order(spark):
    random.seed(2)
    rows = [(i, f"http://h/{i}", f"payload {random.randrange(7)}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {r.page_id: r for r in warc.round_trip(pages.orderBy(F.rand())).collect()}
    tops = {h: max(i for i, _, x in rows if x == h) for _, _, h in rows}
    assert {i: got[i].refers_to for i, _, _ in rows} == {i: None if tops[h] == i else tops[h] for i, _, h in rows}
    assert {r.html for r in got.values() if r.html is not None} == set(tops)


def test_equal_pages_have_one_response(spark):
    rows = [(7, "u", "same")] * 5 + [(7, "t", "same"), (7, None, "same"), (3, "u", "same"), (None, None, None), (None, None, ""), (1, "a", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3, F.rand())
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    assert sorted(r.html for r in got if r.record_type == "response") == ["", "alone", "same"]
    assert sorted((r.page_id or 0, r.refers_to or 0) for r in got if r.record_type == "revisit") == [(0, 0), (3, 7)] + [(7, 7)] * 6
    short = warc.round_trip(pages, least_bytes=5).collect()
    assert sum(r.record_type == "response" for r in short) == len(rows)


def test_rows_go_by_what_they_hold(spark):
    many = spark.createDataFrame([(i % 3, i, {"a": i}) for i in range(50)], "k bigint, i bigint, m map<string,bigint>")
    few = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, v string")
    for most in (1, 1_000_000):
        got = skew.spread_join(many.repartition(4, F.rand()), few, "k", "left", ways=3, most=most).collect()
        assert sorted((r.i, r.v) for r in got) == [(i, {0: "x", 1: "y"}.get(i % 3)) for i in range(50)]


def test_shards_don_t_mind_names(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(3)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(words[5:35] + ["x"]), "s", "i", "d"), (2, None, "s", "i", "d")], "doc_id bigint, text string, _spans string, _items string, _digest string")
    one = [r.asDict(True) for r in decontaminate.find_contamination(docs, items).orderBy("doc_id").collect()]
    several = [r.asDict(True) for r in decontaminate.find_contamination(docs, items, shard_words=20).orderBy("doc_id").collect()]
    assert one == several and one[0]["n_hit"] == 30 and one[0]["_spans"] == "s"
    left = decontaminate.remove_contamination(docs, items, most_coverage=0.99, shard_words=20).orderBy("doc_id").collect()
    assert [r.text for r in left] == ["x", None] and left[0]._items == "i"


def test_masking_doesn_t_mind_names(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh12", "f", "b", "d")], "doc_id bigint, text string, findings string, blob string, doc string")
    [r] = secrets.mask_secrets(docs, secrets.fresh_path(spark, "ledger")).collect()
    assert "abcdefgh12" not in r.text and (r.findings, r.blob, r.doc) == ("f", "b", "d")


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], i, i * 10, "x") for i in range(20)], "doc_id bigint, source string, _rank bigint, _part bigint, block string")
    got = mixing.mix_sources(docs)
    assert got.columns == ["doc_id", "source", "_rank", "_part", "block", "slot", "position"]
    assert all(r._rank == r.doc_id and r._part == 10 * r.doc_id for r in got.collect())
    hosts = ["a.net", "example.net", "b.example.com", "z.org"]
    pages = spark.createDataFrame([(i, f"http://{hosts[i % 4]}/{'en' if i % 3 else 'de'}/{i}", f"t{i}", i) for i in range(60)], "page_id bigint, url string, _text string, _kind bigint")
    got = urls.judge_urls(pages)
    assert got.columns[:4] == ["page_id", "url", "_text", "_kind"]
    assert all(r._text == f"t{r.page_id}" and r._kind == r.page_id for r in got.collect())
