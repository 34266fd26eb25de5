"""Stages of the pipeline on their own input, against brute force and on awkward rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import decontaminate, mixing, quality
from tests.llm.test_operators import DOCS, awkward, brute_components, brute_spans, docs_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows(spark):
    df = awkward(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"), "slot", "score")
    return df.unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(40).cast("bigint")))


def test_stages_return_documents_and_take_awkward_and_empty_tables(spark):
    docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns == list(corpus_pipeline.COLUMNS) and dict(out.dtypes) == dict(table.select(*corpus_pipeline.COLUMNS).dtypes), name
            assert out.count() <= table.count()
    assert corpus_pipeline.mix(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.mix(spark, docs, SF).count() == docs.count()


def test_quality_stage_keeps_what_the_operator_scores_high(spark, documents):
    field = quality.train_on(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in documents.collect() if field.score(r.text) >= 0.7}
    assert {r.doc_id for r in corpus_pipeline.keep_good(spark, documents, SF).collect()} == want
    assert 0 < len(want) < documents.count()


def test_one_of_each_near_copy_group_stays(spark, documents):
    rows = documents.orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    want = sorted({ids[c] for _, _, c in brute_components([r.text for r in rows])})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents, SF).collect()) == want
    left = corpus_pipeline.drop_near_copies(spark, odd_rows(spark), SF).collect()
    assert Counter(r.doc_id for r in left) == Counter([1, 2, 3, 4, 5, 6, None])


def test_an_id_with_two_texts_loses_no_group(spark):
    one, two, three = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    rows = [(3, one), (5, one), (5, two), (5, two), (7, three), (None, three), (None, "alone in the world it is"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert left == Counter([(3, one), (5, two), (7, three), (None, "alone in the world it is"), (8, None), (8, "")])


def test_benchmark_passages_go(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = {r.doc_id: r for r in decontaminate.find_contamination(documents, items).collect()}
    assert any(r.n_hit for r in before.values())
    after = corpus_pipeline.remove_benchmark(spark, documents, SF)
    assert {r.doc_id for r in after.collect()} == {i for i, r in before.items() if r.n_hit * 2 <= r.n_words}
    for r in after.collect():
        if not before[r.doc_id].n_hit:
            assert r.text == before[r.doc_id].text
        else:
            assert len(r.text) < len(before[r.doc_id].text) and r.n_chars == len(r.text)


def test_secrets_are_masked_and_nothing_else_changes(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, documents, SF).collect()}
    masked = 0
    for r in documents.collect():
        spans = brute_spans(r.text)
        masked += bool(spans)
        assert (out[r.doc_id] != r.text) == bool(spans)
        if spans:
            assert out[r.doc_id].startswith(r.text[: spans[0][1]] + "[secret]")
    assert masked and len(out) == documents.count()


def test_run(spark, documents):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert len({r.doc_id for r in rows}) == len(rows) < documents.count()
    counts = Counter(r.source for r in rows)
    shares = mixing.target_shares(counts)
    order = [s for _, s in sorted({(r.slot, r.source) for r in rows})]
    first_out = min(max(t for t, s in enumerate(order) if s == x) for x in shares)
    for t in range(first_out + 1):
        for s, k in shares.items():
            assert abs(order[:t].count(s) - k * t / sum(shares.values())) < 1


def test_equal_text_of_two_ids_is_one_document(spark):
    docs = docs_of(spark, ["a b c d e f g"] * 3 + ["h i j k l m"])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 3]
    assert [f.split()[0] for f in DOCS.split(", ")] == list(corpus_pipeline.COLUMNS)
