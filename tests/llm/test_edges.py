"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns, nothing."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traceloom.llm import (
    cotrain,
    fmindex,
    hilbert,
    jaccard,
    lm,
    mixing,
    neighbours,
    ordinal,
    surrogates,
    warc,
)

BENCH = [("b1", "three four five six seven eight nine ten eleven twelve"), (None, "zzz"), ("b2", None), ("b3", "")]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (1, 1, 0)]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def per_row(documents, benchmark, labels):
    return {
        "quality": cotrain.score(documents, labels, rounds=1),
        "sharding": hilbert.shard_documents(documents),
        "sharded documents": hilbert.with_document_shard(documents),
        "mixing plan": mixing.mix_plan(documents),
        "jaccard": jaccard.components(documents),
        "surrogates": surrogates.replace(documents, b"k"),
        "toxicity": ordinal.score(documents, ordinal.train(documents, labels)),
        "language model": lm.score(documents),
        "decontamination": fmindex.find(documents, benchmark),
        "cleaned": fmindex.cleaned(documents, benchmark),
    }


def test_one_row_per_document_row(documents, benchmark, labels):
    want = sorted(str(r.doc_id) for r in documents.select("doc_id").collect())
    for name, result in per_row(documents, benchmark, labels).items():
        assert sorted(str(r.doc_id) for r in result.select("doc_id").collect()) == want, name


def test_empty_tables(no_documents, benchmark, labels):
    for some in (labels, labels.limit(0)):
        for name, result in per_row(no_documents, benchmark.limit(0), some).items():
            assert result.collect() == [], name


def test_no_labels_and_no_benchmark(documents, benchmark, labels):
    assert {r.good for r in cotrain.score(documents, labels.limit(0)).collect()} == {True}
    toxic = ordinal.score(documents, ordinal.train(documents, labels.limit(0)))
    assert {r.toxic for r in toxic.collect()} == {False}
    assert {len(r.spans) for r in fmindex.find(documents, benchmark.limit(0)).collect()} == {0}


def test_stages_keep_the_columns_of_documents(spark, documents, benchmark, labels, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents, documents.limit(0)):
        for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, str(tmp_path))
            after.collect()
            if place < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns, name


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (40, None), (60, []), (None, [1.0, 1.0]), (7, [2.0, 0.0]),
            (80, [None, 1.0]), (2, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.search(table).collect())
    assert [r[:3] for r in got] == [
        (0, 1, 7), (0, 2, 1), (0, 3, 20), (0, 4, 2), (0, 5, 2),
        (20, 1, 7), (20, 2, 0), (20, 3, 1), (20, 4, 2), (20, 5, 2)]
    assert got[0][3] == 2.0 and got[3][3] == 0.5
    assert neighbours.search(table.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "http://a/b", "<p>x</p>"), (1, "http://a/b", "<p>x</p>"), (None, None, None), (2, "", "a < b & c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 8 and got[:2] == got[2:4]
    assert [r.body for r in got if r.warc_type == "conversion"] == ["x", "x", "", "a < b & c"]
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


def test_repeated_query_rows_and_every_length(spark):
    rows = [(0, [1.0, 0.1 * i]) for i in range(4)] + [(i, [1.0, 0.01 * i]) for i in range(1, 60) if i % 20]
    rows += [(i, [1.0, 2.0, float(i % 7)]) for i in range(100, 106)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    per_query = [r for r in got if r.query_id == 0]
    assert len(per_query) == 4 * 20 and {r["rank"] for r in per_query} == set(range(1, 21))
    tops = sorted((round(r.score, 6), r.vec_id) for r in per_query if r["rank"] == 1)
    assert tops == [(1.0, 0), (1.059, 59), (1.118, 59), (1.177, 59)]
    other = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 100)
    assert other == [(1, 104), (2, 103), (3, 102), (4, 101), (5, 105)]


def test_used_up_forms_end(spark):
    texts = [(i, f"write to {i % 10}@{i // 10}.de now") for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__again", F.lit("own"))
    got = surrogates.replace(docs, b"k").collect()
    new = {r.text for r in got}
    assert len(new) == 100 and not new & {t for _, t in texts} and {r["__again"] for r in got} == {"own"}


def test_joined_tries_and_marks_beside_own_columns(spark, documents, benchmark, monkeypatch):
    sent = surrogates.replace(documents, b"k").select("doc_id", "text", "__again")
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", -1)
    joined = surrogates.replace(documents, b"k").select("doc_id", "text", "__again")
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect()))
    whole, sliced = fmindex.cleaned(documents, benchmark), fmindex.cleaned(documents, benchmark, limit=4)
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect()))
    assert {r["__marks"] for r in sliced.collect()} == {"own __marks"}


@pytest.mark.parametrize("unit", ["<script ", '<a href="', "<title ", "<title>", "<html ", '<p "', "<!--", "<a "])
def test_unclosed_markup_is_read_in_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.monotonic()
    warc.derived("1", "http://a/", warc.DATE, "", page)
    assert time.monotonic() - began < 10
