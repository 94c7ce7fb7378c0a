"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

import pytest

from loomdex.llm import p1_language, p2_seen, p3_copies, p4_lookalike, p5_frequency, p6_distinctive, p7_containers, p8_mixture, p9_sentences

LONG = "The grey goose counts the lantern. " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None), (2, "", "", "xx"), (3, None, LONG, "en"), (4, "Same", "text here", "en"), (5, "Same", "text here", "en"), (6, "42", "7", None), (None, "T", "Who?", None), (7, " \n", "—…!", "ru"), (8, "​", " ", "en")]
    extra = [(*r, r[0], "x", "y", 1.0) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, title string, content string, lang_label string, id long, term string, root string, tokens double")


@pytest.fixture(scope="module")
def texts(docs):
    return docs.withColumnRenamed("content", "text").selectExpr("*", "case when doc_id % 2 = 0 then 's' when doc_id = 1 then null else 'S' end as source", "'z' as bin", "1 as part")


def test_language(spark, docs):
    samples = spark.createDataFrame([("en", "the grey goose counts the lantern"), ("ru", "серый гусь считает фонарь"), (None, "x"), ("en", "")], "lang string, sample_text string")
    codes = spark.createDataFrame([("en", "en"), ("xx", None), (None, "ru")], "label_form string, lang string")
    rows = p1_language.segments(docs, samples, codes).collect()
    assert {r["lang"] for r in rows if r["doc_id"] == 3} == {"en"} and sum(r["doc_id"] == 3 for r in rows) == 20_000
    assert not [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["lang"] is None or r["confidence"] == 0 for r in rows if r["doc_id"] == 6)
    assert p1_language.segments(docs.where("false"), samples, codes).count() == 0
    with pytest.raises(ValueError):
        p1_language.segments(docs, samples.where("false"), codes)


def test_seen(spark):
    seg = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "b", 0), (4, "a", 0), (5, "", 0), (6, "", 0), (7, "A", 0), (8, "a ", 0)], "row_id long, kv_key string, value int")
    idx = spark.createDataFrame([("b", 1), ("b", 1), (None, 1)], "kv_key string, row int")
    got = lambda s, i: sorted(r[0] for r in p2_seen.seen_before(s, i).collect())
    assert got(seg, idx) == [3, 4, 6]
    assert got(seg, idx.where("false")) == [4, 6] and got(seg.where("false"), idx) == []


def test_copies(docs):
    records = p3_copies.document_records(docs.where("doc_id is not null"))
    assert sorted(tuple(r) for r in p3_copies.copies(records).collect()) == [(4, 4), (5, 4)]
    assert {r["doc_id"]: r["copies"] for r in p3_copies.collapsed(records).collect()} == {3: 1, 4: 2, 6: 1}
    assert p3_copies.copies(records.where("false")).count() == 0


def test_lookalikes(docs):
    assert p4_lookalike.lookalike_pairs(docs).count() == 0
    assert p4_lookalike.forms(docs).count() == docs.count() and p4_lookalike.forms(docs.where("false")).count() == 0


def test_frequency(spark, docs):
    seg = spark.createDataFrame([(None,), ("k",), ("k",)], "kv_key string")
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in p5_frequency.frequencies(docs, seg).collect()}
    assert got[("doc", "the")] == (40_000, 1) and got[("doc", "same")] == (2, 2) and got[("kv", "k")] == (2, 2) and ("kv", None) not in got
    assert p5_frequency.frequencies(docs.where("false"), seg.where("false")).count() == 0


def test_distinctive(docs):
    rows = p6_distinctive.distinctive_terms(docs).collect()
    assert {(r["term"], r["tf"], r["df"]) for r in rows if r["doc_id"] == 3} >= {("the", 40_000, 1), ("goose", 20_000, 1)}
    assert {r["term"] for r in rows if r["doc_id"] is None} == {"t", "who"}
    assert p6_distinctive.distinctive_terms(docs.where("false")).count() == 0


def test_containers(texts):
    rows = p7_containers.containers_for(texts, {"small": 512, "none": None}).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8}
    long = [r for r in rows if r["doc_id"] == 3]
    assert sorted(r["part"] for r in long) == list(range(len(long))) and sum(r["tokens"] == 512 for r in long) >= len(long) - 1
    assert p7_containers.containers_for(texts.where("false"), {"small": 512}).count() == 0
    assert p7_containers.containers_for(texts, {}).count() == 0


def test_mixture(spark, texts):
    targets = spark.createDataFrame([("s", 0.5, 3), ("S", 0.5, 2), ("missing", 0.4, 1), (None, 0.1, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = p8_mixture.mixture(texts, targets).collect()
    assert rows and all(r["repeats"] <= 3 for r in rows) and {r["source"] for r in rows} <= {"s", "S"}
    assert p8_mixture.mixture(texts.where("false"), targets).count() == 0 and p8_mixture.mixture(texts, targets.where("false")).count() == 0


def test_sentences(texts):
    rows = p9_sentences.sentences(texts).collect()
    assert sum(r["doc_id"] == 3 for r in rows) == 20_000 and not [r for r in rows if r["doc_id"] in (1, 2)]
    assert p9_sentences.sentences(texts.where("false")).count() == 0
