import pytest
from pyspark.sql import functions as F

from loomdex.functions.kgram import like_pattern, pattern_kgrams, term_kgrams
from loomdex.functions.stemmers import stem
from loomdex.functions.stopwords import is_stop_word, stop_words
from loomdex.functions.text import tokens
from loomdex.operators.analyse import document_terms


def _tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello World", ["hello", "world"]),
        ("Hello, World!", ["hello", "world"]),
        ("one-two-three", ["one", "two", "three"]),
        ("   spaces   ", ["spaces"]),
        ("UPPERCASE", ["uppercase"]),
        ("mix123numbers", ["mix123numbers"]),
        ("İstanbul ΟΔΟΣ", ["istanbul", "οδοσ"]),
        ("", []),
        (None, []),
        ("…!", []),
    ],
)
def test_tokens(spark, text, want):
    assert _tokens(spark, text) == want


def test_stop_words():
    assert len(stop_words("english")) == 90 and len(stop_words("russian")) == 73
    assert not stop_words("english") & stop_words("russian")
    assert stop_words("anything") == stop_words("english") | stop_words("russian")
    assert is_stop_word("The") and not is_stop_word("кот", "russian") and is_stop_word("и", "russian")


@pytest.mark.parametrize(
    "word,want",
    [("running", "run"), ("cats", "cat"), ("better", "better"), ("consigned", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"), ("knackeries", "knackeri"), ("knightly", "knight"), ("skies", "sky"), ("hoping", "hope"), ("hopping", "hop"), ("cat's", "cat"), ("generously", "generous"), ("important", "import"), ("важная", "важн"), ("вагнера", "вагнер"), ("падает", "пада"), ("война", "войн"), ("войне", "войн"), ("123", "123"), ("", "")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_document_terms(spark):
    docs = spark.createDataFrame([(1, None, "The cats are running in the garden, cats"), (2, None, None), (3, "the", "the"), (4, "Война", "и мир")], "doc_id long, title string, content string")
    got = {r["doc_id"]: r["terms"] for r in document_terms(docs).collect()}
    assert got == {1: ["cat", "run", "garden"], 2: [], 3: [], 4: ["войн", "мир"]}
    plain = {r["doc_id"]: r["terms"] for r in document_terms(docs, "english", stemmed=False).collect()}
    assert plain == {1: ["cats", "running", "garden"], 2: [], 3: [], 4: ["война", "и", "мир"]}


def test_kgrams(spark):
    rows = spark.createDataFrame([("cat",), ("a",), ("",), (None,)], "t string").select(term_kgrams(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["$ca", "cat", "at$"], ["$a$"], [], []]
    assert pattern_kgrams("c*pet") == ["pet", "et$"]
    assert pattern_kgrams("car*") == ["$ca", "car"]
    assert pattern_kgrams("*") == [] and pattern_kgrams("") == []
    assert like_pattern("a_b%*\\") == "a\\_b\\%%\\\\"
