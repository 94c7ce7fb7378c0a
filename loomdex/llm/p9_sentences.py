"""Problem 9: sentences of every text, in any of the languages and layouts (sentences.py has the rules).

Two passes. The first gathers, over all documents, how full stops after words go on, and which words that stand after full stops are elsewhere
mostly in small letters or follow numbers; what is decided from these counts is the corpus fallback. The second splits each document by its
own evidence, then that fallback.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.sentences import Splitter, abbreviations, after_numbers, asked_words, full_stops, word_forms
from loomdex.operators.skew import skew_join
from loomdex.session import cut, spread, table

#: Decided words that are broadcast at most; more are joined to the texts that ask for them.
MOST_SHARED = 500_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of full stops by the word before them (form false), and of the forms of words (form true)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        seen: Counter[tuple[str, str]] = Counter()
        for text in texts:
            seen.update(full_stops(text))
        stops = sorted({w for w, _ in seen})
        forms = word_forms(texts)
        columns = [[seen[w, k] for w in stops] + [f[i] for f in forms.values()] for i, k in enumerate("lupd")]
        form = [False] * len(stops) + [True] * len(forms)
        yield pa.RecordBatch.from_pydict({"form": pa.array(form, pa.bool_()), "word": pa.array([*stops, *forms], pa.string()), **{k: pa.array(c, pa.int64()) for k, c in zip("lupd", columns, strict=True)}})


def _decide(at_end: float, usual: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            # that a full stop ends a sentence need only be known of words that don't look like it
            out = [x for x in abbreviations(((w, a, b, c) for form, w, a, b, c, _ in rows if not form), at_end).items() if x[1] == "n" or len(x[0]) < 3 or not x[0].isalpha()]
            out += [(w, "c") for form, w, a, b, c, _ in rows if form and c and a > b]
            out += [(w, "o") for w in after_numbers(((w, c, d) for form, w, _, _, c, d in rows if form), usual)]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in out], pa.string()), "kind": pa.array([k for _, k in out], pa.string())})

    return run


def corpus_evidence(texts: DataFrame) -> DataFrame:
    """(word, kind) from a one-column DataFrame: 'n' abbreviations, 'f' short words that end sentences, 'c' words that it has mostly in small
    letters but also after full stops, 'o' words before which a number's full stop ends nothing. All counts are decided on. Empty for an empty table.
    """
    sums = [F.sum(k).alias(k) for k in "lupd"]
    found = cut(texts.mapInArrow(_counts, "form boolean, word string, l long, u long, p long, d long").groupBy("form", "word").agg(*sums))
    total = {r["form"]: r for r in found.groupBy("form").agg(*sums).collect()}
    stops, forms = total.get(False), total.get(True)
    at_end = stops["p"] / max(1, stops["u"] + stops["p"]) if stops else 0.0
    usual = forms["d"] / max(1, forms["p"]) if forms else 0.0
    return cut(found.mapInArrow(_decide(at_end, usual), "word string, kind string"))


def made_splitter(evidence) -> Splitter:
    """From (word, kind) pairs."""
    by: dict[str, set[str]] = {"c": set(), "o": set()}
    kinds = {}
    for word, kind in evidence:
        if kind in by:
            by[kind].add(word)
        else:
            kinds[word] = kind
    return Splitter(kinds, by["c"], by["o"])


_FOUND = "doc_id long, start_at int, end_at int"


def _rows(found: Iterator[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    ids, start, end = [], [], []
    for i, pieces in found:
        ids += [i] * len(pieces)
        start += [a for a, _ in pieces]
        end += [b for _, b in pieces]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start_at": pa.array(start, pa.int32()), "end_at": pa.array(end, pa.int32())})


def _split(evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made_splitter(evidence.value)
        for batch in batches:
            yield _rows((i, own.split(text)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    return run


def _split_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _split, each text with the evidence that it asks for."""
    for batch in batches:
        yield _rows((i, made_splitter((t["word"], t["kind"]) for t in told or ()).split(text)) for i, text, told in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, w) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in asked_words(text)]
        yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in rows], pa.binary()), "word": pa.array([w for _, w in rows], pa.string())})


def with_evidence(docs: DataFrame, evidence: DataFrame, by: str) -> DataFrame:
    """`docs` with `told`, what the evidence tells of the words that each row's `text` asks for: joined by word to the distinct texts, then by digest
    to the rows, both with hot keys salted by column `by`. NULL texts count as empty."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    asked = cut(keyed.select("digest", "text").mapInArrow(_asked, "digest binary, word string").distinct())
    weight = asked.groupBy("word").agg(F.count("*").alias("n"))
    known = evidence.groupBy("word").agg(F.collect_list("kind").alias("kinds")).join(weight, "word")  # at most three kinds a word
    told = skew_join(asked, cut(known), ["word"], "n", asked.count(), F.col("digest")).select("digest", F.explode("kinds").alias("kind"), "word")
    each = told.groupBy("digest").agg(F.collect_list(F.struct("word", "kind")).alias("told"))  # no more than the words of one text
    texts = keyed.groupBy("digest").agg(F.count("*").alias("n")).join(each, "digest", "left")
    return skew_join(keyed, cut(texts), ["digest"], "n", keyed.count(), F.coalesce(by, F.lit(0))).select(*docs.columns, "told")


def sentences(docs: DataFrame, text: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """(doc_id, start_at, end_at) of each sentence, offsets in code points.

    NULL and blank texts have none; the sentences of a text hold all its non-blank characters; a text is always split whole, whatever its
    length. Needs no shuffle beyond the small counts of the first pass while the decided words are at most `most_shared`, which are broadcast then;
    more are joined to the texts, with the same result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")))
    evidence = corpus_evidence(docs.select("text"))
    if evidence.count() > most_shared:
        return with_evidence(docs, evidence, "doc_id").mapInArrow(_split_each, _FOUND)
    shared = docs.sparkSession.sparkContext.broadcast([(r["word"], r["kind"]) for r in evidence.collect()])
    return docs.mapInArrow(_split(shared), _FOUND)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
