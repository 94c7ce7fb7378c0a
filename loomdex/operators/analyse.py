"""From documents to terms and postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.stemmers import stem
from loomdex.functions.stopwords import stop_words
from loomdex.functions.text import titled, tokens


def kept_tokens(text: Column, language: str = "mixed") -> Column:
    """Tokens that are no stop words, in order and with repetitions."""
    return F.filter(tokens(text), lambda t: ~t.isin(sorted(stop_words(language))))


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        # each distinct token of the batch is stemmed once
        stems = [stem(t) for t in coded.dictionary.to_pylist()]
        places = {s: i for i, s in enumerate(dict.fromkeys(stems))}
        code = np.array([places[s] for s in stems], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if stems else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, first = np.unique(row * max(1, len(places)) + code, return_index=True)
        first.sort()
        row, code = row[first], code[first]
        names = pa.array(list(places), pa.string())
        keep = np.array([bool(s) for s in places], bool)[code] if len(code) else np.zeros(0, bool)
        row, code = row[keep], code[keep]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(code)))
        yield pa.RecordBatch.from_arrays([batch.column(0), terms], ["doc_id", "terms"])


def document_terms(docs: DataFrame, language: str = "mixed", stemmed: bool = True) -> DataFrame:
    """(doc_id, terms): the distinct terms of title, a space and content, in the order they are first seen.

    NULL title or content is empty; a document without terms keeps an empty array. Stop words are dropped before stemming, so a stem may
    equal one. Without stemming everything stays in the JVM; with it, each distinct token of a batch is stemmed once.
    """
    kept = docs.select(F.col("doc_id").cast("long"), kept_tokens(titled(F.col("title"), F.col("content")), language).alias("terms"))
    if not stemmed:
        return kept.select("doc_id", F.array_distinct("terms").alias("terms"))
    return stemmed_terms(kept)


def stemmed_terms(terms: DataFrame) -> DataFrame:
    """(doc_id, terms) with the distinct stems of each row's terms instead, in the order they are first seen."""
    return terms.select("doc_id", "terms").mapInArrow(_stemmed, "doc_id long, terms array<string>")


def postings(terms: DataFrame) -> DataFrame:
    """(term, doc_id), distinct as each document's terms are."""
    return terms.select(F.explode("terms").alias("term"), "doc_id")


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("doc_count"))
