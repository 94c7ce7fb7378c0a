"""Last-seen counters: occurrences and records of each term from a token stream that is ordered by record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stream(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms; the term's code and the record's number of each token; tokens of each record. NULL tokens are left out."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat, record = tokens.flatten(), np.repeat(np.arange(len(lengths)), lengths)
    if flat.null_count:
        there = pc.is_valid(flat)
        record = record[there.to_numpy(zero_copy_only=False)]
        flat = flat.filter(there)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), record, np.bincount(record, minlength=len(lengths))


def last_seen(codes: np.ndarray, record: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and records of each term. A term keeps the record it was last seen in; only another record adds to its records, so no
    set of records is held. `record` never falls."""
    order = np.argsort(codes, kind="stable")
    code, now = codes[order], record[order]
    another = np.ones(len(code), bool)
    another[1:] = (code[1:] != code[:-1]) | (now[1:] != now[:-1])
    return np.bincount(code, minlength=terms), np.bincount(code[another], minlength=terms)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, codes, record, _ = _stream(batch.column(0))
        occurrences, records = last_seen(codes, record, len(terms))
        yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(occurrences), pa.array(records)], ["term", "occurrences", "records"])


def term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(term, occurrences, records) over all rows of `df`, each row being a record with its array of `tokens`.

    A record never spans two batches, so the counters of a batch are whole; they are summed by term, first within the task, so that a term
    found everywhere travels once per task. NULL arrays and NULL tokens count nothing; an empty term is a term; equal rows are different records.
    """
    part = df.select(tokens.alias("tokens")).mapInArrow(_count, "term string, occurrences long, records long")
    return part.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, codes, record, length = _stream(batch.column(1))
        pair, tf = np.unique(codes.astype(np.int64) * max(1, len(length)) + record, return_counts=True)
        code, row = np.divmod(pair, max(1, len(length)))
        records = np.bincount(code, minlength=len(terms))
        ends = pa.array(np.append(0, np.cumsum(records)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (batch.column(0).take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(terms))), pa.array(records), *lists], ["term", "occurrences", "records", "id", "tf", "length"])


def record_terms(df: DataFrame, record_id: str, tokens: Column) -> DataFrame:
    """(term, occurrences, records, id, tf, length) for each term of each Arrow batch of records; the last three are arrays with one value for
    each record that holds the term, `length` being the record's number of tokens. So a term is written once a batch, not once a record, and no
    array is longer than a batch. Needs no shuffle.
    """
    return df.select(F.col(record_id).cast("long").alias("id"), tokens.alias("tokens")).mapInArrow(_by_term, "term string, occurrences long, records long, id array<long>, tf array<int>, length array<int>")
