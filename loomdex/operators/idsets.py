"""Sets of document ids: relations with a doc_id column, and their form as chunked bitmaps.

A missing set (None) counts as the empty set for AND and as nothing for OR and difference; its complement is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a bucket of a bitmap.
BUCKET = 32_768


def distinct_ids(a: DataFrame) -> DataFrame:
    return a.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()


def intersect(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return distinct_ids(a).where(F.lit(False)) if b is None else distinct_ids(a).join(b.select("doc_id"), "doc_id", "left_semi")


def unite(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return distinct_ids(a) if b is None else distinct_ids(a.select("doc_id").union(b.select("doc_id")))


def subtract(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return distinct_ids(a) if b is None else distinct_ids(a).join(b.select("doc_id"), "doc_id", "left_anti")


def complement(a: DataFrame, universe: DataFrame | None) -> DataFrame:
    return distinct_ids(a).where(F.lit(False)) if universe is None else subtract(universe, a)


def to_bitmaps(a: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bits): a bitmap of BUCKET ids per bucket, of any 64-bit ids. Pays off for dense sets only; see to_compressed."""
    return a.groupBy(*keys, F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, bits) of both; buckets that only one has are empty."""
    both = a.join(b.select("bucket"), "bucket", "left_semi").unionByName(b.join(a.select("bucket"), "bucket", "left_semi"))
    return both.groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """One row: the number of ids; 0 for an empty set."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("cardinality"))


def from_bitmaps(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id) of every bit that is set. Buckets above 0 hold positive ids, others 0 and the negative ones."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(n).to_numpy(zero_copy_only=False)
            rows, at = [], []
            for i, bits in enumerate(batch.column(n + 1).to_pylist()):
                where = np.flatnonzero(np.unpackbits(np.frombuffer(bits or b"", np.uint8), bitorder="little"))
                rows.append(np.full(len(where), i))
                at.append((bucket[i] - 1) * BUCKET + where + 1 if bucket[i] > 0 else bucket[i] * BUCKET - where)
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            ids = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(n)], ids], [*keys, "doc_id"])

    rows = bitmaps.select(*keys, F.col("bucket").cast("long").alias("bucket"), "bits")
    return rows.mapInArrow(run, rows.select(*keys, F.lit(0).cast("long").alias("doc_id")).schema)


#: From how many ids of a bucket its bits take less space than the ids' two-byte places.
DENSE = 2048


def to_compressed(a: DataFrame) -> DataFrame:
    """(bucket, dense, data): a bucket with few ids as their ascending two-byte places, one with many as a bitmap. Any 64-bit ids; NULL ids are left out."""
    ids = distinct_ids(a)
    places = ids.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.sort_array(F.collect_list(F.bitmap_bit_position("doc_id"))).alias("places"))  # at most BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, dense = [], []
            for at in batch.column(1).to_pylist():
                dense.append(len(at) > DENSE)
                if dense[-1]:
                    bits = np.zeros(BUCKET, np.uint8)
                    bits[at] = 1
                    data.append(np.packbits(bits, bitorder="little").tobytes())
                else:
                    data.append(np.array(at, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dense, pa.bool_()), pa.array(data, pa.binary())], ["bucket", "dense", "data"])

    return places.mapInArrow(run, "bucket long, dense boolean, data binary")


def from_compressed(sets: DataFrame) -> DataFrame:
    """(doc_id) of what to_compressed made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for dense, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not dense:
                    one = np.zeros(BUCKET, np.uint8)
                    one[np.frombuffer(data, "<u2")] = 1
                    data = np.packbits(one, bitorder="little").tobytes()
                bits.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["bucket", "bits"])

    return from_bitmaps(sets.mapInArrow(run, "bucket long, bits binary"))


def contains(a: DataFrame, doc_id: int) -> DataFrame:
    """One row (contains): whether the set holds the id."""
    return a.where(F.col("doc_id") == F.lit(doc_id)).agg((F.count("*") > 0).alias("contains"))


def is_empty(a: DataFrame) -> DataFrame:
    """One row (is_empty)."""
    return a.where(F.col("doc_id").isNotNull()).limit(1).agg((F.count("*") == 0).alias("is_empty"))


def add(a: DataFrame, *doc_ids: int) -> DataFrame:
    return unite(a, a.sparkSession.createDataFrame([(i,) for i in doc_ids], "doc_id long"))


def remove(a: DataFrame, *doc_ids: int) -> DataFrame:
    return distinct_ids(a).where(~F.col("doc_id").isin(list(doc_ids))) if doc_ids else distinct_ids(a)


def id_arrays(a: DataFrame) -> DataFrame:
    """(bucket, ids): the set as ascending arrays of at most BUCKET ids each, buckets ascending."""
    return distinct_ids(a).groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).orderBy("bucket")


def decode_ids(value: Column) -> Column:
    """Ids of a base64 text of little-endian 32-bit numbers; NULL for NULL or a text that isn't base64. A torn last number is dropped."""

    def number(raw: Column, i: Column) -> Column:
        turned = F.concat(*[F.hex(F.substring(raw, i * 4 + k, F.lit(1))) for k in (4, 3, 2, 1)])
        return F.conv(turned, 16, 10).cast("long")

    def numbers(raw: Column) -> Column:
        n = F.floor(F.octet_length(raw) / 4).cast("int")
        every = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
        return F.when(raw.isNull(), F.lit(None).cast("array<bigint>")).otherwise(F.transform(every, lambda i: number(raw, i)))

    # the text is decoded once, as the only element of an array
    return F.transform(F.array(F.try_to_binary(value, F.lit("base64"))), numbers)[0]
