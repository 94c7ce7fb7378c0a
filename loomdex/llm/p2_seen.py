"""Problem 2: has this key been seen before?

Every key is hashed to 64 bits and reduced to the top `bits` of them, where 2**bits is at least `fp_inverse` times the number of rows. The top
bits are also the shard. Each shard is worked through in order of arrival: a batch of rows is probed against a Golomb-coded set of all that came
before (index entries first, then earlier rows), then its new values are added. A task holds one shard's compressed set and a batch of rows,
never the keys. What the sets take for new or seen is the answer.

A hot key can't overload a shard: rows are first reduced, with map-side combining, to the first row of each (reduced hash, check hash, block of
arrival), so a key counts at most once per `1 << chunk_bits` arrivals.

The sets have no false negatives, and they can only be wrong where two different keys met at one reduced value. So the exact check that follows
looks at those values alone, about one in `fp_inverse`: keys are told apart there by a second, independent 64-bit hash (two of n keys
agree in both with a probability of n**2 / 2**(bits + 65), below 1e-12 for 10 billion keys). What it finds is taken out of the result and counted
for the audited rate. Whole keys are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.golomb import GrowingGolombSet
from loomdex.session import cut, table

#: One in so many new keys may be taken for seen, at most.
FP_INVERSE = 1024
#: Rows of one block of arrival: 2**CHUNK_BITS.
CHUNK_BITS = 16
#: Values that a shard is planned for, and the least number of shards as a power of two.
SHARD_VALUES, LEAST_SHARD_BITS = 1 << 17, 6


def _plan(total: int, fp_inverse: int) -> tuple[int, int]:
    """Bits of a reduced hash, and of a shard's number."""
    bits = min(62, max(16, math.ceil(math.log2(max(2, total) * fp_inverse))))
    return bits, min(bits - 1, max(LEAST_SHARD_BITS, math.ceil(math.log2(max(1, total / SHARD_VALUES)))))


_TOLD = "row_id long, shard long, values_held long, bytes_held long, probes long, positives long, expected_fp double"


def _probe(bits: int, shard_bits: int):
    """The pass over partitions that are sorted by shard and block of arrival: a row per new value, and a row of figures per shard."""
    span = float(1 << (bits - shard_bits))
    figures = [pa.int64()] * 5 + [pa.float64()]
    names = [x.split()[0] for x in _TOLD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, probes, positives, expected = -1, GrowingGolombSet(), 0, 0, 0.0

        def told() -> pa.RecordBatch:
            values = [shard, len(seen), seen.bytes_used(), probes, positives, expected]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.array([x], k) for x, k in zip(values, figures, strict=True)]], names)

        for batch in batches:
            value, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            asked_all, row = row.is_valid().to_numpy(zero_copy_only=False), row.fill_null(-1).to_numpy(zero_copy_only=False)
            shards = value >> (bits - shard_bits)
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(value)], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    if shard >= 0:
                        yield told()
                    shard, seen, probes, positives, expected = int(shards[a]), GrowingGolombSet(), 0, 0, 0.0
                by = np.lexsort((row[a:b], value[a:b]))  # known keys (-1) come before the rows
                v, r, asked = value[a:b][by], row[a:b][by], asked_all[a:b][by]
                fresh = np.ones(len(v), bool)
                fresh[1:] = v[1:] != v[:-1]
                first = np.flatnonzero(fresh)
                fresh[first] = ~seen.contains(v[first])
                probes += int(asked.sum())
                positives += int((asked & ~fresh).sum())
                at = np.argsort(r[fresh], kind="stable")  # the values that each new one was held against: all before it
                expected += float((len(seen) + np.flatnonzero(asked[fresh][at])).sum()) / span
                seen.add(v[fresh])
                new = pa.array(r[fresh & asked])
                yield pa.RecordBatch.from_arrays([new, *[pa.nulls(len(new), k) for k in figures]], names)
        if shard >= 0:
            yield told()

    return run


def _arrivals(rows: DataFrame, known: DataFrame, key: str, order: str, bits: int, shard_bits: int, chunk_bits: int) -> DataFrame:
    """(value, check, row), the first row of each key in each block of arrival, every shard in one partition; known keys have no row and come first."""
    value, check = F.shiftrightunsigned(F.xxhash64(key), 64 - bits).alias("value"), F.xxhash64(F.lit("check"), key).alias("check")
    a = known.where(F.col(key).isNotNull()).select(value, F.lit(-1).cast("long").alias("chunk"), check, F.lit(None).cast("long").alias("row"))
    b = rows.where(F.col(key).isNotNull()).select(value, F.shiftright(F.col(order), chunk_bits).alias("chunk"), check, F.col(order).cast("long").alias("row"))
    first = a.unionByName(b).groupBy("value", "chunk", "check").agg(F.min("row").alias("row")).select("value", "check", "row")
    shard = F.shiftrightunsigned("value", bits - shard_bits)
    return first.repartition(shard).sortWithinPartitions(shard, F.col("row").asc_nulls_first())


def _sets(rows: DataFrame, known: DataFrame, key: str, order: str, fp_inverse: int, chunk_bits: int = CHUNK_BITS) -> tuple[DataFrame, DataFrame]:
    """What the sets tell, rows of `_TOLD` kept in the shared folder; and the arrivals."""
    rows, known = rows.select(key, order), known.select(key)
    bits, shard_bits = _plan(rows.count() + known.count(), fp_inverse)
    arrivals = cut(_arrivals(rows, known, key, order, bits, shard_bits, chunk_bits))
    return cut(arrivals.mapInArrow(_probe(bits, shard_bits), _TOLD)), arrivals


def surely_new(told: DataFrame) -> DataFrame:
    """Rows (row_id) whose key the sets have not seen."""
    return told.where(F.col("row_id").isNotNull()).select("row_id")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First rows of the unknown keys that met another key, from partitions sorted by value, check hash and row, known keys first."""
    kept = [np.zeros(0, np.int64)] * 3  # the keys of the last value, which may go on

    def told(value: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        same = np.zeros(len(value), bool)
        same[1:] = value[1:] == value[:-1]
        same[:-1] |= same[1:]
        return pa.RecordBatch.from_arrays([pa.array(row[same & (row >= 0)])], ["row_id"])

    for batch in batches:
        columns = [np.concatenate([k, batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
        value, check, _ = columns
        if not len(value):
            continue
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (check[1:] != check[:-1])
        value, check, row = (c[new] for c in columns)  # a key's first row
        open_ = int(np.searchsorted(value, value[-1]))
        kept = [value[open_:], check[open_:], row[open_:]]
        yield told(value[:open_], row[:open_])
    yield told(kept[0], kept[2])


def collided(arrivals: DataFrame) -> DataFrame:
    """(row_id) of the first row of every key that isn't known and whose reduced value it shares with another key.

    Such a row is truly new, whatever the sets took it for. Sorts within the shards, without a shuffle; a task holds the keys of one value.
    """
    return arrivals.sortWithinPartitions("value", "check", F.col("row").asc_nulls_first()).mapInArrow(_met, "row_id long")


def seen_before(rows: DataFrame, known: DataFrame, key: str = "kv_key", order: str = "row_id", fp_inverse: int = FP_INVERSE) -> DataFrame:
    """Rows (row_id) whose key stands in `known` or in a row with a smaller `order`: those that the sets took for seen, less their false positives.

    `order` holds distinct non-negative numbers. NULL keys are never seen; an empty key is a key like any other; a row delivered again under a new
    `order` is seen. Empty inputs give an empty result. Other columns of either table, whatever their names, aren't read.
    """
    told, arrivals = _sets(rows, known, key, order, fp_inverse)
    asked = rows.where(F.col(key).isNotNull()).select(F.col(order).alias("row_id"))
    return asked.join(surely_new(told).unionByName(collided(arrivals)), "row_id", "left_anti")


def report(rows: DataFrame, known: DataFrame, key: str = "kv_key", order: str = "row_id", fp_inverse: int = FP_INVERSE) -> DataFrame:
    """One row: how often the sets' answer is wrong, in theory and audited, and what they take per key."""
    told, arrivals = _sets(rows, known, key, order, fp_inverse)
    wrong = collided(arrivals).join(surely_new(told), "row_id", "left_anti").agg(F.count("*").alias("false_positives"))
    held = told.agg(F.count("row_id").alias("surely_new"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("values_held", "bytes_held", "expected_fp")])
    asked = rows.agg(F.count("*").alias("rows_in"), F.count(key).alias("rows_asked"))
    one = lambda d: d.withColumn("one", F.lit(1))
    joined = one(asked).join(one(wrong), "one").join(one(held), "one").drop("one")
    truly = F.greatest(F.col("surely_new") + F.col("false_positives"), F.lit(1))
    return joined.select(
        "rows_in", "rows_asked", "surely_new", "false_positives", "values_held", "bytes_held",
        (F.col("bytes_held") * 8 / F.greatest("values_held", F.lit(1))).alias("bits_per_value"),
        F.lit(1 / fp_inverse).alias("theoretical_bound"), (F.col("expected_fp") / truly).alias("theoretical_rate"), (F.col("false_positives") / truly).alias("audited_rate"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_before(table(spark, sf_dir, "segments"), table(spark, sf_dir, "index_entries"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "segments"), table(spark, sf_dir, "index_entries"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

SQL = {
    "p2_found": """
WITH f AS (SELECT kv_key, min(row_id) AS r FROM segments WHERE kv_key IS NOT NULL GROUP BY kv_key)
SELECT s.row_id FROM segments s JOIN f ON s.kv_key = f.kv_key
WHERE s.row_id > f.r OR s.kv_key IN (SELECT kv_key FROM index_entries WHERE kv_key IS NOT NULL)""",
}
