"""Key-value segments as a log-structured merge tree would read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands between a term and the number of its segment in a posting key.
SEPARATOR = "\x1f"


def newest(segments: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """(kv_key, kv_value, segment_seq, row_id): the newest record of each key, none for a key whose newest is a tombstone.

    Newest is the highest segment, then the highest row. One aggregation with map-side combining, so a key that holds most rows is
    one row per task when it is shuffled. NULL keys are left out; a NULL value that is no tombstone stays.
    """
    at = F.struct("segment_seq", "row_id")
    rows = segments.where(F.col("kv_key").isNotNull())
    best = rows.groupBy("kv_key").agg(F.max_by(F.struct("kv_value", F.coalesce("tombstone", F.lit(False)).alias("tombstone"), "segment_seq", "row_id"), at).alias("r")).select("kv_key", "r.*")
    return best if keep_tombstones else best.where(~F.col("tombstone")).drop("tombstone")


def point_get(segments: DataFrame, key: str) -> DataFrame:
    """The newest live record of one key; the key is pushed down to the scan."""
    return newest(segments.where(F.col("kv_key") == F.lit(key)))


def range_scan(segments: DataFrame, start: str, stop: str | None) -> DataFrame:
    """Newest live records with start <= key < stop; no upper bound if `stop` is None or empty."""
    rows = segments.where(F.col("kv_key") >= F.lit(start))
    return newest(rows.where(F.col("kv_key") < F.lit(stop)) if stop else rows)


def posting_term(key: Column) -> Column:
    """The term of a posting key, or the whole key if it is a bare term."""
    return F.substring_index(key, SEPARATOR, 1)


def posting_key(term: Column, seq: Column) -> Column:
    return F.concat(term, F.lit(SEPARATOR), F.lpad(seq.cast("string"), 20, "0"))


def posting_range(term: str) -> tuple[str, str]:
    """Bounds that hold every posting key of a term."""
    return term + SEPARATOR, term + chr(ord(SEPARATOR) + 1)


def over_budget(level_bytes: dict[int, int], base: int, ratio: int) -> list[int]:
    """Levels that should be compacted: level n may hold base * ratio ** n bytes."""
    return sorted(n for n, size in level_bytes.items() if size > base * ratio**n)
