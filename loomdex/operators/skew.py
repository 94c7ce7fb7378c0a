"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY_SHARE of all weight is heavy; so there are at most HEAVY_SHARE such keys.
HEAVY_SHARE = 1000
#: The rows of a heavy key are spread over this many sub-keys.
SALTS = 64


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, salt_by: Column, heavy_share: int = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Inner join of `left` with `right`, which holds each key once along with `weight`, the number of left rows of that key.

    Keys whose weight reaches total / heavy_share are heavy. As weights sum to `total` at most, there are at most `heavy_share` of them,
    which is the proven bound of the only broadcast here. Rows of a heavy key are salted by `salt_by` and its one right row is repeated
    once per salt; all other keys have few rows by definition and are joined as they are. NULL keys match nothing. Empty inputs give an
    empty result. `weight` is kept.
    """
    floor = max(2, -(-total // heavy_share))
    heavy = right.where(F.col(weight) >= floor).select(*[F.col(k).alias(f"__h_{k}") for k in keys])
    on = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    salted = left.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.when(F.col(f"__h_{keys[0]}").isNotNull(), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop(*[f"__h_{k}" for k in keys])
    fan = F.when(F.col(weight) >= floor, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("__salt", F.explode(fan)), [*keys, "__salt"], "inner").drop("__salt")
