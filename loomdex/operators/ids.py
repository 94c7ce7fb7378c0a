"""Dense ids in a given order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import cut

_WITHIN = (1 << 33) - 1


def with_ids(rows: DataFrame, order: list, first: int = 1, name: str = "doc_id") -> DataFrame:
    """`rows` with ids first, first + 1, ... in the order of the columns `order`, which should tell any two rows apart.

    Rows are range-partitioned and sorted, then numbered within their partition; only one count per partition reaches the driver.
    """
    numbered = cut(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begin, pairs = first, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(begin)]
        begin += n
    if not pairs:
        return numbered.withColumn(name, F.lit(None).cast("long")).drop("__at")
    return numbered.withColumn(name, (F.create_map(*pairs)[part] + F.col("__at").bitwiseAND(F.lit(_WITHIN))).cast("long")).drop("__at")
