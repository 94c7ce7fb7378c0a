"""A log of index commands, replayed to the documents it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators.ids import with_ids


def commands(log: DataFrame) -> DataFrame:
    """The log with each step once, as it first arrived; rows without a step or command are left out."""
    return log.where(F.col("step").isNotNull() & F.col("op").isNotNull()).groupBy("step").agg(F.min_by(F.struct("op", "external_id", "title", "content"), F.coalesce("arrived_at", F.timestamp_seconds(F.lit(0)))).alias("c")).select("step", "c.*")


def replay(log: DataFrame) -> DataFrame:
    """(doc_id, external_id, title, content) that are left after all steps in order.

    Every add takes the next id, upserts too, so a replaced document moves to the end; removing an unknown id does nothing; flush and reopen
    change no document. NULL title or content is empty; an add without external id counts as one with an empty id.
    """
    steps = commands(log).where(F.col("op").isin("add", "remove")).withColumn("external_id", F.coalesce("external_id", F.lit("")))
    adds = with_ids(steps.where("op = 'add'"), ["step"])
    removes = steps.where("op = 'remove'").withColumn("doc_id", F.lit(None).cast("long"))
    last = adds.unionByName(removes).groupBy("external_id").agg(F.max_by(F.struct("op", "doc_id", "title", "content"), "step").alias("c")).select("external_id", "c.*")
    return last.where("op = 'add'").select("doc_id", "external_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
