"""Streams of index commands into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.session import cut
from loomdex.sources.store import IndexStore


def apply_batch(store: IndexStore, batch: DataFrame) -> None:
    """Commands (step, op, external_id, title, content) of one batch, published as one version.

    The order of `step` counts, within a batch and between batches: a command is left out if one of the same external id with the same or a later
    step has counted before, so late commands change nothing and a batch that is run again is a batch without commands. A step counts once.
    Every add takes an id, also where a later command of the batch replaces it.
    """
    steps = batch.where(F.col("op").isin("add", "remove") & F.col("step").isNotNull()).withColumn("external_id", F.coalesce("external_id", F.lit("")))
    once = steps.groupBy("step").agg(F.first(F.struct("op", "external_id", "title", "content")).alias("c")).select("step", "c.*")
    known = store.steps().withColumnRenamed("step", "known")
    fresh = cut(once.join(known, "external_id", "left").where("known IS NULL OR step > known").drop("known"))
    last = fresh.groupBy("external_id").agg(F.max_by("op", "step").alias("op"), F.max("step").alias("step"))
    store.change(fresh.where("op = 'add'"), ["step"], last.where("op = 'remove'"), last)


def ingest(commands: DataFrame, store: IndexStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream of commands into the store, at most one published version per micro-batch.

    `trigger` is handed to the writer, availableNow unless given.
    """
    return commands.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
