"""Problem 8: documents mixed so that each source has its target share of all tokens, none used more often than allowed.

The size of the mixture is the largest that every source can fill with its share. A source then needs each of its documents e times on average:
floor(e) times for certain and once more with chance e - floor(e). Which documents come once more is a balanced sample by the cube method (cube.py):
flights in cells of bounded size leave two open documents each, which are dealt out to cells anew, until one cell a source is left and lands.
"""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.cube import flight, landing
from loomdex.llm.tokens import token_counts
from loomdex.session import cut, table

#: Documents of a cell.
CELL = 1024


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """How often each document of a source is needed on average. Sources without tokens are left out, the other shares keeping their proportions."""
    there = [(s, w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m > 0 and sizes.get(s)]
    whole = sum(w for _, w, _ in there)
    total = min((m * sizes[s] * whole / w for s, w, m in there), default=0.0)
    return {s: min(float(m), w / whole * total / sizes[s]) for s, w, m in there}


def _fly(round_no: int, single: frozenset[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id"]).reset_index(drop=True)
        sizes = [float(x) for x in rows["tokens"]]
        rng = random.Random(zlib.crc32(f"{key[0]}-{key[1]}-{round_no}".encode()))
        order = list(range(len(rows)))
        rng.shuffle(order)
        own, before = [sizes[i] for i in order], [float(x) for x in rows["chance"].to_numpy()[order]]
        flown = flight(own, before, rng)
        if key[0] in single:
            flown = landing(own, before, flown)
        back = [0.0] * len(order)
        for i, x in zip(order, flown, strict=True):
            back[i] = x
        return rows.assign(chance=back)[["source", "doc_id", "tokens", "chance"]]

    return run


def balanced_sample(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """(source, doc_id, tokens) of the chosen rows of (source, doc_id, tokens, chance), balanced within each source on number and tokens."""
    chosen, rest, round_no = [], rows, 0
    while True:
        counts = {r["source"]: r["n"] for r in rest.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per source of the targets
        if not counts and chosen:
            break
        cells = {s: max(1, -(-n // cell)) for s, n in counts.items()}
        n_cells = F.create_map(*[x for s, n in cells.items() for x in (F.lit(s), F.lit(n))])[F.col("source")] if cells else F.lit(1)
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(round_no)), n_cells).cast("int"))
        single = frozenset(s for s, n in cells.items() if n == 1)
        flown = cut(dealt.groupBy("source", "cell").applyInPandas(_fly(round_no, single), "source string, doc_id long, tokens long, chance double"))
        chosen.append(flown.where("chance = 1").drop("chance"))
        if len(single) == len(cells):
            break
        rest, round_no = flown.where("chance > 0 AND chance < 1"), round_no + 1
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def mixture(docs: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """(source, doc_id, tokens, repeats) of the documents used.

    Documents without a source, without tokens or of a source without a target aren't used. `targets` has a row per source: source,
    target_share, max_repeats. doc_id must be unique. Empty tables give no rows.
    """
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()]  # the caller's list of sources
    names = [s for s, *_ in wanted if s is not None]
    kept = docs.where(F.col("source").isin(names)).withColumn("doc_id", F.col("doc_id").cast("long"))
    sized = cut(token_counts(kept, ["source", "doc_id"], text).where("tokens > 0"))
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    needed = plan(sizes, wanted)
    mean = F.create_map(*[x for s, e in needed.items() for x in (F.lit(s), F.lit(e))])[F.col("source")] if needed else F.lit(None).cast("double")
    each = sized.withColumn("mean", mean).where("mean IS NOT NULL").withColumn("sure", F.floor(F.col("mean") + 1e-9).cast("int")).withColumn("chance", F.greatest(F.col("mean") - F.col("sure"), F.lit(0.0)))
    once = balanced_sample(each.where("chance > 1e-9").select("source", "doc_id", "tokens", "chance")).select("source", "doc_id", "tokens", F.lit(1).alias("times"))
    sure = each.where("sure > 0").select("source", "doc_id", "tokens", F.col("sure").alias("times"))
    return sure.unionByName(once).groupBy("source", "doc_id", "tokens").agg(F.sum("times").cast("int").alias("repeats"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, and the most times that one of its documents is used."""
    targets = table(spark, sf_dir, "mix_targets")
    used = mixture(table(spark, sf_dir, "documents"), targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over one row per source
    return targets.join(used, "source", "left").select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / total).alias("reached_share"), "tokens", "documents", "most_repeats", "max_repeats")


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right mixture has none of: documents used too often, twice listed, unknown, of a source without a target, and shares that are off
    by more than two of the longest texts used; the targets of sources without texts are spread over the others."""
    targets, docs = table(spark, sf_dir, "mix_targets"), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("own"))
    used = cut(mixture(table(spark, sf_dir, "documents"), targets))
    against = used.join(docs, "doc_id", "left").join(targets, "source", "left")
    wrong = against.agg(
        F.sum((~(F.col("repeats") <= F.col("max_repeats")) | (F.col("repeats") < 1)).cast("int")).alias("repeats"),
        (F.count("*") - F.count_distinct("doc_id")).alias("twice"),
        F.sum((~F.col("own").eqNullSafe(F.col("source"))).cast("int")).alias("unknown"),
        F.sum(F.col("target_share").isNull().cast("int")).alias("no target"),
    )
    rows = wrong.select(F.explode(F.create_map(*[x for c in wrong.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long"))])).alias("rule", "violations"))
    longest, total = used.agg(F.max("tokens"), F.sum(F.col("tokens") * F.col("repeats"))).first()
    per = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).join(targets, "source")
    whole = per.agg(F.sum("target_share")).first()[0] or 1.0  # over one row per source
    far = F.abs(F.col("n") - F.col("target_share") / whole * (total or 0)) > 2 * (longest or 0)
    off = per.agg(F.coalesce(F.sum(far.cast("long")), F.lit(0)).alias("violations"))
    return rows.unionByName(off.select(F.lit("share").alias("rule"), "violations"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_violations": p8_violations}
#: Rules that every mixture keeps; the mixture itself has no SQL.
SQL = {"p8_violations": "SELECT rule, 0::BIGINT AS violations FROM (VALUES ('repeats'), ('twice'), ('unknown'), ('no target'), ('share')) AS v(rule)"}
