"""Problem 7: texts, measured in tokens, put into containers of each capacity with little unused space.

Items are dealt out by hash to cells of bounded size, and each cell is packed by best fit as a start. Bins that are full enough stay. The others are
taken up by a grouping genetic algorithm (packing.py) on islands: each island of a cell is a task of its own, and after every epoch its elite
migrates to the next island by a shuffle. What the best island leaves in bins that aren't full enough is dealt out anew to fewer cells, round
by round, so the space lost at the edges of cells doesn't add up. A text is split only where it exceeds the capacity: into full containers and
one remainder that is packed like other items.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.packing import Bins, evolve, first_packing, rank
from loomdex.llm.tokens import token_counts
from loomdex.session import cut, table

#: Items of a cell, and the fill from which a bin stays.
CELL, KEPT_FILL = 1024, 0.995
#: Islands of a cell, and epochs, between which the elites migrate.
ISLANDS, EPOCHS = 3, 2
_ITEM = ["container", "capacity", "doc_id", "part", "tokens"]
_PACKED_SCHEMA = pa.schema([("container", pa.string()), ("capacity", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64()), ("cell", pa.int32()), ("bin", pa.string()), ("fill", pa.float64())])
_ELITE_SCHEMA = pa.schema([*_PACKED_SCHEMA, pa.field("island", pa.int32()), pa.field("bins", pa.int32()), pa.field("emptiness", pa.float64())])
_PACKED = "container string, capacity long, doc_id long, part int, tokens long, cell int, bin string, fill double"
_ELITE = f"{_PACKED}, island int, bins int, emptiness double"


Item = tuple[int, int, int]  # tokens, doc_id, part


def _labelled(key: tuple, capacity: int, items: list[Item], bins: Bins, name: str, schema: pa.Schema, *more) -> pa.Table:
    """The rows of a packed cell; `more` are the values of the last columns, the same for every row."""
    n = len(items)
    label, fill = [""] * n, [0.0] * n
    for k, b in enumerate(bins):
        full = sum(items[i][0] for i in b) / capacity
        for i in b:
            label[i], fill[i] = f"{name}-{k}", full
    tokens, ids, parts = (list(x) for x in zip(*items, strict=True))
    columns = [[key[0]] * n, [capacity] * n, ids, parts, tokens, [key[1]] * n, label, fill, *[[x] * n for x in more]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _items(rows: pa.Table) -> tuple[list[Item], int]:
    """The rows' items as they come, and the capacity."""
    return list(zip(*(rows.column(x).to_pylist() for x in ("tokens", "doc_id", "part")), strict=True)), rows.column("capacity")[0].as_py()


def _falling(item: Item) -> Item:
    return -item[0], item[1], item[2]


def _start(round_no: int):
    """Packs a cell by best fit."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        key = tuple(k.as_py() for k in key)
        items, capacity = _items(rows)
        items.sort(key=_falling)
        return _labelled(key, capacity, items, first_packing([i[0] for i in items], capacity), f"{round_no}-{key[1]}", _PACKED_SCHEMA)

    return run


def _island(round_no: int, epoch: int):
    """An epoch of one island of one cell. Its rows are those of each packing it has, told apart by `origin`."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        container, cell, island = (k.as_py() for k in key)
        every, capacity = _items(rows)
        packings: dict[int, dict[str, list[Item]]] = {}
        for item, origin, label in zip(every, rows.column("origin").to_pylist(), rows.column("bin").to_pylist(), strict=True):
            packings.setdefault(origin, {}).setdefault(label, []).append(item)
        items = sorted((i for b in packings[min(packings)].values() for i in b), key=_falling)
        at = {item: i for i, item in enumerate(items)}
        people = [[sorted(at[i] for i in b) for _, b in sorted(packings[o].items())] for o in sorted(packings)]
        sizes = [i[0] for i in items]
        best = evolve(people, sizes, capacity, zlib.crc32(f"{container}-{round_no}-{cell}-{island}-{epoch}".encode()))
        return _labelled((container, cell), capacity, items, best, f"{round_no}-{cell}-{epoch}-{island}", _ELITE_SCHEMA, island, *rank(best, sizes, capacity))

    return run


def _evolved(taken: DataFrame, round_no: int) -> DataFrame:
    """(..., cell, bin, fill) of the open items of each cell, as its best island packs them."""
    every = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    people = taken.withColumn("target", every).withColumn("origin", F.lit(0))
    for epoch in range(EPOCHS):
        elites = people.groupBy("container", "cell", "target").applyInArrow(_island(round_no, epoch), _ELITE)
        stays, goes = F.struct(F.col("island").alias("target"), F.lit(0).alias("origin")), F.struct(((F.col("island") + 1) % ISLANDS).alias("target"), F.lit(1).alias("origin"))
        people = elites.withColumn("to", F.explode(F.array(stays, goes))).select("*", "to.target", "to.origin")
    best = F.min(F.struct("bins", "emptiness", "island")).over(Window.partitionBy("container", "cell"))  # over the islands of one cell
    return elites.withColumn("best", best).where("island = best.island").select(*_ITEM, "cell", "bin", "fill")


def _counts(packed: DataFrame, kept_fill: float) -> DataFrame:
    """Items and bins of each container, and the cells that have two or more open bins."""
    bins = packed.groupBy("container", "cell", "bin").agg(F.count("*").alias("items"), F.max("fill").alias("fill"))
    cells = bins.groupBy("container", "cell").agg(F.sum("items").alias("items"), F.count("*").alias("bins"), F.sum((F.col("fill") < kept_fill).cast("int")).alias("open"))
    return cells.groupBy("container").agg(F.sum("items").alias("items"), F.sum("bins").alias("bins"), F.count("*").alias("cells"), F.sum((F.col("open") > 1).cast("int")).alias("open_cells"))


def pack_items(items: DataFrame, cell: int = CELL, kept_fill: float = KEPT_FILL) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """(container, capacity, doc_id, part, tokens, bin, fill) of items no larger than their capacity, and figures of each container.

    (doc_id, part) is unique per container. A container ends where one cell holds what is left of it. Where a round saves no bin against what the round
    before had left, those bins stand, and only bins at most half full go on, of which any two go together; where a round of these saves none either
    (they hold more empty items than a cell has) the container ends too. Each container goes on or ends by itself. Figures: rounds, cells packed, cells in which the genetic
    algorithm ran (all with two open bins or more; in others nothing can be gained), and the bins that it saved against best fit in the same cells.
    """
    done: list[DataFrame] = []
    rest, before, round_no = items, {}, 0
    merging: set[str] = set()
    figures: dict[str, dict[str, int]] = {}
    while True:
        left = {r["container"]: r["n"] for r in rest.groupBy("container").agg(F.count("*").alias("n")).collect()}  # a row per container
        if not left and done:
            break
        cells = {c: max(1, -(-n // cell)) for c, n in left.items()}
        n_cells = F.create_map(*[x for c, n in cells.items() for x in (F.lit(c), F.lit(n))])[F.col("container")] if cells else F.lit(1)
        dealt = rest.select(*_ITEM).withColumn("cell", F.pmod(F.xxhash64("doc_id", "part", F.lit(round_no)), n_cells).cast("int"))
        start = cut(dealt.groupBy("container", "cell").applyInArrow(_start(round_no), _PACKED))
        first = {r["container"]: r for r in _counts(start, kept_fill).collect()}
        packed = cut(start.where(F.col("fill") >= kept_fill).unionByName(_evolved(start.where(F.col("fill") < kept_fill), round_no)))
        now = {r["container"]: r for r in _counts(packed, kept_fill).collect()}
        for c, r in now.items():
            own = figures.setdefault(c, {"rounds": 0, "cells": 0, "cells_evolved": 0, "bins_saved": 0})
            for k, n in (("rounds", 1), ("cells", first[c]["cells"]), ("cells_evolved", first[c]["open_cells"]), ("bins_saved", first[c]["bins"] - r["bins"])):
                own[k] += n
        stuck = sorted(c for c in now if c in before and now[c]["bins"] >= before[c])
        ends = sorted({c for c in now if cells[c] == 1 and c not in stuck} | (merging & set(stuck)))
        merging |= set(stuck)
        # where a round saved nothing, what it had been given stands
        went = packed.where(~F.col("container").isin(stuck)).unionByName(rest.where(F.col("container").isin(stuck))) if stuck else packed
        least = F.when(F.col("container").isin(ends), 0.0).when(F.col("container").isin(sorted(merging)), 0.5000001).otherwise(kept_fill)
        done.append(went.where(F.col("fill") >= least).select(*_ITEM, "bin", "fill"))
        rest = went.where(F.col("fill") < least)
        before = {r["container"]: r["n"] for r in rest.groupBy("container").agg(F.count_distinct("cell", "bin").alias("n")).collect()}
        round_no += 1
    return reduce(DataFrame.unionByName, done), figures


def _split_up(docs: DataFrame, capacities: dict[str, int], text: str) -> tuple[DataFrame, DataFrame]:
    """Items to be packed, and the bins that the first parts of texts above the capacity fill; both without `bin` where no container is."""
    sized = cut(token_counts(docs.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], text))
    kinds = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items())])
    each = sized.select("doc_id", "tokens", F.explode(kinds).alias("k")).select("doc_id", "tokens", "k.*").withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")).cast("int"))
    rest = F.col("tokens") - F.col("whole") * F.col("capacity")
    items = each.where((rest > 0) | (F.col("tokens") == 0)).select("container", "capacity", "doc_id", F.col("whole").alias("part"), rest.alias("tokens"))
    parts = each.where("whole > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    return items, parts.select("container", "capacity", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("bin"), "doc_id", "part", F.col("capacity").alias("tokens"))


_RESULT = "container string, capacity long, bin string, doc_id long, part int, tokens long"


def _filled(docs: DataFrame, capacities: dict[str, int], text: str) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    known = {k: c for k, c in capacities.items() if c and c > 0}
    if not known:
        return docs.sparkSession.createDataFrame([], _RESULT), {}
    items, full = _split_up(docs, known, text)
    packed, figures = pack_items(items)
    return full.unionByName(packed.select("container", "capacity", "bin", "doc_id", "part", "tokens")), figures


def containers_for(docs: DataFrame, capacities: dict[str, int], text: str = "text") -> DataFrame:
    """(container, capacity, bin, doc_id, part, tokens): each text of `docs` in a bin of every container.

    NULL and empty texts are items of size 0 and stand in some bin. A text above the capacity fills bins of its own with its first parts, `part`
    counting from 0. doc_id must be unique; rows without one are left out. An empty table, or no container, gives no rows.
    """
    return _filled(docs, capacities, text)[0]


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["container"]: r["capacity"] for r in table(spark, sf_dir, "containers").collect()}  # a fixed table of a few rows


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers_for(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of each container, the fewest that any packing could have, the share of space used, and what the genetic algorithm did."""
    rows, figures = _filled(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir), "text")
    per = rows.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens")).groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    did = spark.createDataFrame([(c, *f.values()) for c, f in figures.items()], "container string, rounds long, cells long, cells_evolved long, bins_saved long")
    least = F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins")
    return per.join(did, "container", "left").select("container", "capacity", "bins", least, "tokens", "fullest", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("used"), "rounds", "cells", "cells_evolved", "bins_saved")


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right packing has none of: overfull bins, texts that aren't whole, and parts of texts that would fit one bin. One row per container and rule."""
    docs, rows = table(spark, sf_dir, "documents"), p7_containers(spark, sf_dir)
    over = rows.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("n")).groupBy("container").agg(F.sum((F.col("n") > F.col("capacity")).cast("int")).alias("n"))
    texts = rows.groupBy("container", "capacity", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts"), F.count_distinct("part").alias("different"))
    split = texts.groupBy("container").agg(F.sum(((F.col("parts") != F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))) | (F.col("parts") != F.col("different"))).cast("int")).alias("n"))
    sized = token_counts(docs, ["doc_id"])
    each = F.explode(F.array(*[F.lit(c) for c in sorted(_capacities(spark, sf_dir))]))
    lost = sized.withColumn("container", each).join(texts.select("container", "doc_id", "n"), ["container", "doc_id"], "left")
    lost = lost.groupBy("container").agg(F.sum((~F.col("tokens").eqNullSafe(F.col("n"))).cast("int")).alias("n"))
    found = [d.select("container", F.lit(k).alias("rule"), F.col("n").cast("long").alias("violations")) for k, d in (("overfull", over), ("split", split), ("not whole", lost))]
    return reduce(DataFrame.unionByName, found)


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_violations": p7_violations}
#: Rules that every packing keeps; the packing itself has no SQL.
SQL = {"p7_violations": "SELECT container, rule, 0::BIGINT AS violations FROM containers CROSS JOIN (VALUES ('overfull'), ('split'), ('not whole')) AS v(rule)"}
