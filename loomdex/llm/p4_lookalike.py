"""Problem 4: texts that look the same but are made of different characters (normal.py has the form they are brought to)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.normal import normal_form
from loomdex.operators.skew import skew_join
from loomdex.session import cut, spread, table

#: Rows of one block of a spelling, and blocks of a look that one task pairs with another block at most.
BLOCK, FAN = 256, 1024
#: Texts of these characters alone are in their form as they are.
PLAIN = r"\A[\x09-\x0D\x20-\x7E]*\z"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = [pa.array([normal_form(x) for x in batch.column(i).to_pylist()], pa.string()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *form], ["doc_id", "title", "content", "title_form", "content_form"])


def forms(docs: DataFrame) -> DataFrame:
    """(doc_id, title, content, title_form, content_form) of every row; NULL counts as the empty text, in title and content too.

    Rows of plain ASCII stay in the JVM: their texts are their forms.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    plain = F.col("title").rlike(PLAIN) & F.col("content").rlike(PLAIN)
    other = spread(kept).where(~plain).mapInArrow(_forms, "doc_id long, title string, content string, title_form string, content_form string")
    return kept.where(plain).select("*", F.col("title").alias("title_form"), F.col("content").alias("content_form")).unionByName(other)


def _digest(a: str, b: str) -> Column:
    return F.coalesce(F.unhex(F.sha2(F.concat_ws("\x1f", a, b), 256)), F.lit(b""))


def looks(docs: DataFrame) -> DataFrame:
    """(doc_id, look, own): digests of the common form and of the characters as they are, of rows with a letter or digit."""
    return forms(docs).where(F.concat("title_form", "content_form").rlike(r"[\p{L}\p{N}]")).select("doc_id", _digest("title_form", "content_form").alias("look"), _digest("title", "content").alias("own"))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, look, own, n) of the rows of every look that comes in two or more spellings; n is the look's number of rows."""
    rows = cut(looks(docs))
    n_of = rows.groupBy("look", "own").agg(F.count("*").alias("k")).groupBy("look").agg(F.sum("k").alias("n"), F.count("*").alias("spellings")).where("spellings > 1").select("look", "n")
    return skew_join(rows, n_of, ["look"], "n", rows.count(), F.col("doc_id"))


def _salted(df: DataFrame, own: list[str], every: bool) -> DataFrame:
    """`salt` below `fan`: every one, or that of the columns `own`."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)) if every else F.pmod(F.xxhash64(*own), F.col("fan")).cast("int"))


def spelling_pairs(spellings: DataFrame) -> DataFrame:
    """(look, fan, own_a, blocks_a, own_b, blocks_b) of every two spellings of a look, own_a below own_b, from (look, own, blocks, fan). The pairs of a
    look with many spellings are made by `fan` tasks."""
    a = _salted(spellings.select("look", "fan", F.col("own").alias("own_a"), F.col("blocks").alias("blocks_a")), ["own_a"], every=False)
    b = _salted(spellings.select("look", "fan", F.col("own").alias("own_b"), F.col("blocks").alias("blocks_b")), [], every=True).drop("fan")
    return a.join(b, ["look", "salt"]).where("own_a < own_b").drop("salt")


def lookalike_pairs(docs: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: rows that look the same though title or content differs in its characters.

    Spellings of a look are paired first, then blocks of at most some hundreds of rows of two spellings, then their rows: the work grows with the
    result, however often a spelling recurs, and no task holds more than the pairs of some blocks. Rows with the same characters form no pair. Rows
    without any letter or digit, or without a doc_id, are left out; an empty table gives no rows.
    """
    rows = cut(looks(docs).where(F.col("doc_id").isNotNull()))
    spellings = rows.groupBy("look", "own").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
    many = spellings.groupBy("look").agg(F.count("*").alias("s"), F.sum("blocks").alias("all_blocks"))
    many = many.where("s > 1").select("look", "s", F.ceil(F.col("all_blocks") / fan).cast("int").alias("fan"))
    spellings = cut(skew_join(spellings, many, ["look"], "s", rows.count(), F.col("own")).drop("s"))
    own = skew_join(rows, spellings, ["look", "own"], "k", rows.count(), F.col("doc_id"))
    blocks = own.groupBy("look", "own", "fan", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("doc_id").alias("ids"))  # about `block` ids
    blocks = cut(blocks)
    pairs = spelling_pairs(spellings)
    for side in "ab":
        pairs = pairs.withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1)))
    for side, other in ("ab", "ba"):
        given = _salted(blocks.select("look", "fan", F.col("own").alias(f"own_{side}"), F.col("block").alias(f"block_{side}"), F.col("ids").alias(f"ids_{side}")), [], every=True).drop("fan")
        pairs = _salted(pairs, [f"own_{other}", f"block_{other}"], every=False).join(given, ["look", f"own_{side}", f"block_{side}", "salt"]).drop("salt")
    each = pairs.select("ids_b", F.explode("ids_a").alias("a")).select("a", F.explode("ids_b").alias("b")).where("a <> b")
    return each.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "doc_store"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(table(spark, sf_dir, "doc_store")).select("doc_id", "title_form", "content_form", ((F.col("title") != F.col("title_form")) | (F.col("content") != F.col("content_form"))).alias("changed"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of a look that comes in several spellings, with its class: the look's smallest doc_id."""
    m = cut(members(table(spark, sf_dir, "doc_store")))
    least = m.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    return skew_join(m.drop("n"), least, ["look"], "n", m.count(), F.col("doc_id")).select("doc_id", "class_id", "n")


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms, "p4_classes": p4_classes}
SQL: dict[str, str] = {}
