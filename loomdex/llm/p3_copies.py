"""Problem 3: records that are the same but for layout, by bottom-up hashing (trees.py).

A record is a node without order over its fields: those of the title and those of the content, where a field list contributes each of its parts.
Leaves are normalised (letter case and everything that is not a letter, combining mark or digit disregarded) and hashed; a node's digest is the hash
of its children's sorted digests. Records are grouped by root digest and whole normalised structure, so that equal digests never decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from loomdex.llm.trees import digest, structure
from loomdex.operators.skew import skew_join
from loomdex.session import cut, spread, table

#: Marks that part the fields of a list, and that end a field's name. Fixed values of the format.
PARTS, NAMED = r"[;|\r\n]+", r"^[^:=]*[\p{L}\p{N}][^:=]*[:=].*\S"
#: Fewest parts of a field list.
LEAST_PARTS = 3
#: Characters dropped from a leaf: all but letters, marks and digits, and those letters and marks that can't be seen.
DROPPED = r"[[^\p{L}\p{M}\p{N}][\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]]+"
VISIBLE = r"[\p{L}\p{N}&&[^\x{115F}\x{1160}\x{3164}\x{FFA0}]]"
#: The kind of a document's record.
FIELDS = ArrayType(StringType())


def leaf(text: Column) -> Column:
    """A leaf without letter case, blanks, punctuation and invisible characters. Upper case of ß is SS, that of ς is Σ."""
    lower = F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(lower, DROPPED, "")


def parts(text: Column) -> Column:
    """The stretches with a letter or digit between the marks that part a field list; none for a text without a mark that ends a name."""
    named = text.contains(":") | text.contains("=")
    return F.when(named, F.filter(F.split(text, PARTS), lambda p: p.rlike(VISIBLE))).otherwise(F.array().cast("array<string>"))


def fields(text: Column, stretches: Column) -> Column:
    """Each part of a field list as a field; any other text is one field."""
    listed = (F.size(stretches) >= LEAST_PARTS) & F.forall(stretches, lambda p: p.rlike(NAMED))
    return F.when(listed, stretches).otherwise(F.array(text))


def document_records(docs: DataFrame) -> DataFrame:
    """(doc_id, record): the fields of title and content, each of which may be a field list, of the rows that have a letter or digit.

    NULL title or content is an empty field, which is left out of the hashes.
    """
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    kept = spread(docs.select("doc_id", "title", "content")).where(F.concat(title, content).rlike(VISIBLE))
    cells = kept.select("doc_id", title.alias("t"), content.alias("c"), parts(title).alias("tp"), parts(content).alias("cp"))
    return cells.select("doc_id", F.concat(fields(F.col("t"), F.col("tp")), fields(F.col("c"), F.col("cp"))).alias("record"))


def merkle(records: DataFrame, kind: DataType = FIELDS, named: bool = True) -> DataFrame:
    """(doc_id, root, whole): the root digest of each record of (doc_id, record) and its normalised structure. Records without any kept leaf are equal."""
    own = leaf
    if kind == FIELDS:  # normalised once for both
        records, own = records.select("doc_id", F.transform("record", leaf).alias("record")), lambda x: x
    record = F.col("record")
    return records.select("doc_id", digest(record, kind, own, named).alias("root"), structure(record, kind, own, named).alias("whole"))


def groups(trees: DataFrame) -> DataFrame:
    """(root, whole, copy_of, n) of each group: its digests, smallest doc_id and size; `whole` leaves as a digest of the structure.

    The structures themselves are the key of the one aggregation, which combines before it shuffles: a group of any size is one row per task.
    """
    found = trees.groupBy("root", "whole").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    return found.select("root", _short("whole"), "copy_of", "n")


def _short(whole: str) -> Column:
    return F.coalesce(F.unhex(F.sha2(F.col(whole).cast("binary"), 256)), F.lit(b"")).alias(whole)


def copies(records: DataFrame, kind: DataType = FIELDS, named: bool = True) -> DataFrame:
    """(doc_id, copy_of) for every record of (doc_id, record) that has copies, its group's smallest doc_id standing for it, that one included.

    Members are joined to their groups by digests only, without their texts; a group with a thousandth of all records is salted (skew_join).
    Equal rows count as copies of each other; a row without a doc_id counts but can't stand for others.
    """
    trees = merkle(records, kind, named)
    members = trees.select("doc_id", "root", _short("whole"))
    repeated = cut(groups(trees).where("n > 1"))
    return skew_join(members, repeated, ["root", "whole"], "n", records.count(), F.col("doc_id")).select("doc_id", "copy_of")


def collapsed(records: DataFrame, kind: DataType = FIELDS, named: bool = True) -> DataFrame:
    """(doc_id, copies): one record, that with the smallest doc_id, for each group of copies, and the size of the group.

    Records without any letter or digit are left out; an empty table gives no rows.
    """
    return groups(merkle(records, kind, named)).select(F.col("copy_of").alias("doc_id"), F.col("n").alias("copies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(document_records(table(spark, sf_dir, "doc_store")))
    return found.where("doc_id > copy_of").select(F.col("copy_of").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(document_records(table(spark, sf_dir, "doc_store")))


QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}

_SQL = r"""
WITH r AS (SELECT doc_id, coalesce(title, '') AS t, coalesce(content, '') AS c FROM doc_store),
s AS (SELECT doc_id, unnest([t, c]) AS x FROM r WHERE regexp_matches(t || c, '[\p{L}\p{N}]')),
p AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[;|\r\n]+'), lambda y: regexp_matches(y, '[\p{L}\p{N}]')) AS parts FROM s),
f AS (SELECT doc_id, unnest(CASE WHEN len(parts) >= 3 AND len(list_filter(parts, lambda y: NOT regexp_matches(y, '^[^:=]*[\p{L}\p{N}][^:=]*[:=].*\S'))) = 0 THEN parts ELSE [x] END) AS y FROM p),
n AS (SELECT doc_id, regexp_replace(replace(replace(lower(y), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{M}\p{N}]', '', 'g') AS y FROM f),
k AS (SELECT doc_id, list(y ORDER BY y) AS k FROM n WHERE y <> '' GROUP BY doc_id),
g AS (SELECT k, min(doc_id) AS a, count(*) AS copies FROM k GROUP BY k)
"""
SQL = {
    "p3_found": _SQL + "SELECT a AS doc_id_a, doc_id AS doc_id_b FROM k JOIN g USING (k) WHERE doc_id > a",
    "p3_collapsed": _SQL + "SELECT a AS doc_id, copies FROM g",
}
