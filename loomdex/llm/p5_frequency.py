"""Problem 5: how often every distinct value or term occurs, in how many records, and which are too rare or too common to be useful.

Last-seen counters (counters.py) run over the tokens of each task in the order of its records; their sums are then hash-partitioned by term.
No set of records is kept for any term, and a term that every record holds is one row per task when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import split_tokens, titled
from loomdex.llm.counters import term_counts
from loomdex.session import spread, table

#: Above this share of all records a term is common.
COMMON_DOC, COMMON_KV = 0.1, 0.01


def doc_tokens() -> Column:
    """Terms of title, space, content: lower-cased, split at everything that is neither letter nor number."""
    return split_tokens(F.lower(titled(F.col("title"), F.col("content"))))


def marked(counts: DataFrame, total: int, common: float) -> DataFrame:
    """Adds `mark`: 'rare' in exactly one record, 'common' in more than `common` of `total` records, else NULL. Rare wins where both hold."""
    return counts.withColumn("mark", F.when(F.col("records") == 1, "rare").when(F.col("records") > F.lit(common * total), "common"))


def frequencies(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, mark) of the terms of `docs` and the keys of `segments`.

    NULL title or content is empty; NULL keys aren't counted, though their rows count for the share; empty tables give no rows.
    """
    doc = marked(term_counts(spread(docs.select("title", "content")), doc_tokens()), docs.count(), COMMON_DOC)
    # a record has one key at most, so each occurrence is last seen in another record
    keys = segments.where(F.col("kv_key").isNotNull()).groupBy(F.col("kv_key").alias("term")).agg(F.count("*").alias("occurrences"))
    kv = marked(keys.withColumn("records", F.col("occurrences")), segments.count(), COMMON_KV)
    return doc.select(F.lit("doc").alias("field"), "*").unionByName(kv.select(F.lit("kv").alias("field"), "*"))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(table(spark, sf_dir, "doc_store"), table(spark, sf_dir, "segments"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

#: Terms in SQL. DuckDB lowers a capital sigma to the plain form always; at the end of a word the final one is meant.
TERMS_SQL = r"""
raw AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(title, '') || ' ' || coalesce(content, ''), '[^\p{L}\p{N}]+')) AS t FROM doc_store),
tok AS (SELECT doc_id, CASE WHEN length(t) > 1 AND t LIKE '%Σ' THEN lower(left(t, -1)) || 'ς' ELSE lower(t) END AS term FROM raw WHERE t <> '')"""

_COUNTS_SQL = f"""
WITH {TERMS_SQL},
doc AS (SELECT 'doc' AS field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM tok GROUP BY term),
kv AS (SELECT 'kv' AS field, kv_key AS term, count(*) AS occurrences, count(*) AS records FROM segments WHERE kv_key IS NOT NULL GROUP BY kv_key),
a AS (
SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM doc_store) THEN 'common' END AS mark FROM doc
UNION ALL
SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.01 * (SELECT count(*) FROM segments) THEN 'common' END AS mark FROM kv)
"""

SQL = {
    "p5_found": _COUNTS_SQL + "SELECT field, term, mark FROM a WHERE mark IS NOT NULL",
    "p5_terms": _COUNTS_SQL + "SELECT field, term, occurrences, records, mark FROM a",
}
