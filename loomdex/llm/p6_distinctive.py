"""Problem 6: how characteristic each term is of a record, by the log-likelihood ratio.

For a term that occurs tf times among the `length` tokens of a record and cf times among the N tokens of the collection, the two-by-two table is
(tf, cf - tf; length - tf, N - length - cf + tf). The score is the signed G statistic: positive where the term is relatively more frequent in the
record than in the rest of the collection, negative where it is less frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.counters import record_terms
from loomdex.llm.p5_frequency import TERMS_SQL, doc_tokens
from loomdex.operators.skew import skew_join
from loomdex.session import cut, spread, table


def log_likelihood_ratio(tf: Column, length: Column, cf: Column, total: int) -> Column:
    """Signed G of the contingency table, rounded to three digits; 0 where the record is the whole collection, NULL where the counts make no table."""
    n = F.lit(float(total))
    a, b, c = tf.cast("double"), (cf - tf).cast("double"), (length - tf).cast("double")
    d = n - length - cf + tf

    def part(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(F.lit(0.0))

    g = 2 * (part(a, cf, length) + part(b, cf, n - length) + part(c, n - cf, length) + part(d, n - cf, n - length))
    sign = F.when(a * (n - length) < b * length, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when((a > 0) & (b >= 0) & (c >= 0) & (d >= 0), F.round(sign * F.greatest(g, F.lit(0.0)), 3))


def distinctive_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, df, llr) for each row of `docs` and each of its terms.

    df is the number of rows that hold the term. NULL title or content is empty; a row without terms gives none; equal rows are different
    records; an empty table gives no rows. Collection totals are joined by term to the terms of each batch, whose records are spread out only then:
    terms found in at least a thousandth of all pairs are few and their batches are salted (skew_join), the rest are joined as they are.
    """
    docs = spread(docs.select("doc_id", "title", "content"))
    groups = record_terms(docs, "doc_id", doc_tokens())
    totals = cut(groups.groupBy("term").agg(F.sum("occurrences").alias("cf"), F.sum("records").alias("df")))
    tokens, weight = totals.agg(F.coalesce(F.sum("cf"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    joined = skew_join(groups.select("term", "id", "tf", "length"), totals, ["term"], "df", weight, F.col("id"))
    pairs = joined.select("term", "cf", "df", F.inline(F.arrays_zip("id", "tf", "length"))).withColumns({c: F.col(c).cast("long") for c in ("tf", "length")})
    return pairs.select(F.col("id").alias("doc_id"), "term", "tf", "df", log_likelihood_ratio(F.col("tf"), F.col("length"), F.col("cf"), tokens).alias("llr"))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(table(spark, sf_dir, "doc_store"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair is scored before any is chosen: no filter passes below the observation, which counts pairs and scores. TESTDATA.md tells the
    cases by counts alone, so how high a score is chooses none; a pair that can't be scored is none."""
    scored = p6_scores(spark, sf_dir).observe(Observation(), F.count("*").alias("pairs"), F.count("llr").alias("scored"))
    return scored.where(F.col("llr").isNotNull() & (F.length("term") >= 4) & (F.col("tf") >= 3) & (F.col("df") <= 5)).select("doc_id", "term")


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores}

SQL = {
    "p6_found": f"""
WITH {TERMS_SQL},
p AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, term FROM p JOIN t USING (term) WHERE length(term) >= 4 AND tf >= 3 AND df <= 5""",
    "p6_scores": f"""
WITH {TERMS_SQL},
p AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
t AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
l AS (SELECT doc_id, sum(tf)::DOUBLE AS length FROM p GROUP BY doc_id),
n AS (SELECT sum(cf)::DOUBLE AS n FROM t),
x AS (SELECT doc_id, term, tf, df, tf::DOUBLE AS a, (cf - tf)::DOUBLE AS b, length - tf AS c, n - length - cf + tf AS d, cf, length, n
      FROM p JOIN t USING (term) JOIN l USING (doc_id) CROSS JOIN n),
g AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a * n / (cf * length)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * n / (cf * (n - length))) ELSE 0 END
      + CASE WHEN c > 0 THEN c * ln(c * n / ((n - cf) * length)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * n / ((n - cf) * (n - length))) ELSE 0 END) AS g FROM x)
SELECT doc_id, term, tf, df, round(CASE WHEN a * (n - length) < b * length THEN -1 ELSE 1 END * greatest(g, 0), 3) AS llr FROM g""",
}
