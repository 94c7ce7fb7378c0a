"""Character k-grams of terms and of wildcard patterns, and patterns as LIKE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 3
EDGE = "$"


def term_kgrams(term: Column, k: int = K) -> Column:
    """All k-grams of $term$ in order, with repetitions; the padded term itself if it is shorter; empty for NULL and the empty term."""
    padded = F.concat(F.lit(EDGE), term, F.lit(EDGE))
    many = F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(F.coalesce(term, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(padded) < k, F.array(padded)).otherwise(many)


def pattern_kgrams(pattern: str, k: int = K) -> list[str]:
    """The k-grams that every term matching the pattern has; empty if no piece between stars is long enough."""
    pieces = pattern.split("*")
    if pattern == "":
        return []
    pieces[0] = EDGE + pieces[0] if pieces[0] else ""
    pieces[-1] = pieces[-1] + EDGE if pieces[-1] else ""
    return list(dict.fromkeys(p[i : i + k] for p in pieces for i in range(len(p) - k + 1)))


def like_pattern(pattern: str) -> str:
    """The pattern for LIKE: a star is any run of characters, everything else stands for itself."""
    return pattern.translate({ord("\\"): "\\\\", ord("%"): "\\%", ord("_"): "\\_", ord("*"): "%"})
