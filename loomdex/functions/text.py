"""Text analysis as Catalyst expressions: lowering, splitting, stop words, k-grams and wildcards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything between two tokens.
SPLIT = r"[^\p{L}\p{N}]+"


def lowered(text: Column) -> Column:
    """Rune-wise lower case: a dotted capital I gives a plain i and a capital sigma never the final form."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def split_tokens(text: Column) -> Column:
    """Maximal runs of letters and numbers of an already lowered text; empty for NULL."""
    return F.filter(F.coalesce(F.split(text, SPLIT), F.array().cast("array<string>")), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text in order, with repetitions; empty for NULL or a text without letters and numbers."""
    return split_tokens(lowered(text))


def titled(title: Column, content: Column) -> Column:
    """Title, a space, content; NULL counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
