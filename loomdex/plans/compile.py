"""Boolean queries as Spark plans.

`scan`: one filter over documents that carry their terms as an array; no shuffle. `flags` (the default): one pass over the postings that match any
leaf, one aggregation by document whatever the number of leaves; leaves that only stand in one OR are one flag together. `relational`: a semi join,
union or anti join per node. Postings may hold ids of removed documents: `live` takes them out of what is found, so that only a query with a
negation reads the documents.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.kgram import like_pattern
from loomdex.functions.stemmers import stem
from loomdex.plans.query import And, Leaf, Not, Or, Prefix, Query, Term, Wildcard, fold, holds, leaves

#: Gives a predicate over a term column.
Predicate = Callable[[Column], Column]


def normalise(word: str, stemmed: bool = True) -> str:
    """A query word as it stands in the index: trimmed, in small letters, stemmed; neither split nor checked for stop words."""
    word = word.strip().translate({ord("İ"): "i", ord("Σ"): "σ"}).lower()
    return stem(word) if stemmed else word


def predicate(leaf: Leaf, stemmed: bool = True) -> Predicate:
    """What a term must be to match the leaf. An empty word or prefix matches nothing; a wildcard isn't stemmed."""
    if isinstance(leaf, Wildcard):
        pattern = normalise(leaf.pattern, stemmed=False)
        if "*" in pattern:
            return lambda term: term.like(like_pattern(pattern))
        leaf = Term(pattern)
    word = normalise(leaf.text, stemmed)
    if not word:
        return lambda term: F.lit(False)
    return (lambda term: term.startswith(word)) if isinstance(leaf, Prefix) else (lambda term: term == word)


def joined(parts: list[Column], both: Callable[[Column, Column], Column]) -> Column:
    """All parts under one operator, as a balanced tree, since Catalyst goes down deep ones by recursion."""
    while len(parts) > 1:
        parts = [both(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def combine(query: Query, value: Callable[[Leaf], Column]) -> Column:
    def node(at: Query, parts: list[Column]) -> Column:
        return ~parts[0] if isinstance(at, Not) else joined(parts, operator.and_ if isinstance(at, And) else operator.or_)

    return fold(query, value, node)


@dataclass(frozen=True)
class AnyOf:
    """Leaves of one OR chain: a document has one of them if one posting matches any."""

    leaves: tuple[Leaf, ...]


def grouped(query: Query) -> Query:
    """The query with the leaves of each OR chain as one AnyOf."""

    def node(at: Query, parts: list) -> Query:
        if isinstance(at, Not):
            return Not(parts[0])
        if isinstance(at, And):
            return And(*parts)
        single = tuple(x for p in parts if isinstance(p, AnyOf) for x in p.leaves)
        rest = [p for p in parts if not isinstance(p, AnyOf)]
        every = [*([AnyOf(tuple(dict.fromkeys(single)))] if single else []), *rest]
        return every[0] if len(every) == 1 else Or(*every)

    return fold(query, lambda leaf: AnyOf((leaf,)), node)


def any_predicate(group: AnyOf, stemmed: bool = True) -> Predicate:
    """What a term must be to match one of the leaves; plain terms are looked up in one set."""
    words = sorted({w for leaf in group.leaves if isinstance(leaf, Term) and (w := normalise(leaf.text, stemmed))})
    others = [predicate(leaf, stemmed) for leaf in group.leaves if not isinstance(leaf, Term)]

    def test(term: Column) -> Column:
        parts = [p(term) for p in others]
        if words:
            parts.append(term == words[0] if len(words) == 1 else term.isin(words))
        return joined(parts, operator.or_) if parts else F.lit(False)

    return test


def scan(query: Query, documents: DataFrame, stemmed: bool = True) -> DataFrame:
    """Ids (doc_id) of `documents` (doc_id, terms) for which the query holds."""

    def value(group: AnyOf) -> Column:
        leaf = group.leaves[0]
        if len(group.leaves) == 1 and isinstance(leaf, Term) and normalise(leaf.text, stemmed):
            return F.array_contains("terms", normalise(leaf.text, stemmed))
        return F.exists("terms", any_predicate(group, stemmed))

    return documents.where(combine(grouped(query), value)).select("doc_id")


Live = Callable[[DataFrame], DataFrame]


def flags(query: Query, postings: DataFrame, universe: DataFrame, stemmed: bool = True, live: Live = lambda ids: ids) -> DataFrame:
    """Ids for which the query holds over `postings` (term, doc_id).

    A query that can hold for a document without any of its leaves starts from the `universe` (doc_id) of live documents, any other from the
    postings that match.
    """
    query = grouped(query)
    own = leaves(query)
    tests = [any_predicate(group, stemmed) for group in own]
    hits = postings.where(joined([t(F.col("term")) for t in tests], operator.or_))
    marked = hits.groupBy("doc_id").agg(*[F.max(t(F.col("term"))).alias(f"f{i}") for i, t in enumerate(tests)])
    at = {group: i for i, group in enumerate(own)}
    if holds(query, lambda group: False):
        whole = universe.select("doc_id").join(marked, "doc_id", "left")
        return whole.where(combine(query, lambda group: F.coalesce(F.col(f"f{at[group]}"), F.lit(False)))).select("doc_id")
    return live(marked.where(combine(query, lambda group: F.col(f"f{at[group]}"))).select("doc_id"))


def relational(query: Query, postings: DataFrame, universe: DataFrame, stemmed: bool = True, live: Live = lambda ids: ids) -> DataFrame:
    """As `flags`, by one join or union per node."""

    def found(group: AnyOf) -> DataFrame:
        return live(postings.where(any_predicate(group, stemmed)(F.col("term"))).select("doc_id").distinct())

    def node(at: Query, parts: list[DataFrame]) -> DataFrame:
        if isinstance(at, Not):
            return universe.select("doc_id").join(parts[0], "doc_id", "left_anti")
        if isinstance(at, Or):
            return reduce(DataFrame.union, parts).distinct()
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), parts)

    return fold(grouped(query), found, node)
