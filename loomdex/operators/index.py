"""A searchable index over documents: batch build, leaf look-ups and boolean search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.kgram import pattern_kgrams, term_kgrams
from loomdex.operators.analyse import document_terms, postings
from loomdex.plans.compile import flags, normalise, predicate, relational, scan
from loomdex.plans.query import Leaf, Prefix, Query, Term, Wildcard, parse


@dataclass(frozen=True)
class SearchIndex:
    """documents: doc_id, external_id, title, content of live documents; terms: (doc_id, terms); posts: (term, doc_id), which may hold ids of
    removed documents, those of `removed` (doc_id)."""

    documents: DataFrame
    posts: DataFrame
    terms: DataFrame | None = None
    language: str = "mixed"
    stemmed: bool = True
    removed: DataFrame | None = None

    def live(self, found: DataFrame) -> DataFrame:
        """`found`, of the postings, without removed documents."""
        return found if self.removed is None else found.join(self.removed.select("doc_id"), "doc_id", "left_anti")

    def without(self, external_ids: DataFrame) -> tuple[SearchIndex, DataFrame]:
        """The index without the documents of the external ids (external_id), and for each of these, once, whether it existed."""
        asked = external_ids.select(F.coalesce("external_id", F.lit("")).alias("external_id")).distinct()
        own = F.coalesce("external_id", F.lit(""))
        gone = self.documents.select("doc_id", own.alias("external_id")).join(asked, "external_id", "left_semi")
        told = asked.join(gone.select("external_id").distinct().withColumn("existed", F.lit(True)), "external_id", "left").select("external_id", F.coalesce("existed", F.lit(False)).alias("existed"))
        removed = gone.select("doc_id") if self.removed is None else gone.select("doc_id").union(self.removed.select("doc_id"))
        kept = self.documents.join(gone.select("doc_id"), "doc_id", "left_anti")
        terms = self.terms.join(gone.select("doc_id"), "doc_id", "left_anti") if self.terms is not None else None
        return replace(self, documents=kept, terms=terms, removed=removed), told

    def universe(self) -> DataFrame:
        return self.documents.select("doc_id")

    def ids(self, query: str | Query, plan: str = "flags") -> DataFrame:
        """Ids of the documents for which the query holds, by the named plan. Raises QueryError for a query that can't be parsed."""
        tree = parse(query) if isinstance(query, str) else query
        if plan == "scan":
            return scan(tree, self.terms, self.stemmed)
        return (relational if plan == "relational" else flags)(tree, self.posts, self.universe(), self.stemmed, self.live)

    def ascending(self, query: str | Query, plan: str = "flags") -> DataFrame:
        """The ids in ascending order."""
        return self.ids(query, plan).orderBy("doc_id")

    def search(self, query: str | Query, plan: str = "flags") -> DataFrame:
        """The documents themselves, ascending by id, neither ranked nor cut."""
        return self.get_documents(self.ids(query, plan))

    def lookup(self, leaf: Leaf) -> DataFrame:
        return self.live(self.posts.where(predicate(leaf, self.stemmed)(F.col("term"))).select("doc_id").distinct())

    def term(self, word: str) -> DataFrame:
        return self.lookup(Term(word))

    def raw_term(self, term: str) -> DataFrame:
        """By the term as it stands in the index."""
        return self.live(self.posts.where(F.col("term") == F.lit(term)).select("doc_id"))

    def prefix(self, word: str) -> DataFrame:
        return self.lookup(Prefix(word))

    def wildcard(self, pattern: str) -> DataFrame:
        return self.lookup(Wildcard(pattern))

    def get_document(self, doc_id: int) -> DataFrame:
        return self.documents.where(F.col("doc_id") == F.lit(doc_id))

    def get_documents(self, ids: DataFrame) -> DataFrame:
        """Live documents among the ids, ascending; ids without a document are skipped."""
        return self.documents.join(ids.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id")

    def vocabulary(self) -> DataFrame:
        """Distinct terms of live documents."""
        return self.live(self.posts).select("term").distinct()

    def kgrams(self) -> DataFrame:
        """(gram, term) of the vocabulary."""
        return self.vocabulary().select(F.explode(F.array_distinct(term_kgrams(F.col("term")))).alias("gram"), "term")

    def kgram_candidates(self, pattern: str) -> DataFrame:
        """Terms that have every k-gram of the pattern; all terms if it has none. A superset of the pattern's matches."""
        grams = pattern_kgrams(normalise(pattern, stemmed=False))
        if not grams:
            return self.vocabulary()
        return self.kgrams().where(F.col("gram").isin(grams)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("term")

    def stats(self) -> DataFrame:
        """One row: documents and distinct terms."""
        one = lambda d: d.withColumn("one", F.lit(1))
        n = one(self.documents.agg(F.count("*").alias("document_count")))
        return n.join(one(self.vocabulary().agg(F.count("*").alias("term_count"))), "one").drop("one")

    def listing(self, width: int = 60) -> DataFrame:
        """Every document, ascending, with its title or (no title) and the beginning of its content."""
        cut = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("..."))).otherwise(F.col("content"))
        return self.documents.select("doc_id", F.when(F.coalesce("title", F.lit("")) == "", "(no title)").otherwise(F.col("title")).alias("title"), cut.alias("content")).orderBy("doc_id")


def build_index(documents: DataFrame, language: str = "mixed", stemmed: bool = True) -> SearchIndex:
    """An index over documents (doc_id, external_id, title, content) with distinct ids. Nothing is computed until a result is asked for."""
    terms = document_terms(documents, language, stemmed)
    return SearchIndex(documents, postings(terms), terms, language, stemmed)
