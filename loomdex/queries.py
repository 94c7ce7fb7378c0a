"""The engine's own queries over the test tables, and the same results in SQL.

Each query reads its whole tables. SQL has no stemmer, so most searches that are compared with it run on an index without stemming; those with it are
named stemmed_... and their SQL lists the words of the stems they ask for. stem_terms alone has no SQL; stem_samples holds the stemmers to published stems.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.stopwords import ENGLISH, RUSSIAN, stop_words
from loomdex.functions.text import titled, tokens
from loomdex.operators import idsets, lsm, mutate
from loomdex.operators.analyse import document_frequencies, kept_tokens, stemmed_terms
from loomdex.operators.ids import with_ids
from loomdex.operators.index import SearchIndex, build_index
from loomdex.plans.query import QueryError, parse
from loomdex.session import shared_dir, spread, table
from loomdex.sources.demo import demo_documents
from loomdex.sources.store import IndexStore
from loomdex.streaming.ingest import ingest


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as the engine's documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "external_id", "title", F.col("text").alias("content"))


def index(spark: SparkSession, sf_dir: str, stemmed: bool = False, language: str = "mixed") -> SearchIndex:
    return build_index(spread(corpus(spark, sf_dir)), language, stemmed)


# Words and their stems as published with the stemmers' descriptions.
PUBLISHED_STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн важнейшие важн
важнейшими важн важничал важнича важно важн важного важн важное важн важной важн важном важн важному важн важности важност важностию важност
важность важност важностью важност важную важн важны важн важные важн важный важн важным важн важных важн вазах ваз вазы ваз вакса вакс
вакханка вакханк вал вал валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет пава пав павел павел
павильон павильон павильонам павильон павла павл павлиний павлин павлиньи павлин павлиньим павлин павлович павлович павловна павловн
павловны павловн павловцы павловц павлыч павлыч пагубная пагубн падает пада падай пада падал пада падаль падал падать пада падающий пада
падеж падеж падение паден падением паден падениях паден
""".split()


# text analysis


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tokens(titled(F.col("title"), F.col("content")))).alias("at", "token"))


def stopword_filter(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", F.explode(kept_tokens(titled(F.col("title"), F.col("content")), language)).alias("token"))


def is_stopword(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize(spark, sf_dir).select("token").distinct()
    return found.select("token", F.col("token").isin(sorted(stop_words("mixed"))).alias("is_stop"))


def analyze_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).posts.select("doc_id", "term")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_frequencies(index(spark, sf_dir).posts)


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).posts.select("term").distinct().agg(F.count("*").alias("n"))


def term_kgram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).kgrams()


def kgram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).kgram_candidates("lan*rn")


def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, stemmed=True).posts.select("doc_id", "term")


def stem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published words through the analysis of an index; a table of its own that reads no data."""
    words = spark.createDataFrame([(i, [w]) for i, w in enumerate(PUBLISHED_STEMS[::2])], "doc_id long, terms array<string>")
    return words.join(stemmed_terms(words).withColumnRenamed("terms", "stems"), "doc_id").select(F.col("terms")[0].alias("word"), F.col("stems")[0].alias("stem"))


# search


def search(spark: SparkSession, sf_dir: str, query: str, plan: str = "flags", stemmed: bool = False) -> DataFrame:
    return index(spark, sf_dir, stemmed).ids(query, plan)


def search_count(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return search(spark, sf_dir, query).agg(F.count("*").alias("n"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).universe()


def raw_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).raw_term("lantern")


def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).agg(F.count("*").alias("n"))


def get_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).search("otter AND lantern").select("doc_id", "title", "content")


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).get_document(42).select("doc_id", "title", "content")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats()


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).listing()


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed trees; a table of its own that reads no data."""
    rows = [(q, str(parse(q))) for q in ("a OR b AND c", "NOT (a OR b*)", "x*y and not z")]
    return spark.createDataFrame(rows, "query string, tree string")


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of queries that can't be parsed; a table of its own that reads no data."""

    def said(query: str) -> str | None:
        try:
            parse(query)
        except QueryError as e:
            return str(e)
        return None

    return spark.createDataFrame([(q, said(q)) for q in ("", "cats dogs", "cats)", "(cats", "()", "cats AND", "not", "cats")], "query string, message string")


def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found documents as the command line lists them."""
    own = index(spark, sf_dir)
    return replace(own, documents=own.search("otter AND lantern")).listing(80)


def demo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the demonstration documents, which are no table."""
    docs = demo_documents(spark).select((F.col("at") + 1).alias("doc_id"), "external_id", "title", "content")
    return build_index(docs).search("(cat OR dog) AND NOT summer").select("doc_id", "external_id")


def removed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after the documents of some external ids have been removed from the index."""
    own = index(spark, sf_dir)
    left, _ = own.without(corpus(spark, sf_dir).where(F.col("title").like("The Book%")))
    return left.ids("otter OR NOT lantern")


def removed_existed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which external ids to remove existed, of all those that the log of commands names."""
    return index(spark, sf_dir).without(table(spark, sf_dir, "mutations").where("op = 'remove'").select("external_id"))[1]


# id sets


def _set(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    return index(spark, sf_dir).term(word)


def set_op(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    a, b = _set(spark, sf_dir, "otter"), _set(spark, sf_dir, "lantern")
    return idsets.complement(a, universe(spark, sf_dir)) if op == "complement" else getattr(idsets, op)(a, b)


def bitmap_op(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    a, b = (idsets.to_bitmaps(_set(spark, sf_dir, w)) for w in ("otter", "lantern"))
    return idsets.from_bitmaps(getattr(idsets, op)(a, b))


def bitmap_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idsets.cardinality(idsets.to_bitmaps(_set(spark, sf_dir, "otter")))


def bitmap_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To compressed sets and back."""
    return idsets.from_compressed(idsets.to_compressed(_set(spark, sf_dir, "otter")))


def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idsets.contains(_set(spark, sf_dir, "otter"), 42)


def set_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idsets.is_empty(_set(spark, sf_dir, "the"))


def set_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending ids, written out."""
    return idsets.id_arrays(_set(spark, sf_dir, "otter")).select("bucket", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


def set_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idsets.remove(idsets.add(_set(spark, sf_dir, "otter"), -5, 42), 1, 2, 3)


def posting_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "segments").where("kv_value IS NOT NULL")
    return rows.select("row_id", F.explode(idsets.decode_ids(F.col("kv_value"))).alias("doc_id"))


# key-value segments


def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.newest(table(spark, sf_dir, "segments")).select("kv_key", "kv_value", "row_id")


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.point_get(table(spark, sf_dir, "segments"), "goose").select("kv_key", "kv_value", "row_id")


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.range_scan(table(spark, sf_dir, "segments"), *lsm.posting_range("lantern")).select("kv_key", "kv_value", "row_id")


def posting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of each term's postings, united at read."""
    live = lsm.newest(table(spark, sf_dir, "segments"))
    return live.select(lsm.posting_term(F.col("kv_key")).alias("term"), F.explode(idsets.decode_ids(F.col("kv_value"))).alias("doc_id")).distinct()


# mutations


def mutation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.replay(table(spark, sf_dir, "mutations"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_store row by row into a store: the newest row of each external id stays, under its place among all rows."""
    rows = table(spark, sf_dir, "doc_store").select(F.col("doc_id").alias("row"), F.coalesce("external_id", F.lit("")).alias("external_id"))
    numbered = with_ids(rows, ["row"])
    return numbered.groupBy("external_id").agg(F.max("doc_id").alias("doc_id"))


def _new_store(spark: SparkSession, **kind) -> IndexStore:
    """An empty store in the shared folder, which is deleted when the process ends, since results are read after the query has returned."""
    store = IndexStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", **kind)

    def drop() -> None:
        with suppress(Exception):  # the session may have ended
            store.files.drop("")

    atexit.register(drop)
    return store


def _store(spark: SparkSession, sf_dir: str, **kind) -> IndexStore:
    """A store of its own in the shared folder, with the documents in two batches, some replaced and some removed."""
    store = _new_store(spark, stemmed=False, **kind)
    docs = corpus(spark, sf_dir)
    half = F.col("doc_id") % 2
    store.add(docs.where(half == 0), ["doc_id"])
    store.add(docs.where(half == 1), ["doc_id"])
    store.remove(docs.where(F.col("title").like("The Book%")).select("external_id"))
    return store


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).documents().select("doc_id", "external_id", "title", "content")


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).index().ids("otter AND NOT lantern")


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.compact()
    reopened = IndexStore(spark, store.root)
    return reopened.index().ids("otter AND NOT lantern")


def store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels so small that every change compacts."""
    return _store(spark, sf_dir, level_bytes=1, ratio=2).index().ids("otter AND NOT lantern", "relational")


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).stats().select("document_count", "next_doc_id", "segments")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of commands as a stream into a store: the documents that it leaves."""
    store = _new_store(spark, stemmed=False)
    log = spark.readStream.schema(table(spark, sf_dir, "mutations").schema).parquet(f"{sf_dir}/mutations.parquet*")
    ingest(log, store, f"{store.root}-checkpoint").awaitTermination()
    return store.documents().select("external_id", "title", "content")


#: Name of each search query, with the query, the plan, and its SQL over t(doc_id, term) and u(doc_id).
_SEARCHES: dict[str, tuple[str, str, str]] = {
    "term": ("lantern", "flags", "SELECT doc_id FROM t WHERE term = 'lantern'"),
    "term_cyrillic": ("Гусь", "flags", "SELECT doc_id FROM t WHERE term = 'гусь'"),
    "prefix": ("lant*", "flags", "SELECT DISTINCT doc_id FROM t WHERE starts_with(term, 'lant')"),
    "wildcard_mid": ("l*rn", "flags", "SELECT DISTINCT doc_id FROM t WHERE term LIKE 'l%rn'"),
    "wildcard_multi": ("*a*t*n", "relational", "SELECT DISTINCT doc_id FROM t WHERE term LIKE '%a%t%n'"),
    "wildcard_star": ("*", "flags", "SELECT DISTINCT doc_id FROM t"),
    "and": ("otter AND lantern", "flags", "SELECT doc_id FROM t WHERE term = 'otter' INTERSECT SELECT doc_id FROM t WHERE term = 'lantern'"),
    "or": ("otter OR гусь", "relational", "SELECT doc_id FROM t WHERE term = 'otter' UNION SELECT doc_id FROM t WHERE term = 'гусь'"),
    "not": ("NOT otter", "flags", "SELECT doc_id FROM u WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'otter')"),
    "and_not": ("otter AND NOT lantern", "scan", "SELECT doc_id FROM t WHERE term = 'otter' EXCEPT SELECT doc_id FROM t WHERE term = 'lantern'"),
    "nested_parens": ("((otter OR fox) AND (NOT (lantern)))", "flags", "SELECT doc_id FROM t WHERE term IN ('otter', 'fox') EXCEPT SELECT doc_id FROM t WHERE term = 'lantern'"),
    "double_not": ("NOT NOT otter", "relational", "SELECT doc_id FROM t WHERE term = 'otter'"),
    "lowercase_keywords": ("otter and not lantern or fox", "flags", "(SELECT doc_id FROM t WHERE term = 'otter' EXCEPT SELECT doc_id FROM t WHERE term = 'lantern') UNION SELECT doc_id FROM t WHERE term = 'fox'"),
    "not_stopword_all": ("NOT the", "flags", "SELECT doc_id FROM u"),
    "not_complex": ("NOT (otter OR fo*) AND NOT *карт*", "scan", "SELECT doc_id FROM u WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'otter' OR starts_with(term, 'fo') OR term LIKE '%карт%')"),
}

QUERIES = {
    "tokenize": tokenize,
    "stopword_filter_mixed": partial(stopword_filter, language="mixed"),
    "stopword_filter_english": partial(stopword_filter, language="english"),
    "stopword_filter_russian": partial(stopword_filter, language="russian"),
    "is_stopword": is_stopword,
    "analyze_distinct": analyze_distinct,
    "postings": analyze_distinct,
    "doc_freq": doc_freq,
    "vocab_size": vocab_size,
    "term_kgrams": term_kgram_rows,
    "kgram_candidates": kgram_candidates,
    "stem_terms": stem_terms,
    "stem_samples": stem_samples,
    "doc_count": doc_count,
    "universe": universe,
    "raw_term": raw_term,
    "get_documents": get_documents,
    "get_document": get_document,
    "stats": stats,
    "listing": listing,
    "parsed": parsed,
    "parse_errors": parse_errors,
    "search_listing": search_listing,
    "demo_search": demo_search,
    "removed_search": removed_search,
    "removed_existed": removed_existed,
    **{name: partial(search, query=q, plan=plan) for name, (q, plan, _) in _SEARCHES.items()},
    "stopword_term_empty": partial(search_count, query="the"),
    "punctuated_term_empty": partial(search_count, query="one-two"),
    "stemmed_term": partial(search, query="repairing", stemmed=True),
    "stemmed_term_cyrillic": partial(search, query="гуси OR тетрадями", stemmed=True),
    "stemmed_prefix": partial(search, query="repairing*", stemmed=True),
    "stemmed_and_not": partial(search, query="otters AND NOT lanterns", stemmed=True),
    "set_intersect": partial(set_op, op="intersect"),
    "set_unite": partial(set_op, op="unite"),
    "set_subtract": partial(set_op, op="subtract"),
    "set_complement": partial(set_op, op="complement"),
    "bitmap_and": partial(bitmap_op, op="bitmap_and"),
    "bitmap_or": partial(bitmap_op, op="bitmap_or"),
    "bitmap_cardinality": bitmap_cardinality,
    "bitmap_compressed": bitmap_compressed,
    "set_contains": set_contains,
    "set_is_empty": set_is_empty,
    "set_arrays": set_arrays,
    "set_add_remove": set_add_remove,
    "posting_decode": posting_decode,
    "segment_merge": segment_merge,
    "point_get": point_get,
    "range_scan": range_scan,
    "posting_terms": posting_terms,
    "mutation_replay": mutation_replay,
    "upsert": upsert,
    "store_documents": store_documents,
    "store_search": store_search,
    "store_compacted": store_compacted,
    "store_levels": store_levels,
    "store_stats": store_stats,
    "stream_ingest": stream_ingest,
}


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_RAW = r"""
full_text AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[^\p{L}\p{N}]+') AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS term FROM full_text)"""
_T = f"""{_RAW},
t AS (SELECT DISTINCT doc_id, term FROM raw WHERE term <> '' AND term NOT IN ({_words(ENGLISH + RUSSIAN)})),
u AS (SELECT doc_id FROM documents)"""
_KGRAMS = "k AS (SELECT DISTINCT substr('$' || term || '$', i::INT, 3) AS gram, term FROM (SELECT DISTINCT term FROM t), LATERAL (SELECT unnest(generate_series(1, length(term))) AS i))"
_PAIR = "a AS (SELECT doc_id FROM t WHERE term = 'otter'), b AS (SELECT doc_id FROM t WHERE term = 'lantern')"
_NEWEST = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kv_key ORDER BY segment_seq DESC, row_id DESC) AS r FROM segments WHERE kv_key IS NOT NULL)
      WHERE r = 1 AND NOT coalesce(tombstone, false))"""
_IDS = "list_transform(range(0, octet_length(from_base64(kv_value)) // 4), lambda i: ('0x' || hex(from_base64(kv_value))[8*i+7:8*i+8] || hex(from_base64(kv_value))[8*i+5:8*i+6] || hex(from_base64(kv_value))[8*i+3:8*i+4] || hex(from_base64(kv_value))[8*i+1:8*i+2])::BIGINT)"
_STORE = """
numbered AS (SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id) AS new_id, coalesce(external_id, '') AS external_id, coalesce(title, '') AS title, coalesce(text, '') AS content FROM documents),
live AS (SELECT new_id AS doc_id, external_id, title, content FROM numbered
  WHERE new_id IN (SELECT max(new_id) FROM numbered GROUP BY external_id) AND external_id NOT IN (SELECT external_id FROM documents WHERE title LIKE 'The Book%' AND external_id IS NOT NULL))"""
_STORE_SEARCH = rf"""WITH {_STORE},
raw AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(title || ' ' || content), '[^\p{{L}}\p{{N}}]+')) AS term FROM live)
SELECT doc_id FROM raw WHERE term = 'otter' EXCEPT SELECT doc_id FROM raw WHERE term = 'lantern'"""


def _filtered(words: list[str]) -> str:
    return f"WITH {_RAW} SELECT doc_id, term AS token FROM raw WHERE term <> '' AND term NOT IN ({_words(words)})"


SQL = {
    "tokenize": f"WITH {_RAW}, f AS (SELECT doc_id, list_filter(parts, lambda x: x <> '') AS p FROM full_text) SELECT doc_id, (unnest(generate_series(1, len(p))) - 1)::INT AS at, unnest(p) AS token FROM f",
    "stopword_filter_mixed": _filtered(ENGLISH + RUSSIAN),
    "stopword_filter_english": _filtered(ENGLISH),
    "stopword_filter_russian": _filtered(RUSSIAN),
    "is_stopword": f"WITH {_RAW} SELECT DISTINCT term AS token, term IN ({_words(ENGLISH + RUSSIAN)}) AS is_stop FROM raw WHERE term <> ''",
    "analyze_distinct": f"WITH {_T} SELECT doc_id, term FROM t",
    "postings": f"WITH {_T} SELECT doc_id, term FROM t",
    "doc_freq": f"WITH {_T} SELECT term, count(*) AS doc_count FROM t GROUP BY term",
    "vocab_size": f"WITH {_T} SELECT count(DISTINCT term) AS n FROM t",
    "term_kgrams": f"WITH {_T}, {_KGRAMS} SELECT gram, term FROM k",
    "kgram_candidates": f"WITH {_T}, {_KGRAMS} SELECT term FROM k WHERE gram IN ('$la', 'lan', 'rn$') GROUP BY term HAVING count(*) = 3",
    "doc_count": "SELECT count(*) AS n FROM documents",
    "universe": "SELECT doc_id FROM documents",
    "raw_term": f"WITH {_T} SELECT doc_id FROM t WHERE term = 'lantern'",
    "get_documents": f"WITH {_T} SELECT doc_id, title, text AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE term = 'otter') AND doc_id IN (SELECT doc_id FROM t WHERE term = 'lantern')",
    "get_document": "SELECT doc_id, title, text AS content FROM documents WHERE doc_id = 42",
    "stats": f"WITH {_T} SELECT (SELECT count(*) FROM documents) AS document_count, count(DISTINCT term) AS term_count FROM t",
    "listing": "SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN '(no title)' ELSE title END AS title, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS content FROM documents",
    "parsed": "SELECT * FROM (VALUES ('a OR b AND c', '(a OR (b AND c))'), ('NOT (a OR b*)', 'NOT (a OR b*)'), ('x*y and not z', '(x*y AND NOT z)')) AS v(query, tree)",
    **{name: f"WITH {_T} {sql}" for name, (_, _, sql) in _SEARCHES.items()},
    "stopword_term_empty": f"WITH {_T} SELECT count(*) AS n FROM t WHERE term = 'the'",
    "punctuated_term_empty": f"WITH {_T} SELECT count(*) AS n FROM t WHERE term = 'one-two'",
    "set_intersect": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b",
    "set_unite": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a UNION SELECT doc_id FROM b",
    "set_subtract": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b",
    "set_complement": f"WITH {_T}, {_PAIR} SELECT doc_id FROM u EXCEPT SELECT doc_id FROM a",
    "bitmap_and": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b",
    "bitmap_or": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a UNION SELECT doc_id FROM b",
    "bitmap_cardinality": f"WITH {_T}, {_PAIR} SELECT count(*) AS cardinality FROM a",
    "bitmap_compressed": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a",
    "set_contains": f"WITH {_T}, {_PAIR} SELECT count(*) > 0 AS contains FROM a WHERE doc_id = 42",
    "set_is_empty": f"WITH {_T} SELECT count(*) = 0 AS is_empty FROM t WHERE term = 'the'",
    "set_arrays": f"WITH {_T}, {_PAIR} SELECT CASE WHEN doc_id > 0 THEN 1 + (doc_id - 1) // 32768 ELSE -((-doc_id) // 32768) END AS bucket, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM a GROUP BY 1",
    "set_add_remove": f"WITH {_T}, {_PAIR} SELECT doc_id FROM a WHERE doc_id NOT IN (1, 2, 3) UNION SELECT unnest([-5, 42]) AS doc_id",
    "stem_samples": f"SELECT * FROM (VALUES {', '.join(f"('{w}', '{x}')" for w, x in zip(PUBLISHED_STEMS[::2], PUBLISHED_STEMS[1::2], strict=True))}) AS v(word, stem)",
    "stemmed_term": f"WITH {_T} SELECT DISTINCT doc_id FROM t WHERE term IN ('repair', 'repairs', 'repaired', 'repairing')",
    "stemmed_term_cyrillic": f"WITH {_T} SELECT DISTINCT doc_id FROM t WHERE term IN ('гуси', 'гуся', 'гусю', 'гусем', 'гусе', 'гусей', 'гусям', 'гусями', 'гусях', 'тетрадь', 'тетради', 'тетрадью', 'тетрадей', 'тетрадям', 'тетрадями', 'тетрадях')",
    "stemmed_prefix": f"WITH {_T} SELECT DISTINCT doc_id FROM t WHERE starts_with(term, 'repair')",
    "stemmed_and_not": f"WITH {_T} SELECT doc_id FROM t WHERE term IN ('otter', 'otters') EXCEPT SELECT doc_id FROM t WHERE term IN ('lantern', 'lanterns', 'lanterne')",
    "parse_errors": """SELECT * FROM (VALUES ('', 'empty query'), ('cats dogs', 'unexpected token at position 1: dogs'), ('cats)', 'unexpected token at position 1: )'), ('(cats', 'expected closing parenthesis'),
      ('()', 'expected closing parenthesis'), ('cats AND', 'unexpected end of query'), ('not', 'unexpected end of query'), ('cats', NULL)) AS v(query, message)""",
    "search_listing": f"""WITH {_T} SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN '(no title)' ELSE title END AS title, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS content
      FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE term = 'otter') AND doc_id IN (SELECT doc_id FROM t WHERE term = 'lantern')""",
    "demo_search": "SELECT * FROM (VALUES (1::BIGINT, 'doc1'), (3, 'doc3'), (8, 'doc8'), (10, 'doc10')) AS v(doc_id, external_id)",
    "removed_search": f"""WITH {_T}, left_ AS (SELECT doc_id FROM documents WHERE coalesce(external_id, '') NOT IN (SELECT coalesce(external_id, '') FROM documents WHERE title LIKE 'The Book%'))
      SELECT doc_id FROM left_ WHERE doc_id IN (SELECT doc_id FROM t WHERE term = 'otter') OR doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'lantern')""",
    "removed_existed": "SELECT DISTINCT coalesce(external_id, '') AS external_id, coalesce(external_id, '') IN (SELECT coalesce(external_id, '') FROM documents) AS existed FROM mutations WHERE op = 'remove'",
    "posting_decode": f"SELECT row_id, unnest({_IDS}) AS doc_id FROM segments WHERE kv_value IS NOT NULL",
    "segment_merge": f"WITH {_NEWEST} SELECT kv_key, kv_value, row_id FROM n",
    "point_get": f"WITH {_NEWEST} SELECT kv_key, kv_value, row_id FROM n WHERE kv_key = 'goose'",
    "range_scan": f"WITH {_NEWEST} SELECT kv_key, kv_value, row_id FROM n WHERE kv_key >= 'lantern' || chr(31) AND kv_key < 'lantern' || chr(32)",
    "posting_terms": f"WITH {_NEWEST} SELECT DISTINCT split_part(kv_key, chr(31), 1) AS term, unnest({_IDS}) AS doc_id FROM n WHERE kv_value IS NOT NULL",
    "mutation_replay": """
WITH m AS (SELECT step, op, coalesce(external_id, '') AS external_id, title, content FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY arrived_at) AS r FROM mutations) WHERE r = 1 AND op IN ('add', 'remove')),
a AS (SELECT *, CASE WHEN op = 'add' THEN sum(CASE WHEN op = 'add' THEN 1 ELSE 0 END) OVER (ORDER BY step) END::BIGINT AS doc_id, row_number() OVER (PARTITION BY external_id ORDER BY step DESC) AS r FROM m)
SELECT doc_id, external_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM a WHERE r = 1 AND op = 'add'""",
    "stream_ingest": """
WITH m AS (SELECT step, op, coalesce(external_id, '') AS external_id, title, content FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY arrived_at) AS r FROM mutations) WHERE r = 1 AND op IN ('add', 'remove')),
a AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY step DESC) AS r FROM m)
SELECT external_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM a WHERE r = 1 AND op = 'add'""",
    "upsert": "SELECT external_id, max(n) AS doc_id FROM (SELECT coalesce(external_id, '') AS external_id, row_number() OVER (ORDER BY doc_id) AS n FROM doc_store) GROUP BY external_id",
    "store_documents": f"WITH {_STORE} SELECT doc_id, external_id, title, content FROM live",
    "store_search": _STORE_SEARCH,
    "store_compacted": _STORE_SEARCH,
    "store_levels": _STORE_SEARCH,
    "store_stats": f"WITH {_STORE} SELECT (SELECT count(*) FROM live) AS document_count, (SELECT count(*) + 1 FROM documents) AS next_doc_id, 2::INT AS segments",
}
