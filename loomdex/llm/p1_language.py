"""Problem 1: the language of every document and of every segment of a mixed one, with a confidence.

Units are the title and the sentences of the content, split as in problem 9; a field list is one unit made of its field names. Look-alike characters are
first brought to one form. language.py has the mixture inference. The models are fitted twice: on lang_samples, then also on those units of a bounded
sample of labelled rows that the first models place in the language of the row's label, which adds words such as field names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.language import LanguageModel, fit, main_words, mixture, price, script_words
from loomdex.llm.normal import is_stable, normal_form, scripts_of
from loomdex.llm.p3_copies import LEAST_PARTS
from loomdex.llm.p9_sentences import MOST_SHARED, corpus_evidence, made_splitter, with_evidence
from loomdex.llm.sentences import Splitter, splitter
from loomdex.session import spread, table

#: Most rows of lang_samples and most labelled documents that the models are fitted on.
MOST_SAMPLES, MOST_LABELLED = 20_000, 2_000
#: Most characters of those labelled documents together; only documents of at most their even share are taken, whole.
MOST_CHARACTERS = 8_000_000
#: A unit of such a document may speak against its language by this much, about a word and a half, and still be learned from.
SLACK = 10.0

_PARTS, _NAMED = re.compile(r"[;|\r\n]+"), re.compile(r"\s*([^:=]*[^\W_][^:=]*)[:=].*\S")


def field_names(content: str) -> str | None:
    """The field names of a field list, parted by blanks; None for other texts."""
    parts = [p for p in _PARTS.split(content) if p.strip()]
    if len(parts) < LEAST_PARTS:
        return None
    named = [_NAMED.match(p) for p in parts]
    return " ".join(m[1].strip() for m in named) if all(named) else None


Unit = tuple[str, int, int, list[str], bool]


def units(title: str | None, content: str | None, split: Splitter | None = None) -> list[Unit]:
    """(part, start, end, words, whether of one script) of a document's units; offsets in code points of the part as it is. Blank units are left out."""
    out: list[Unit] = []
    if title and title.strip():
        out.append(("title", 0, len(title), *main_words(normal_form(title))))
    if content and content.strip():
        names = field_names(content) if ":" in content or "=" in content else None
        if names is not None:
            out.append(("content", 0, len(content), *main_words(normal_form(names))))
        else:
            stable = is_stable(content)
            plain = stable and scripts_of(content) < 2  # letters of one script only: none is taken for another's
            for a, b in (split or splitter()).split(content):
                piece = content[a:b]
                out.append(("content", a, b, *main_words(piece if plain else normal_form(piece, stable))))
    return out


def label_codes(codes: DataFrame) -> dict[str, str]:
    """Label forms and the language they name; a fixed table of a few dozen rows."""
    return {r["label_form"]: r["lang"] for r in codes.select("label_form", "lang").collect() if r["label_form"] and r["lang"]}


def _labelled(docs: DataFrame) -> list:
    """At most MOST_LABELLED labelled documents by hash, of MOST_CHARACTERS characters together; longer ones never reach the driver."""
    short = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("content", F.lit(""))) <= MOST_CHARACTERS // MOST_LABELLED
    rows = docs.where(F.col("lang_label").isNotNull() & short).select("doc_id", "title", "content", "lang_label")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).collect()


def train(samples: DataFrame, docs: DataFrame, codes: dict[str, str]) -> LanguageModel:
    """Models from at most MOST_SAMPLES sample sentences and MOST_LABELLED labelled documents, the latter taken by hash."""
    own = [(r["lang"], normal_form(r["sample_text"])) for r in samples.select("lang", "sample_text").limit(MOST_SAMPLES).collect() if r["lang"]]
    langs = sorted({x for x, _ in own})
    if not langs:
        raise ValueError("no sample sentences to fit languages on")
    first = fit(own, langs)
    labelled = _labelled(docs)
    more: list[tuple[str, str]] = []
    for r in labelled:
        lang = codes.get(r["lang_label"])
        if lang not in first.langs:
            continue
        i = first.langs.index(lang)
        found = units(r["title"], r["content"])
        scores = first.scores([u[3] for u in found], [u[4] for u in found])
        mostly = scores.sum(axis=0).argmax() == i if found else False
        sure = [bool(u[3]) and mostly and scores[k].max() - scores[k][i] < SLACK for k, u in enumerate(found)]
        listed = field_names(r["content"] or "") is not None
        for k, (part, a, b, *_) in enumerate(found):
            if listed and part == "content":
                if len(found) == 2 and sure[0]:
                    more.append((lang, normal_form(field_names(r["content"]) or "")))
            elif sure[k]:
                more.append((lang, normal_form((r["title"] if part == "title" else r["content"])[a:b])))
    return fit([*own, *more], langs)


def infer(model: LanguageModel, docs: list[list[tuple[str, int, int, list[str], bool]]]) -> list[tuple[int, float]]:
    """(language, confidence) of every unit of some documents, by each document's mixture.

    Documents in which no further language could gain enough, whatever its share, are settled together; the others go through the mixture one
    by one. Units without words take their document's main language at confidence 0; those of a document without any word have none (-1).
    """
    sizes = np.array([len(d) for d in docs])
    first = np.cumsum(sizes) - sizes
    scores = model.scores([u[3] for d in docs for u in d], [u[4] for d in docs for u in d])
    n = len(scores)
    if not n:
        return []
    told = np.fromiter((bool(u[3]) for d in docs for u in d), bool, n)
    full = np.flatnonzero(sizes)
    doc = np.repeat(np.arange(len(full)), sizes[full])
    totals = np.add.reduceat(scores, first[full], axis=0)
    bound = np.add.reduceat(scores.max(axis=1), first[full])
    many = bound - totals.max(axis=1) > price(np.add.reduceat(told, first[full], dtype=np.int64))
    weight = np.full((n, len(model.langs)), np.log(1e-3))
    own = totals.argmax(axis=1)[doc]
    weight[np.arange(n), own] = 0.0
    for k in np.flatnonzero(many):
        at = slice(first[full[k]], first[full[k]] + sizes[full[k]])
        chosen, shares = mixture(scores[at][told[at]])
        weight[at] = np.log(1e-3)
        weight[at, chosen] = np.log(np.maximum(shares, 1e-6))
        own[at] = np.where(told[at], np.array(chosen)[(scores[at] + weight[at])[:, chosen].argmax(axis=1)], chosen[0])
    joint = scores + weight
    sure = np.exp(joint - joint.max(axis=1, keepdims=True))
    sure = sure[np.arange(n), own] / sure.sum(axis=1)
    any_told = np.logical_or.reduceat(told, first[full])[doc]
    return list(zip(np.where(any_told, own, -1).tolist(), np.where(told, sure, 0.0).tolist(), strict=True))


def settled(model: LanguageModel, docs: list[tuple[str | None, str | None]]) -> list[int]:
    """The language of each document that needs no splitting, since no mixture could gain enough; -1 for others.

    As each word's likelihoods are relative to its best language, no mixture over any units gets above zero. A document of one script whose
    words together fall short of zero by no more than a further language costs at least is therefore in one language.
    """
    own: list[list[str]] = []
    at: list[int] = []
    for i, (title, content) in enumerate(docs):
        if content and (":" in content or "=" in content) and field_names(content) is not None:
            continue
        parts = [script_words(x if is_stable(x) and scripts_of(x) < 2 else normal_form(x)) for x in (title, content) if x and x.strip()]
        if all(single for _, single, _ in parts) and len(scripts := {main for _, _, main in parts if main}) == 1:
            own.append([w for found, *_ in parts for w in found])
            at.append(i)
    out = [-1] * len(docs)
    if at:
        scores = model.scores(own, [False] * len(own))
        best = scores.argmax(axis=1)
        for k in np.flatnonzero(-scores.max(axis=1) <= price(1)):
            if model.written(own[k][0])[best[k]]:
                out[at[k]] = int(best[k])
    return out


_SEGMENTS = "doc_id long, part string, start_at int, end_at int, lang string, confidence double, named string"


def _label(model, codes: dict[str, str], evidence, brief: bool):
    """Segments, or, if `brief`, one row per document and language with a word in it, without places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        shared = made_splitter(evidence.value) if evidence else None
        for batch in batches:
            ids, titles, contents, labels = (batch.column(i).to_pylist() for i in range(4))
            splits = [shared] * len(ids) if shared else [made_splitter((t["word"], t["kind"]) for t in told or ()) for told in batch.column(4).to_pylist()]
            sure = settled(own, list(zip(titles, contents, strict=True))) if brief else [-1] * len(ids)
            rows = [(i, None, None, None, own.langs[lang], 1.0, codes.get(label)) for i, label, lang in zip(ids, labels, sure, strict=True) if lang >= 0]
            rest = [k for k, lang in enumerate(sure) if lang < 0]
            found = [units(titles[k], contents[k], splits[k]) for k in rest]
            heads = ((ids[k], part, a, b, codes.get(labels[k])) for k, us in zip(rest, found, strict=True) for part, a, b, *_ in us)
            rows += [(i, part, a, b, own.langs[lang] if lang >= 0 else None, at, named) for (i, part, a, b, named), (lang, at) in zip(heads, infer(own, found), strict=True)]
            if brief:
                rows = list({(r[0], r[4]): r for r in rows if r[5] > 0 and r[4] is not None}.values())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "part", "start_at", "end_at", "lang", "confidence", "named"])

    return run


def segments(docs: DataFrame, samples: DataFrame, codes_table: DataFrame, brief: bool = False, most_shared: int = MOST_SHARED) -> DataFrame:
    """(doc_id, part, start_at, end_at, lang, confidence, named) of every unit of every document.

    `named` is the language that the label names, NULL if none. NULL title or content is empty; a blank document has no units; units of
    documents without any letter have no language. Texts are always read whole. With `brief`, one row per document and language instead,
    without places or those without a language, for which documents of one language for certain needn't be split.
    """
    codes = label_codes(codes_table)
    model = train(samples, docs, codes)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # its size is bounded by MOST_SAMPLES and MOST_CHARACTERS
    rows = spread(docs.select(F.col("doc_id").cast("long"), "title", "content", "lang_label"))
    evidence = corpus_evidence(rows.select("content"))
    if evidence.count() > most_shared:
        told = with_evidence(rows.withColumn("text", F.col("content")), evidence, "doc_id").select("doc_id", "title", "content", "lang_label", "told")
        return told.mapInArrow(_label(shared, codes, None, brief), _SEGMENTS)
    return rows.mapInArrow(_label(shared, codes, context.broadcast([tuple(r) for r in evidence.collect()]), brief), _SEGMENTS)


def _segments(spark: SparkSession, sf_dir: str, brief: bool = False) -> DataFrame:
    return segments(table(spark, sf_dir, "doc_store"), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "lang_codes"), brief)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in which a document's title, content or a whole sentence is written, other than the one its label names."""
    return _segments(spark, sf_dir, brief=True).where(~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "lang").distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's languages with their shares of its text and mean confidence."""
    found = _segments(spark, sf_dir).where(F.col("lang").isNotNull()).withColumn("size", F.col("end_at") - F.col("start_at"))
    per = found.groupBy("doc_id", "lang").agg(F.sum("size").alias("size"), F.avg("confidence").alias("confidence"), F.first("named").alias("named"))
    whole = F.sum("size").over(Window.partitionBy("doc_id"))
    return per.select("doc_id", "lang", (F.col("size") / F.greatest(whole, F.lit(1))).alias("share"), "confidence", "named")


QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments, "p1_documents": p1_documents}
SQL: dict[str, str] = {}
