"""A persistent index: Parquet segments, documents and removals under a manifest that is published in one step.

    <path>/manifest/<version>.json    what a version consists of; the highest version is current
    <path>/postings/<seq>/            (term, doc_id), sorted by term, with a Bloom filter on term
    <path>/documents/<seq>/           doc_id, external_id, title, content
    <path>/removed/<seq>/             ids that are no longer live
    <path>/steps/<seq>/               external_id, step: the last command of a stream that counted for each external id

Every change writes new folders first and then a manifest that names them, so a reader sees whole versions only and a crash leaves nothing but unnamed
folders. One writer at a time: publishing fails if another writer has published the same version. Reading fails loudly when a named folder is missing.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.analyse import document_terms, postings
from loomdex.operators.ids import with_ids
from loomdex.operators.index import SearchIndex
from loomdex.operators.lsm import over_budget
from loomdex.session import cut, spread

#: Bytes that level 0 may hold, and how many times as much each further level.
LEVEL_BYTES, RATIO = 10 << 20, 4
#: Kinds of folders.
KINDS = ("documents", "postings", "removed", "steps")
_DOCUMENT = "doc_id long, external_id string, title string, content string"


@dataclass(frozen=True)
class Segment:
    seq: int
    level: int
    bytes: int
    documents: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    language: str = "mixed"
    stemmed: bool = True
    next_doc_id: int = 1
    next_seq: int = 1
    segments: list[Segment] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)
    steps: list[int] = field(default_factory=list)


class StoreError(RuntimeError):
    """A store that can't be read or written as it should."""


class Files:
    """The few file operations needed, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        p = self.jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            p = self.jvm.org.apache.hadoop.fs.Path(p, part)
        return p

    def names(self, folder: str) -> list[str]:
        at = self.path(self.root.toString(), folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(self.root.toString(), folder)).getLength()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.root.toString(), name))
        try:
            return bytes(x & 0xFF for x in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes beside, under a name of its own, and gives it the wanted name in one step, which fails if the name is taken."""
        target, beside = self.path(self.root.toString(), name), self.path(self.root.toString(), f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            else:
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
                how = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
                self.jvm.java.lang.reflect.Array.set(how, 0, rename.NONE)
                context.rename(beside, target, how)
        except (FileExistsError, Py4JJavaError) as e:
            if self.fs.exists(target):
                raise StoreError(f"{name} has been published by another writer") from e
            raise StoreError(f"{name} could not be published: {e}") from e
        finally:
            self.fs.delete(beside, False)

    def drop(self, folder: str) -> None:
        self.fs.delete(self.path(self.root.toString(), folder) if folder else self.root, True)


class IndexStore:
    """Opens the store at `path`, or makes an empty one there. An existing store keeps its language and stemming; asking for others is an error."""

    def __init__(self, spark: SparkSession, path: str, language: str | None = None, stemmed: bool | None = None, level_bytes: int = LEVEL_BYTES, ratio: int = RATIO):
        self.spark, self.root, self.level_bytes, self.ratio = spark, path, level_bytes, ratio
        self.files = Files(spark, path)
        versions = [int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json")]
        if versions:
            self.manifest = self._load(max(versions))
            for name, asked, kept in (("language", language, self.manifest.language), ("stemming", stemmed, self.manifest.stemmed)):
                if asked is not None and asked != kept:
                    raise StoreError(f"the store has {name} {kept}, not {asked}")
        else:
            self.manifest = Manifest(language="mixed" if language is None else language, stemmed=True if stemmed is None else stemmed)
            self._publish(self.manifest)

    def _load(self, version: int) -> Manifest:
        try:
            told = json.loads(self.files.read(f"manifest/{version:012d}.json"))
            return Manifest(**{**told, "segments": [Segment(**s) for s in told["segments"]]})
        except (ValueError, TypeError, KeyError) as e:
            raise StoreError(f"manifest {version} can't be read: {e}") from e

    def _publish(self, manifest: Manifest) -> None:
        manifest = replace(manifest, version=self.manifest.version + 1)
        self.files.publish(f"manifest/{manifest.version:012d}.json", json.dumps(asdict(manifest), ensure_ascii=False))
        self.manifest = manifest

    def _read(self, kind: str, seqs: list[int], schema: str) -> DataFrame:
        if not seqs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{s}" for s in seqs])

    def _seqs(self) -> list[int]:
        return [s.seq for s in self.manifest.segments if s.documents]

    def _next_seq(self) -> int:
        """A number no folder has, be it one that a crash has left unnamed."""
        there = [int(n) for kind in KINDS for n in self.files.names(kind) if n.isdigit()]
        return max([self.manifest.next_seq, *(n + 1 for n in there)])

    def removed(self) -> DataFrame:
        return self._read("removed", self.manifest.removed, "doc_id long").distinct()

    def steps(self) -> DataFrame:
        """(external_id, step) of the last command of each external id that came from a stream."""
        return self._read("steps", self.manifest.steps, "external_id string, step long").groupBy("external_id").agg(F.max("step").alias("step"))

    def documents(self) -> DataFrame:
        """Live documents of this version."""
        return self._read("documents", self._seqs(), _DOCUMENT).join(self.removed(), "doc_id", "left_anti")

    def index(self) -> SearchIndex:
        """A snapshot of this version; later changes don't show in it."""
        docs = self.documents()
        return SearchIndex(docs, self._read("postings", self._seqs(), "term string, doc_id long"), document_terms(docs, self.manifest.language, self.manifest.stemmed), self.manifest.language, self.manifest.stemmed, self.removed() if self.manifest.removed else None)

    def _write(self, docs: DataFrame, seq: int, level: int, posts: DataFrame | None = None) -> Segment:
        """A segment of documents and their postings, which are worked out from the written texts unless given."""
        docs.write.parquet(f"{self.root}/documents/{seq}")
        written = self._read("documents", [seq], _DOCUMENT)
        if posts is None:
            posts = cut(postings(document_terms(spread(written), self.manifest.language, self.manifest.stemmed)))  # read twice, once to find the ranges
        posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.root}/postings/{seq}")
        return Segment(seq, level, self.files.size(f"postings/{seq}"), written.count())

    def change(self, adds: DataFrame, order: list | None = None, removes: DataFrame | None = None, steps: DataFrame | None = None) -> None:
        """Adds documents (external_id, title, content) and removes those of other external ids (external_id), as one version.

        `order` lists the columns by which the adds are ordered; each row takes the next id, and of rows with one external id the last stays, unless
        it is among the removes. Every live document of an external id that is added or removed goes. NULL external id, title or content is the empty text;
        unknown ids to remove are no error. `steps` (external_id, step) is kept for streams. Without any rows nothing is published.
        """
        m, seq = self.manifest, self._next_seq()
        order = order or ["external_id", "title", "content"]
        clean = adds.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("external_id", "title", "content")], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        numbered = with_ids(clean, [f"__o{i}" for i in range(len(order))], m.next_doc_id).select("doc_id", "external_id", "title", "content")
        count = numbered.count()
        gone = removes.select(F.coalesce("external_id", F.lit("")).alias("external_id")).distinct() if removes is not None else None
        if not count and (gone is None or gone.isEmpty()):
            return
        last = numbered.groupBy("external_id").agg(F.max("doc_id").alias("doc_id"))
        replaced = last.select("external_id")
        if gone is not None:
            last, replaced = last.join(gone, "external_id", "left_anti"), replaced.union(gone)
        old = self.documents().join(replaced, "external_id", "left_semi").select("doc_id")
        old.write.parquet(f"{self.root}/removed/{seq}")
        segments = m.segments
        if count:
            segments = [*segments, self._write(numbered.join(last.select("doc_id"), "doc_id", "left_semi"), seq, 0)]
        if steps is not None:
            steps.select("external_id", "step").write.parquet(f"{self.root}/steps/{seq}")
        self._publish(replace(m, next_doc_id=m.next_doc_id + count, next_seq=seq + 1, segments=segments, removed=[*m.removed, seq], steps=m.steps if steps is None else [*m.steps, seq]))
        self._compact_where_due()

    def add(self, batch: DataFrame, order: list | None = None) -> None:
        """Adds documents (external_id, title, content), each replacing the live one of its external id; see `change`. An empty batch changes nothing."""
        self.change(batch, order)

    def remove(self, external_ids: DataFrame) -> DataFrame:
        """Removes the documents of the external ids (external_id); unknown ones are no error. Gives (external_id, existed), once each."""
        asked = external_ids.select(F.coalesce("external_id", F.lit("")).alias("external_id")).distinct()
        there = self.documents().select("external_id").distinct().withColumn("existed", F.lit(True))
        told = cut(asked.join(there, "external_id", "left").select("external_id", F.coalesce("existed", F.lit(False)).alias("existed")))
        self.change(self.spark.createDataFrame([], _DOCUMENT), None, told)
        return told

    def compact(self, level: int | None = None) -> None:
        """Merges the segments of a level, or all of them, to one of the next level, without removed documents. No text is analysed again."""
        m, seq = self.manifest, self._next_seq()
        inside = [s for s in m.segments if level is None or s.level == level]
        if not inside:
            return
        seqs, removed = [s.seq for s in inside if s.documents], self.removed()
        docs = self._read("documents", seqs, _DOCUMENT).join(removed, "doc_id", "left_anti")
        posts = self._read("postings", seqs, "term string, doc_id long").join(removed, "doc_id", "left_anti")
        segment = self._write(docs, seq, 1 + max(s.level for s in inside), posts)
        others = [s for s in m.segments if s not in inside]
        steps = m.steps
        if len(steps) > 1:
            self.steps().write.parquet(f"{self.root}/steps/{seq}")
            steps = [seq]
        self._publish(replace(m, next_seq=seq + 1, segments=[*others, segment], removed=m.removed if others else [], steps=steps))

    def _compact_where_due(self) -> None:
        while True:
            sizes: dict[int, int] = {}
            for s in self.manifest.segments:
                sizes[s.level] = sizes.get(s.level, 0) + s.bytes
            due = over_budget(sizes, self.level_bytes, self.ratio)
            if not due:
                return
            self.compact(due[0])

    def vacuum(self) -> None:
        """Deletes folders and manifests that the current version doesn't name. No other reader or writer may be at work."""
        m = self.manifest
        named = {"documents": {s.seq for s in m.segments}, "postings": {s.seq for s in m.segments}, "removed": set(m.removed), "steps": set(m.steps)}
        for kind, seqs in named.items():
            for name in self.files.names(kind):
                if int(name) not in seqs:
                    self.files.drop(f"{kind}/{name}")
        for name in self.files.names("manifest"):
            if name != f"{m.version:012d}.json":
                self.files.drop(f"manifest/{name}")

    def stats(self) -> DataFrame:
        """One row: live documents, segments, bytes of postings, the next id and the place."""
        m = self.manifest
        extra = [F.lit(len(m.segments)).alias("segments"), F.lit(sum(s.bytes for s in m.segments)).cast("long").alias("postings_bytes"), F.lit(m.next_doc_id).cast("long").alias("next_doc_id"), F.lit(self.root).alias("base_dir")]
        return self.documents().agg(F.count("*").alias("document_count")).select("document_count", *extra)
