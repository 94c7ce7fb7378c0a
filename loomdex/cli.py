"""A small command line over an index: python -m loomdex.cli [folder] [language]; without arguments it asks for both."""

from __future__ import annotations

import itertools
import sys
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.query import QueryError
from loomdex.session import local_session, shared_dir
from loomdex.sources.demo import QUERIES, demo_documents
from loomdex.sources.store import IndexStore

HELP = """Commands:
  add <id> <title> | <content>   add or replace a document
  search <query>                 documents for which the query holds
  remove <id>                    remove a document
  list                           all documents
  stats                          figures of the index
  flush                          make changes durable (they are, as soon as made)
  compact                        merge the segments on disk
  demo                           load ten documents
  help, exit
Queries: term, prefix*, wi*ld*card, AND, OR, NOT and parentheses"""

_ALIASES = {"h": "help", "?": "help", "a": "add", "s": "search", "q": "search", "rm": "remove", "delete": "remove", "ls": "list", "quit": "exit", "q!": "exit"}
_NEED = {"add": "add <id> <title> | <content>", "search": "search <query>", "remove": "remove <id>"}


def add_arguments(rest: str) -> tuple[str, str, str] | None:
    """External id, title and content of `<id> <title> | <content>`; without a bar all is content. None if there is no text after the id."""
    name, blank, text = rest.partition(" ")
    if not blank:
        return None
    title, bar, content = text.partition("|")
    return (name, title.strip(), content.strip()) if bar else (name, "", text)


class Session:
    def __init__(self, spark: SparkSession, store: IndexStore):
        self.spark, self.store = spark, store

    def _one(self, **row: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))

    def run(self, line: str) -> Iterable[str] | None:
        """What a line of input prints; None at the end."""
        line = line.strip()
        if not line:
            return []
        word, _, rest = line.partition(" ")
        command = _ALIASES.get(word.lower(), word.lower())
        if command == "exit":
            return None
        if command in _NEED and not rest:
            return [f"Usage: {_NEED[command]}"]
        does = getattr(self, f"_do_{command}", None)
        return does(rest) if does else [f"Unknown command: {word} (help lists them)"]

    def _do_help(self, _: str) -> list[str]:
        return HELP.split("\n")

    def _do_add(self, rest: str) -> list[str]:
        parts = add_arguments(rest)
        if parts is None:
            return [f"Usage: {_NEED['add']}"]
        name, title, content = parts
        new_id = self.store.manifest.next_doc_id
        self.store.add(self._one(external_id=name, title=title, content=content))
        return [f"Added document '{name}' (internal ID: {new_id})"]

    def _do_search(self, rest: str) -> list[str]:
        index = self.store.index()
        try:
            found = index.get_documents(index.ids(rest))
        except QueryError as e:
            return [f"Search error: {e}"]
        return self._listed(type(index)(found, index.posts).listing(80), "Found {} document(s):", "No documents found", "  [{0}] {1}\n      {2}")

    def _listed(self, rows: DataFrame, head: str, none: str, line: str) -> Iterable[str]:
        """Lines of a listing, a partition of it at a time on the driver."""
        n = rows.count()
        return itertools.chain([head.format(n)], (x for r in rows.toLocalIterator() for x in line.format(*r).split("\n"))) if n else [none]

    def _do_remove(self, rest: str) -> list[str]:
        existed = self.store.remove(self._one(external_id=rest)).first()["existed"]
        return [f"Removed document '{rest}'" if existed else f"No document '{rest}'"]

    def _do_list(self, _: str) -> Iterable[str]:
        rows = self.store.index().listing().withColumn("content", F.regexp_replace("content", r"[\r\n]+", " "))
        return self._listed(rows, "Documents in index: {}", "No documents in index", "  [{0}] {1}: {2}")

    def _do_stats(self, _: str) -> list[str]:
        return [f"  {k}: {v}" for k, v in self.store.stats().first().asDict().items()]

    def _do_flush(self, _: str) -> list[str]:
        return ["Nothing to flush: every change is durable"]

    def _do_compact(self, _: str) -> list[str]:
        self.store.compact()
        return ["Index compacted"]

    def _do_demo(self, _: str) -> list[str]:
        self.store.add(demo_documents(self.spark), ["at"])
        return ["Loaded the demonstration documents. Try these searches:", *[f"  search {q}" for q in QUERIES]]


def choices(lines: Iterator[str], say=print) -> tuple[str | None, str | None]:
    """Folder and language as answered; no folder stands for an index that is gone at the end."""
    say("Index: 1 in memory, 2 on disk [1]")
    folder = None
    if next(lines, "").strip() == "2":
        say("Folder [index_data]")
        folder = next(lines, "").strip() or "index_data"
    say("Language: english, russian, mixed [mixed]")
    return folder, next(lines, "").strip().lower() or None


def main(lines: Iterable[str], folder: str | None = None, language: str | None = None) -> None:
    lines = iter(lines)
    if folder is None:
        folder, language = choices(lines)
    spark = local_session()
    passing = folder is None
    session = Session(spark, IndexStore(spark, folder or f"{shared_dir(spark)}/passing/{uuid.uuid4().hex}", language))
    print(HELP)
    try:
        for line in lines:
            out = session.run(line)
            if out is None:
                break
            for text in out:
                print(text)
    finally:
        if passing:
            session.store.files.drop("")
        spark.stop()


if __name__ == "__main__":
    main(sys.stdin, *sys.argv[1:3])
