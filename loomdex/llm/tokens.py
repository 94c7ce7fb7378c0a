"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import spread

#: Where the vocabulary files lie, and the one used unless another is named.
TOKENIZERS, VOCABULARY = os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabulary parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: bytes) -> int:
    return len(_encoding(vocabulary).encode_ordinary(text)) if text else 0


def token_counts(docs: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """`columns` of `docs` with `tokens`, the size of `text`; NULL and empty texts have none.

    The vocabulary, a file of fixed size under a megabyte, is read on the driver and broadcast, so executors need no copy of it.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = spread(docs.select(*columns, F.col(text).alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(x, shared.value) for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sizes, pa.int64())], [*columns, "tokens"])

    return kept.mapInArrow(run, kept.select(*columns, F.lit(0).cast("long").alias("tokens")).schema)
