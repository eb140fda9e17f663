"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LOOMSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
"""A file of byte-level BPE ranks (base64 token and rank a line), on every machine."""
# Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 100_000
"""Texts are encoded in pieces of about this length, cut before white space, so that a run without spaces can't take quadratic time for the whole text."""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text; strings that look like special tokens are ordinary text."""
    encode = _encoding(path).encode_ordinary
    if len(text) <= PIECE_CHARS:
        return len(encode(text))
    total = begin = 0
    while begin < len(text):
        end = begin + PIECE_CHARS
        if end < len(text):
            space = max(text.rfind(" ", begin + 1, end), text.rfind("\n", begin + 1, end))
            end = space if space > begin else end
        total += len(encode(text[begin:end]))
        begin = end
    return total


def with_tokens(documents: DataFrame, text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``tokens``; null and empty texts have none. Texts are read only here and don't leave the task."""
    chosen = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count(t, path) if t else 0 for t in batch.column("text").to_pylist()]
            columns = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*(f"k{i}" for i in range(len(keep))), "tokens"])

    counted = chosen.mapInArrow(run, schema)
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "tokens")
