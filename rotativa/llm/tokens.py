"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary (a rank file), on every executor.
VOCABULARY = os.environ.get("ROTATIVA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of such a rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a rank file."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Number of tokens; 0 for null and empty texts."""
    return len(encoding(vocabulary).encode_ordinary(text)) if text else 0


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *also, tokens) of every row; null and empty texts have 0 tokens."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "tokens"])

    picked = docs.select(F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(also)), F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join([f"k {types[key]}", *(f"a{i} {types[c]}" for i, c in enumerate(also)), "tokens int"])
    out = picked.mapInArrow(scan, schema)
    return out.select(F.col("k").alias(key), *(F.col(f"a{i}").alias(c) for i, c in enumerate(also)), "tokens")
