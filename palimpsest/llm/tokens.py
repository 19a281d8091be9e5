"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public byte-level vocabularies split a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without the text but with ``n_tokens`` (0 for null and empty texts). Texts are read whole."""
    rest = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64())], [*rest, "n_tokens"])

    return df.select(*rest, text_col).mapInArrow(run, f"{schema}, n_tokens bigint")


def numbered_copies(sizes: DataFrame) -> DataFrame:
    """Rows with ``nth`` (from 1) that tells equal rows apart and depends on nothing but the rows, and ``h``, a hash of both."""
    cols = sizes.columns
    counted = sizes.groupBy(*cols).agg(F.count("*").alias("nth"))
    return counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("nth")))).withColumn("h", F.xxhash64(*cols, "nth"))
