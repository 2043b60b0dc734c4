"""Sizes of texts in tokens of a public tokenizer. The vocabulary's path is a parameter; executors read it there, or, where they have no
such file, get the driver's."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: how this vocabulary's texts are cut before byte pairs are merged
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> Any:
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, key: str, text: str = "text", *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., tokens): the tokens of each text as a whole; rows without text have none (0)."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [key, *keep]
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*names, "tokens"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", tokens bigint"
    return df.select(*names, F.col(text).alias("text of row")).mapInArrow(run, schema)
