"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of ranks, one "base64 rank" a line, and the pattern that splits text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(name: str, ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary; made once in each worker process."""
    if name not in _loaded:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _loaded[name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[name]


def with_tokens(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """documents without its text column but with `tokens`, the size of the text; null text has 0.

    The vocabulary is read on the driver and broadcast: its size is that of the file, under 1 MB. Strings of special tokens
    in a text are ordinary text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary, shared.value)
        for b in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in b], dtype="int64")

    return documents.withColumn("tokens", F.pandas_udf(count, "bigint")(F.col(text))).drop(text)
