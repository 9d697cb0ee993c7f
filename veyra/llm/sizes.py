"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file the driver reads where it lies and broadcasts."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_encoders: dict[str, object] = {}
_sent: dict[tuple[str, str], object] = {}


def encoder(mark: str, vocabulary):
    """The tokenizer of a broadcast vocabulary, held by the worker process from task to task."""
    if mark not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        _encoders[mark] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[mark]


def token_count(spark: SparkSession, text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text, read whole; null for null. The driver reads the vocabulary, a file of a public tokenizer of a few MB at most, and broadcasts it."""
    own = (spark.sparkContext.applicationId, path)
    if own not in _sent:
        with open(path, "rb") as f:
            _sent[own] = spark.sparkContext.broadcast(f.read())
    vocabulary = _sent[own]

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoder(path, vocabulary)
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(doc_id, *keep, tokens) of the documents that have an id; a null text has no tokens."""
    path = path or os.environ.get("VEYRA_TOKENIZER", TOKENIZER)
    tokens = F.coalesce(token_count(docs.sparkSession, F.col(text), path), F.lit(0)).cast("long")
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *keep, tokens.alias("tokens"))
