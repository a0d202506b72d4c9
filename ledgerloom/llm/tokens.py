"""Token counts of whole texts under a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Defaults of the parameters: the folder, overridden by the session's `spark.ledgerloom.tokenizers`, and the file in it.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the default vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_held: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The encoder of a rank file; one is kept per worker."""
    if (path, pattern) not in _held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held.clear()
        _held[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _held[path, pattern]


def token_counter(path: str | None = None, pattern: str = PATTERN):
    """A pandas UDF text -> number of tokens (bigint). Null gives null, empty text 0; strings of special tokens are ordinary text."""
    if path is None:
        spark = SparkSession.getActiveSession()
        path = os.path.join(spark.conf.get("spark.ledgerloom.tokenizers", FOLDER) if spark else FOLDER, VOCABULARY)

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        e = encoder(path, pattern)
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in text], dtype="Int64")

    return count
