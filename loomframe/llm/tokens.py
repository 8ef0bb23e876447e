"""Token counts by a public tokenizer, shared by packing and mixing."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rank file and the pre-tokenizer pattern are parameters; nothing is copied into this repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[tuple[str, str], object] = {}


def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer, loaded once per process."""
    key = (ranks, pattern)
    if key not in _LOADED:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _LOADED[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[key]


def count_tokens(texts: list[str | None], ranks: str = RANKS) -> list[int]:
    """Tokens of each text, which is always encoded as a whole."""
    enc = encoding(ranks)
    return [len(enc.encode_ordinary(text)) if text else 0 for text in texts]


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), ranks), dtype="int32")

    return counted(text)
