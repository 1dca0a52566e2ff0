"""Token counts and token offsets under a public byte-level tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file (tiktoken ranks); every executor reads it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer, once per worker process, and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoding(path)[0].encode_ordinary(text)) if text else 0


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text column as BIGINT, in Arrow batches; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        encode = encoding(path)[0].encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def token_offsets(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Character offset of every token boundary (one more than there are tokens); -1 inside a character."""
    enc, sizes = encoding(path)
    ids = np.array(enc.encode_ordinary(text), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes[ids])])
    raw = np.frombuffer(text.encode(), np.uint8)
    first = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    chars = np.cumsum(first) - 1
    return np.where(first[at], chars[at], -1)
