"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: A byte-level vocabulary for many languages, as ranks; see the folder's own description.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", column: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in place of it; null and empty texts have none."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{column}` bigint"])
    names = [f.name for f in kept]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            out = pdf[names].copy()
            out[column] = [len(encode(t)) if t else 0 for t in pdf[text]]
            yield out

    return df.select(*names, text).mapInPandas(count, schema)
