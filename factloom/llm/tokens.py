"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Vocabulary file (token in base64 and rank on each line); it must be on every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with its size in tokens; null texts have null, empty ones 0.

    Special tokens are ordinary text. Whole texts are counted, in Arrow batches.
    """
    kept = [(n, t) for n, t in df.dtypes if n != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoding(path)
        for batch in batches:
            sizes = [None if t is None else len(tokenizer.encode_ordinary(t)) for t in batch[text]]
            yield batch.drop(columns=[text]).assign(**{name: pd.array(sizes, dtype="Int64")})

    schema = ", ".join(f"`{n}` {t}" for n, t in kept) + f", `{name}` bigint"
    return df.select(*(n for n, _ in kept), text).mapInPandas(run, schema)
