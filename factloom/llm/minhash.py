"""MinHash banding over padded q-grams of short strings."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRIME = (1 << 31) - 1


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(similarity: float, recall: float, most_hashes: int = 384) -> tuple[int, int]:
    """(bands, rows): the steepest curve that still reaches ``recall`` at ``similarity``.

    More rows a band make fewer chance candidates, more bands win recall back;
    the number of hashes bounds both.
    """
    for rows in range(12, 0, -1):
        p = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("recall can't be reached with so few hashes")


def padded_qgrams(text: str, q: int) -> set[str]:
    padded = "\x01" * (q - 1) + text + "\x02" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def band_hashes(words: list[str], q: int, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """One row for each word, one 64-bit hash for each band."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, _PRIME, bands * rows, dtype=np.uint64)
    b = rng.integers(0, _PRIME, bands * rows, dtype=np.uint64)
    out = np.empty((len(words), bands), dtype=np.int64)
    weights = rng.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)
    for at in range(0, len(words), 512):
        chunk = [sorted(zlib.crc32(g.encode()) % _PRIME for g in padded_qgrams(w, q)) for w in words[at : at + 512]]
        starts = np.cumsum([0] + [len(c) for c in chunk[:-1]])
        grams = np.array([g for c in chunk for g in c], dtype=np.uint64)
        signature = np.minimum.reduceat((grams[:, None] * a + b) % np.uint64(_PRIME), starts, axis=0)
        mixed = (signature.reshape(len(chunk), bands, rows) + np.uint64(1)) * weights
        out[at : at + 512] = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), axis=2).view(np.int64)
    return out


def with_buckets(words: DataFrame, q: int, bands: int, rows: int) -> DataFrame:
    """(bucket, id, side) for each band of a word; ``words``: space, word, id, side.

    A bucket is one number made of space, band and band hash, and words are
    told by number, so that rows stay 17 bytes whatever the words.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(band_hashes(batch["word"].tolist(), q, bands, rows)) if len(batch) else []
            yield batch.drop(columns=["word"]).assign(bands=made)

    spread = words.select("space", "word", "id", "side").repartition(words.sparkSession.sparkContext.defaultParallelism, "id")
    hashed = spread.mapInPandas(
        make, "space string, id bigint, side int, bands array<bigint>"
    )
    each = hashed.select("space", "id", F.col("side").cast("tinyint").alias("side"), F.posexplode("bands").alias("band", "h"))
    return each.select(F.xxhash64("space", "band", "h").alias("bucket"), "id", "side")
