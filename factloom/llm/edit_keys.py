"""Keys that every two similar words share: candidates of which none is missed.

Two words are similar if a part of the one is near a part of the other: 1 -
edits / longer length is at least some threshold, where two edits that leave
the letters as they are count as one. The keys are exact: words that are so
near have a key in common, whatever the edits. Keys say nothing more, so what
shares one has to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a row of a word can meet in its bucket: PROBE rows meet INDEX rows, BOTH is the two in one.
INDEX, PROBE, BOTH = 1, 2, 3
#: Most edits that whole words are keyed for; beyond, pieces of words are.
WHOLE_EDITS = 2
#: Longest words of which pieces are keyed with a letter left out; pieces of longer ones are shorter and exact.
LONG = 64
#: Rows of keys that are handed on at once.
CHUNK = 50_000


def edits_allowed(slack: float, length: int) -> int:
    """Most edits within ``slack`` (1 - threshold) of the longer length."""
    return int(slack * length + 1e-9)


def without(text: str, n: int) -> set[str]:
    """All that is left of ``text`` without ``n`` of its letters."""
    out = {text}
    for _ in range(n):
        out = {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out


@cache
def piece_classes(length: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(edits, pieces, length of a piece, letters left out) of the pairs, of more than WHOLE_EDITS edits, that a word of this length may be in.

    A class is a range of lengths of the longer word. Its pairs have at most
    ``edits``, so that of so many pieces of one word one has at most the
    letters left out as its edits. Classes grow with the length, so a word is
    in a few of them only. Pieces without a length stand for the class itself.
    """
    out, low = [], WHOLE_EDITS + 1

    def first(edits: int) -> int:
        """The least length that allows so many edits."""
        at = max(int(edits / slack) - 2, 1)
        while edits_allowed(slack, at) < edits:
            at += 1
        return at

    while (shortest := (first(low) - low)) <= length:
        high = low + low // 10
        longest = first(high + 1) - 1
        if length <= longest:
            pieces = high // 2 + 1
            if longest <= LONG and shortest // pieces >= 3:
                out.append((high, pieces, shortest // pieces, 1))
            else:
                out.append((high, high + 1, shortest // (high + 1), 0))
        low = high + 1
    return out


def part_keys(part: str, slack: float) -> tuple[set[str], set[str], set[str]]:
    """Keys of one part of a word as (both, index, probe).

    Up to WHOLE_EDITS edits: what is left without as many letters, which two
    words have in common if the edits take the one to the other; and the
    sorted letters, where two edits count as one. More edits: one of the
    pieces of a word has few of them, and stands in the other word no further
    away than all edits can move it; of a piece and of the letters there, some
    remainder is the same.
    """
    if slack >= 1 - 1e-9:
        return {"all"}, set(), set()
    both, index, probe = set(), set(), set()
    edits, length = edits_allowed(slack, len(part)), len(part)
    if edits <= WHOLE_EDITS:
        both = {t for n in range(edits + 1) for t in without(part, n)}
    if edits == 1:
        both.add("=" + "".join(sorted(part)))
    for most, pieces, size, out in piece_classes(length, slack) if slack > 1e-9 else []:
        if not size:
            index.add(f"{most} {length}")
            probe |= {f"{most} {n}" for n in range(length - most, length + most + 1)}
            continue
        block = 2 * most + 1
        for at in range(0, pieces * size, size):
            index |= {f"{most} {at // block} {t}" for t in without(part[at : at + size], out)}
        for at in range(length - size + 1):
            near = {max(at - most, 0) // block, (at + most) // block}
            probe |= {f"{most} {n} {t}" for t in without(part[at : at + size], out) for n in near}
    return both, index, probe


def word_keys(word: str, least: float) -> Iterator[tuple[str, int]]:
    """(key, role) of a word of one or more parts, for pairs of Monge-Elkan similarity ``least`` or more.

    A word of one part has a part of any similar word within ``least``. Of a
    word of several, the parts lack 1 - ``least`` on average, so one of the
    longer half lacks twice that at most; short parts, which many names share,
    need no index then.
    """
    parts, slack = sorted(word.split(" "), key=len, reverse=True), 1 - least
    single = len(parts) == 1
    for part in {*parts}:
        both, index, probe = part_keys(part, slack)
        yield from ((f"s{k}", BOTH if single else PROBE) for k in both)
        yield from ((f"s{k}", PROBE) for k in probe)
        if single:
            yield from ((f"s{k}", INDEX) for k in index)
    if single:
        return
    half = {*parts[: (len(parts) + 1) // 2]}
    for part in {*parts}:
        both, index, probe = part_keys(part, 2 * slack)
        yield from ((f"m{k}", BOTH if part in half else PROBE) for k in both)
        yield from ((f"m{k}", PROBE) for k in probe)
        if part in half:
            yield from ((f"m{k}", INDEX) for k in index)


def with_keys(words: DataFrame, least: float) -> DataFrame:
    """(bucket, id, side, role) for each key of a word; ``words``: space, word, id, side."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["space", "id", "side", "key", "role"]
        for batch in batches:
            rows = []
            for space, word, id_, side in zip(batch["space"], batch["word"], batch["id"], batch["side"]):
                for key, role in word_keys(word, least):
                    rows.append((space, id_, side, key, role))
                    if len(rows) >= CHUNK:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    spread = words.select("space", "word", "id", "side").repartition(words.sparkSession.sparkContext.defaultParallelism, "id")
    keyed = spread.mapInPandas(make, "space string, id bigint, side tinyint, key string, role tinyint")
    return keyed.select(F.xxhash64("space", "key").alias("bucket"), "id", "side", "role")
