"""Texts packed into containers of fixed capacity by local search.

Items are spread evenly over packing groups of bounded size. Each group starts
from a greedy packing and improves its underfull bins by moving one item,
exchanging one for one, two for one or one for two, so that the sum of squared
fills rises until bins run empty. Bins that are still not full enough are
opened again and packed once more together with those of other groups.
"""

from __future__ import annotations

import bisect
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import VOCABULARY, with_tokens
from factloom.session import stage

#: Items of one packing group.
GROUP_ITEMS = 2_000
#: A bin below this fill is improved, and after the first round opened again.
FULL = 0.995


def greedy_bins(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first; bins of item numbers."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(gaps, (sizes[i], -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > sizes[i]:
            bisect.insort(gaps, (gap - sizes[i], b))
    return bins


def squared_fill(bins: list[list[int]], sizes: list[int]) -> int:
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def _best_exchange(source: list[int], target: list[int], gap: int, sizes: list[int]) -> tuple[int, list[int], list[int]]:
    """(gain, items out of source, items out of target) that fills ``target`` best; gain 0 where nothing helps."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    sizes_b = sorted((sizes[j], j) for j in target)
    keys_b = [s for s, _ in sizes_b]
    gives = [([i], sizes[i]) for i in source]
    gives += [([i, j], sizes[i] + sizes[j]) for i, j in combinations(source, 2)]
    for items, amount in gives:
        if amount <= gap:
            if amount > best[0]:
                best = (amount, items, [])
            continue
        # The smallest item of the target that makes room enough leaves the least space.
        at = bisect.bisect_left(keys_b, amount - gap)
        if at < len(keys_b) and amount - keys_b[at] > best[0]:
            best = (amount - keys_b[at], items, [sizes_b[at][1]])
        if best[0] == gap:
            return best
    for i in source:  # one for two
        need, low, high = sizes[i] - gap, 0, len(keys_b) - 1
        while low < high:  # two ends closing in on the least sum that is enough
            total = keys_b[low] + keys_b[high]
            if total < need:
                low += 1
            else:
                if sizes[i] - total > best[0]:
                    best = (sizes[i] - total, [i], [sizes_b[low][1], sizes_b[high][1]])
                high -= 1
    return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Local search on the bins below ``full``; the sum of squared fills never falls, and no bin is added."""
    done = [b for b in bins if sum(sizes[i] for i in b) >= full * capacity]
    work = [(sum(sizes[i] for i in b), list(b)) for b in bins if sum(sizes[i] for i in b) < full * capacity]
    work.sort(key=lambda x: (x[0], x[1]))
    while work:
        fill, source = work.pop(0)
        # Every other underfull bin is at least as full, so each gain of it raises the sum of squares.
        changed = True
        while source and changed:
            changed = False
            for k in range(len(work) - 1, -1, -1):
                other, target = work[k]
                gain, out, back = _best_exchange(source, target, capacity - other, sizes)
                if gain <= 0:
                    continue
                source = [i for i in source if i not in out] + back
                target = [i for i in target if i not in back] + out
                work[k] = (other + gain, target)
                fill -= gain
                changed = True
                if not source:
                    break
            for k in range(len(work) - 1, -1, -1):
                if work[k][0] >= full * capacity:
                    done.append(work.pop(k)[1])
            work.sort(key=lambda x: (x[0], x[1]))
        if source:
            done.append(source)
    return done


def pack_group(sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Bins of item numbers; no item exceeds the capacity."""
    return improve(greedy_bins(sizes, capacity), sizes, capacity, full)


def _pack_round(items: DataFrame, label: str, full: float) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "item_id"], ascending=[False, True], ignore_index=True)
        sizes = [int(x) for x in group["n_tokens"]]
        capacity = int(group["capacity_tokens"].iloc[0])
        number = np.zeros(len(sizes), dtype=np.int64)
        filled = np.zeros(len(sizes), dtype=np.int64)
        for k, b in enumerate(pack_group(sizes, capacity, full)):
            number[b] = k
            filled[b] = sum(sizes[i] for i in b)
        return group.assign(bin_no=number, bin_tokens=filled)

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", bin_no bigint, bin_tokens bigint"
    packed = items.groupBy("pack_id", "packing_group").applyInPandas(run, schema)
    return packed.withColumn("bin_id", F.concat_ws("-", F.lit(label), "packing_group", "bin_no"))


def _grouped(items: DataFrame, group_items: int) -> DataFrame:
    """Spread items over groups of about ``group_items``: by a number of the item, so copies are spread too."""
    counts = {r.pack_id: -(-r.n // group_items) for r in items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return items.withColumn("packing_group", F.lit(0).cast("bigint"))
    groups = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(v))))
    return items.withColumn("packing_group", F.pmod(F.xxhash64("item_id"), groups[F.col("pack_id")]))


def pack_documents(
    documents: DataFrame,
    packs: DataFrame,
    group_items: int = GROUP_ITEMS,
    full: float = FULL,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Every text in one container of each pack, or in several if it alone exceeds the capacity.

    ``documents``: doc_id, text; ``packs``: pack_id, capacity_tokens (a small
    fixed list, collected and refused beyond 1,000; null, zero or negative
    capacities are no packs). Null and empty texts are no items. A text beyond
    the capacity is divided into pieces that fill a container each and a rest.
    Rows repeated under one doc_id are items of their own, numbered by their
    doc_id, text and count, so the containers don't depend on how files are
    split. An empty table gives no rows. Result: pack_id, bin_id, doc_id, piece, start_token, n_tokens,
    capacity_tokens.
    """
    sizes = [
        (r.pack_id, r.capacity_tokens)
        for r in packs.where(F.col("capacity_tokens") > 0).select("pack_id", "capacity_tokens").distinct().limit(1001).collect()
    ]
    if len(sizes) > 1000:
        raise ValueError("more than 1000 packs")
    columns = ["pack_id", "bin_id", "doc_id", "piece", "start_token", "n_tokens", "capacity_tokens"]
    counted = stage(
        with_tokens(
            documents.where(F.col("text") != "").select("doc_id", "text", F.xxhash64("text").alias("text_hash")), path=vocabulary
        )
        .where(F.col("n_tokens") > 0)
        .groupBy("doc_id", "text_hash", "n_tokens")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("doc_id", "n_tokens", "text_hash", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        .select("doc_id", "n_tokens", F.xxhash64("doc_id", "text_hash", "copy").alias("item_id")),
        "token-counts",
    )
    wanted = F.array(*(F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity_tokens")) for p, c in sizes))
    if not sizes:
        wanted = F.array().cast("array<struct<pack_id:int,capacity_tokens:bigint>>")
    each = counted.select("*", F.explode(wanted).alias("p")).select("doc_id", "item_id", "n_tokens", "p.*")
    whole = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("bigint")
    rest = F.col("n_tokens") - whole * F.col("capacity_tokens")
    full_pieces = (
        each.where(whole > 0)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
        .select(
            "pack_id",
            F.concat_ws("-", F.lit("whole"), "item_id", "piece").alias("bin_id"),
            "doc_id",
            "piece",
            (F.col("piece") * F.col("capacity_tokens")).alias("start_token"),
            F.col("capacity_tokens").alias("n_tokens"),
            "capacity_tokens",
        )
    )
    items = each.where(rest > 0).select(
        "pack_id", "item_id", "doc_id", whole.alias("piece"), (F.col("n_tokens") - rest).alias("start_token"), rest.alias("n_tokens"), "capacity_tokens"
    )
    first = stage(_pack_round(_grouped(items, group_items), "a", full), "packed-first")
    settled = F.col("bin_tokens") >= F.col("capacity_tokens") * full
    opened = first.where(~settled).drop("packing_group", "bin_no", "bin_tokens", "bin_id")
    second = _pack_round(_grouped(opened, group_items), "b", full)
    return full_pieces.unionByName(first.where(settled).select(*columns)).unionByName(second.select(*columns))


def packing_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and fill of each pack, with the least number of containers that could do."""
    bins = packed.groupBy("pack_id", "capacity_tokens", "bin_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items")
    )
    return bins.groupBy("pack_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.sum("items").alias("n_items"),
        F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("largest_bin"),
        F.ceil(F.sum("tokens") / F.col("capacity_tokens")).alias("least_bins"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.col("capacity_tokens")), 6).alias("fill"),
    )


