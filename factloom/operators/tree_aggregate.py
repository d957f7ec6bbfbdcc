"""Per-key aggregation through a tree of bounded fan-in.

A plain ``groupBy(key)`` sends the partial state of every map task for one
key to one reducer. With a hundred thousand map tasks and large states that
reducer is the bottleneck. Here states climb a tree: chunks of the input are
combined where they lie, and each round merges at most ``fan_in`` neighbouring
nodes of a key, so no task receives more than ``fan_in`` states of a key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import stage

_NODE = "__tree_node"


@dataclass(frozen=True)
class State:
    """One mergeable state: ``first`` aggregates rows, ``merge`` aggregates states, ``final`` reads the result."""

    first: Column
    merge: object
    final: object = None


def count_state(condition: Column | None = None) -> State:
    """Rows, or rows that meet a condition."""
    return State(F.count(F.lit(1)) if condition is None else F.count_if(condition), F.sum)


def sum_state(value: Column) -> State:
    return State(F.sum(value), F.sum)


def min_state(value: Column) -> State:
    return State(F.min(value), F.min)


def max_state(value: Column) -> State:
    return State(F.max(value), F.max)


def distinct_state(value: Column, bits: int = 12) -> State:
    """Approximate distinct count by a mergeable sketch of fixed size."""
    return State(
        F.hll_sketch_agg(value, F.lit(bits)),
        lambda c: F.hll_union_agg(c),
        lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)),
    )


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    states: Mapping[str, State],
    chunk_rows: int = 262_144,
    fan_in: int = 32,
    chunk_bits: int = 6,
) -> DataFrame:
    """Aggregate ``states`` per ``keys`` in rounds of ``fan_in``.

    Leaf nodes are chunks of ``chunk_rows`` consecutive rows of one input
    partition, numbered through the partitions in steps of ``2**chunk_bits``.
    A partition with more chunks than that goes on into the numbers of the
    next one: chunks stay of one size and results exact, and a node of that
    stretch merges a chunk of each. The number of rounds is the logarithm of
    the number of leaves to the base ``fan_in``.
    A null in a key is a key of its own. An empty input gives no rows. Columns
    of ``df`` that are named like a state are no matter: only keys and states
    leave the first round.
    """
    shift = max(1, int(math.log2(fan_in)))
    partition_bits = max(1, math.ceil(math.log2(max(2, df.rdd.getNumPartitions()))))
    row = F.monotonically_increasing_id()
    chunk = F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), int(math.log2(chunk_rows)))
    leaf = F.shiftleft(F.shiftright(row, 33), chunk_bits) + chunk
    names = {name: f"__tree_{i}" for i, name in enumerate(states)}
    tree = (
        df.withColumn(_NODE, leaf)
        .groupBy(*keys, _NODE)
        .agg(*(s.first.alias(names[n]) for n, s in states.items()))
    )
    rounds = math.ceil((partition_bits + chunk_bits) / shift)
    for level in range(1, rounds + 1):
        grouping = [*keys] if level == rounds else [*keys, F.shiftright(_NODE, shift).alias(_NODE)]
        tree = tree.groupBy(*grouping).agg(*(s.merge(F.col(names[n])).alias(names[n]) for n, s in states.items()))
    return tree.select(
        *keys, *((s.final(F.col(names[n])) if s.final else F.col(names[n])).alias(n) for n, s in states.items())
    )


def heavy_keys(fields: list[tuple[str, DataFrame, str]], least_share: float) -> DataFrame:
    """Values that hold at least ``least_share`` of all rows of their table.

    ``fields`` has a name, a table and a column for each case. Repeated rows
    count; null counts in the total and is no case. An empty table gives no
    rows. The counts are made once and kept; the totals climb a tree of their
    own over them. Result: field_name, key_value, n_rows, total_rows.
    """
    keyed = None
    for name, table, column in fields:
        one = table.select(F.lit(name).alias("field_name"), F.col(column).cast("string").alias("key_value"))
        keyed = one if keyed is None else keyed.unionByName(one)
    counts = stage(tree_aggregate(keyed, ["field_name", "key_value"], {"n_rows": count_state()}), "key-counts")
    totals = tree_aggregate(counts, ["field_name"], {"total_rows": sum_state(F.col("n_rows"))})
    return (
        counts.join(F.broadcast(totals), "field_name")  # one row for each of ``fields``
        .where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.col("total_rows") * F.lit(least_share)))
        .select("field_name", "key_value", "n_rows", "total_rows")
    )
