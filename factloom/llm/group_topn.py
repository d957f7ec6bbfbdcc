"""The N best items of every group, by per-group score histograms.

A histogram of scores per group, combined before the shuffle, gives every
group a threshold above which at least N different items are certain to lie.
Rows below the threshold of their group are dropped where they are read; what
is left is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import stage

#: Bits of an item's number that tell its bin, after the leading one.
BIN_BITS = 5
#: Thresholds that are broadcast, those that drop most rows: a fixed bound, whatever the number of groups.
BROADCAST_GROUPS = 10_000


def item_bin(item: str) -> Column:
    """A bin number that never falls as ``item`` (a BIGINT) rises.

    As in a histogram of fixed relative precision, a bin is told by a number's
    length in bits and its first bits: bins are finer where the better items
    are, and no pass over the data is needed to find a range.
    """
    low = 1 << BIN_BITS
    size = f"CASE WHEN {item} < 0 THEN -1 - {item} ELSE {item} END"
    drop = f"greatest(length(bin({size})) - {BIN_BITS + 1}, 0)"
    bin_ = f"shiftright({size}, {drop}) + {drop} * {low}"
    return F.expr(f"CAST(CASE WHEN {item} < 0 THEN -1 - ({bin_}) ELSE {bin_} END AS INT)")


def thresholds(rows: DataFrame, group: list[str], item: str, n: int) -> DataFrame:
    """(group, __last_rank, __last_bin, __dropped): where ``n`` different items are certain to lie at or before a bin of a rank.

    ``rows``: group, item, __rank, __bin. A bin keeps its smallest and largest
    item: two different ones prove two items, however often rows repeat. Bins
    of one rank hold different items, so what they prove adds up. ``__dropped``
    is the number of rows beyond; groups without any need no threshold and are
    left out.
    """
    bins = rows.groupBy(*group, "__rank", "__bin").agg(
        F.count(F.lit(1)).alias("__rows"), F.min(item).alias("__lo"), F.max(item).alias("__hi")
    )
    sure = F.when(F.col("__lo") == F.col("__hi"), 1).otherwise(2)
    so_far = F.sum("__rows").over(Window.partitionBy(*group).orderBy("__rank", "__bin"))
    proved = F.sum(sure).over(Window.partitionBy(*group, "__rank").orderBy("__bin"))
    found = (
        bins.withColumn("__so_far", so_far)
        .withColumn("__proved", proved)
        .groupBy(*group)
        .agg(
            F.min(F.when(F.col("__proved") >= n, F.struct("__rank", "__bin", "__so_far"))).alias("__t"),
            F.sum("__rows").alias("__all"),
        )
    )
    return found.where(F.col("__t.__so_far") < F.col("__all")).select(
        *group,
        F.col("__t.__rank").alias("__last_rank"),
        F.col("__t.__bin").alias("__last_bin"),
        (F.col("__all") - F.col("__t.__so_far")).alias("__dropped"),
    )


def group_topn(
    df: DataFrame, group: list[str], rank: Column, item: str, n: int, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """Rows (group columns, ``item``) of the ``n`` first items of each group.

    Order: ``rank`` (an int, 0 is best), then the smaller ``item`` (a BIGINT),
    so equals always come out the same way. A repeated item of a group counts
    once, at its best rank. Groups with a null in a group column, null ranks
    and null items are no cases. Groups smaller than ``n`` come out whole; an
    empty table gives no rows.

    Every group has a histogram and, where it has rows to drop, a threshold.
    The ``broadcast_groups`` thresholds that drop most rows are broadcast and
    applied at the scan; the groups beyond are smaller than all of these, and
    the limit of the window, which goes below the last shuffle, holds them to
    ``n`` rows a task.
    """
    rows = cut_rows(df, group, rank, item, n, broadcast_groups)
    best = rows.groupBy(*group, item).agg(F.min("__rank").alias("__rank"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__rank", item))
    return best.withColumn("__place", place).where(F.col("__place") <= n).select(*group, item)


def cut_rows(df: DataFrame, group: list[str], rank: Column, item: str, n: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(group, item, __rank) of the rows that the thresholds leave."""
    rows = df.select(*group, F.col(item).cast("bigint").alias(item), rank.cast("int").alias("__rank"))
    for c in [*group, item, "__rank"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("__bin", item_bin(f"`{item}`"))
    order = [F.desc("__dropped"), *group]
    most = stage(thresholds(rows, group, item, n).orderBy(*order).limit(broadcast_groups), "thresholds")
    beyond = F.struct("__rank", "__bin") > F.struct("__last_rank", "__last_bin")
    return (
        rows.join(F.broadcast(most), group, "left")
        .where(F.col("__last_rank").isNull() | ~beyond)
        .select(*group, item, "__rank")
    )
