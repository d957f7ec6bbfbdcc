"""Joins that Spark has no operator for: as-of, range, pattern, tiered; and a running sum at any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import stage


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` before it.

    One sort of the union instead of a join of pairs, and the last value seen
    is carried on. Rows are range-partitioned by key and time, so that a hot
    key fills many parts; the last value of a key that goes on from part to
    part is handed over, which takes a row for each part only. ``strict``: at the same
    point of ``at``, right rows come after left ones and are not seen. Of right
    rows at one point the largest values win. Left rows without one have nulls.
    """
    carried = F.struct(*(F.col(v) for v in values))
    kept = [c for c in left.columns]
    a = left.select(*by, at, F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__side"))
    b = right.groupBy(*by, at).agg(F.max(carried).alias("__v")).select(*by, at, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__v", F.lit(1 if strict else 0).alias("__side"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.unionByName(b).repartitionByRange(parts, *by, at, "__side").withColumn("__part", F.spark_partition_id())
    both = stage(both, "as-of")
    order = Window.partitionBy("__part", *by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order))
    # Keys of a part are neighbours in the order, so only those at its ends go beyond it: at most two of them.
    held = both.groupBy(*by, "__part").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(at, "__side", "__v"))).alias("__end"))
    spans = held.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*by)
    same = lambda x, y: reduce(lambda p, q: p & q, (x[k].eqNullSafe(y[k]) for k in by))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = held.join(F.broadcast(spans), same(held, spans), "left_semi")
    handed = handed.withColumn("__carry", F.last(F.col("__end").getField("__v"), ignorenulls=True).over(before)).where(F.col("__carry").isNotNull())
    handed = handed.select(*(F.col(k).alias(f"__by_{k}") for k in by), F.col("__part").alias("__at_part"), "__carry")
    meets = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by)) & (F.col("__part") == F.col("__at_part"))
    seen = seen.join(F.broadcast(handed), meets, "left").withColumn("__last", F.coalesce("__last", "__carry"))
    return seen.where(F.col("__row").isNotNull()).select("__row.*", *(F.col("__last").getField(v).alias(v) for v in values))


def near_before(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, within: int, absent: bool = False
) -> DataFrame:
    """Rows of ``left`` for which ``right`` has one at 0 to ``within`` before it; ``absent``: has none.

    Null keys and positions have none.

    Positions are cut into blocks of ``within`` + 1, so only two blocks can
    match: an equi join on (by, block). Positions are made distinct first, so
    a block has at most ``within`` + 1 of them however many rows there are.
    """
    width = within + 1
    blocks = right.select(*by, F.col(right_at).alias("__p")).where(F.col("__p").isNotNull()).distinct()
    blocks = blocks.withColumn("__block", F.floor(F.col("__p") / width))
    places = left.select(*by, F.col(left_at).alias("__q")).where(F.col("__q").isNotNull()).distinct()
    places = places.withColumn("__block", F.explode(F.array(F.floor(F.col("__q") / width), F.floor(F.col("__q") / width) - 1)))
    hits = (
        places.join(blocks, [*by, "__block"])
        .where((F.col("__q") - F.col("__p")).between(0, within))
        .select(*by, F.col("__q").alias(left_at))
        .distinct()
    )
    return left.join(hits, [*by, left_at], "left_anti" if absent else "left_semi")


def prefix_join(left: DataFrame, text: str, patterns: DataFrame, prefix: str, max_patterns: int = 10_000) -> DataFrame:
    """Pairs of ``left`` rows and patterns whose ``prefix`` starts ``text``, by equi joins on the lengths in use.

    The different lengths of the prefixes are few; they are collected and their
    number is checked. Null and empty prefixes match nothing.
    """
    clean = patterns.where(F.length(prefix) > 0)
    lengths = [r[0] for r in clean.select(F.length(prefix)).distinct().limit(max_patterns + 1).collect()]
    if len(lengths) > max_patterns:
        raise ValueError("too many lengths of prefixes")
    if not lengths:
        return left.join(clean, F.lit(False))
    heads = F.array_distinct(F.array(*(F.substring(text, 1, n) for n in lengths)))
    headed = left.withColumn("__head", F.explode(heads))
    return headed.join(clean.withColumn("__head", F.col(prefix)), "__head").drop("__head")


def tiered_join(left: DataFrame, right: DataFrame, tiers: Sequence[Sequence[str]], limit: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` on the first tier of columns that has a match.

    Rows that a tier matched don't reach the next one. ``tier`` tells which it
    was. With ``limit``, keys of a tier with more right rows don't match there.
    """
    left = stage(left.withColumn("__id", F.monotonically_increasing_id()), "tiered")
    extra = [c for c in right.columns]
    rest, out = left, None
    for number, keys in enumerate(tiers, 1):
        side = right.select(*(F.col(c).alias(f"r_{c}") for c in extra))
        if limit is not None:
            few = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= limit)
            few = few.select(*(F.col(k).alias(f"r_{k}") for k in keys))
            side = side.join(few, [f"r_{k}" for k in keys], "left_semi")
        condition = None
        for k in keys:
            test = F.col(k) == F.col(f"r_{k}")
            condition = test if condition is None else condition & test
        hit = rest.join(side, condition).withColumn("tier", F.lit(number))
        out = hit if out is None else out.unionByName(hit)
        if number < len(tiers):
            rest = rest.join(hit.select("__id").distinct(), "__id", "left_anti")
    return out.drop("__id")


def tiered_counts(left: DataFrame, right: DataFrame, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """``left`` with ``tier``, the first tier of columns that has a match in ``right``, and ``n_matches``, how many.

    Right rows are counted by key first, so a hot key makes one row for each
    left one and no pairs. Left rows that no tier matches are left out; null
    keys match nothing.
    """
    out = left
    for number, keys in enumerate(tiers, 1):
        out = out.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n{number}")), list(keys), "left")
    counts = [F.col(f"__n{number}") for number in range(1, len(tiers) + 1)]
    tier = F.coalesce(*(F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(counts, 1)))
    return out.withColumn("tier", tier).withColumn("n_matches", F.coalesce(*counts)).where(F.col("tier").isNotNull()).select(*left.columns, "tier", "n_matches")


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in a total ``order``, without a single task for all rows.

    Rows are range-partitioned by the order; each part is summed, the sums of
    the parts (one row for each) give its start, and the rest is a window
    within the part. Nulls count as 0. The order must tell rows apart.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = {r["__part"]: r["s"] for r in ranged.groupBy("__part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("s")).collect()}
    start, starts = 0, []
    for p in sorted(sums):
        starts += [F.lit(p), F.lit(start)]
        start += sums[p]
    if not starts:
        return df.withColumn(name, F.lit(0))
    offset = F.try_element_at(F.create_map(*starts), F.col("__part"))
    within = F.sum(F.coalesce(F.col(value), F.lit(0))).over(
        Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return ranged.withColumn(name, within + offset).drop("__part")
