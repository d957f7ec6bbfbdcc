"""Merging of data-flow facts: flags by OR, sets by union, with deterministic caps and widening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the reference semantics. None switches a limit off.
ORIGIN_CAP, ENTRY_CAP, LOCATION_CAP, PATH_DEPTH, NESTED_PATHS = 48, 8, 16, 16, 64


def merge_flags(df: DataFrame, keys: Sequence[str], flags: Sequence[str], strict: bool = False) -> DataFrame:
    """One row for each key with every flag ORed (``strict``: ANDed); null flags are false.

    Idempotent, commutative and associative; partial sums are made before the shuffle.
    """
    merge = F.bool_and if strict else F.bool_or
    return df.groupBy(*keys).agg(*(merge(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags))


def cap_per_holder(df: DataFrame, holder: Sequence[str], order: Sequence[str], cap: int | None = ORIGIN_CAP) -> DataFrame:
    """The first ``cap`` rows of each holder; merge before, so that flags of kept rows are whole.

    A limit on the window goes below the shuffle, so a large holder sends at most ``cap`` rows a task.
    """
    if cap is None:
        return df
    place = F.row_number().over(Window.partitionBy(*holder).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= cap).drop("__place")


def merge_sets(df: DataFrame, keys: Sequence[str], columns: dict[str, int | None]) -> DataFrame:
    """Union of arrays for each key, sorted, and cut after the number given.

    Distinct elements are found before they are gathered: an element that
    repeats in many rows is gathered once, and a cap goes below the gathering.
    Nulls and empty arrays add nothing; a key without elements has an empty array.
    """
    out = df.select(*keys).distinct()
    for column, cap in columns.items():
        elements = df.select(*keys, F.explode(column).alias("__e")).where(F.col("__e").isNotNull()).distinct()
        elements = cap_per_holder(elements, keys, ["__e"], cap)
        sets = elements.groupBy(*keys).agg(F.array_sort(F.collect_list("__e")).alias(column))
        condition = None
        right = sets.select(*(F.col(k).alias(f"__{k}") for k in keys), column)
        for k in keys:
            test = F.col(k).eqNullSafe(F.col(f"__{k}"))
            condition = test if condition is None else condition & test
        out = out.join(right, condition, "left").drop(*(f"__{k}" for k in keys))
        element = dict(df.dtypes)[column]
        out = out.withColumn(column, F.coalesce(column, F.array().cast(element)))
    return out


def widen_paths(df: DataFrame, holder: Sequence[str], path: str, limit: int = NESTED_PATHS, depth: int = PATH_DEPTH) -> DataFrame:
    """Collapse paths (arrays) of holders with more than ``limit`` different ones below a root.

    The root is the first segment; beyond the limit the last segment of a path
    becomes ``[*]``, and where that's still too many, only the root stays with
    one ``[*]``. Paths are cut at ``depth`` segments first. Distinct paths are
    counted, so repeated rows don't widen anything.
    """
    df = df.withColumn(path, F.slice(path, 1, depth)).withColumn("__root", F.element_at(path, 1))
    for stage in ("last", "root"):
        counts = df.select(*holder, "__root", path).distinct().groupBy(*holder, "__root").agg(F.count(F.lit(1)).alias("__n"))
        many = counts.where(F.col("__n") > limit).select(*holder, "__root", F.lit(True).alias("__many"))
        short = F.concat(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), F.array(F.lit("[*]")))
        collapsed = short if stage == "last" else F.array("__root", F.lit("[*]"))
        df = (
            df.join(many, [*holder, "__root"], "left")
            .withColumn(path, F.when(F.col("__many") & (F.size(path) > 1), collapsed).otherwise(F.col(path)))
            .drop("__many")
        )
    return df.drop("__root")


def path_segments(path: Column) -> Column:
    """``root.prop[key][]`` as an array of segments, each with its sign."""
    return F.regexp_extract_all(path, F.lit(r"(^[^.\[]+|\.[^.\[]+|\[[^\]]*\])"), 1)


def path_variants(segments: Column) -> Column:
    """All paths that a lookup of ``segments`` may mean: any key may stand as ``[*]``, at the last key only.

    An equi join on the exploded variants replaces a join on patterns.
    """
    last = F.element_at(segments, -1)
    general = F.concat(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("[*]")))
    return F.when((F.size(segments) > 0) & last.startswith("["), F.array_distinct(F.array(segments, general))).otherwise(
        F.array(segments)
    )


def optional_merge(value: Column) -> Column:
    """Union of values as a sorted array, or null where there is none: nothing merged with nothing stays nothing."""
    values = F.array_sort(F.collect_set(value))
    return F.when(F.size(values) > 0, values)


def equivalent(*pairs: tuple[Column, Column]) -> Column:
    """Whether all pairs are equal, null and null included; arrays must be sorted."""
    test = F.lit(True)
    for a, b in pairs:
        test = test & a.eqNullSafe(b)
    return test


def single_root(df: DataFrame, holder: Sequence[str], root: str, flags: Sequence[str]) -> DataFrame:
    """(holder, root): holders whose origins all have one root, none of them null, and no flag at all.

    Smallest and largest are compared, so nothing is gathered. Null flags are false.
    """
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f), F.lit(False))
    folded = df.groupBy(*holder).agg(
        F.min(root).alias("__lo"), F.max(root).alias("__hi"), F.count_if(F.col(root).isNull()).alias("__none"), F.bool_or(any_flag).alias("__flagged")
    )
    return folded.where((F.col("__lo") == F.col("__hi")) & (F.col("__none") == 0) & ~F.col("__flagged")).select(*holder, F.col("__lo").alias(root))


def drop_covered_parents(df: DataFrame, holder: Sequence[str], path: str, origin: str) -> DataFrame:
    """``df`` (holder, path: array of segments, origin; distinct) without the paths whose origins all stand below them.

    A path is dropped if it has a path below it and each of its origins is one
    of those below. Every path is spread to the paths above it, so that the
    relation of prefixes is an equi join.
    """
    ups = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(F.col(path), F.lit(1), n))
    below = df.where(F.size(path) > 1).select(*holder, F.explode(ups).alias(path), origin).distinct()
    open_ = df.join(below, [*holder, path, origin], "left_anti").select(*holder, path).distinct()
    return df.join(open_, [*holder, path], "left_semi")


def cap_fan_out(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``df`` without the rows of keys that have more than ``limit`` of them."""
    few = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= limit).select(*keys)
    return df.join(few, list(keys), "left_semi")
