"""Changes between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.severity import canonical_severity
from factloom.functions.versions import version_key

_NO_TEXT = "\u0000null"


def row_hash(*columns: Column) -> Column:
    """A 64-bit hash of a row in which null differs from every value.

    ``xxhash64`` skips nulls, so each column is followed by its null flag.
    """
    parts: list[Column] = []
    for c in columns:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def struct_hash(column: Column, fields: tuple[str, ...]) -> Column:
    """Hash of a struct; a null struct differs from one of nulls."""
    return F.when(column.isNotNull(), row_hash(*(column.getField(f) for f in fields)))


def set_hash(column: Column, fields: tuple[str, ...]) -> Column:
    """Hash of an array of structs read as a set: order and repeats don't matter; null is the empty set."""
    hashes = F.transform(column, lambda x: row_hash(*(x.getField(f) for f in fields)))
    return F.xxhash64(F.coalesce(F.array_sort(F.array_distinct(hashes)), F.array().cast("array<bigint>")))


def finding_hash() -> Column:
    """Canonical hash of what makes a finding itself, apart from its key."""
    place = ("path", "line", "snippet")
    return row_hash(
        F.col("message"),
        F.col("access"),
        canonical_severity(F.col("severity")),
        F.col("required_capability"),
        F.col("minimum_role"),
        F.col("callable"),
        struct_hash(F.col("source"), place),
        struct_hash(F.col("sink"), place),
        set_hash(F.col("entrypoints"), ("kind", "name", "route", "methods", "access")),
    )


def ordered_snapshots(snapshots: DataFrame) -> DataFrame:
    """Number the versions of each batch: batch_id, version, idx from 1, n versions, next_version.

    ``snapshots`` is made distinct first, so a batch has one row per version
    that was scanned in it; scans repeated for a version add nothing.
    """
    batch = Window.partitionBy("batch_id")
    order = batch.orderBy("__key", "version")
    return (
        snapshots.select("batch_id", "version")
        .distinct()
        .withColumn("__key", version_key(F.col("version")))
        .select(
            "batch_id",
            "version",
            F.row_number().over(order).alias("idx"),
            F.count(F.lit(1)).over(batch).alias("n"),
            F.lead("version").over(order).alias("next_version"),
        )
    )


def snapshot_changes(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Added, removed and changed keys between consecutive snapshots.

    ``snapshots``: snapshot_id, batch_id, version, one row or more for each
    delivery; several deliveries of one version agree and count once.
    ``records``: snapshot_id, record_key, record_hash; rows of ids that are no
    snapshot are ignored. A snapshot without records is an empty one: all keys
    of its neighbours were removed before it and added after it. Null batch or
    version is no snapshot, a null key is a key like any other. A key repeated
    in a snapshot with different contents is changed if the set of its
    contents is: distinct hashes are found first, then folded into one, so that
    order and repeats don't matter and no set is gathered.

    Both sides of the full outer join come from one aggregate, whose exchange
    Spark reuses: a side is chosen by a value made in the aggregate, so that
    no filter moves below it. Repeats are combined before the shuffle.
    Result: batch_id, version_from, version_to, record_key, change_kind.
    """
    kept = snapshots.where(F.col("batch_id").isNotNull() & F.col("version").isNotNull()).select(
        "snapshot_id", "batch_id", "version"
    ).distinct()
    order = ordered_snapshots(kept)
    numbered = kept.join(order, ["batch_id", "version"]).select("snapshot_id", "batch_id", "idx", "n")
    span = F.shiftleft(F.col("idx").cast("bigint"), 31).bitwiseOR(F.col("n").cast("bigint"))
    states = (
        records.select("snapshot_id", F.coalesce("record_key", F.lit(_NO_TEXT)).alias("record_key"), "record_hash")
        .join(numbered, "snapshot_id")
        .groupBy("batch_id", "idx", "record_key", "record_hash")
        .agg(F.max(span).alias("span"))
        .groupBy("batch_id", "idx", "record_key")
        .agg(F.bit_xor(F.xxhash64("record_hash")).alias("contents"), F.max("span").alias("span"))
    )
    at, last = F.shiftright("span", 31), F.col("span").bitwiseAND(F.lit((1 << 31) - 1))
    a = states.where(at < last).select(
        "batch_id", "idx", "record_key", F.col("contents").alias("a_contents"), F.lit(True).alias("in_a")
    )
    b = states.where(at > 1).select(
        "batch_id",
        (F.col("idx") - 1).alias("idx"),
        "record_key",
        F.col("contents").alias("b_contents"),
        F.lit(True).alias("in_b"),
    )
    joined = a.join(b, ["batch_id", "idx", "record_key"], "full_outer")
    kind = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(~F.col("a_contents").eqNullSafe(F.col("b_contents")), "changed")
    )
    changes = joined.select(
        "batch_id",
        "idx",
        F.nullif("record_key", F.lit(_NO_TEXT)).alias("record_key"),
        kind.alias("change_kind"),
    ).where(F.col("change_kind").isNotNull())
    pairs = order.where(F.col("next_version").isNotNull()).select(
        "batch_id", "idx", F.col("version").alias("version_from"), F.col("next_version").alias("version_to")
    )
    return changes.join(pairs, ["batch_id", "idx"]).select(
        "batch_id", "version_from", "version_to", "record_key", "change_kind"
    )


def finding_changes(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Changes of findings between the versions of a batch.

    A job with a batch that is done and not truncated delivers the snapshot of
    its version. Result: batch_id, version_from, version_to, finding_key,
    change_kind.
    """
    snapshots = jobs.where(
        F.col("batch_id").isNotNull() & (F.col("status") == "done") & ~F.coalesce(F.col("truncated"), F.lit(False))
    ).select(F.col("id").alias("snapshot_id"), "batch_id", "version")
    records = findings.select(
        F.col("job_id").alias("snapshot_id"), F.col("finding_key").alias("record_key"), finding_hash().alias("record_hash")
    )
    return snapshot_changes(records, snapshots).withColumnRenamed("record_key", "finding_key")
