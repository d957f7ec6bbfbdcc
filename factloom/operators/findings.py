"""Operators on findings: representatives, clusters, suppression, tallies, diffs, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scores import concrete, standing, visible_callable
from factloom.operators.closure import components
from factloom.operators.joins import near_before


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; ties beyond the order go to any equal row.

    The limit of the window is applied before the shuffle too, so copies of a
    hot key don't travel.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def cluster_by_keys(df: DataFrame, row: str, keys: Sequence[Column]) -> DataFrame:
    """(row, cluster): rows that share any of the key texts, directly or through others.

    Every key is a node beside the rows, so a key shared by many rows costs an
    edge for each row, not one for each pair. Null keys link nothing; a row
    without keys is alone.
    """
    named = F.array(*(F.concat(F.lit(f"k{i}|"), k) for i, k in enumerate(keys)))
    own = F.concat(F.lit("r|"), F.col(row).cast("string"))
    edges = df.select(own.alias("a"), F.explode(named).alias("b")).where(F.col("b").isNotNull())
    groups = components(edges)
    return (
        df.select(F.col(row), own.alias("node"))
        .distinct()
        .join(groups, "node", "left")
        .select(row, F.coalesce("component", "node").alias("cluster"))
    )


def without_guarded(findings: DataFrame, guards: DataFrame, by: Sequence[str], line: str, guard_line: str, within: int = 48) -> DataFrame:
    """Findings that no guard stands 0 to ``within`` lines before."""
    return near_before(findings, guards, by, line, guard_line, within, absent=True)


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): removed, added or common by key, in one full outer join of distinct keys."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("common")
    return left.join(right, list(keys), "full_outer").select(*keys, kind.alias("change"))


def tally(df: DataFrame, keys: Sequence[str], severity: Column) -> DataFrame:
    """Counts by severity word, and in total."""
    words = ("critical", "high", "medium", "low", "info")
    return df.groupBy(*keys).agg(
        *(F.count_if(severity == w).alias(f"n_{w}") for w in words), F.count(F.lit(1)).alias("n_total")
    )


def top_values(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """(keys, values): the ``n`` most frequent values of each key, by count and then the value, as an array."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    kept = counts.withColumn("place", place).where(F.col("place") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col(value).alias("v"))))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda x: x.getField("v")).alias("top_values"))


#: Rules whose findings at one site are one, whatever their sources; all others are told by their source too.
COLLAPSED = """wp-request-tainted-privilege-mutation predictable-security-identifier-surface upload-api-surface
wp-issued-auth-link-surface wp-reflected-xss-direct-request-output stored-xss path-transversal request-path-read-delete
render-callback-execution unsafe-deserialization unsafe-use tainted-sql-string wp-stored-xss-persistent-read-to-output
wp-ajax-financial-action-without-cap-check wp-request-file-upload-without-cap-check
wp-request-record-read-to-output-without-cap-check wp-request-file-delete-without-cap-check
wp-rest-token-issuance-surface wp-rest-public-data-disclosure-surface wp-request-sensitive-action-without-cap-check""".split()
#: Rules whose site has no line but a callable; rules whose sites are the same for every callable.
BY_CALLABLE = ("wp-request-sensitive-action-without-cap-check",)
ANY_CALLABLE = """wp-request-tainted-privilege-mutation path-transversal request-path-read-delete tainted-sql-string upload-api-surface
wp-request-file-upload-without-cap-check wp-stored-xss-persistent-read-to-output unsafe-use
wp-request-record-read-to-output-without-cap-check render-callback-execution""".split()


def site_keys() -> tuple[Column, Column]:
    """The key of a finding's site, and another one that ties findings of the same source and sink text together (or null)."""
    text = lambda *c: F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("")) for x in c))
    rule = F.coalesce("rule_id", F.lit(""))
    name = visible_callable(F.col("callable"))
    exact = text(F.lit("exact"), rule, F.col("path"), F.col("line"), F.col("source.path"), F.col("source.line"), F.col("callable"))
    place = text(F.lit("site"), rule, F.col("path"), F.col("line"), F.col("message"), F.col("sink.path"), F.col("sink.line"))
    key = (
        F.when(~rule.isin(*COLLAPSED), F.when(concrete(F.col("source")), exact).otherwise(text(place, name)))
        .when(rule.isin(*BY_CALLABLE), text(F.lit("action"), rule, F.col("path"), F.col("message"), F.col("sink.path"), F.col("sink.snippet")))
        .when(rule.isin(*ANY_CALLABLE), place)
        .otherwise(text(place, name))
    )
    tied = (rule == "wp-request-tainted-privilege-mutation") & (name != "") & (F.trim("source.snippet") != "") & (F.trim("sink.snippet") != "")
    return key, F.when(tied, text(F.lit("tied"), rule, F.col("message"), F.col("source.snippet"), F.col("sink.snippet")))


def final_findings(findings: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One finding for each site within ``scope``: columns of ``findings``, standing, n_findings.

    Sites that a second key ties together are one. Of a site's findings the
    one that stands best for it is kept, of equals the first in ``order``. The
    rules hold whatever the order of the rows.
    """
    key, other = site_keys()
    owner = F.concat_ws("|", *(F.coalesce(F.col(s), F.lit("")) for s in scope))
    keyed = findings.withColumn("__key", F.concat_ws("|", owner, key)).withColumn("__other", F.concat(owner, F.lit("|"), other))
    links = keyed.where(F.col("__other").isNotNull()).select(F.col("__key").alias("a"), F.col("__other").alias("b")).distinct()
    groups = components(links)
    ranked = (
        keyed.join(groups.withColumnRenamed("node", "__key"), "__key", "left")
        .withColumn("__site", F.coalesce("component", "__key"))
        .withColumn("standing", standing(F.col("rule_id"), F.col("source"), F.col("sink"), F.col("callable")))
    )
    counts = ranked.groupBy("__site").agg(F.count(F.lit(1)).alias("n_findings"))
    best = best_per_key(ranked, ["__site"], [F.desc("standing"), *(F.asc(c) for c in order)])
    return best.join(counts, "__site").drop("__key", "__other", "__site", "component")


def valid_requests(requests: DataFrame, most_versions: int) -> DataFrame:
    """Requests (slug, version) of a right form, once each, the first ``most_versions`` of a slug.

    A slug is lower-case letters, figures, hyphens and underscores, a version
    has no path in it; null is neither.
    """
    good = requests.where(F.col("slug").rlike(r"^[a-z0-9][a-z0-9_-]*$") & F.col("version").rlike(r"^[0-9A-Za-z][0-9A-Za-z._+-]*$"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("version"))
    return good.select("slug", "version").distinct().withColumn("place", place).where(F.col("place") <= most_versions).drop("place")


def merge_payloads(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Result lists as one; of rows with equal keys that of the last list stays."""
    merged = None
    for i, part in enumerate(parts):
        one = part.withColumn("__part", F.lit(i))
        merged = one if merged is None else merged.unionByName(one)
    return best_per_key(merged, keys, [F.desc("__part")]).drop("__part")
