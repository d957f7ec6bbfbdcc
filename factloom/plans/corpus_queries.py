"""Queries of the general corpus problems (1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.severity import canonical_severity
from factloom.operators.instants import normalise_instants
from factloom.operators.snapshot_diff import finding_changes
from factloom.operators.tree_aggregate import (
    count_state,
    distinct_state,
    heavy_keys,
    max_state,
    min_state,
    sum_state,
    tree_aggregate,
)
from factloom.session import load, stage

#: A value is heavy from this share of its table's rows on.
HEAVY_SHARE = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    findings, jobs = load(spark, d, "findings"), load(spark, d, "jobs")
    return heavy_keys(
        [("findings.rule_id", findings, "rule_id"), ("findings.slug", findings, "slug"), ("jobs.slug", jobs, "slug")],
        HEAVY_SHARE,
    ).select("field_name", "key_value")


def p1_rule_profile(spark: SparkSession, d: str) -> DataFrame:
    """Results of each rule, all rows, nulls included."""
    severity = canonical_severity(F.col("severity"))
    return tree_aggregate(
        load(spark, d, "findings"),
        ["rule_id"],
        {
            "n_rows": count_state(),
            "n_critical": count_state(severity == "critical"),
            "n_high": count_state(severity == "high"),
            "first_line": min_state(F.col("line")),
            "last_line": max_state(F.col("line")),
            "last_id": max_state(F.col("finding_id")),
        },
    )


def p1_slug_profile(spark: SparkSession, d: str) -> DataFrame:
    """Results of each slug and the number of its jobs, both counted whole: jobs by the tree first, then slugs over them."""
    by_job = stage(tree_aggregate(load(spark, d, "findings"), ["slug", "job_id"], {"n_rows": count_state()}), "slug-jobs")
    jobs = count_state(F.col("job_id").isNotNull())
    return tree_aggregate(by_job, ["slug"], {"n_rows": sum_state(F.col("n_rows")), "n_jobs": jobs, "most_rows": max_state(F.col("n_rows"))})


def p1_slug_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Distinct jobs of each slug by a sketch of fixed size: an estimate beside ``p1_slug_profile``."""
    return tree_aggregate(load(spark, d, "findings"), ["slug"], {"jobs_estimate": distinct_state(F.col("job_id"))})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return finding_changes(load(spark, d, "findings"), load(spark, d, "jobs"))


def p3_change_tally(spark: SparkSession, d: str) -> DataFrame:
    """Changes counted by batch and pair of versions."""
    return (
        p3_found(spark, d)
        .groupBy("batch_id", "version_from", "version_to", "change_kind")
        .agg(F.count(F.lit(1)).alias("n_keys"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_instants(
        [
            ("plugins", load(spark, d, "plugins"), "record_id", ["last_updated", "added"]),
            ("payload_summaries", load(spark, d, "payload_summaries"), "payload_id", ["generated_at"]),
        ],
        load(spark, d, "collectors"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_rule_profile": p1_rule_profile,
    "p1_slug_profile": p1_slug_profile,
    "p1_slug_sketch": p1_slug_sketch,
    "p3_found": p3_found,
    "p3_change_tally": p3_change_tally,
    "p5_found": p5_found,
}

_SEVERITY_SQL = (
    "CASE WHEN lower(trim(severity, chr(32) || chr(9) || chr(13) || chr(10) || chr(160)))"
    " IN ('critical','high','medium','low') THEN"
    " lower(trim(severity, chr(32) || chr(9) || chr(13) || chr(10) || chr(160))) ELSE 'info' END"
)

_SNAPSHOT_SQL = f"""
WITH scans AS (
  SELECT DISTINCT id, batch_id, version FROM jobs
  WHERE batch_id IS NOT NULL AND status = 'done' AND NOT coalesce(truncated, false)
), versions AS (
  SELECT batch_id, version, lead(version) OVER w AS next_version
  FROM (SELECT DISTINCT batch_id, version FROM scans)
  WINDOW w AS (PARTITION BY batch_id ORDER BY
    list_resize(list_transform(string_split(regexp_extract(version, '^[0-9.]+'), '.'), lambda x: CAST(x AS BIGINT)), 8, 0),
    CASE WHEN version LIKE '%-beta%' THEN 1 WHEN version LIKE '%-rc%' THEN 2 ELSE 3 END,
    coalesce(TRY_CAST(regexp_extract(version, '-[a-z]+([0-9]+)', 1) AS BIGINT), 0), version)
), contents AS (
  SELECT DISTINCT s.batch_id, s.version, f.finding_key,
    {{'m': message, 'a': access, 's': {_SEVERITY_SQL}, 'c': required_capability, 'r': minimum_role, 'f': callable,
      'x': source, 'y': sink, 'e': list_sort(list_distinct(list_transform(entrypoints, lambda e: CAST(e AS VARCHAR))))}} AS body
  FROM findings f JOIN scans s ON f.job_id = s.id
), pairs AS (SELECT batch_id, version AS version_from, next_version AS version_to FROM versions WHERE next_version IS NOT NULL),
a AS (SELECT p.*, c.finding_key, c.body FROM pairs p JOIN contents c ON c.batch_id = p.batch_id AND c.version = p.version_from),
b AS (SELECT p.*, c.finding_key, c.body FROM pairs p JOIN contents c ON c.batch_id = p.batch_id AND c.version = p.version_to),
changes AS (
  SELECT coalesce(a.batch_id, b.batch_id) AS batch_id, coalesce(a.version_from, b.version_from) AS version_from,
    coalesce(a.version_to, b.version_to) AS version_to, coalesce(a.finding_key, b.finding_key) AS finding_key,
    CASE WHEN a.batch_id IS NULL THEN 'added' WHEN b.batch_id IS NULL THEN 'removed'
         WHEN a.body IS DISTINCT FROM b.body THEN 'changed' END AS change_kind
  FROM a FULL JOIN b ON a.batch_id = b.batch_id AND a.version_from = b.version_from AND a.version_to = b.version_to
    AND a.finding_key = b.finding_key
)"""

ORACLES = {
    "p1_found": """
WITH v AS (
  SELECT 'findings.rule_id' AS field_name, rule_id AS key_value FROM findings
  UNION ALL SELECT 'findings.slug', slug FROM findings
  UNION ALL SELECT 'jobs.slug', slug FROM jobs
), c AS (SELECT field_name, key_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS total FROM v GROUP BY 1, 2)
SELECT field_name, key_value FROM c WHERE key_value IS NOT NULL AND n >= 0.04 * total""",
    "p1_rule_profile": f"""
SELECT rule_id, count(*) AS n_rows, count_if({_SEVERITY_SQL} = 'critical')::BIGINT AS n_critical,
  count_if({_SEVERITY_SQL} = 'high')::BIGINT AS n_high, min(line) AS first_line, max(line) AS last_line,
  max(finding_id) AS last_id
FROM findings GROUP BY rule_id""",
    "p1_slug_profile": """
WITH j AS (SELECT slug, job_id, count(*) AS n FROM findings GROUP BY 1, 2)
SELECT slug, sum(n)::BIGINT AS n_rows, count_if(job_id IS NOT NULL)::BIGINT AS n_jobs, max(n) AS most_rows FROM j GROUP BY 1""",
    "p3_found": _SNAPSHOT_SQL
    + " SELECT batch_id, version_from, version_to, finding_key, change_kind FROM changes WHERE change_kind IS NOT NULL",
    "p3_change_tally": _SNAPSHOT_SQL
    + """ SELECT batch_id, version_from, version_to, change_kind, count(*) AS n_keys
FROM changes WHERE change_kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
}
