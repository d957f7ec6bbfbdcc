"""Queries of the fact operators over the findings, jobs and plugins tables, and over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.access import (
    CAPABILITY_ROLE,
    ROLE_LEVEL,
    access_severity,
    derive_access,
    minimum_role,
    role_level,
)
from factloom.functions.scores import exploitability, standing
from factloom.functions.severity import canonical_severity
from factloom.functions.text import ENTITIES, fingerprint, plain_text, tolerant_string, url_host, wildcard_pattern
from factloom.functions.versions import version_key
from factloom.operators import closure, findings as ops, joins, lattice
from factloom.session import load

#: Patterns of hook names.
HOOKS = ["save_", "admin_post_", "wp_", "load", "order_"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Findings once each, best of every site, ranked, with severity; counted by rule and severity."""
    f = load(spark, d, "findings")
    once = ops.best_per_key(
        f.select("finding_id", "slug", "rule_id", "access", "ingested_at", F.col("sink.path").alias("sink_path"), F.col("sink.line").alias("sink_line")),
        ["finding_id"],
        [F.desc("ingested_at"), F.asc("slug")],
    )
    scored = once.withColumn("score", exploitability(F.col("rule_id"), F.col("access")))
    best = ops.best_per_key(scored, ["slug", "rule_id", "sink_path", "sink_line"], [F.desc("score"), F.asc("finding_id")])
    return (
        best.groupBy(F.coalesce("rule_id", F.lit("")).alias("rule"), access_severity(F.col("access")).alias("tier"))
        .agg(F.count(F.lit(1)).alias("n_sites"), F.max("score").alias("best_score"))
    )


def finding_latest(spark, d):
    f = load(spark, d, "findings").select("finding_id", "job_id", "slug", "rule_id", "ingested_at")
    return ops.best_per_key(f, ["finding_id"], [F.desc("ingested_at"), F.asc("job_id")])


def finding_rank(spark, d):
    """The fifty most exposed findings; the report is a top list."""
    f = load(spark, d, "findings").select("finding_id", "rule_id", "access", "path", "line", "source", "sink").distinct()
    return (
        f.withColumn("score", exploitability(F.col("rule_id"), F.col("access"), None, F.col("source"), F.col("sink")))
        .orderBy(F.desc("score"), "rule_id", "path", "line", "finding_id")
        .limit(50)
        .select("finding_id", "rule_id", "score")
    )


def finding_clusters(spark, d):
    """Clusters of a slug's findings that share their exact site or their sink, with their size."""
    f = load(spark, d, "findings").select(
        "finding_id",
        F.concat_ws("|", "slug", "finding_key").alias("exact"),
        F.concat_ws("|", "slug", "rule_id", "sink.path", F.col("sink.line").cast("string")).alias("site"),
    ).distinct()
    return ops.cluster_by_keys(f, "finding_id", [F.col("exact"), F.col("site")]).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_findings"), F.min("finding_id").alias("first_id")
    ).select("n_findings", "first_id")


def finding_unguarded(spark, d):
    """Findings of a job's file that no capability-checked finding stands up to 48 lines before."""
    f = load(spark, d, "findings").select("job_id", "path", "line", "finding_id", "access", "rule_id").distinct()
    guards = f.where(F.col("access") == "capability_checked").select("job_id", "path", F.col("line").alias("guard"))
    open_ = f.where((F.col("access") != "capability_checked") | F.col("access").isNull())
    left = ops.without_guarded(open_, guards, ["job_id", "path"], "line", "guard")
    return left.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_unguarded"))


def finding_tally(spark, d):
    f = load(spark, d, "findings").select("finding_id", "slug", "severity").dropDuplicates(["finding_id"])
    return ops.tally(f, ["slug"], canonical_severity(F.col("severity")))


def finding_summary(spark, d):
    """Rule, file and grand totals in one pass by grouping sets."""
    f = load(spark, d, "findings")
    return (
        f.groupingSets([["rule_id"], ["path"], []], "rule_id", "path")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct("slug").alias("n_slugs"))
        .select("level", "rule_id", "path", "n", "n_slugs")
    )


def sink_groups(spark, d):
    """Each sink text with its number of findings and its five commonest sources."""
    f = load(spark, d, "findings").select(F.col("sink.snippet").alias("sink_text"), F.col("source.snippet").alias("source_text"))
    counts = f.groupBy("sink_text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_text").alias("n_sources"))
    top = ops.top_values(f.where("sink_text is not null"), ["sink_text"], "source_text", 5)
    return counts.join(top, "sink_text").select("sink_text", "n", "n_sources", F.array_join("top_values", " ; ").alias("top_sources"))


def hook_patterns(spark, d):
    """Entry points by the hook pattern that their name starts with."""
    entries = load(spark, d, "findings").select("finding_id", F.explode("entrypoints").alias("e")).select("e.name").where("name is not null")
    patterns = spark.createDataFrame([(h,) for h in HOOKS], "prefix string")
    return joins.prefix_join(entries, "name", patterns, "prefix").groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_names")
    )


def hook_holes(spark, d):
    """Names of entry points that a pattern with holes fits."""
    entries = load(spark, d, "findings").select(F.explode("entrypoints").alias("e")).select("e.name").where("name is not null")
    names = entries.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    pattern = wildcard_pattern(F.lit("save_{what}"))
    return names.where(F.rlike("name", pattern))


def access_context(spark, d):
    """Tier of each slug's rule derived from the tiers of its entry points and its checks."""
    f = load(spark, d, "findings").where("rule_id is not null")
    facts = f.groupBy("slug", "rule_id").agg(
        F.bool_or(F.col("required_capability").isNotNull() & (F.col("required_capability") != "read")).alias("privileged"),
        F.bool_or(F.col("required_capability").isNotNull()).alias("capability"),
        F.bool_or(F.col("access") == "authenticated").alias("auth"),
        F.bool_or(F.col("access") == "unauthenticated").alias("unauth"),
        F.bool_or(F.col("access") == "nonce_only").alias("nonce"),
    )
    tier = derive_access(*(F.col(c) for c in ("privileged", "capability", "auth", "unauth", "nonce")), F.array().cast("array<string>"))
    return facts.select("slug", "rule_id", tier.alias("tier"))


def capability_roles(spark, d):
    f = load(spark, d, "findings").where("required_capability is not null")
    role = minimum_role(F.col("required_capability"))
    return f.groupBy("required_capability", role.alias("role"), role_level(role).alias("role_level")).agg(F.count(F.lit(1)).alias("n"))


def origin_merge(spark, d):
    """Flags of each slug's sink file ORed, and its first 48 origins in order."""
    f = load(spark, d, "findings").select(
        "slug",
        F.col("sink.path").alias("holder"),
        F.concat_ws(":", "source.path", F.col("source.line").cast("string")).alias("origin"),
        F.contains("source.snippet", F.lit("get_post_meta")).alias("persistent"),
        F.contains("source.snippet", F.lit("$_COOKIE")).alias("cookie"),
    )
    flags = lattice.merge_flags(f, ["slug", "holder"], ["persistent", "cookie"])
    origins = lattice.cap_per_holder(f.select("slug", "holder", "origin").distinct(), ["slug", "holder"], ["origin"])
    counts = origins.groupBy("slug", "holder").agg(F.count(F.lit(1)).alias("n_origins"), F.max("origin").alias("last_origin"))
    return flags.join(counts, ["slug", "holder"])


def context_merge(spark, d):
    """First eight entry points of each rule, as the union over its findings."""
    f = load(spark, d, "findings").where("rule_id is not null").select(
        "rule_id", F.transform("entrypoints", lambda e: F.concat_ws("/", e.getField("kind"), e.getField("name"), e.getField("route"))).alias("entries")
    )
    return lattice.merge_sets(f, ["rule_id"], {"entries": lattice.ENTRY_CAP}).select("rule_id", F.array_join("entries", ",").alias("entries"))


def path_widening(spark, d):
    """Directories of each slug; those with more than 64 different files below a root collapse."""
    f = load(spark, d, "findings").select("slug", F.split("path", "/").alias("segments")).distinct()
    wide = lattice.widen_paths(f, ["slug"], "segments")
    return wide.groupBy("slug", F.array_join("segments", "/").alias("place")).agg(F.count(F.lit(1)).alias("n"))


def job_fingerprint(spark, d):
    """Fingerprint of the set of finding keys of each slug's rule.

    The keys' hashes are summed, so order doesn't matter, partial sums are made
    before the shuffle and no set is gathered.
    """
    f = load(spark, d, "findings").where("rule_id is not null").select("slug", "rule_id", "finding_key").distinct()
    number = F.conv(F.substring(F.sha1("finding_key"), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = f.groupBy("slug", "rule_id").agg(F.sum(number).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("slug", "rule_id", fingerprint(F.array(F.col("s").cast("string"), F.col("n").cast("string"))).alias("fingerprint"))


def file_reach(spark, d):
    """Files of a slug that values from unauthenticated sources may reach, with the number of steps."""
    f = load(spark, d, "findings")
    node = lambda side: F.concat_ws("|", "slug", f"{side}.path")
    edges = f.select(node("source").alias("src"), node("sink").alias("dst"))
    seeds = f.where(F.col("access") == "unauthenticated").select(node("source").alias("node"))
    return closure.reach(edges, seeds)


def file_relevant(spark, d):
    """Files on a way from request values to redirects."""
    f = load(spark, d, "findings")
    node = lambda side: F.concat_ws("|", "slug", f"{side}.path")
    edges = f.select(node("source").alias("src"), node("sink").alias("dst"))
    sources = f.where(F.contains("source.snippet", F.lit("$request"))).select(node("source").alias("node"))
    sinks = f.where(F.contains("sink.snippet", F.lit("wp_redirect"))).select(node("sink").alias("node"))
    return closure.relevant(edges, sources, sinks)


def context_passes(spark, d):
    """Access tiers handed from file to file for up to eight passes."""
    f = load(spark, d, "findings")
    node = lambda side: F.concat_ws("|", "slug", f"{side}.path")
    edges = f.select(node("source").alias("src"), node("sink").alias("dst"))
    facts = f.where("access is not null").select(node("source").alias("node"), F.col("access").alias("fact"))
    got = closure.propagate_sets(edges, facts, 8)
    return got.groupBy("node").agg(F.count(F.lit(1)).alias("n_tiers"), F.min("fact").alias("first_tier"))


def owner_lookup(spark, d):
    """Nearest owner of each customer: itself if rich, else its nation if that has an even key, else its region."""
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    parents = c.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")).union(
        n.select(name("n", "n_nationkey"), name("r", "n_regionkey"))
    )
    owners = c.where("c_acctbal > 9000").select(name("c", "c_custkey").alias("node")).union(
        n.where("n_nationkey % 2 = 0").select(name("n", "n_nationkey"))
    ).union(n.select(name("r", "n_regionkey")).distinct())
    found = closure.nearest_owner(parents, owners)
    return found.where(F.col("node").startswith("c")).select("node", "owner", "depth")


def storage_bridge(spark, d):
    """Readers of stored values joined to writers: by exact key in the slug, else by family."""
    f = load(spark, d, "findings").select("finding_id", "slug", "rule_id", F.col("source.snippet").alias("text")).dropDuplicates(["finding_id"])
    readers = f.where(F.contains("text", F.lit("get_post_meta"))).select(
        "finding_id", "slug", F.lit("meta").alias("family"), F.regexp_extract("text", r"'(\w+)'", 1).alias("key")
    )
    writers = (
        load(spark, d, "findings")
        .where(F.col("rule_id").isin("wp-user-meta-write-open", "wp-option-write-without-role"))
        .select(
            "slug",
            F.when(F.contains("rule_id", F.lit("meta")), "meta").otherwise("option").alias("family"),
            F.regexp_extract("source.snippet", r"'(\w+)'", 1).alias("key"),
        )
        .distinct()
    )
    writers = writers.where("key <> ''").groupBy("slug", "family", "key").agg(F.lit(1).alias("one"))
    hit = joins.tiered_counts(readers, writers, [["slug", "family", "key"], ["slug", "family"]])
    return hit.groupBy("tier").agg(F.sum("n_matches").alias("n_links"), F.count(F.lit(1)).alias("n_readers"))


def latest_purchase(spark, d):
    """The latest purchase of the user before each error."""
    e = load(spark, d, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return joins.asof_join(errors, buys, ["user_id"], "ts", ["purchase_id"]).select("event_id", "purchase_id")


def cache_evict(spark, d):
    """Jobs whose results fall out of a cache that keeps the newest 5,000,000 ms of scans."""
    j = load(spark, d, "jobs").where("finished_at is not null").select("id", "finished_at", "duration_ms").dropDuplicates(["id"])
    sized = joins.running_sum(j, [F.desc("finished_at"), F.asc("id")], "duration_ms")
    return sized.where("running > 5000000").select("id", "running")


def job_latest(spark, d):
    """Each job once, newest first in its slug, with how many came before."""
    j = load(spark, d, "jobs").select("id", "slug", "status", "queued_at").distinct()
    return j.groupBy("slug").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.max_by("id", F.struct("queued_at", "id")).alias("newest"), F.count_if(F.col("status") == "done").alias("n_done")
    )


def job_batches(spark, d):
    """Batches with their state and totals."""
    j = load(spark, d, "jobs").where("batch_id is not null").dropDuplicates(["id"])
    return j.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col("status").isin("done", "failed", "skipped", "canceled")).alias("n_ended"),
        F.sum("counts.total").alias("n_findings"),
        F.sum("counts.critical").alias("n_critical"),
        F.max("queued_at").alias("last_queued"),
        F.count_distinct("version").alias("n_versions"),
    )


def scanned_versions(spark, d):
    """Versions of slugs with at least two, newest first."""
    j = load(spark, d, "jobs").where("status = 'done'").select("slug", "version").distinct()
    place = F.row_number().over(Window.partitionBy("slug").orderBy(version_key(F.col("version")).desc(), F.desc("version")))
    several = Window.partitionBy("slug")
    return j.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(several)).where("n >= 2").select("slug", "version", "place")


def latest_diff(spark, d):
    """Finding keys of the two newest done scans of each slug: added, removed or common, counted."""
    j = load(spark, d, "jobs").where("status = 'done' and finished_at is not null").select("id", "slug", "finished_at").distinct()
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("finished_at"), "id"))
    two = j.withColumn("place", place).where("place <= 2").select(F.col("id").alias("job_id"), "slug", "place")
    keys = load(spark, d, "findings").select("job_id", "finding_key").join(two, "job_id").select("slug", "finding_key", "place").distinct()
    both = two.groupBy("slug").agg(F.max("place").alias("n")).where("n = 2").select("slug")
    keys = keys.join(both, "slug", "left_semi")
    diff = ops.key_diff(keys.where("place = 2"), keys.where("place = 1"), ["slug", "finding_key"])
    return diff.groupBy("slug", "change").agg(F.count(F.lit(1)).alias("n_keys"))


def plugin_search(spark, d):
    """Page two of well-rated plugins in an install range, most installed first; a page is 24 rows."""
    p = load(spark, d, "plugins").where("active_installs >= 1000 and active_installs < 100000 and rating >= 60")
    return (
        p.select("record_id", "slug", "active_installs", "rating")
        .orderBy(F.desc("active_installs"), F.desc("rating"), "record_id")
        .offset(24)
        .limit(24)
    )


def plugin_text(spark, d):
    """Names and descriptions as plain text; tolerant fields; host of the author's address."""
    p = load(spark, d, "plugins")
    return p.select(
        "record_id",
        plain_text(F.col("name")).alias("name_text"),
        tolerant_string(F.col("requires_php")).alias("php"),
        url_host(F.regexp_extract("author", "href=[\"']([^\"']+)[\"']", 1)).alias("host"),
        F.coalesce(F.size(F.map_keys("icons")), F.lit(0)).alias("n_icons"),
    )


def payload_rules(spark, d):
    """Results per rule as the payload summaries tell them."""
    s = load(spark, d, "payload_summaries").select(F.explode("results_per_rule").alias("rule_id", "n"))
    return s.groupBy("rule_id").agg(F.sum("n").alias("n_results"), F.count(F.lit(1)).alias("n_payloads"))


def payload_enrich(spark, d):
    """Counts of each job's findings beside what its summary says."""
    s = load(spark, d, "payload_summaries").select("job_id", "total_results")
    f = load(spark, d, "findings").select("job_id", "finding_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(f, "job_id", "left").groupBy(
        F.when(F.coalesce("n", F.lit(0)) == F.col("total_results"), "agree").otherwise("differ").alias("verdict")
    ).agg(F.count(F.lit(1)).alias("n_jobs"))


def late_findings(spark, d):
    """Findings that came in more than a day after their job ended, by slug."""
    j = load(spark, d, "jobs").select(F.col("id").alias("job_id"), "finished_at").distinct()
    f = load(spark, d, "findings").select("job_id", "slug", "ingested_at")
    late = f.join(j, "job_id").where(F.col("ingested_at") > F.col("finished_at") + F.expr("INTERVAL 1 DAY"))
    return late.groupBy("slug").agg(F.count(F.lit(1)).alias("n_late"))


def event_sessions(spark, d):
    """Sessions of each user with gaps under two hours."""
    e = load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return (
        e.groupBy("user_id", F.session_window("t", "2 hours").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "total")
    )


def event_windows(spark, d):
    e = load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("w.start").alias("start_us"), "event_type", "n"
    )


def event_props(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def revenue_by_nation(spark, d):
    """A star join: revenue of each nation's customers from suppliers of the same nation."""
    c, o, l_, s, n = (load(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        l_.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.round(F.sum(money), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))
    )


def vector_norms(spark, d):
    v = load(spark, d, "embeddings")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.round(F.sqrt(squares), 3).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, finding_latest, finding_rank, finding_clusters, finding_unguarded, finding_tally, finding_summary,
        sink_groups, hook_patterns, hook_holes, access_context, capability_roles,
        origin_merge, context_merge, path_widening, job_fingerprint, file_reach, file_relevant, context_passes,
        owner_lookup, storage_bridge, latest_purchase, cache_evict, job_latest, job_batches, scanned_versions,
        latest_diff, plugin_search, plugin_text, payload_rules, payload_enrich, late_findings, event_sessions,
        event_windows, event_props, revenue_by_nation, vector_norms,
    )
}

_WEIGHT = """(CASE access WHEN 'unauthenticated' THEN 1000 WHEN 'permission_callback' THEN 700 WHEN 'nonce_only' THEN 600
  WHEN 'authenticated' THEN 400 WHEN 'unknown' THEN 200 WHEN 'capability_checked' THEN 50 ELSE 100 END
  - CASE WHEN coalesce(rule_id, '') LIKE '%-surface' THEN 150 ELSE 0 END)"""
_POINTS = [
    ("render-callback-execution", "source", "has('apply_filters(') OR has('apply_filters_ref_array(')", 160),
    ("render-callback-execution", "source", "has('apply_filters_deprecated(') AND NOT has('apply_filters(') AND NOT has('apply_filters_ref_array(')", 80),
    ("render-callback-execution", "source", "has('prepare_post_data(') OR has('stripslashes_deep($_post[''data''])') OR has('stripslashes_deep( $_post[''data''] )')", 48),
    ("wp-request-tainted-privilege-mutation", "source", "has('json_decode(') AND (has('$_post') OR has('$_request'))", 96),
    ("wp-request-tainted-privilege-mutation", "source", "has('new_role') OR has('[''role'']') OR has('\"role\"')", 72),
    ("wp-request-tainted-privilege-mutation", "source", "has('file_get_contents(') AND has('$_files')", -64),
    ("unsafe-deserialization", "source", "starts_with(ltrim(text), 'function ')", -128),
    *(
        (rule, "sink", test, points)
        for rule in ("wp-request-record-read-to-output-without-cap-check", "wp-stored-xss-persistent-read-to-output")
        for test, points in (
            ("has('preg_replace(')", 160), ("has('call_user_func(') OR has('call_user_func_array(')", 144),
            ("has('echo $') OR has('<?= $') OR has('print $')", 112),
            ("has('href=\"<?php echo') OR has('src=\"<?php echo') OR has('title=\"<?php echo')", 48),
            ("has('esc_url(') OR has('esc_attr(')", 24), ("has('esc_html(') OR has('number_format_i18n(')", -16),
        )
    ),
    *(
        (rule, "source", test, points)
        for rule in ("wp-request-file-delete-without-cap-check", "request-path-read-delete", "path-transversal")
        for test, points in (("has('file_path') OR has('tmp_name') OR has('filepath')", 96), ("has('path') OR has('file')", 40), ("has('text')", -24))
    ),
]


def _points_sql(rule: str, side: str, test: str, points: int) -> str:
    text = f"lower(coalesce({side}.snippet, ''))"
    test = test.replace("has(", f"contains({text}, ").replace("(text)", f"({text})")
    return f"CASE WHEN rule_id = '{rule}' AND ({test}) THEN {points} ELSE 0 END"


RULE_POINTS_SQL = "(" + " + ".join(_points_sql(*p) for p in _POINTS) + (
    " + CASE WHEN rule_id = 'path-transversal' AND source.path <> '' AND sink.path <> '' AND source.path <> sink.path THEN 32 ELSE 0 END)"
)
_TIER = """(CASE access WHEN 'unauthenticated' THEN 'critical' WHEN 'authenticated' THEN 'high' WHEN 'nonce_only' THEN 'medium'
  WHEN 'capability_checked' THEN 'low' ELSE 'info' END)"""
_WORD = "lower(trim(severity, chr(32) || chr(9) || chr(13) || chr(10) || chr(160)))"
_FILES = """
edges AS (SELECT DISTINCT slug || '|' || source.path AS src, slug || '|' || sink.path AS dst FROM findings)"""

ORACLES = {
    "flagship": f"""
WITH once AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC, slug) = 1),
best AS (SELECT *, {_WEIGHT} AS score FROM once
  QUALIFY row_number() OVER (PARTITION BY slug, rule_id, sink.path, sink.line ORDER BY {_WEIGHT} DESC, finding_id) = 1)
SELECT coalesce(rule_id, '') AS rule, {_TIER} AS tier, count(*) AS n_sites, max(score) AS best_score FROM best GROUP BY 1, 2""",
    "finding_latest": """
SELECT finding_id, job_id, slug, rule_id, ingested_at FROM findings
QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC, job_id) = 1""",
    "finding_rank": f"""
SELECT finding_id, rule_id, score FROM (
  SELECT DISTINCT finding_id, rule_id, access, path, line, source, sink, {_WEIGHT} + {RULE_POINTS_SQL} AS score FROM findings)
ORDER BY score DESC, rule_id NULLS FIRST, path, line, finding_id LIMIT 50""",
    "finding_clusters": """
WITH RECURSIVE f AS (SELECT DISTINCT finding_id, 'e' || concat_ws('|', slug, finding_key) AS x, 's' || concat_ws('|', slug, rule_id, sink.path, sink.line::VARCHAR) AS y FROM findings),
n AS (SELECT DISTINCT x AS a, y AS b FROM f UNION SELECT DISTINCT y, x FROM f),
c(k, root) AS (SELECT DISTINCT a, a FROM n UNION SELECT n.b, c.root FROM c JOIN n ON n.a = c.k),
g AS (SELECT k, min(root) AS root FROM c GROUP BY 1)
SELECT count(DISTINCT finding_id) AS n_findings, min(finding_id) AS first_id FROM f JOIN g ON g.k = f.x GROUP BY root""",
    "path_widening": """
WITH a AS (SELECT DISTINCT slug, array_slice(string_split(path, '/'), 1, 16) AS p FROM findings),
b AS (SELECT slug, CASE WHEN count(*) OVER (PARTITION BY slug, p[1]) > 64 AND len(p) > 1 THEN list_append(array_slice(p, 1, len(p) - 1), '[*]') ELSE p END AS p FROM a),
d AS (SELECT slug, p[1] AS root, count(DISTINCT p) AS n FROM b GROUP BY 1, 2),
e AS (SELECT b.slug, CASE WHEN n > 64 AND len(p) > 1 THEN [p[1], '[*]'] ELSE p END AS p FROM b JOIN d ON b.slug = d.slug AND b.p[1] = d.root)
SELECT slug, array_to_string(p, '/') AS place, count(*) AS n FROM e GROUP BY 1, 2""",
    "finding_unguarded": """
WITH f AS (SELECT DISTINCT job_id, path, line, finding_id, access, rule_id FROM findings)
SELECT rule_id, count(*) AS n_unguarded FROM f
WHERE access IS DISTINCT FROM 'capability_checked' AND NOT EXISTS (
  SELECT 1 FROM f g WHERE g.access = 'capability_checked' AND g.job_id = f.job_id AND g.path = f.path
    AND f.line - g.line BETWEEN 0 AND 48)
GROUP BY rule_id""",
    "finding_tally": f"""
SELECT slug, count_if({_WORD} = 'critical')::BIGINT AS n_critical, count_if({_WORD} = 'high')::BIGINT AS n_high,
  count_if({_WORD} = 'medium')::BIGINT AS n_medium, count_if({_WORD} = 'low')::BIGINT AS n_low,
  count_if({_WORD} IS NULL OR {_WORD} NOT IN ('critical', 'high', 'medium', 'low'))::BIGINT AS n_info, count(*) AS n_total
FROM (SELECT DISTINCT finding_id, slug, severity FROM findings) GROUP BY slug""",
    "finding_summary": """
SELECT grouping(rule_id, path)::BIGINT AS level, rule_id, path, count(*) AS n, count(DISTINCT slug) AS n_slugs
FROM findings GROUP BY GROUPING SETS ((rule_id), (path), ())""",
    "sink_groups": """
WITH f AS (SELECT sink.snippet AS sink_text, source.snippet AS source_text FROM findings WHERE sink.snippet IS NOT NULL),
c AS (SELECT sink_text, source_text, count(*) AS n FROM f WHERE source_text IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY sink_text ORDER BY count(*) DESC, source_text) <= 5),
t AS (SELECT sink_text, string_agg(source_text, ' ; ' ORDER BY n DESC, source_text) AS top_sources FROM c GROUP BY 1)
SELECT f.sink_text, count(*) AS n, count(DISTINCT source_text) AS n_sources, any_value(top_sources) AS top_sources
FROM f JOIN t ON f.sink_text = t.sink_text GROUP BY 1""",
    "hook_patterns": """
WITH e AS (SELECT unnest(entrypoints).name AS name FROM findings), p AS (SELECT unnest(['save_', 'admin_post_', 'wp_', 'load', 'order_']) AS prefix)
SELECT prefix, count(*) AS n, count(DISTINCT name) AS n_names FROM e JOIN p ON starts_with(name, prefix) GROUP BY prefix""",
    "hook_holes": """
WITH e AS (SELECT unnest(entrypoints).name AS name FROM findings)
SELECT name, count(*) AS n FROM e WHERE regexp_matches(name, '^save_.*$') GROUP BY name""",
    "access_context": """
SELECT slug, rule_id, CASE
  WHEN bool_or(required_capability IS NOT NULL AND required_capability <> 'read') THEN 'capability_checked'
  WHEN (coalesce(bool_or(access = 'authenticated'), false) OR bool_or(required_capability IS NOT NULL))
    AND NOT coalesce(bool_or(access = 'unauthenticated'), false) THEN 'authenticated'
  WHEN coalesce(bool_or(access = 'unauthenticated'), false) AND NOT coalesce(bool_or(access = 'authenticated'), false) THEN 'unauthenticated'
  WHEN coalesce(bool_or(access = 'nonce_only'), false) THEN 'nonce_only' ELSE 'unknown' END AS tier
FROM findings WHERE rule_id IS NOT NULL GROUP BY slug, rule_id""",
    "origin_merge": """
WITH f AS (SELECT slug, sink.path AS holder, concat_ws(':', source.path, source.line) AS origin,
  contains(source.snippet, 'get_post_meta') AS persistent, contains(source.snippet, '$_COOKIE') AS cookie FROM findings),
o AS (SELECT slug, holder, origin FROM (SELECT DISTINCT slug, holder, origin FROM f)
  QUALIFY row_number() OVER (PARTITION BY slug, holder ORDER BY origin) <= 48),
n AS (SELECT slug, holder, count(*) AS n_origins, max(origin) AS last_origin FROM o GROUP BY 1, 2)
SELECT f.slug, f.holder, bool_or(coalesce(persistent, false)) AS persistent, bool_or(coalesce(cookie, false)) AS cookie,
  any_value(n_origins) AS n_origins, any_value(last_origin) AS last_origin
FROM f JOIN n ON f.slug = n.slug AND f.holder = n.holder GROUP BY 1, 2""",
    "context_merge": """
WITH e AS (SELECT DISTINCT rule_id, concat_ws('/', u.kind, u.name, u.route) AS entry
  FROM (SELECT rule_id, unnest(entrypoints) AS u FROM findings WHERE rule_id IS NOT NULL)),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY entry) <= 8),
r AS (SELECT DISTINCT rule_id FROM findings WHERE rule_id IS NOT NULL)
SELECT r.rule_id, coalesce(string_agg(entry, ',' ORDER BY entry), '') AS entries FROM r LEFT JOIN k ON r.rule_id = k.rule_id GROUP BY 1""",
    "job_fingerprint": """
WITH k AS (SELECT slug, rule_id, ('0x' || sha1(finding_key)[1:15])::BIGINT::HUGEINT AS v
  FROM (SELECT DISTINCT slug, rule_id, finding_key FROM findings WHERE rule_id IS NOT NULL))
SELECT slug, rule_id, sha1(encode(sum(v)::VARCHAR || chr(0) || count(*)::VARCHAR || chr(0))) AS fingerprint FROM k GROUP BY 1, 2""",
    "file_reach": f"""
WITH RECURSIVE {_FILES},
r(node, depth) USING KEY (node) AS (
  SELECT DISTINCT slug || '|' || source.path, 0 FROM findings WHERE access = 'unauthenticated'
  UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN edges e ON r.node = e.src
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r s WHERE s.node = e.dst) GROUP BY e.dst)
SELECT node, depth FROM r""",
    "file_relevant": f"""
WITH RECURSIVE {_FILES},
f(node) AS (SELECT slug || '|' || source.path FROM findings WHERE contains(source.snippet, '$request')
  UNION SELECT e.dst FROM f JOIN edges e ON f.node = e.src),
b(node) AS (SELECT slug || '|' || sink.path FROM findings WHERE contains(sink.snippet, 'wp_redirect')
  UNION SELECT e.src FROM b JOIN edges e ON b.node = e.dst)
SELECT node FROM f INTERSECT SELECT node FROM b""",
    "context_passes": f"""
WITH RECURSIVE {_FILES},
p(node, fact, k) AS (SELECT DISTINCT slug || '|' || source.path, access, 0 FROM findings WHERE access IS NOT NULL
  UNION SELECT e.dst, p.fact, p.k + 1 FROM p JOIN edges e ON p.node = e.src WHERE p.k < 8)
SELECT node, count(DISTINCT fact) AS n_tiers, min(fact) AS first_tier FROM p GROUP BY node""",
    "owner_lookup": """
SELECT 'c' || c_custkey AS node,
  CASE WHEN c_acctbal > 9000 THEN 'c' || c_custkey WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS owner,
  CASE WHEN c_acctbal > 9000 THEN 0 WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "storage_bridge": """
WITH r AS (SELECT DISTINCT finding_id, slug, 'meta' AS family, regexp_extract(source.snippet, chr(39) || '([0-9A-Za-z_]+)' || chr(39), 1) AS key
  FROM findings WHERE contains(source.snippet, 'get_post_meta')),
w AS (SELECT DISTINCT slug, CASE WHEN contains(rule_id, 'meta') THEN 'meta' ELSE 'option' END AS family,
  regexp_extract(source.snippet, chr(39) || '([0-9A-Za-z_]+)' || chr(39), 1) AS key
  FROM findings WHERE rule_id IN ('wp-user-meta-write-open', 'wp-option-write-without-role') AND key <> ''),
a AS (SELECT r.finding_id, 1 AS tier FROM r JOIN w USING (slug, family, key)),
b AS (SELECT r.finding_id, 2 AS tier FROM r JOIN w USING (slug, family) WHERE finding_id NOT IN (SELECT finding_id FROM a))
SELECT tier, count(*) AS n_links, count(DISTINCT finding_id) AS n_readers FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY tier""",
    "latest_purchase": """
WITH b AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, b.purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts > b.ts""",
    "cache_evict": """
WITH j AS (SELECT DISTINCT id, finished_at, duration_ms FROM jobs WHERE finished_at IS NOT NULL)
SELECT id, running FROM (
  SELECT id, sum(coalesce(duration_ms, 0)) OVER (ORDER BY finished_at DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM j)
WHERE running > 5000000""",
    "job_latest": """
WITH j AS (SELECT DISTINCT id, slug, status, queued_at FROM jobs)
SELECT slug, count(*) AS n_jobs, arg_max(id, {'q': queued_at, 'i': id}) AS newest, count_if(status = 'done')::BIGINT AS n_done FROM j GROUP BY slug""",
    "job_batches": """
WITH j AS (SELECT DISTINCT ON (id) * FROM jobs WHERE batch_id IS NOT NULL)
SELECT batch_id, count(*) AS n_jobs, count_if(status IN ('done', 'failed', 'skipped', 'canceled'))::BIGINT AS n_ended,
  sum(counts.total)::BIGINT AS n_findings, sum(counts.critical)::BIGINT AS n_critical, max(queued_at) AS last_queued,
  count(DISTINCT version) AS n_versions FROM j GROUP BY batch_id""",
    "scanned_versions": """
WITH j AS (SELECT DISTINCT slug, version FROM jobs WHERE status = 'done'),
k AS (SELECT *, list_resize(list_transform(string_split(regexp_extract(version, '^[0-9.]+'), '.'), lambda x: CAST(x AS BIGINT)), 8, 0) AS n,
  CASE WHEN version LIKE '%-beta%' THEN 1 WHEN version LIKE '%-rc%' THEN 2 ELSE 3 END AS s,
  coalesce(TRY_CAST(regexp_extract(version, '-[a-z]+([0-9]+)', 1) AS BIGINT), 0) AS v FROM j)
SELECT slug, version, row_number() OVER (PARTITION BY slug ORDER BY n DESC, s DESC, v DESC, version DESC) AS place
FROM k QUALIFY count(*) OVER (PARTITION BY slug) >= 2""",
    "latest_diff": """
WITH j AS (SELECT DISTINCT id, slug, finished_at FROM jobs WHERE status = 'done' AND finished_at IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY finished_at DESC, id) AS place FROM j QUALIFY place <= 2),
two AS (SELECT slug FROM t GROUP BY slug HAVING count(*) = 2),
k AS (SELECT DISTINCT t.slug, finding_key, place FROM findings f JOIN t ON f.job_id = t.id WHERE t.slug IN (SELECT slug FROM two)),
c AS (SELECT slug, finding_key, CASE WHEN count(*) = 2 THEN 'common' WHEN max(place) = 2 THEN 'removed' ELSE 'added' END AS change
  FROM k GROUP BY 1, 2)
SELECT slug, change, count(*) AS n_keys FROM c GROUP BY 1, 2""",
    "plugin_search": """
SELECT record_id, slug, active_installs, rating FROM plugins WHERE active_installs >= 1000 AND active_installs < 100000 AND rating >= 60
ORDER BY active_installs DESC, rating DESC, record_id LIMIT 24 OFFSET 24""",
    "payload_rules": """
SELECT e.key AS rule_id, sum(e.value)::BIGINT AS n_results, count(*) AS n_payloads
FROM (SELECT unnest(map_entries(results_per_rule)) AS e FROM payload_summaries) GROUP BY 1""",
    "payload_enrich": """
WITH f AS (SELECT job_id, count(DISTINCT finding_id) AS n FROM findings GROUP BY 1)
SELECT CASE WHEN coalesce(n, 0) = total_results THEN 'agree' ELSE 'differ' END AS verdict, count(*) AS n_jobs
FROM payload_summaries s LEFT JOIN f ON s.job_id = f.job_id GROUP BY 1""",
    "late_findings": """
SELECT slug, count(*) AS n_late FROM (
  SELECT f.slug FROM findings f JOIN (SELECT DISTINCT id, finished_at FROM jobs) j ON f.job_id = j.id
  WHERE f.ingested_at > j.finished_at + INTERVAL 1 DAY) GROUP BY slug""",
    "event_sessions": """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "event_windows": """
SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "revenue_by_nation": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) AS norm FROM embeddings",
}

_ROLES = ", ".join(f"('{c}', '{r}', {ROLE_LEVEL[r]})" for r, cs in CAPABILITY_ROLE.items() for c in cs.split())
ORACLES["capability_roles"] = f"""
WITH m(capability, role, role_level) AS (VALUES {_ROLES})
SELECT required_capability, coalesce(role, 'unknown_role') AS role, role_level, count(*) AS n FROM findings LEFT JOIN m ON required_capability = capability
WHERE required_capability IS NOT NULL GROUP BY 1, 2, 3"""


def _plain_sql(column: str) -> str:
    text = f"regexp_replace({column}, '<[^<>]*>', '', 'g')"
    for reference, char in [*ENTITIES.items(), ("&amp;", "&")]:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{reference}', '{quoted}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


ORACLES["plugin_text"] = f"""
SELECT record_id, {_plain_sql("name")} AS name_text,
  CASE WHEN lower(trim(requires_php)) NOT IN ('false', 'null', 'none', '') THEN requires_php END AS php,
  nullif(lower(regexp_extract(regexp_extract(author, 'href=["'']([^"'']+)["'']', 1), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  coalesce(cardinality(icons), 0)::BIGINT AS n_icons
FROM plugins"""
