"""Queries of manifests, final findings and lattice operators over the findings table, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import findings as ops, lattice, verdicts
from factloom.plans.fact_queries import RULE_POINTS_SQL
from factloom.session import load
from factloom.sources import readers

_ARRAYS = ("configs", "sink_ops", "rules", "paths", "sources", "trace_sources", "trace_sinks", "sink_places", "bundle_texts")
#: Cases that every plugin has: what they are configured with.
TEMPLATES: dict[str, dict[str, list[str]]] = {
    "sql": {"configs": ["x/sqli.yaml"], "rules": ["sql-text-from-request"], "trace_sinks": [" $WPDB"], "trace_sources": ["$_request", "get_param"]},
    "path": {"configs": ["path-transversal.yaml"], "paths": [" export.php", "menu.php "], "sources": ["$_POST", "handler", "readfile("], "trace_sources": ["save_", "$_COOKIE"]},
    "call": {"sink_ops": [" Call", "call", ""], "rules": ["callback-name-from-request", "class-name-from-request"], "trace_sinks": ["unlink"]},
    "place": {"configs": ["xss.yaml"], "sink_places": ["report.php:877", "php:2", "nonsense"]},
    "odd": {"configs": ["odd.yaml"], "rules": ["x"]},
    "none": {"configs": ["xss.yaml"]},
    "bundle": {"configs": ["xss.yaml"], "rules": ["sql-text-from-request"], "bundle_texts": ["x"]},
    "blank": {"sink_ops": [" "], "rules": ["x"]},
}


def _cases(spark, d):
    """A manifest with the same cases for every plugin."""
    none = F.lit(None).cast("array<string>")
    arrays = lambda t: [(F.array(*map(F.lit, t[c])) if c in t else none).alias(c) for c in _ARRAYS]
    all_ = F.array(*(F.struct(F.lit(name).alias("template"), *arrays(t)) for name, t in TEMPLATES.items()))
    slugs = load(spark, d, "findings").select("slug").where("slug is not null").distinct()
    return slugs.select("slug", F.explode(all_).alias("c")).select(F.concat_ws("-", "slug", "c.template").alias("case_id"), "slug", "c.*").drop("template")


def _findings(spark, d):
    f = load(spark, d, "findings").select("finding_id", "slug", "rule_id", "path", "line", "callable", "source", "sink")
    return f.dropDuplicates(["finding_id"])


def verdict_cases(spark, d):
    """Verdict of each case of each plugin, with the best finding."""
    got = verdicts.compare_cases(_findings(spark, d), _cases(spark, d), ["path", "line", "finding_id"])
    return got.select("case_id", "status", "reason", F.col("score").cast("int").alias("score"), F.col("found.finding_id").alias("finding_id"))


def verdict_totals(spark, d):
    return verdicts.verdict_totals(verdict_cases(spark, d))


def case_operations(spark, d):
    """Operations of the cases, from what is given or from their configurations."""
    return verdicts.comparable(_cases(spark, d)).groupBy(F.array_join("operations", ",").alias("operations"), "reason").agg(F.count(F.lit(1)).alias("n"))


def case_coverage(spark, d):
    return verdicts.coverage(_findings(spark, d), _cases(spark, d))


def case_traces(spark, d):
    f, c = _findings(spark, d), _cases(spark, d)
    return verdicts.trace_status(f, c, verdicts.coverage(f, c))


def case_proofs(spark, d):
    """Best proof of each case: the smallest finding of the highest score above 0."""
    pairs = _findings(spark, d).join(_cases(spark, d), "slug").withColumn("score", verdicts.proof_score()).where("score > 0")
    best = pairs.groupBy("case_id").agg(F.max_by("finding_id", F.struct("score", -F.col("finding_id"))).alias("finding_id"), F.max("score").alias("score"))
    return best.select("case_id", F.col("score").cast("int").alias("score"), "finding_id")


def path_cover(spark, d):
    """Three files of each plugin at most that between them hold most rules, chosen greedily."""
    f = load(spark, d, "findings").where("slug is not null and rule_id is not null and path is not null")
    return verdicts.path_cover(f.select(F.col("slug").alias("case_id"), F.col("path").alias("item"), F.lit(0).alias("score"), F.col("rule_id").alias("piece")))


def meaning_duplicates(spark, d):
    """Findings that say the same: those of modules as lowered ones, told by what they read."""
    f = _findings(spark, d).select(
        "finding_id", "rule_id", "path", "line", F.col("sink.path").alias("read_path"), F.col("sink.line").alias("read_line"),
        F.col("source.path").alias("source_path"), F.col("source.line").alias("source_line"),
        F.when(F.contains("source.snippet", F.lit("get_post_meta")), "meta").otherwise("request").alias("family"),
        F.regexp_extract("source.snippet", r"'(\w+)'", 1).alias("key"), F.coalesce(F.col("path").startswith("modules/"), F.lit(False)).alias("lowered"),
        F.when(F.contains("source.snippet", F.lit("get_post_meta")), "storage_bridge").when(F.contains("source.snippet", F.lit("$_COOKIE")), "call_bridge")
        .when(F.contains("source.snippet", F.lit("$_POST")), "value").alias("kind"),
    )
    keyed = f.withColumn("meaning", verdicts.meaning_key(F.col("lowered"), F.col("kind")))
    return keyed.groupBy("meaning").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first_id")).where("n > 1")


#: Rules of the table, read as rules of the scan.
SCAN_RULES = {
    "sql-text-from-request": "tainted-sql-string",
    "wp-request-value-into-markup": "wp-reflected-xss-direct-request-output",
    "wp-stored-meta-into-markup": "wp-stored-xss-persistent-read-to-output",
    "wp-option-write-without-role": "wp-request-sensitive-action-without-cap-check",
    "file-path-from-request": "path-transversal",
    "serialized-blob-from-cookie": "unsafe-deserialization",
    "callback-name-from-request": "render-callback-execution",
    "wp-user-meta-write-open": "wp-request-tainted-privilege-mutation",
    "archive-entry-path-unchecked": "wp-request-file-upload-without-cap-check",
    "redirect-target-from-request": "wp-open-redirect",
}


def final_findings(spark, d):
    """One finding for each site of a plugin, the one that stands best for it, with how many it stands for."""
    names = F.create_map(*(F.lit(x) for pair in SCAN_RULES.items() for x in pair))
    f = load(spark, d, "findings").withColumn("rule_id", F.coalesce(F.try_element_at(names, F.col("rule_id")), "rule_id"))
    f = f.select("finding_id", "slug", "rule_id", "path", "line", "message", "callable", "source", "sink").dropDuplicates(["finding_id"])
    return ops.final_findings(f, ["slug"], ["finding_id"]).select("slug", "finding_id", F.col("standing").cast("int").alias("standing"), "n_findings")


def origins_whole(spark, d):
    """Origins of each slug's sink file, all of them: the exact side of ``origin_merge``."""
    f = load(spark, d, "findings").select("slug", F.col("sink.path").alias("holder"), F.concat_ws(":", "source.path", F.col("source.line").cast("string")).alias("origin"))
    whole = lattice.cap_per_holder(f.distinct(), ["slug", "holder"], ["origin"], None)
    return whole.groupBy("slug", "holder").agg(F.count(F.lit(1)).alias("n_origins"), F.max("origin").alias("last_origin"))


def contexts_whole(spark, d):
    """All entry points of each rule: the exact side of ``context_merge``."""
    f = load(spark, d, "findings").where("rule_id is not null").select(
        "rule_id", F.transform("entrypoints", lambda e: F.concat_ws("/", e.getField("kind"), e.getField("name"), e.getField("route"))).alias("entries")
    )
    return lattice.merge_sets(f, ["rule_id"], {"entries": None}).select("rule_id", F.size("entries").alias("n"), F.array_join(F.slice("entries", -3, 3), ",").alias("last"))


def context_changes(spark, d):
    """Rules of a slug whose merged contexts equal those of the next rule, nulls included."""
    f = load(spark, d, "findings").where("rule_id is not null").select("slug", "rule_id", "access", "required_capability").distinct()
    merged = f.groupBy("slug", "rule_id").agg(lattice.optional_merge(F.col("required_capability")).alias("caps"), F.max("access").alias("access"))
    order = Window.partitionBy("slug").orderBy("rule_id")
    after = merged.select("*", *(F.lead(c).over(order).alias(f"{c}_b") for c in ("rule_id", "caps", "access"))).where("rule_id_b is not null")
    same = lattice.equivalent((F.col("caps"), F.col("caps_b")), (F.col("access"), F.col("access_b")))
    return after.groupBy("slug").agg(F.count_if(same).alias("n_same"), F.count(F.lit(1)).alias("n"))


def single_parameter(spark, d):
    """Callables all of whose flagless origins are one key of the request, with that key."""
    f = load(spark, d, "findings").where("callable is not null").select(
        "slug", "callable", F.nullif(F.regexp_extract("source.snippet", r"'(\w+)'", 1), F.lit("")).alias("key"),
        F.contains("source.snippet", F.lit("get_post_meta")).alias("persistent"),
    )
    return lattice.single_root(f, ["slug", "callable"], "key", ["persistent"])


def covered_parents(spark, d):
    """Folders of a slug whose rules all stand in folders below them are dropped; what is left, counted."""
    f = load(spark, d, "findings").where("rule_id is not null and path is not null").select("slug", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.slice(F.split("path", "/"), F.lit(1), n))).alias("segments"), "rule_id")
    kept = lattice.drop_covered_parents(f.distinct(), ["slug"], "segments", "rule_id")
    return kept.groupBy("slug", F.array_join("segments", "/").alias("folder")).agg(F.count(F.lit(1)).alias("n_rules"))


def broad_hooks(spark, d):
    """Entry points of the names that few rules share: names with more than eight are left out."""
    e = load(spark, d, "findings").where("rule_id is not null").select("rule_id", F.explode("entrypoints").alias("e")).select("rule_id", F.col("e.name").alias("name")).where("name is not null").distinct()
    return lattice.cap_fan_out(e, ["name"], 8)


def requested_scans(spark, d):
    """Valid requests for scans: slugs and versions of the right form, once each, 400 versions a slug at most."""
    j = load(spark, d, "jobs").select(F.lower(F.trim("slug")).alias("slug"), F.trim("version").alias("version"))
    return ops.valid_requests(j, 400)


def plugin_versions(spark, d):
    """Plugins whose name holds 'a' and versions that hold '.1', without regard to case; counted by version."""
    p = load(spark, d, "plugins").where(F.contains("version", F.lit(".1")) & F.contains(F.lower("name"), F.lit("a")))
    return p.groupBy("version").agg(F.count_distinct("slug").alias("n"))


def merged_payloads(spark, d):
    """Two result lists as one: those of the first kind of rule and those of the second, with errors added up."""
    s = load(spark, d, "payload_summaries").select("job_id", "total_results", "total_errors")
    parts = [s.where("total_errors = 0"), s.where("total_errors > 0")]
    return ops.merge_payloads(parts, ["job_id"]).agg(F.count(F.lit(1)).alias("n"), F.sum("total_results").alias("n_results"), F.sum("total_errors").alias("n_errors"))


def payload_counts(spark, d):
    """Summary of the payload of each job that has one, counted from its findings."""
    f = load(spark, d, "findings").select("job_id", "rule_id", "finding_id").dropDuplicates(["finding_id"])
    runs = load(spark, d, "payload_summaries").select("job_id", "generated_at", "elapsed_ms", "total_errors")
    got = readers.payload_summaries(f, runs, "job_id")
    rules = F.array_join(F.transform(F.map_entries("results_per_rule"), lambda e: F.concat_ws("=", e.getField("key"), e.getField("value").cast("string"))), ",")
    return got.select("job_id", "generated_at", "elapsed_ms", "total_results", "total_errors", rules.alias("rules"))


def job_reports(spark, d):
    """A report of each done job in Markdown: its title and its findings by rule."""
    j = load(spark, d, "jobs").where("status = 'done'").select("id", F.concat_ws(" ", "slug", "version").alias("title")).distinct()
    f = load(spark, d, "findings").select("job_id", "rule_id", "finding_id").dropDuplicates(["finding_id"])
    counts = f.groupBy(F.col("job_id").alias("id"), F.col("rule_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return readers.job_markdown(j, counts)


def line_statistics(spark, d):
    """Mean, spread, median and ends of the lines of each rule's findings."""
    f = load(spark, d, "findings").where("line is not null")
    return f.groupBy("rule_id").agg(
        F.round(F.avg("line"), 4).alias("mean"), F.round(F.stddev_samp("line"), 4).alias("spread"), F.round(F.percentile("line", F.lit(0.5)), 4).alias("median"),
        F.round(F.percentile("line", F.lit(0.9)), 4).alias("p90"), F.min("line").alias("low"), F.max("line").alias("high"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        verdict_cases, verdict_totals, case_operations, case_coverage, case_traces, case_proofs, path_cover, meaning_duplicates, final_findings,
        origins_whole, contexts_whole, context_changes, single_parameter, covered_parents, broad_hooks, requested_scans, plugin_versions, merged_payloads,
        payload_counts, job_reports, line_statistics,
    )
}


def _list(values: list[str] | None) -> str:
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(column: str, names) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


_ROWS = ", ".join("('" + name + "', " + ", ".join(_list(t.get(c)) for c in _ARRAYS) + ")" for name, t in TEMPLATES.items())
_CASES = f"""f AS (SELECT DISTINCT ON (finding_id) * FROM findings),
cases AS (SELECT slug || '-' || template AS case_id, slug, t.* EXCLUDE (template)
  FROM (SELECT DISTINCT slug FROM findings WHERE slug IS NOT NULL), (VALUES {_ROWS}) t(template, {", ".join(_ARRAYS)})),
named AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(coalesce(sink_ops, []), lambda x: lower(trim(x))), lambda x: x <> ''))) AS given,
  list_transform(coalesce(configs, []), lambda c: regexp_extract(c, '[^/]*$')) AS names FROM cases),
derived AS (SELECT *, list_filter(names, lambda c: c NOT IN ('path-transversal.yaml', 'privilege-escalation.yaml', 'sqli.yaml', 'file-upload.yaml', 'unsafe-use.yaml', 'xss.yaml')) AS unknown,
  list_sort(list_distinct(flatten(list_transform(names, lambda c: CASE c WHEN 'path-transversal.yaml' THEN ['include', 'read', 'open', 'delete']
    WHEN 'privilege-escalation.yaml' THEN ['action', 'output', 'write', 'call'] WHEN 'sqli.yaml' THEN ['sql'] WHEN 'file-upload.yaml' THEN ['write', 'read', 'open', 'delete']
    WHEN 'unsafe-use.yaml' THEN ['call'] WHEN 'xss.yaml' THEN ['output'] ELSE []::VARCHAR[] END)))) AS told FROM named),
early AS (SELECT *, CASE WHEN len(sink_ops) > 0 THEN CASE WHEN len(given) = 0 THEN 'no operations are left' END
  WHEN len(unknown) > 0 THEN 'unsupported config ' || unknown[1] END AS stop FROM derived),
ready AS (SELECT *, CASE WHEN stop IS NOT NULL THEN []::VARCHAR[] WHEN len(given) > 0 THEN given ELSE told END AS operations,
  coalesce(stop, CASE WHEN len(bundle_texts) > 0 THEN 'bundle specific'
    WHEN coalesce(len(rules), 0) + coalesce(len(paths), 0) + coalesce(len(sources), 0) + coalesce(len(trace_sources), 0) + coalesce(len(trace_sinks), 0) + coalesce(len(sink_places), 0) = 0
    THEN 'no criteria' END) AS reason FROM early)"""


def _count_sql(needles: str, *texts: str) -> str:
    tests = " OR ".join(f"contains(lower(coalesce({t}, '')), n)" for t in texts)
    return f"coalesce(len(list_filter(list_transform({needles}, lambda n: lower(trim(n))), lambda n: n <> '' AND ({tests}))), 0)"


_UPLOAD_RULES = "['wp-request-file-upload-without-cap-check', 'wp-request-file-delete-without-cap-check', 'request-path-read-delete']"
_MET = {
    "rules": "(list_contains(rules, rule_id) OR len(list_filter(rules, lambda r: list_contains(CASE WHEN trim(r) IN ('file-download-upload', 'upload-api-surface', 'wordpress-upload-helper-surface') THEN "
    + _UPLOAD_RULES
    + " WHEN trim(r) = 'wp-ajax-financial-action-without-cap-check' THEN ['wp-request-sensitive-action-without-cap-check'] ELSE []::VARCHAR[] END, rule_id))) > 0)",
    "paths": "len(list_filter(paths, lambda e: ends_with(coalesce(path, ''), trim(e)) OR ends_with(coalesce(sink.path, ''), trim(e)) OR ends_with(coalesce(source.path, ''), trim(e)))) > 0",
    "sources": _count_sql("sources", "source.snippet", "source.path", "sink.snippet", "sink.path", "path", "callable") + " > 0",
    "trace_sources": _count_sql("trace_sources", "source.snippet", "source.path", "callable") + " > 0",
    "trace_sinks": _count_sql("trace_sinks", "sink.snippet", "sink.path", "path", "callable") + " > 0",
    "sink_places": "len(list_filter(sink_places, lambda p: regexp_matches(trim(p), '^.+:[0-9]+$') AND ends_with(sink.path, regexp_extract(trim(p), '^(.*):[0-9]+$', 1)) AND regexp_extract(trim(p), ':([0-9]+)$', 1) = sink.line::VARCHAR)) > 0",
}
_ALL = " AND ".join(f"(coalesce(len({k}), 0) = 0 OR coalesce({v}, false))" for k, v in _MET.items())
_SCORE = (
    f"(100 * {_count_sql('trace_sources', 'source.snippet', 'source.path')} + 40 * {_count_sql('sources', 'source.snippet', 'source.path', 'sink.snippet', 'sink.path', 'path')}"
    f" + 20 * {_count_sql('trace_sinks', 'sink.snippet', 'sink.path', 'path', 'callable')} + 10 * {_count_sql('trace_sources', 'callable')} + 5 * {_count_sql('sources', 'callable')})"
)
_VERDICTS = f"""{_CASES},
best AS (SELECT case_id, finding_id, {_SCORE} AS score FROM f JOIN ready USING (slug) WHERE reason IS NULL AND {_ALL}
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {_SCORE} DESC, path NULLS FIRST, line NULLS FIRST, finding_id) = 1),
verdicts AS (SELECT case_id, CASE WHEN reason IS NOT NULL THEN 'not_comparable_yet' WHEN score IS NOT NULL THEN 'match' ELSE 'miss' END AS status,
  reason, score::INT AS score, finding_id FROM ready LEFT JOIN best USING (case_id))"""
_COVERED = f"""{_CASES},
hits AS (SELECT case_id, bool_or(coalesce({_MET["rules"]}, false)) AS hit_rules, bool_or(coalesce({_MET["paths"]}, false)) AS hit_paths,
  bool_or(coalesce({_MET["sources"]}, false)) AS hit_sources FROM f JOIN cases USING (slug) GROUP BY 1),
covered AS (SELECT c.*, concat_ws(',', CASE WHEN len(rules) > 0 AND NOT coalesce(hit_rules, false) THEN 'rules' END,
    CASE WHEN len(paths) > 0 AND NOT coalesce(hit_paths, false) THEN 'paths' END, CASE WHEN len(sources) > 0 AND NOT coalesce(hit_sources, false) THEN 'sources' END) AS failed,
  coalesce(len(rules), 0) + coalesce(len(paths), 0) + coalesce(len(sources), 0) AS n FROM cases c LEFT JOIN hits USING (case_id)),
coverage AS (SELECT *, CASE WHEN n = 0 THEN 'not_configured' WHEN failed = '' THEN 'passed' ELSE 'failed' END AS status FROM covered)"""
_SAID = "coalesce(len(list_filter({}, lambda n: contains(coalesce({}, ''), n))), 0) > 0"
_PIECES = "coalesce(len(list_filter({}, lambda n: n <> '' AND contains(coalesce({}, ''), n))), 0) > 0"
_PROOF = (
    f"(CASE WHEN coalesce({_MET['rules']}, false) THEN 100 ELSE 0 END + CASE WHEN {_PIECES.format('paths', 'path')} THEN 80 ELSE 0 END"
    f" + CASE WHEN {_PIECES.format('sources', 'sink.snippet')} THEN 70 ELSE 0 END + CASE WHEN {_PIECES.format('paths', 'source.path')} THEN 60 ELSE 0 END"
    f" + CASE WHEN {_PIECES.format('sources', 'source.snippet')} THEN 80 ELSE 0 END)"
)
_RULE_NAMES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SCAN_RULES.items())
_VISIBLE = "CASE WHEN starts_with(coalesce(callable, ''), 'file:') THEN '' ELSE coalesce(callable, '') END"
_T = "coalesce({}::VARCHAR, '')"


def _joined(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(c if c.startswith("'") else _T.format(c) for c in columns) + ")"


_SITE = _joined("'site'", "rule_id", "path", "line", "message", "sink.path", "sink.line")
_CONCRETE = "({0} IS NOT NULL AND (coalesce({0}.path, '') <> '' OR coalesce({0}.line, 0) <> 0 OR coalesce({0}.snippet, '') <> ''))"
_KEY = f"""CASE WHEN NOT coalesce({_in("rule_id", ops.COLLAPSED)}, false)
  THEN CASE WHEN {_CONCRETE.format("source")} THEN {_joined("'exact'", "rule_id", "path", "line", "source.path", "source.line", "callable")} ELSE {_SITE} || '|' || {_VISIBLE} END
  WHEN rule_id = 'wp-request-sensitive-action-without-cap-check' THEN {_joined("'action'", "rule_id", "path", "message", "sink.path", "sink.snippet")}
  WHEN {_in("rule_id", ops.ANY_CALLABLE)} THEN {_SITE} ELSE {_SITE} || '|' || {_VISIBLE} END"""
_LOW = "lower(coalesce(source.snippet, ''))"
_STANDING = f"""(CASE WHEN {_CONCRETE.format("source")} THEN 4 ELSE 0 END + CASE WHEN {_CONCRETE.format("sink")} THEN 2 ELSE 0 END
  + CASE WHEN {_VISIBLE} <> '' THEN 2 WHEN coalesce(callable, '') <> '' THEN 1 ELSE 0 END + CASE WHEN {_LOW} <> '' THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches({_LOW}, '[$]_(get|post|request|files|cookie|server)') OR contains({_LOW}, 'php://input') THEN 64 ELSE 0 END
  + CASE WHEN contains({_LOW}, 'filter_input(') THEN 48 ELSE 0 END
  + CASE WHEN regexp_matches({_LOW}, '(sanitize_text_field|sanitize_textarea_field|sanitize_key|wp_unslash)[(]') THEN 16 ELSE 0 END + {RULE_POINTS_SQL})"""
_META = "contains(coalesce(source.snippet, ''), 'get_post_meta')"

ORACLES = {
    "verdict_cases": f"WITH {_VERDICTS} SELECT * FROM verdicts",
    "verdict_totals": f"""WITH {_VERDICTS} SELECT count(*) AS n_cases, count_if(status = 'match')::BIGINT AS n_match, count_if(status = 'miss')::BIGINT AS n_miss,
  count_if(status = 'not_comparable_yet')::BIGINT AS n_not_comparable_yet, round(count_if(status = 'match') / count_if(status IN ('match', 'miss')), 6) AS share FROM verdicts""",
    "case_operations": f"WITH {_CASES} SELECT array_to_string(operations, ',') AS operations, reason, count(*) AS n FROM ready GROUP BY 1, 2",
    "case_coverage": f"WITH {_COVERED} SELECT case_id, status, failed FROM coverage",
    "case_traces": f"""WITH {_COVERED},
found AS (SELECT DISTINCT case_id FROM f JOIN cases USING (slug) WHERE source.path IS NOT NULL AND sink.path IS NOT NULL
  AND (coalesce(len(rules), 0) = 0 OR list_contains(rules, rule_id)) AND {_SAID.format("trace_sources", "source.snippet")}
  AND ({_SAID.format("trace_sinks", "sink.snippet")} OR coalesce({_MET["sink_places"]}, false)))
SELECT case_id, CASE WHEN status <> 'passed' THEN 'not_found' WHEN coalesce(len(trace_sinks), 0) + coalesce(len(sink_places), 0) = 0 THEN 'not_found'
  WHEN coalesce(len(trace_sources), 0) = 0 THEN 'nearby_only' WHEN case_id IN (SELECT case_id FROM found) THEN 'found' ELSE 'not_found' END AS status FROM coverage""",
    "case_proofs": f"""WITH {_CASES}, s AS (SELECT case_id, finding_id, {_PROOF} AS score FROM f JOIN cases USING (slug))
SELECT case_id, score::INT AS score, finding_id FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, finding_id) = 1""",
    "path_cover": """
WITH c AS (SELECT DISTINCT slug AS case_id, path AS item, rule_id AS piece FROM findings WHERE slug IS NOT NULL AND rule_id IS NOT NULL AND path IS NOT NULL),
w AS (SELECT case_id, item, count(*) AS whole FROM c GROUP BY 1, 2),
p1 AS (SELECT case_id, item FROM w QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY whole DESC, item) = 1),
d1 AS (SELECT case_id, piece FROM c JOIN p1 USING (case_id, item)),
c2 AS (SELECT * FROM c ANTI JOIN d1 USING (case_id, piece)),
p2 AS (SELECT case_id, item FROM (SELECT case_id, item, count(*) AS fresh FROM c2 GROUP BY 1, 2) JOIN w USING (case_id, item)
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY fresh DESC, whole DESC, item) = 1),
d2 AS (SELECT case_id, piece FROM c2 JOIN p2 USING (case_id, item)),
c3 AS (SELECT * FROM c2 ANTI JOIN d2 USING (case_id, piece)),
p3 AS (SELECT case_id, item FROM (SELECT case_id, item, count(*) AS fresh FROM c3 GROUP BY 1, 2) JOIN w USING (case_id, item)
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY fresh DESC, whole DESC, item) = 1)
SELECT case_id, 1 AS pick, item FROM p1 UNION ALL SELECT case_id, 2, item FROM p2 UNION ALL SELECT case_id, 3, item FROM p3""",
    "meaning_duplicates": f"""
WITH f AS (SELECT DISTINCT ON (finding_id) *, coalesce(starts_with(path, 'modules/'), false) AS lowered,
  CASE WHEN {_META} THEN 'storage_bridge' WHEN contains(source.snippet, '$_COOKIE') THEN 'call_bridge' WHEN contains(source.snippet, '$_POST') THEN 'value' END AS kind FROM findings),
k AS (SELECT finding_id, CASE WHEN NOT lowered THEN {_joined("'target'", "rule_id", "path", "line")} WHEN kind IS NULL THEN {_joined("'lowered-raw'", "rule_id", "path", "line")}
  ELSE concat_ws('|', 'lowered', rule_id, kind, {_joined("sink.path", "sink.line")}, CASE WHEN kind = 'storage_bridge' THEN
    concat_ws('|', 'meta', coalesce(regexp_extract(source.snippet, chr(39) || '([0-9A-Za-z_]+)' || chr(39), 1), '')) WHEN kind = 'value' THEN {_joined("source.path", "source.line")} END) END AS meaning FROM f)
SELECT meaning, count(*) AS n, min(finding_id) AS first_id FROM k GROUP BY 1 HAVING count(*) > 1""",
    "final_findings": f"""
WITH RECURSIVE r AS (SELECT DISTINCT ON (finding_id) * REPLACE (CASE rule_id {_RULE_NAMES} ELSE rule_id END AS rule_id) FROM findings),
k AS (SELECT slug, finding_id, coalesce(slug, '') || '|' || {_KEY} AS key, {_STANDING} AS standing,
  CASE WHEN rule_id = 'wp-request-tainted-privilege-mutation' AND {_VISIBLE} <> '' AND trim(source.snippet) <> '' AND trim(sink.snippet) <> ''
    THEN coalesce(slug, '') || '|' || {_joined("'tied'", "rule_id", "message", "source.snippet", "sink.snippet")} END AS other FROM r),
e AS (SELECT DISTINCT key, other FROM k WHERE other IS NOT NULL),
n AS (SELECT DISTINCT a.key AS a, b.key AS b FROM e a JOIN e b USING (other)),
c(key, root) AS (SELECT DISTINCT key, key FROM e UNION SELECT n.b, c.root FROM c JOIN n ON n.a = c.key),
g AS (SELECT key, min(root) AS root FROM c GROUP BY 1),
s AS (SELECT k.*, coalesce(g.root, k.key) AS site FROM k LEFT JOIN g USING (key))
SELECT slug, finding_id, standing::INT AS standing, count(*) OVER (PARTITION BY site) AS n_findings FROM s
QUALIFY row_number() OVER (PARTITION BY site ORDER BY standing DESC, finding_id) = 1""",
    "origins_whole": """
SELECT slug, sink.path AS holder, count(DISTINCT concat_ws(':', source.path, source.line)) AS n_origins, max(concat_ws(':', source.path, source.line)) AS last_origin
FROM findings GROUP BY 1, 2""",
    "contexts_whole": """
WITH e AS (SELECT DISTINCT rule_id, concat_ws('/', u.kind, u.name, u.route) AS entry FROM (SELECT rule_id, unnest(entrypoints) AS u FROM findings WHERE rule_id IS NOT NULL)),
l AS (SELECT rule_id, list(entry ORDER BY entry) AS entries FROM e GROUP BY 1)
SELECT rule_id, len(entries)::INT AS n, array_to_string(entries[-3:], ',') AS last FROM l""",
    "context_changes": """
WITH m AS (SELECT slug, rule_id, list_sort(list(DISTINCT required_capability) FILTER (required_capability IS NOT NULL)) AS caps, max(access) AS access
  FROM findings WHERE rule_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, lead(rule_id) OVER w AS rule_b, lead(caps) OVER w AS caps_b, lead(access) OVER w AS access_b FROM m WINDOW w AS (PARTITION BY slug ORDER BY rule_id))
SELECT slug, count_if(caps IS NOT DISTINCT FROM caps_b AND access IS NOT DISTINCT FROM access_b)::BIGINT AS n_same, count(*) AS n FROM a WHERE rule_b IS NOT NULL GROUP BY 1""",
    "single_parameter": f"""
WITH o AS (SELECT slug, callable, nullif(regexp_extract(source.snippet, chr(39) || '([0-9A-Za-z_]+)' || chr(39), 1), '') AS key, {_META} AS flagged FROM findings WHERE callable IS NOT NULL)
SELECT slug, callable, min(key) AS key FROM o GROUP BY 1, 2 HAVING count(DISTINCT key) = 1 AND count(*) = count(key) AND NOT bool_or(flagged)""",
    "covered_parents": """
WITH s AS (SELECT DISTINCT slug, array_slice(string_split(path, '/'), 1, k) AS folder, rule_id
  FROM (SELECT slug, path, rule_id, unnest(range(1, len(string_split(path, '/')))) AS k FROM findings WHERE rule_id IS NOT NULL AND path IS NOT NULL)),
below AS (SELECT DISTINCT slug, array_slice(folder, 1, k) AS folder, rule_id FROM (SELECT *, unnest(range(1, len(folder))) AS k FROM s)),
kept AS (SELECT DISTINCT slug, folder FROM s ANTI JOIN below USING (slug, folder, rule_id))
SELECT slug, array_to_string(folder, '/') AS folder, count(*) AS n_rules FROM s SEMI JOIN kept USING (slug, folder) GROUP BY 1, 2""",
    "broad_hooks": """
WITH e AS (SELECT DISTINCT rule_id, u.name AS name FROM (SELECT rule_id, unnest(entrypoints) AS u FROM findings WHERE rule_id IS NOT NULL) WHERE u.name IS NOT NULL)
SELECT name, rule_id FROM e QUALIFY count(*) OVER (PARTITION BY name) <= 8""",
    "requested_scans": """
WITH j AS (SELECT DISTINCT lower(trim(slug)) AS slug, trim(version) AS version FROM jobs)
SELECT slug, version FROM j WHERE regexp_matches(slug, '^[a-z0-9][a-z0-9_-]*$') AND regexp_matches(version, '^[0-9A-Za-z][0-9A-Za-z._+-]*$')
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY version) <= 400""",
    "plugin_versions": "SELECT version, count(DISTINCT slug) AS n FROM plugins WHERE contains(version, '.1') AND contains(lower(name), 'a') GROUP BY 1",
    "payload_counts": """
WITH c AS (SELECT job_id, rule_id, count(DISTINCT finding_id) AS n FROM findings GROUP BY 1, 2),
p AS (SELECT job_id, sum(n)::BIGINT AS total, string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FILTER (rule_id IS NOT NULL) AS rules FROM c GROUP BY 1)
SELECT job_id, generated_at, elapsed_ms, coalesce(total, 0) AS total_results, coalesce(total_errors, 0) AS total_errors, coalesce(rules, '') AS rules
FROM payload_summaries LEFT JOIN p USING (job_id)""",
    "job_reports": """
WITH j AS (SELECT DISTINCT id, slug || ' ' || version AS title FROM jobs WHERE status = 'done'),
c AS (SELECT job_id AS id, rule_id, count(DISTINCT finding_id) AS n FROM findings WHERE rule_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT id, string_agg(chr(10) || '| ' || rule_id || ' | ' || n || ' |', '' ORDER BY rule_id) AS lines FROM c GROUP BY 1)
SELECT id, '# ' || title || chr(10) || chr(10) || '| Name | Count |' || chr(10) || '|---|---|' || coalesce(lines, '') AS markdown FROM j LEFT JOIN r USING (id)""",
    "line_statistics": """
SELECT rule_id, round(avg(line), 4) AS mean, round(stddev_samp(line), 4) AS spread, round(quantile_cont(line, 0.5), 4) AS median,
  round(quantile_cont(line, 0.9), 4) AS p90, min(line) AS low, max(line) AS high FROM findings WHERE line IS NOT NULL GROUP BY 1""",
    "merged_payloads": """
SELECT count(*) AS n, sum(total_results)::BIGINT AS n_results, sum(total_errors)::BIGINT AS n_errors FROM payload_summaries WHERE total_errors >= 0""",
}
