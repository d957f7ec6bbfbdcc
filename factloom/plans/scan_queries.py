"""Queries of the scan over programs and over program text in the documents table, and of job state over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.taint_scan import _facts, constants, contexts, extract_callables, extract_program, own_checks, scan, summarise
from factloom.operators import taint_models
from factloom.plans import scan_programs as P
from factloom.session import load, stage
from factloom.sources.excerpts import document_programs
from factloom.streaming.jobs import latest_states


def _excerpts(spark, d):
    """Program excerpts of each document, in whatever form they stand, as files of a program of its own."""
    return document_programs(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("root"), "text"))


def excerpt_callables(spark, d):
    """Callables in the excerpts by kind, unreadable files among them."""
    return extract_callables(_excerpts(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("n_documents"))


def excerpt_findings(spark, d):
    """Findings of the scan in the excerpts by rule and tier."""
    return scan(_excerpts(spark, d)).groupBy("rule_id", "access", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("n_documents")
    )


def scan_cases(spark, d):
    """Findings of programs of a few lines, one case for each rule of the scan."""
    place = F.concat_ws(":", "sink.path", F.col("sink.line").cast("string"))
    return scan(P.program_files(spark)).select(
        F.col("root").alias("case_id"), "rule_id", place.alias("place"), F.col("source.line").alias("source_line"), "access", "severity",
        "required_capability", "minimum_role", "score",
    )


def scan_surfaces(spark, d):
    """Signals of weak design in programs of a few lines, each beside a counterpart that gives none."""
    place = F.concat_ws(":", "sink.path", F.col("sink.line").cast("string"))
    return scan(P.surface_files(spark), ("surface",)).select(F.col("root").alias("case_id"), "rule_id", place.alias("place"), F.col("source.line").alias("source_line"))


def scan_models(spark, d):
    """Findings by sinks, sources and sanitizers that a table adds to the built-in ones."""
    rows = [("function", "own_sink", "own-rule", "call", [1]), ("method", "own_write", "own-write", "write", [0]), ("source", "own_input", None, None, None), ("sanitizer", "own_clean", None, "html", None), ("function", None, "x", "call", [0])]
    models = spark.createDataFrame(rows, "kind string, name string, rule string, op string, positions array<int>")
    found = scan(P.model_files(spark), models=models)
    return found.select(F.col("root").alias("case_id"), "rule_id", F.col("sink.line").alias("line"), F.col("source.line").alias("source_line"))


def scan_large(spark, d):
    """Findings of twenty programs of 1,613 callables each, a fifth of them on a way from an entry to a sink."""
    return scan(P.large_programs(spark).repartition(32)).select(F.col("root").alias("case_id"), "callable", "rule_id", "access")


def scan_facts(spark, d):
    """Checks with those of helpers, entries, calls, stores and constants of some of the programs."""
    callables = stage(extract_program(P.program_files(spark, P.FACT_CASES)), "fact-callables")
    summaries, edges, meaning = summarise(callables)
    case = F.col("root").alias("case_id")
    fact = lambda df, kind, about, value: df.select(case, F.lit(kind).alias("kind"), about.alias("about"), value.alias("value"))
    entries = contexts(summaries, edges.limit(0), meaning).where("what = 'entry'")
    name = F.regexp_replace("name", "^wp_ajax_(nopriv_)?", "")
    stores = summaries.select("root", "key", F.explode(F.from_json(F.get_json_object("summary", "$.stores"), "array<string>")).alias("x"))
    parts = [
        fact(own_checks(summaries, meaning).where("key not like 'file:%'"), "check", F.col("key"), F.concat_ws(":", "kind", "name")),
        fact(entries, "entry", F.col("key"), F.concat_ws("/", "kind", name, "tier")),
        fact(edges.where(F.col("caller") != F.col("callee")), "call", F.col("caller"), F.col("callee")),
        fact(_facts(summaries, "reads"), "read", F.col("key"), F.concat_ws("/", F.col("x")[0], F.col("x")[1])),
        fact(stores, "write", F.col("key"), F.concat_ws("/", F.get_json_object("x", "$[0]"), F.get_json_object("x", "$[1]"))),
        fact(constants(callables), "constant", F.col("name"), F.col("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def job_state_machine(spark, d):
    """States of users read as jobs: each event type moves a job on, never back."""
    words = {"view": "queued", "click": "downloading", "signup": "scanning", "purchase": "done", "error": "failed"}
    status = F.try_element_at(F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.lit(v)))), F.col("event_type"))
    e = load(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return latest_states(e)


QUERIES = {f.__name__: f for f in (scan_cases, scan_facts, scan_surfaces, scan_models, scan_large, excerpt_callables, excerpt_findings, job_state_machine)}

_SEVERITY = "CASE access WHEN 'unauthenticated' THEN 'critical' WHEN 'authenticated' THEN 'high' WHEN 'nonce_only' THEN 'medium' WHEN 'capability_checked' THEN 'low' ELSE 'info' END"

ORACLES = {
    "scan_cases": f"""
SELECT case_id, rule_id, place, source_line::INT AS source_line, access, {_SEVERITY} AS severity, nullif(capability, '-') AS required_capability,
  CASE capability WHEN 'manage_options' THEN 'administrator' WHEN 'read' THEN 'subscriber' END AS minimum_role, score::INT AS score
FROM (VALUES {P.values(P.EXPECTED, 7)}) t(case_id, rule_id, place, source_line, access, capability, score)""",
    "scan_surfaces": f"""
SELECT case_id, rule_id, place, source_line::INT AS source_line FROM (VALUES {P.values(P.EXPECTED_SURFACES, 4)}) t(case_id, rule_id, place, source_line)""",
    "scan_models": """
SELECT case_id, rule_id, line::INT AS line, source_line::INT AS source_line FROM (VALUES ('own', 'own-rule', 2, 2), ('own', 'own-write', 4, 3),
  ('own', 'wp-reflected-xss-direct-request-output', 5, 3)) t(case_id, rule_id, line, source_line)""",
    "scan_large": f"""
SELECT 'large' || p AS case_id, 'f:show_' || i AS callable, 'wp-reflected-xss-direct-request-output' AS rule_id, 'unauthenticated' AS access
FROM range({P.LARGE_PROGRAMS}) a(p), range({P.LARGE_RELEVANT // 3}) b(i)""",
    "scan_facts": f"""
SELECT case_id, kind, about, value FROM (VALUES {P.values(P.EXPECTED_FACTS, 4)}) t(case_id, kind, about, value)""",
    "job_state_machine": """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'downloading'
  WHEN 'signup' THEN 'scanning' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, CASE status WHEN 'queued' THEN 1 WHEN 'downloading' THEN 2 WHEN 'scanning' THEN 3 ELSE 4 END AS level FROM e WHERE status IS NOT NULL)
SELECT job_id, coalesce(arg_min(status, seq) FILTER (level = 4), arg_max(status, level)) AS status, count(*) AS n_events FROM l GROUP BY job_id""",
}
