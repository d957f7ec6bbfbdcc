"""Findings against the cases of a manifest: comparability, verdicts, scores, coverage, proofs.

A manifest is a DataFrame with a row for each case: case_id, slug, and arrays
of texts (null or empty: not configured): configs, sink_ops, rules, paths,
sources, trace_sources, trace_sinks, sink_places, bundle_texts. Findings have
slug, rule_id, path, line, callable, source and sink (structs: path, line,
snippet). Cases meet the findings of their slug in an equi join, so a manifest
of any length makes a plan of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations that the configurations of a case stand for.
CONFIG_OPERATIONS = {
    "path-transversal.yaml": "include read open delete",
    "privilege-escalation.yaml": "action output write call",
    "sqli.yaml": "sql",
    "file-upload.yaml": "write read open delete",
    "unsafe-use.yaml": "call",
    "xss.yaml": "output",
}
#: Rules that a rule of a manifest stands for beside itself.
_UPLOADS = "wp-request-file-upload-without-cap-check wp-request-file-delete-without-cap-check request-path-read-delete"
RULE_ALIASES = {
    "file-download-upload": _UPLOADS,
    "upload-api-surface": _UPLOADS,
    "wordpress-upload-helper-surface": _UPLOADS,
    "wp-ajax-financial-action-without-cap-check": "wp-request-sensitive-action-without-cap-check",
}
#: Points of each needle by where it is found.
TRACE_SOURCE, SOURCE, TRACE_SINK, CALLABLE_TRACE, CALLABLE = 100, 40, 20, 10, 5
#: Points of a proof: rule, path, source text; mapped onto an expected path, with a source text there.
PROOF_RULE, PROOF_PATH, PROOF_TEXT, PROOF_MAPPED_PATH, PROOF_MAPPED_TEXT = 100, 80, 70, 60, 80
_CRITERIA = ("rules", "paths", "sources", "trace_sources", "trace_sinks", "sink_places")


def _words(table: dict[str, str]) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))


def _clean(needles: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(needles, none), lambda n: F.lower(F.trim(n))), lambda n: n != "")


def _texts(*columns: Column) -> Column:
    return F.filter(F.transform(F.array(*columns), F.lower), lambda t: F.coalesce(t, F.lit("")) != "")


def _hits(texts: Column, needles: Column) -> Column:
    """Needles that any of the texts holds, without regard to case and outer blanks."""
    return F.filter(_clean(needles), lambda n: F.exists(texts, lambda t: F.contains(t, n)))


def configured(needles: Column) -> Column:
    return F.coalesce(F.size(needles), F.lit(0)) > 0


def sink_operations(cases: DataFrame) -> DataFrame:
    """``cases`` with ``operations`` (sorted, distinct) and ``reason`` where they can't be told.

    Given operations go before those of the configurations; a configuration
    that isn't known makes the case incomparable.
    """
    given = F.array_sort(F.array_distinct(_clean(F.col("sink_ops"))))
    names = F.transform(F.coalesce("configs", F.array().cast("array<string>")), lambda c: F.substring_index(c, "/", -1))
    known = _words(CONFIG_OPERATIONS)
    unknown = F.filter(names, lambda c: F.try_element_at(known, c).isNull())
    derived = F.array_sort(F.array_distinct(F.flatten(F.transform(names, lambda c: F.coalesce(F.try_element_at(known, c), F.array().cast("array<string>"))))))
    return cases.withColumn(
        "reason",
        F.when(configured(F.col("sink_ops")), F.when(F.size(given) == 0, "no operations are left"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unsupported config "), unknown[0])),
    ).withColumn("operations", F.when(F.col("reason").isNotNull(), F.array().cast("array<string>")).when(F.size(given) > 0, given).otherwise(derived))


def comparable(cases: DataFrame) -> DataFrame:
    """``sink_operations``, with a reason as well for cases without criteria and for those about bundles."""
    any_ = F.lit(False)
    for c in _CRITERIA:
        any_ = any_ | configured(F.col(c))
    return sink_operations(cases).withColumn(
        "reason", F.coalesce("reason", F.when(configured(F.col("bundle_texts")), "bundle specific").when(~any_, "no criteria"))
    )


def rule_matches(rule: Column, wanted: Column) -> Column:
    """Whether a rule is wanted, by itself or by an alias of a wanted one."""
    aliases = _words(RULE_ALIASES)
    none = F.array().cast("array<string>")
    return F.array_contains(wanted, rule) | F.exists(wanted, lambda w: F.array_contains(F.coalesce(F.try_element_at(aliases, F.trim(w)), none), rule))


def met(kind: str) -> Column:
    """Whether a finding meets one criterion of the case beside it."""
    source, sink = F.col("source"), F.col("sink")
    snippet, path = (lambda x: x.getField("snippet")), (lambda x: x.getField("path"))
    if kind == "rules":
        return rule_matches(F.col("rule_id"), F.col("rules"))
    if kind == "paths":
        ends = F.transform("paths", lambda e: F.trim(e))
        return F.exists(ends, lambda e: F.endswith(F.coalesce("path", F.lit("")), e) | F.endswith(F.coalesce(path(sink), F.lit("")), e) | F.endswith(F.coalesce(path(source), F.lit("")), e))
    if kind == "sink_places":
        place = lambda p: F.endswith(path(sink), F.regexp_extract(p, r"^(.*):\d+$", 1)) & (F.regexp_extract(p, r":(\d+)$", 1) == sink.getField("line").cast("string"))
        return F.exists(F.filter(F.transform("sink_places", lambda p: F.trim(p)), lambda p: p.rlike(r"^.+:\d+$")), place)
    texts = {
        "sources": (snippet(source), path(source), snippet(sink), path(sink), F.col("path"), F.col("callable")),
        "trace_sources": (snippet(source), path(source), F.col("callable")),
        "trace_sinks": (snippet(sink), path(sink), F.col("path"), F.col("callable")),
    }[kind]
    return F.size(_hits(_texts(*texts), F.col(kind))) > 0


def match_score() -> Column:
    """Points of a finding for the case beside it: every needle counts where it is found."""
    source, sink = F.col("source"), F.col("sink")
    of = lambda x: (x.getField("snippet"), x.getField("path"))
    count = lambda texts, needles: F.size(_hits(_texts(*texts), F.col(needles)))
    return (
        TRACE_SOURCE * count(of(source), "trace_sources")
        + SOURCE * count((*of(source), *of(sink), F.col("path")), "sources")
        + TRACE_SINK * count((*of(sink), F.col("path"), F.col("callable")), "trace_sinks")
        + CALLABLE_TRACE * count((F.col("callable"),), "trace_sources")
        + CALLABLE * count((F.col("callable"),), "sources")
    )


def compare_cases(findings: DataFrame, cases: DataFrame, order: list[str]) -> DataFrame:
    """(case_id, status, reason, score, found): the best finding that meets every criterion of a case by itself.

    status: match, miss, or not_comparable_yet with a reason. Of equal scores
    the first in ``order`` (columns of ``findings``) wins; ``found`` holds
    them. Nulls meet nothing. An empty table of findings makes misses.
    """
    ready = comparable(cases)
    pairs = findings.join(ready.where(F.col("reason").isNull()), "slug")
    for kind in _CRITERIA:
        pairs = pairs.where(~configured(F.col(kind)) | F.coalesce(met(kind), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), *order))
    best = pairs.withColumn("score", match_score()).withColumn("__place", place).where(F.col("__place") == 1)
    best = best.select("case_id", "score", F.struct(*order).alias("found"))
    return ready.select("case_id", "reason").join(best, "case_id", "left").select(
        "case_id",
        F.when(F.col("reason").isNotNull(), "not_comparable_yet").when(F.col("score").isNotNull(), "match").otherwise("miss").alias("status"),
        "reason",
        "score",
        "found",
    )


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """One row: cases, by status, and the share of the comparable ones that match."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("match", "miss", "not_comparable_yet")}
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_cases"),
        *(n.alias(f"n_{s}") for s, n in counts.items()),
        F.round(F.try_divide(counts["match"], counts["match"] + counts["miss"]), 6).alias("share"),
    )


def coverage(findings: DataFrame, cases: DataFrame, kinds: tuple[str, ...] = ("rules", "paths", "sources")) -> DataFrame:
    """(case_id, status, failed): whether each configured criterion is met by any finding of the case, not all by one.

    Weaker than ``compare_cases``. A slug without any finding fails the case
    for want of its results; a case without criteria is ``not_configured``.
    """
    hits = findings.join(cases, "slug").groupBy("case_id").agg(*(F.bool_or(F.coalesce(met(k), F.lit(False))).alias(f"hit_{k}") for k in kinds))
    joined = cases.join(hits, "case_id", "left")
    failed = F.filter(F.array(*(F.when(configured(F.col(k)) & ~F.coalesce(F.col(f"hit_{k}"), F.lit(False)), k) for k in kinds)), lambda x: x.isNotNull())
    any_ = F.lit(False)
    for k in kinds:
        any_ = any_ | configured(F.col(k))
    return joined.withColumn("failed", failed).select(
        "case_id", F.when(~any_, "not_configured").when(F.size("failed") == 0, "passed").otherwise("failed").alias("status"), F.array_join("failed", ",").alias("failed")
    )


def proof_score() -> Column:
    """Points of a finding as a proof of the case beside it; its source is what it is mapped onto."""
    path = F.coalesce("path", F.lit(""))
    at = F.coalesce(F.col("source.path"), F.lit(""))
    holds = lambda text, pieces: F.exists(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: (p != "") & F.contains(text, p))
    says = lambda text: holds(F.coalesce(text, F.lit("")), F.col("sources"))
    return (
        F.when(F.coalesce(rule_matches(F.col("rule_id"), F.col("rules")), F.lit(False)), PROOF_RULE).otherwise(0)
        + F.when(holds(path, F.col("paths")), PROOF_PATH).otherwise(0)
        + F.when(says(F.col("sink.snippet")), PROOF_TEXT).otherwise(0)
        + F.when(holds(at, F.col("paths")), PROOF_MAPPED_PATH).otherwise(0)
        + F.when(says(F.col("source.snippet")), PROOF_MAPPED_TEXT).otherwise(0)
    )


def path_cover(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(case_id, pick, item): a small set of items that covers the pieces of each case, chosen greedily.

    ``candidates``: case_id, item, score, piece (an item has a row for each
    piece that it covers). Each of at most ``most`` rounds takes, for every
    case at once, the item that covers most open pieces, then most pieces,
    then the higher score, then the smaller item. Null pieces cover nothing.
    """
    candidates = candidates.where(F.col("piece").isNotNull()).distinct()
    whole = candidates.groupBy("case_id", "item").agg(F.count_distinct("piece").alias("all"))
    open_, picked = candidates, None
    for pick in range(1, most + 1):
        gain = open_.groupBy("case_id", "item").agg(F.count_distinct("piece").alias("fresh"), F.max("score").alias("score")).join(whole, ["case_id", "item"])
        place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("fresh"), F.desc("all"), F.desc("score"), "item"))
        best = gain.withColumn("__place", place).where("__place = 1").select("case_id", F.lit(pick).alias("pick"), "item")
        picked = best if picked is None else picked.unionByName(best)
        covered = open_.join(best.select("case_id", "item"), ["case_id", "item"], "left_semi").select("case_id", "piece").distinct()
        open_ = open_.join(covered, ["case_id", "piece"], "left_anti")
    return picked


def meaning_key(lowered: Column, kind: Column) -> Column:
    """What makes two results the same: the place of one in the target; for one in a lowered file the bridge that it stands for.

    Needs the columns rule_id, path, line, read_path, read_line, family, key,
    source_path and source_line. A lowered result without a segment (null
    kind) is told by its own place.
    """
    text = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c))
    own = text("rule_id", "path", "line")
    bridge = F.concat_ws("|", F.lit("lowered"), F.col("rule_id"), kind, text("read_path", "read_line"))
    rest = (
        F.when(kind.isin("storage_bridge", "object_state_bridge"), F.concat_ws("|", bridge, text("family", "key")))
        .when(kind.isin("call_bridge", "hook_bridge"), bridge)
        .otherwise(F.concat_ws("|", bridge, text("source_path", "source_line")))
    )
    return F.when(~lowered, F.concat_ws("|", F.lit("target"), own)).when(kind.isNull(), F.concat_ws("|", F.lit("lowered-raw"), own)).otherwise(rest)


def trace_status(findings: DataFrame, cases: DataFrame, covered: DataFrame) -> DataFrame:
    """(case_id, status): how surely a case's own source and sink are found.

    ``covered``: the result of ``coverage``. not_run without a row there;
    not_found if it failed, asserts no sink, or no trace meets it; nearby_only
    if it asks for no trace; found if a finding of a wanted rule has both a
    wanted source and a wanted sink. A finding without source or sink is no trace.
    """
    sinks = configured(F.col("trace_sinks")) | configured(F.col("sink_places"))
    traces = findings.where(F.col("source.path").isNotNull() & F.col("sink.path").isNotNull()).join(cases, "slug")
    said = lambda text, needles: F.exists(F.coalesce(needles, F.array().cast("array<string>")), lambda n: F.contains(F.coalesce(text, F.lit("")), n))
    rule = ~configured(F.col("rules")) | F.array_contains("rules", F.col("rule_id"))
    hit = rule & said(F.col("source.snippet"), F.col("trace_sources")) & (said(F.col("sink.snippet"), F.col("trace_sinks")) | (configured(F.col("sink_places")) & met("sink_places")))
    found = traces.where(F.coalesce(hit, F.lit(False))).select("case_id").distinct().withColumn("found", F.lit(True))
    run = covered.select("case_id", F.col("status").alias("ran"))
    return cases.join(run, "case_id", "left").join(found, "case_id", "left").select(
        "case_id",
        F.when(F.col("ran").isNull(), "not_run")
        .when(F.col("ran") != "passed", "not_found")
        .when(~sinks, "not_found")
        .when(~configured(F.col("trace_sources")), "nearby_only")
        .when(F.col("found"), "found")
        .otherwise("not_found")
        .alias("status"),
    )
