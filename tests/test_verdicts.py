"""Manifest, final-finding and lattice operators on small fixtures, with the awkward cases of each."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.access import minimum_role
from factloom.operators import findings as ops, lattice, verdicts

PLACE = "struct<path:string,line:int,snippet:string>"
FINDING = f"finding_id bigint, slug string, rule_id string, path string, line int, message string, callable string, source {PLACE}, sink {PLACE}"
CASE = "case_id string, slug string, " + ", ".join(
    f"{c} array<string>" for c in "configs sink_ops rules paths sources trace_sources trace_sinks sink_places bundle_texts".split()
)


def case(name, slug="s", **given):
    columns = "configs sink_ops rules paths sources trace_sources trace_sinks sink_places bundle_texts".split()
    return (name, slug, *(given.get(c) for c in columns))


def found(i, rule="r", slug="s", path="a.php", line=3, callable="f:f", source=("b.php", 1, "$_GET['q']"), sink=("a.php", 3, "echo $q;")):
    return (i, slug, rule, path, line, "m", callable, source, sink)


@pytest.fixture(scope="module")
def findings(spark):
    rows = [found(1), found(2, "wp-request-sensitive-action-without-cap-check"), found(3, None, path=None, source=None, sink=None, callable=None), found(4, slug=None), found(5, line=9)]
    return spark.createDataFrame(rows, FINDING)


def test_verdicts(spark, findings):
    cases = [
        case("rule", configs=["x/xss.yaml"], rules=["r"]),
        case("alias", sink_ops=["Action "], rules=["wp-ajax-financial-action-without-cap-check"]),
        case("needle", configs=["xss.yaml"], rules=["r"], trace_sources=[" $_get", "b.php", "none", ""]),
        case("place", configs=["xss.yaml"], sink_places=["a.php:3"]),
        case("other", configs=["xss.yaml"], sink_places=["a.php:4", "3", ":3"]),
        case("both", configs=["xss.yaml"], rules=["r"], paths=["none.php"]),
        case("odd", configs=["what.yaml"], rules=["r"]),
        case("empty", configs=["xss.yaml"], rules=[]),
        case("bundle", configs=["xss.yaml"], rules=["r"], bundle_texts=["b"]),
        case("blank", sink_ops=[" "], rules=["r"]),
        case("elsewhere", slug="t", configs=["xss.yaml"], rules=["r"]),
        case("nowhere", slug=None, configs=["xss.yaml"], rules=["r"]),
    ]
    got = verdicts.compare_cases(findings, spark.createDataFrame(cases, CASE), ["path", "line", "finding_id"])
    rows = {r.case_id: (r.status, r.score, r.found and r.found.finding_id) for r in got.collect()}
    assert rows == {
        "rule": ("match", 0, 1), "alias": ("match", 0, 2), "needle": ("match", 200, 1), "place": ("match", 0, 1), "other": ("miss", None, None),
        "both": ("miss", None, None), "odd": ("not_comparable_yet", None, None), "empty": ("not_comparable_yet", None, None),
        "bundle": ("not_comparable_yet", None, None), "blank": ("not_comparable_yet", None, None), "elsewhere": ("miss", None, None), "nowhere": ("miss", None, None),
    }
    total = verdicts.verdict_totals(got).first()
    assert (total.n_cases, total.n_match, total.n_miss, total.n_not_comparable_yet, total.share) == (12, 4, 4, 4, 0.5)
    nothing = verdicts.compare_cases(findings.limit(0), spark.createDataFrame(cases[:1], CASE), ["finding_id"]).first()
    assert nothing.status == "miss" and verdicts.verdict_totals(got.limit(0)).first().n_cases == 0


def test_coverage_and_traces(spark, findings):
    cases = spark.createDataFrame(
        [
            case("apart", rules=["wp-request-sensitive-action-without-cap-check"], sources=["$_get"], trace_sinks=["echo"], trace_sources=["$_GET"]),
            case("lacks", rules=["no"], sources=["$_get"]),
            case("bare"),
            case("near", rules=["r"], trace_sinks=["echo"]),
            case("none", slug="t", rules=["r"]),
        ],
        CASE,
    )
    covered = verdicts.coverage(findings, cases)
    assert {r.case_id: (r.status, r.failed) for r in covered.collect()} == {
        "apart": ("passed", ""), "lacks": ("failed", "rules"), "bare": ("not_configured", ""), "near": ("passed", ""), "none": ("failed", "rules")
    }
    got = {r.case_id: r.status for r in verdicts.trace_status(findings, cases, covered.where("case_id <> 'none'")).collect()}
    assert got == {"apart": "found", "lacks": "not_found", "bare": "not_found", "near": "nearby_only", "none": "not_run"}


def test_path_cover(spark):
    rows = [("c", "x", 0, p) for p in "ab"] + [("c", "y", 0, p) for p in "bcd"] + [("c", "z", 9, "a"), ("c", "w", 0, None), ("d", "only", 0, None)]
    got = sorted(tuple(r) for r in verdicts.path_cover(spark.createDataFrame(rows, "case_id string, item string, score int, piece string")).collect())
    assert got == [("c", 1, "y"), ("c", 2, "x")]


def test_final_findings(spark):
    rule = "wp-request-tainted-privilege-mutation"
    rows = [
        found(1, "path-transversal", callable="f:a"), found(2, "path-transversal", callable="f:b", source=("c.php", 2, "none")),
        found(3, "wp-open-redirect"), found(4, "wp-open-redirect", source=("c.php", 2, "x")),
        found(5, rule, line=1), found(6, rule, line=2, sink=("z.php", 8, "echo $q;")), found(7, rule, line=1, slug="t"),
        found(8, None, source=None, sink=None, callable=None, path=None),
    ]
    got = ops.final_findings(spark.createDataFrame(rows + rows[:1], FINDING).distinct(), ["slug"], ["finding_id"])
    assert sorted((r.finding_id, r.n_findings) for r in got.collect()) == [(1, 2), (3, 1), (4, 1), (5, 2), (7, 1), (8, 1)]
    assert ops.final_findings(spark.createDataFrame([], FINDING), ["slug"], ["finding_id"]).count() == 0


def test_lattice_of_options_roots_and_parents(spark):
    df = spark.createDataFrame([("h", "p", False), ("h", "p", None), ("g", "p", True), ("f", "p", False), ("f", "q", False), ("e", None, False)], "h string, r string, flag boolean")
    assert [tuple(r) for r in lattice.single_root(df, ["h"], "r", ["flag"]).collect()] == [("h", "p")]
    paths = [(["a"], "o1"), (["a"], "o2"), (["a", "b"], "o1"), (["a", "b"], "o2"), (["c"], "o1"), (["c", "d"], "o2"), (["a", "b", "x"], "o1")]
    df = spark.createDataFrame([("h", p, o) for p, o in paths], "h string, path array<string>, origin string")
    got = sorted(("/".join(r.path), r.origin) for r in lattice.drop_covered_parents(df, ["h"], "path", "origin").collect())
    assert got == [("a/b", "o1"), ("a/b", "o2"), ("a/b/x", "o1"), ("c", "o1"), ("c/d", "o2")]
    df = spark.createDataFrame([("k", None), ("k", None), ("l", "b"), ("l", "a"), ("l", "b")], "k string, v string")
    assert {r.k: r.v for r in df.groupBy("k").agg(lattice.optional_merge(F.col("v")).alias("v")).collect()} == {"k": None, "l": ["a", "b"]}
    assert {r.k for r in lattice.cap_fan_out(df, ["k"], 2).collect()} == {"k"}


def test_requests_roles_and_payloads(spark):
    df = spark.createDataFrame([("a", "1.0"), ("a", "1.0"), ("a", "2"), ("A b", "1"), ("a", "../1"), (None, "1"), ("b", None)], "slug string, version string")
    assert sorted(tuple(r) for r in ops.valid_requests(df, 400).collect()) == [("a", "1.0"), ("a", "2")]
    assert ops.valid_requests(df, 1).count() == 1
    merged = ops.merge_payloads([df.where("version = '1.0'"), df.limit(0), df.where("version = '2'")], ["slug"]).collect()
    assert [tuple(r) for r in merged] == [("a", "2")]
    caps = spark.createDataFrame([("edit_posts",), ("own_cap",), (None,)], "c string")
    assert [r.r for r in caps.select(minimum_role(F.col("c")).alias("r")).collect()] == ["contributor", "unknown_role", None]
