"""Lattice laws, closures, joins and findings operators against brute force."""

import random

from pyspark.sql import functions as F

from factloom.functions.access import TIER_WEIGHT, derive_access
from factloom.functions.scores import exploitability
from factloom.functions.text import controls_host, fingerprint, has_string_conversion, plain_text, tolerant_string, url_host
from factloom.operators import closure, findings, joins, lattice


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_flags_merge_like_a_lattice(spark):
    df = spark.createDataFrame([("a", True, None), ("a", False, False), ("b", None, True), (None, False, True)], "k string, x boolean, y boolean")
    once = rows(lattice.merge_flags(df, ["k"], ["x", "y"]))
    assert once == rows(lattice.merge_flags(df.union(df).repartition(3), ["k"], ["x", "y"]))
    assert dict((k, (x, y)) for k, x, y in once) == {"a": (True, False), "b": (False, True), None: (False, True)}
    strict = dict((k, (x, y)) for k, x, y in rows(lattice.merge_flags(df, ["k"], ["x", "y"], strict=True)))
    assert strict["a"] == (False, False)


def test_sets_merge_and_cap(spark):
    df = spark.createDataFrame([("a", ["3", "1"]), ("a", ["2", None, "1"]), ("b", []), ("c", None), (None, ["z"])], "k string, e array<string>")
    got = dict((k, v) for k, v in rows(lattice.merge_sets(df, ["k"], {"e": 2})))
    assert got == {"a": ["1", "2"], "b": [], "c": [], None: ["z"]}
    assert lattice.merge_sets(df.limit(0), ["k"], {"e": 2}).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("a.b[k][]",), ("x",), ("a[k]",)], "p string")
    got = [r.s for r in df.select(lattice.path_segments(F.col("p")).alias("s")).collect()]
    assert got == [["a", ".b", "[k]", "[]"], ["x"], ["a", "[k]"]]
    variants = df.where("p = 'a[k]'").select(lattice.path_variants(lattice.path_segments(F.col("p"))).alias("v")).first().v
    assert variants == [["a", "[k]"], ["a", "[*]"]]
    many = spark.createDataFrame([("h", ["r", f"[{i}]"]) for i in range(70)] * 2 + [("h", ["q", "[1]"])], "h string, p array<string>")
    wide = {tuple(r.p) for r in lattice.widen_paths(many, ["h"], "p").collect()}
    assert wide == {("r", "[*]"), ("q", "[1]")}


def test_reach_and_relevant_on_cycles(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(1, 1), (None, 2)]
    e = spark.createDataFrame(edges, "src int, dst int")
    want, frontier = {3: 0}, {3}
    depth = 0
    while frontier:
        depth += 1
        frontier = {b for a, b in edges if a in frontier} - set(want)
        want.update(dict.fromkeys(frontier, depth))
    seeds = spark.createDataFrame([(3,), (3,), (None,)], "node int")
    assert dict((n, d) for n, d in rows(closure.reach(e, seeds))) == want
    back, grow = {5}, True
    while grow:
        more = {a for a, b in edges if b in back and a is not None} | back
        grow, back = more != back, more
    got = {r.node for r in closure.relevant(e, seeds, spark.createDataFrame([(5,)], "node int")).collect()}
    assert got == set(want) & back
    assert closure.reach(e, seeds.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(40)]
    edges += [("hub", f"leaf{i:03}") for i in range(200)] + [(None, "x"), ("self", "self")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(parent))
    got = rows(closure.components(spark.createDataFrame(edges, "a string, b string")))
    assert got == want


def test_nearest_owner_and_passes(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("c", "z")], "node string, parent string")
    owners = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(closure.nearest_owner(parents, owners)) == [("a", "a", 0), ("b", "a", 1), ("c", "z", 1), ("z", "z", 0)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    facts = spark.createDataFrame([(0, "f")], "node int, fact string")
    assert closure.propagate_sets(chain, facts, 8).agg(F.max("node")).first()[0] == 8


def test_asof(spark):
    rng = random.Random(9)
    left = [(rng.choice("ab"), rng.randrange(50), i) for i in range(60)]
    right = [(rng.choice("ab"), rng.randrange(50), i) for i in range(40)]
    a = spark.createDataFrame(left, "k string, t int, id int")
    b = spark.createDataFrame(right, "k string, t int, v int")
    for strict in (True, False):
        want = []
        for k, t, i in left:
            before = [(u, v) for j, u, v in right if j == k and (u < t or (not strict and u == t))]
            want.append((k, t, i, max(before)[1] if before else None))
        assert rows(joins.asof_join(a, b, ["k"], "t", ["v"], strict)) == sorted(want, key=repr)


def test_near_before(spark):
    rng = random.Random(10)
    left = [(rng.choice("ab"), rng.randrange(-100, 400), i) for i in range(80)] + [("a", None, 99)]
    right = [(rng.choice("abc"), rng.randrange(-100, 400)) for _ in range(30)] * 2 + [("a", None)]
    want = sorted(i for k, p, i in left if p is not None and any(j == k and q is not None and 0 <= p - q <= 48 for j, q in right))
    got = joins.near_before(spark.createDataFrame(left, "k string, p int, id int"), spark.createDataFrame(right, "k string, q int"), ["k"], "p", "q", 48)
    assert sorted(r.id for r in got.collect()) == want
    none = joins.near_before(spark.createDataFrame(left, "k string, p int, id int"), spark.createDataFrame(right, "k string, q int"), ["k"], "p", "q", 48, absent=True)
    assert sorted(r.id for r in none.collect()) == sorted(i for _, _, i in left if i not in want)


def test_prefix_and_tiers(spark):
    names = spark.createDataFrame([("save_a",), ("load",), ("sav",), (None,), ("",)], "name string")
    patterns = spark.createDataFrame([("save_",), ("sa",), ("",), (None,)], "prefix string")
    assert rows(joins.prefix_join(names, "name", patterns, "prefix")) == [("sav", "sa"), ("save_a", "sa"), ("save_a", "save_")]
    left = spark.createDataFrame([(1, "f", "k"), (2, "f", "other"), (3, "g", "k"), (4, None, None)], "id int, fam string, key string")
    right = spark.createDataFrame([("f", "k"), ("f", "z")], "fam string, key string")
    got = joins.tiered_join(left, right, [["fam", "key"], ["fam"]])
    assert sorted((r.id, r.r_key, r.tier) for r in got.collect()) == [(1, "k", 1), (2, "k", 2), (2, "z", 2)]
    assert {r.id for r in joins.tiered_join(left, right, [["fam", "key"], ["fam"]], limit=1).collect()} == {1}


def test_running_sum(spark):
    rng = random.Random(11)
    data = [(i, rng.choice([None, 1, 5, 7])) for i in range(300)]
    rng.shuffle(data)
    total, want = 0, []
    for i, v in sorted(data, reverse=True):
        total += v or 0
        want.append((i, total))
    got = joins.running_sum(spark.createDataFrame(data, "i int, v int"), [F.desc("i")], "v")
    assert sorted((r.i, r.running) for r in got.collect()) == sorted(want)


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("<b>A &amp;lt; B</b>", "false", "https://User@Ex.org:80/x"), (None, None, None), ("", "7.4", "ftp//x")], "t string, f string, u string"
    )
    got = rows(df.select(plain_text(F.col("t")), tolerant_string(F.col("f")), url_host(F.col("u"))))
    assert got == sorted([("A &lt; B", None, "ex.org"), (None, None, None), ("", "7.4", None)], key=repr)
    formats = spark.createDataFrame([("%s",), ("100%%s",), ("%d",), (None,), ("%%%5s",)], "f string")
    assert [r[0] for r in formats.select(has_string_conversion(F.col("f"))).collect()] == [True, False, False, True, True]
    heads = spark.createDataFrame([("https://a.b/",), ("https://a.b",), ("",)], "p string")
    assert [r[0] for r in heads.select(controls_host(F.col("p"))).collect()] == [False, True, True]
    parts = spark.createDataFrame([(["a"],), (["a", None],), (["a", ""],), ([],)], "p array<string>")
    a, b, c, none = (r[0] for r in parts.select(fingerprint(F.col("p"))).collect())
    assert a == "a" and b == c and len(b) == 40 and none is None


def test_access(spark):
    def tier(**seen):
        keys = ("privileged", "capability", "auth", "unauth", "nonce")
        entries = F.array(*map(F.lit, seen.get("entries", []))).cast("array<string>")
        return spark.range(1).select(derive_access(*(F.lit(seen.get(k)) for k in keys), entries).alias("t")).first().t

    assert tier() == "unknown"
    assert tier(privileged=True, unauth=True) == "capability_checked"
    assert tier(capability=True) == "authenticated"
    assert tier(unauth=True) == "unauthenticated"
    assert tier(nonce=True, entries=["unauthenticated"]) == "nonce_only"
    assert tier(nonce=True, auth=True, unauth=True) == "nonce_only"
    assert tier(entries=["authenticated", "unauthenticated"]) == "unauthenticated"
    df = spark.createDataFrame([("r-surface", "unauthenticated", None), ("r", "capability_checked", "authenticated"), (None, None, None)], "r string, a string, s string")
    got = [x[0] for x in df.select(exploitability(F.col("r"), F.col("a"), F.col("s"))).collect()]
    assert got == [850, TIER_WEIGHT["authenticated"], 100]


def test_findings_operators(spark):
    f = spark.createDataFrame([(1, "k1", "s1"), (2, "k1", "s2"), (3, "k9", "s2"), (4, None, None), (4, None, None)], "id int, exact string, site string")
    groups = {}
    for r in findings.cluster_by_keys(f, "id", [F.col("exact"), F.col("site")]).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4]]
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(findings.key_diff(a, b, ["k"])) == [("x", "removed"), ("y", "common"), ("z", "added")]
    t = spark.createDataFrame([("g", v) for v in "aabbbcd"] + [("g", None)], "g string, v string")
    assert rows(findings.top_values(t, ["g"], "v", 3)) == [("g", ["b", "a", "c"])]


def test_long_chains_are_walked_to_their_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    assert max(r.depth for r in closure.reach(edges, spark.createDataFrame([(0,)], "node int")).collect()) == 30
    parents = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "x")], "node string, parent string")
    found = {r.node: (r.owner, r.depth) for r in closure.nearest_owner(parents, spark.createDataFrame([("c30",)], "node string")).collect()}
    assert found["c00"] == ("c30", 30) and len(found) == 31 and "x" not in found


def test_tiered_counts_equal_pairs(spark):
    left = spark.createDataFrame([(1, "f", "k"), (2, "f", "z"), (3, "g", "k"), (4, None, "k")], "id int, fam string, key string")
    right = spark.createDataFrame([("f", "k"), ("f", "k"), ("f", "y"), (None, "k")], "fam string, key string")
    got = sorted((r.id, r.tier, r.n_matches) for r in joins.tiered_counts(left, right, [["fam", "key"], ["fam"]]).collect())
    assert got == [(1, 1, 2), (2, 2, 3)]


def test_asof_of_a_key_that_fills_many_parts(spark):
    left = [("hot", t, t) for t in range(1, 400, 3)] + [(k, 5, 1000 + i) for i, k in enumerate("abc")] + [(None, 9, 2000)]
    right = [("hot", t, t) for t in (7, 8, 200)] + [("a", 4, 40), ("a", 5, 50), ("c", 6, 60), (None, 3, 30)]
    a = spark.createDataFrame(left, "k string, t int, id int")
    b = spark.createDataFrame(right, "k string, t int, v int")
    for strict in (True, False):
        got = {r.id: r.v for r in joins.asof_join(a, b, ["k"], "t", ["v"], strict).collect()}
        for k, t, i in left:
            before = [(x, v) for y, x, v in right if y == k and (x < t if strict else x <= t)]
            assert got[i] == (max(before)[1] if before else None), (k, t, strict)
        assert len(got) == len(left)
