import random

from pyspark.sql import functions as F

from factloom.llm.group_topn import cut_rows, group_topn, item_bin

SCHEMA = "g string, h string, item bigint, sev int, __bin int"


def brute(rows, n):
    best = {}
    for g, h, i, s, _ in rows:
        if None not in (g, h, i, s):
            best[g, h, i] = min(s, best.get((g, h, i), 9))
    groups = {}
    for (g, h, i), s in best.items():
        groups.setdefault((g, h), []).append((s, i))
    return sorted((g, h, i) for (g, h), v in groups.items() for _, i in sorted(v)[:n])


def run(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in group_topn(df, ["g", "h"], F.col("sev"), "item", n, **more).collect())


def test_hot_groups_ties_repeats_and_nulls(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(4000):
        g = rng.choice(["hot"] * 5 + ["a", "b", None])
        i = rng.choice([rng.randrange(-50, 900), 7, None])
        rows.append((g, rng.choice(["x"] * 6 + ["y", None]), i, rng.choice([0, 1, 2, 3, 4, None]), 1))
    for n in (1, 3, 10):
        for groups in (0, 1, 100):
            assert run(spark, rows, n, broadcast_groups=groups) == brute(rows, n)


def test_thresholds_cut_rows_of_any_group_with_more_than_n(spark):
    rows = [(g, "x", i, i % 2, 0) for g, size in (("small", 3), ("middle", 40), ("large", 5000)) for i in range(size)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = {r.g: r.n for r in cut_rows(df, ["g", "h"], F.col("sev"), "item", 3).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert left["small"] == 3 and left["middle"] <= 6 and left["large"] <= 6
    left = cut_rows(df, ["g", "h"], F.col("sev"), "item", 3, 1).groupBy("g").agg(F.count("*").alias("n")).collect()
    assert {r.g: r.n for r in left}["middle"] == 40 and {r.g: r.n for r in left}["large"] <= 6


def test_bins_never_fall(spark):
    numbers = sorted({s * ((1 << k) + d) for k in range(62) for d in (-1, 0, 1, 5) for s in (1, -1)} | {(1 << 63) - 1, -(1 << 63)})
    got = [r.b for r in spark.createDataFrame([(x,) for x in numbers], "x bigint").orderBy("x").select(item_bin("x").alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 200


def test_one_item_in_every_rank_is_one_item(spark):
    rows = [("g", "x", 1, s, 0) for s in range(5)] * 50 + [("g", "x", i, 4, 0) for i in range(2, 9)]
    assert run(spark, rows, 3) == [("g", "x", 1), ("g", "x", 2), ("g", "x", 3)]


def test_small_and_empty(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [("g", "x", None, 0, 0)], 3) == []
    assert run(spark, [("g", "x", 5, 0, 0)], 3) == [("g", "x", 5)]
