"""Tree aggregation, snapshot changes and instants against brute force, with the awkward cases of each."""

import datetime as dt
import random
import zoneinfo
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.versions import version_key
from factloom.operators.instants import InstantDictionary, normalise_instants
from factloom.operators.snapshot_diff import finding_changes, row_hash, set_hash, snapshot_changes
from factloom.operators.tree_aggregate import count_state, distinct_state, heavy_keys, max_state, sum_state, tree_aggregate


def test_tree_equals_group_by_with_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, None if i % 7 == 0 else i % 5) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    states = {"n": count_state(), "s": sum_state(F.col("v")), "m": max_state(F.col("i")), "d": distinct_state(F.col("i"))}
    got = {r.k: r for r in tree_aggregate(df, ["k"], states, chunk_rows=64, fan_in=2, chunk_bits=3).collect()}
    want = Counter(k for k, _, _ in rows)
    assert {k: r.n for k, r in got.items()} == want
    for k, r in got.items():
        assert r.s == sum(v or 0 for x, _, v in rows if x == k)
        assert r.m == max(i for x, i, _ in rows if x == k)
        assert abs(r.d - want[k]) <= 0.1 * want[k] + 2


def test_tree_rounds_limit_fan_in(spark):
    df = spark.range(1000).withColumn("k", F.lit("x")).repartition(16)
    plan = tree_aggregate(df, ["k"], {"n": count_state()}, chunk_rows=16, fan_in=4)._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") >= 5


def test_partitions_with_more_chunks_than_numbers(spark):
    df = spark.range(3000).withColumn("k", (F.col("id") % 3).cast("string")).repartition(3)
    got = tree_aggregate(df, ["k"], {"n": count_state(), "m": max_state(F.col("id"))}, chunk_rows=8, fan_in=2, chunk_bits=1).collect()
    assert sorted(tuple(r) for r in got) == [("0", 1000, 2997), ("1", 1000, 2998), ("2", 1000, 2999)]


def test_tree_of_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k string, n int, __x int")
    assert tree_aggregate(df, ["k"], {"n": count_state()}).count() == 0
    df = spark.createDataFrame([("a", 5)], "k string, n int")
    assert tree_aggregate(df, ["k"], {"n": count_state()}).collect() == [("a", 1)]


def test_heavy_keys_count_repeats_and_nulls(spark):
    rows = [("a",)] * 4 + [("b",)] * 3 + [(None,)] * 93
    df = spark.createDataFrame(rows, "k string")
    empty = spark.createDataFrame([], "k string")
    got = heavy_keys([("t.k", df, "k"), ("e.k", empty, "k")], 0.04).collect()
    assert [(r.field_name, r.key_value, r.n_rows, r.total_rows) for r in got] == [("t.k", "a", 4, 100)]


def test_versions_order(spark):
    order = ["0.1", "1.0-beta1", "1.0-beta2", "1.0.0-rc1", "1.0", "1.0.1", "1.9", "1.10", "2.0.0.1"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(version_key(F.col("v"))).collect()] == order
    same = spark.createDataFrame([("1.2", "1.2.0.0")], "a string, b string")
    assert same.select((version_key(F.col("a")) == version_key(F.col("b"))).alias("x")).first().x


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("", "x"), ("x", "")], "a string, b string")
    assert df.select(row_hash(F.col("a"), F.col("b")).alias("h")).distinct().count() == 4
    sets = spark.createDataFrame(
        [([("a", 1), ("b", None)],), ([("b", None), ("a", 1), ("a", 1)],), ([("a", 1)],), ([],), (None,)],
        "e array<struct<k:string,v:int>>",
    )
    h = [r.h for r in sets.select(set_hash(F.col("e"), ("k", "v")).alias("h")).collect()]
    assert h[0] == h[1] and h[3] == h[4] and len(set(h)) == 3


def _snapshots(spark, snapshots, records):
    s = spark.createDataFrame(snapshots, "snapshot_id string, batch_id string, version string, record_key int")
    r = spark.createDataFrame(records, "snapshot_id string, record_key string, record_hash bigint, idx int")
    return sorted((tuple(x) for x in snapshot_changes(r, s).collect()), key=str)


def test_snapshot_changes(spark):
    snapshots = [("s1", "b", "1.9", 0), ("s2", "b", "1.10", 0), ("s2b", "b", "1.10", 0), ("s3", "b", "2.0", 0), ("s4", "c", "1.0", 0), ("x", None, "1", 0)]
    records = [("s1", "k1", 1, 0), ("s1", "k1", 1, 0), ("s1", "k2", 2, 0), ("s1", None, 9, 0), ("s2", "k2", 3, 0), ("s2b", "k2", 3, 0), ("s2", "k3", 4, 0), ("s4", "k1", 1, 0), ("gone", "k1", 1, 0), (None, "k1", 1, 0)]
    got = _snapshots(spark, snapshots + snapshots, records)
    want = [
        ("b", "1.9", "1.10", "k1", "removed"),
        ("b", "1.9", "1.10", "k2", "changed"),
        ("b", "1.9", "1.10", "k3", "added"),
        ("b", "1.9", "1.10", None, "removed"),
        ("b", "1.10", "2.0", "k2", "removed"),
        ("b", "1.10", "2.0", "k3", "removed"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_key_with_several_contents_compares_by_all_of_them(spark):
    snapshots = [("s1", "b", "1", 0), ("s2", "b", "2", 0), ("s3", "b", "3", 0)]
    records = [("s1", "k", h, 0) for h in (1, 5, 9)] + [("s2", "k", h, 0) for h in (9, 9, 5, 1, 5)] + [("s3", "k", h, 0) for h in (1, 6, 9)]
    assert _snapshots(spark, snapshots, records) == [("b", "2", "3", "k", "changed")]


def test_snapshots_of_nothing(spark):
    assert _snapshots(spark, [], []) == []
    assert _snapshots(spark, [("s1", "b", "1", 0)], []) == []
    assert _snapshots(spark, [("s1", "b", "1", 0), ("s2", "b", "2", 0)], []) == []


def test_finding_changes_takes_only_full_scans(spark):
    place = "struct<path:string,line:int,snippet:string>"
    f = spark.createDataFrame(
        [(j, k, m, None, s, None, None, None, ("p", 1, None), None, None, "extra") for j, k, m, s in [("j1", "k", "m", " HIGH "), ("j2", "k", "m", "high"), ("j3", "k", "other", "high"), ("j4", "z", "m", None)]],
        f"job_id string, finding_key string, message string, access string, severity string, required_capability string, minimum_role string, callable string, source {place}, sink {place}, entrypoints array<struct<kind:string,name:string,route:string,methods:string,access:string>>, version string",
    )
    j = spark.createDataFrame(
        [("j1", "b", "1", "done", False), ("j2", "b", "2", "done", None), ("j3", "b", "3", "done", False), ("j4", "b", "4", "failed", False), ("j4", "b", "4", "done", True)],
        "id string, batch_id string, version string, status string, truncated boolean",
    )
    assert [tuple(r) for r in finding_changes(f, j).collect()] == [("b", "2", "3", "k", "changed")]


CASES = [
    ("2024-06-01T12:00:00Z", 0, "2024-06-01 12:00:00"),
    (" 2024-06-01  3:05pm gmt ", 0, "2024-06-01 15:05:00"),
    ("2024-06-01 12:05 a.m. UTC", 0, "2024-06-01 00:05:00"),
    ("2024-06-01", 1, "2024-06-01 00:00:00"),
    ("2024-06-01 12:00", 0, "2024-06-01 10:00:00"),
    ("2024-10-27 02:30:00", 0, "2024-10-27 00:30:00"),
    ("2024-03-31 02:30:00", 0, "2024-03-31 01:30:00"),
    ("2024-10-27 02:30:00 CET", 0, "2024-10-27 01:30:00"),
    ("2024-10-27 02:30:00 CEST", 0, "2024-10-27 00:30:00"),
    ("2024-11-03 01:30:00 EST", 1, "2024-11-03 06:30:00"),
    ("03/04/2024 10:00", 0, "2024-04-03 08:00:00"),
    ("03/04/2024 10:00 AM", 1, "2024-03-04 15:00:00"),
    ("2024/03/04 10:00", 2, "2024-03-04 01:00:00"),
    ("1.8.2023, 09:15", 0, "2023-08-01 07:15:00"),
    ("Tue, 2 Jan 2024 10:00:00 -0530", 0, "2024-01-02 15:30:00"),
    ("March 31, 2011 1:46 pm", 2, "2011-03-31 04:46:00"),
    ("7 Aug 2024", 1, "2024-08-07 00:00:00"),
    ("20240102T030405Z", 0, "2024-01-02 03:04:05"),
    ("1704164645", 0, "2024-01-02 03:04:05"),
    ("1704164645123", 0, "2024-01-02 03:04:05.123"),
    ("2024-01-02T03:04:05.123456789Z", 0, "2024-01-02 03:04:05.123456"),
    ("2024-01-02 03:04:05-09", 0, "2024-01-02 12:04:05"),
    ("2024-01-02T03:04:05+09:00[Asia/Tokyo]", 0, "2024-01-01 18:04:05"),
    ("2024-01-02 03:04:05", None, None),
    ("2024-01-02 03:04:05 UTC", None, "2024-01-02 03:04:05"),
]
UNUSABLE = ["", " ", "-", "n/a", "unknown", "false", "0000-00-00", "0000-00-00 00:00:00", "2024-02-30", "2024-13-01", "2024-01-01 25:00", "2024-01-01 13:00 PM", "31/31/2024 10:00", "x" * 50_000, None]


@pytest.fixture(scope="module")
def clocks(spark):
    return spark.createDataFrame(
        [(0, "Europe/Berlin", "dmy", 1), (1, "America/New_York", "mdy", 1), (2, "Asia/Tokyo", "ymd", 1), (3, "No/Where", "dmy", 1), (4, None, None, 1)],
        "collector_id int, zone_name string, date_order string, raw int",
    )


def _instants(spark, clocks, values, path=None):
    rows = [(i, v, c) for i, (v, c) in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, at string, collector_id int").withColumn("zone", F.lit("clash"))
    got = normalise_instants([("t", df, "id", ["at"])], clocks, path).collect()
    assert all(r.source_table == "t" and r.field_name == "at" for r in got)
    return {r.record_id: r.utc_us for r in got}


def test_instants(spark, clocks):
    got = _instants(spark, clocks, [(v, c) for v, c, _ in CASES] + [(v, 0) for v in UNUSABLE] + [("2024-01-01 10:00", 3), ("2024-01-01 10:00", 4)])
    for i, (value, _, want) in enumerate(CASES):
        expected = None
        if want:
            at = dt.datetime.fromisoformat(want)
            expected = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert got.get(i) == expected, value
    assert not [i for i in got if i >= len(CASES)]


def test_instants_of_random_local_times(spark, clocks):
    rng = random.Random(3)
    zones = {0: "Europe/Berlin", 1: "America/New_York", 2: "Asia/Tokyo"}
    values, want = [], []
    for _ in range(400):
        at = dt.datetime(2010, 1, 1) + dt.timedelta(seconds=rng.randrange(500_000_000))
        c = rng.randrange(3)
        utc = at.replace(tzinfo=zoneinfo.ZoneInfo(zones[c]), fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None)
        values.append((at.strftime("%Y-%m-%d %H:%M:%S"), c))
        want.append((utc - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
    got = _instants(spark, clocks, values)
    assert [got[i] for i in range(len(values))] == want


def test_dictionary_parses_each_value_once(spark, clocks, tmp_path):
    path = f"file://{tmp_path}/book"
    _instants(spark, clocks, [("2024-01-01 10:00", 0)] * 3 + [("n/a", 0)], path)
    book = InstantDictionary(spark, path)
    assert book.read().count() == 2
    _instants(spark, clocks, [("2024-01-01 10:00", 0), ("2024-01-02", 0)], path)
    assert book.read().count() == 3


def test_values_that_hold_most_rows(spark, clocks):
    values = [("2024-01-01 10:00", 0)] * 300 + [("0000-00-00", 0)] * 300 + [(f"2024-02-{i % 28 + 1:02d}", 0) for i in range(56)]
    got = _instants(spark, clocks, values)
    assert sorted(got) == [*range(300), *range(600, 656)] and {got[i] for i in range(300)} == {1704099600000000}


def test_dictionary_in_the_folder_of_the_setting(spark, clocks, tmp_path):
    spark.conf.set("spark.factloom.instants.dir", f"file://{tmp_path}/kept")
    try:
        for value in ("2024-01-01", "2024-01-02"):
            assert len(_instants(spark, clocks, [(value, 0), ("n/a", 0)])) == 1
        assert InstantDictionary(spark).read().count() == 3
    finally:
        spark.conf.unset("spark.factloom.instants.dir")


def test_instants_of_nothing(spark, clocks):
    assert _instants(spark, clocks.limit(0), []) == {}
    assert _instants(spark, clocks.limit(0), [("2024-01-01", 0)]) == {0: 1704067200000000}
