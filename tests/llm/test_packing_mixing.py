import random
from collections import defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.mixing import largest_budget, mix_report, mix_sources, route
from factloom.llm.packing import greedy_bins, improve, pack_documents, packing_report, squared_fill
from factloom.llm.tokens import encoding

DOCS = "doc_id bigint, text string, source string, n_tokens bigint, piece int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_local_search_keeps_items_and_never_loses_fill(sizes):
    start = [[i] for i in range(len(sizes))]
    for bins in (start, greedy_bins(sizes, 100)):
        got = improve([list(b) for b in bins], sizes, 100)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in got)
        assert len(got) <= len(bins) and squared_fill(got, sizes) >= squared_fill(bins, sizes)


def test_search_alone_empties_bins():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(120)]
    got = improve([[i] for i in range(120)], sizes, 100)
    assert len(got) <= 1.05 * -(-sum(sizes) // 100) + 1


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1) for i, t, s in rows], DOCS)


def test_packs_whole_texts(spark):
    words = "alpha beta gamma delta epsilon".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, "beta " * 2000, "s"), (5, texts[5], "s")]
    packs = spark.createDataFrame([(1, 64), (2, 500), (3, 0), (4, None), (1, 64)], "pack_id int, capacity_tokens int")
    got = pack_documents(_docs(spark, rows), packs, group_items=40).collect()
    tokens = lambda t: len(encoding().encode_ordinary(t))
    for pack, capacity in ((1, 64), (2, 500)):
        bins, docs = defaultdict(int), defaultdict(int)
        for r in got:
            if r.pack_id == pack:
                bins[r.bin_id] += r.n_tokens
                docs[r.doc_id] += r.n_tokens
                if tokens(dict((i, t) for i, t, _ in rows)[r.doc_id]) <= capacity:
                    assert r.piece == 0 and r.start_token == 0
        assert max(bins.values()) <= capacity
        assert docs == {i: tokens(t) * (2 if i == 5 else 1) for i, t, _ in rows if t}
        assert sum(docs.values()) / (len(bins) * capacity) > 0.9
    assert {r.pack_id for r in got} == {1, 2}
    report = packing_report(pack_documents(_docs(spark, rows), packs)).collect()
    assert all(r.n_bins >= r.least_bins and r.largest_bin <= r.capacity_tokens for r in report)


def test_packs_do_not_depend_on_how_rows_are_split(spark):
    rng = random.Random(8)
    rows = [(i % 130, "word " * rng.randrange(1, 60), "s") for i in range(200)] + [(7, "same", "s")] * 3
    packs = spark.createDataFrame([(1, 64)], "pack_id int, capacity_tokens int")
    one, other = (pack_documents(_docs(spark, rows).repartition(n, "text"), packs, group_items=40).collect() for n in (1, 6))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len(one) == len(set(map(tuple, one)))


def test_packs_nothing(spark):
    packs = spark.createDataFrame([(1, 64)], "pack_id int, capacity_tokens int")
    assert pack_documents(_docs(spark, []), packs).count() == 0
    assert pack_documents(_docs(spark, [(1, "a", "s")]), packs.limit(0)).count() == 0


def test_flow_prefers_unused_and_respects_repeats():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    total, flows = route(patterns, {"a": 150, "b": 60}, {"a": 1, "b": 2})
    by = defaultdict(int)
    for (p, s), x in flows.items():
        by[s] += x
    assert total == 170 and by["a"] + by["b"] == 170 and flows[("b",), "b"] == 20
    assert largest_budget({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) == 61


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(1, 60), min_size=1, max_size=6),
    st.dictionaries(st.sampled_from("abcd"), st.tuples(st.integers(0, 90), st.integers(1, 3)), min_size=1),
)
def test_flow_is_the_largest_and_the_cheapest(patterns, wanted):
    quotas, repeats = {s: q for s, (q, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}
    total, flows = route(patterns, quotas, repeats)
    most = {p: t * min(repeats[s] for s in p if s in quotas) for p, t in patterns.items() if any(s in quotas for s in p)}
    subsets = [set(x) for k in range(len(quotas) + 1) for x in combinations(quotas, k)]
    assert total == min(sum(quotas[s] for s in quotas if s not in x) + sum(m for p, m in most.items() if x & set(p)) for x in subsets)
    used = {p: sum(x for (q, _), x in flows.items() if q == p) for p in most}
    assert sum(used.values()) == total and all(used[p] <= most[p] for p in used)
    once, _ = route(patterns, quotas, {s: 1 for s in quotas})
    assert sum(min(used[p], patterns[p]) for p in used) == once  # first uses go as far as they can
    shares = {s: 1 / len(quotas) for s in quotas if any(s in p for p in patterns)}
    if shares:
        size = largest_budget(patterns, shares, repeats)
        met = [route(patterns, {s: int(b * w) for s, w in shares.items()}, repeats)[0] == sum(int(b * w) for w in shares.values()) for b in (size, size + len(quotas))]
        assert met == [True, False]


def test_long_documents_at_the_end_of_a_stretch_are_made_up(spark):
    rows = [(i, f"text {i} " + "word " * (900 if i % 9 == 0 else 3 + i % 40), "ab"[i % 2]) for i in range(200)]
    targets = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = mix_sources(_docs(spark, rows), targets, budget=9_001)
    report = mix_report(got, targets).collect()
    assert all(abs(r.actual_share - 0.5) < 0.002 and r.most_uses <= r.max_repeats for r in report)


def test_mixes(spark):
    rows = [(i, f"word number {i} here", "a") for i in range(300)] + [(1000 + i, f"word number {i} here", "b") for i in range(60)]
    rows += [(2000 + i, f"other text {i} of c", "c") for i in range(20)] + [(2100, "other text 1 of c", "c"), (3000, None, "a"), (3001, "", "a"), (3002, "no source", None)]
    targets = spark.createDataFrame(
        [(1, "a", 0.5, 1, "x"), (1, "b", 0.25, 2, "x"), (1, "c", 0.25, 4, "x"), (2, "c", 0.5, 3, "x"), (2, "gone", 0.5, 1, "x"), (3, "gone", 1.0, 1, "x"), (4, None, 1.0, 1, "x")],
        "mix_id int, source string, target_share double, max_repeats int, doc_id string",
    )
    docs = _docs(spark, rows)
    got = mix_sources(docs, targets, slice_documents=30)
    again = mix_sources(docs.repartition(7), targets, slice_documents=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    report = {(r.mix_id, r.source): r for r in mix_report(got, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        assert abs(report[1, s].actual_share - share) < 0.03
    assert report[2, "c"].actual_share == 1.0 and report[2, "gone"].tokens == 0 and report[3, "gone"].tokens == 0
    text = {i: t for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    uses = defaultdict(int)
    for r in got.collect():
        assert source[r.doc_id] == r.source
        uses[r.mix_id, text[r.doc_id]] += r.uses
    assert max(u for (m, t), u in uses.items() if m == 1 and "word" in t) == 1
    assert max(u for (m, t), u in uses.items() if m == 2) == 3
    small = mix_report(mix_sources(docs, targets, budget=100), targets).where("mix_id = 1").collect()
    assert 80 <= sum(r.tokens for r in small) <= 120


def test_mixes_of_nothing(spark):
    targets = spark.createDataFrame([(1, "a", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    assert mix_sources(_docs(spark, []), targets).count() == 0
    assert mix_sources(_docs(spark, [(1, "t", "a")]), targets.limit(0)).count() == 0
