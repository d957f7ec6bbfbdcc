"""Mixes of sources at target weights, by min-cost flow over membership patterns.

A text may stand under several sources. Texts are aggregated by their pattern,
the set of sources that hold them; the tokens of each pattern flow to source
quotas, a first use free and each further use dearer than the one before. The
flow network has a node for each pattern and source, whatever the number of
documents. The flows are then laid over each pattern's documents in a seeded
order, and what is missing or over at the ends of a stretch, where a document
is taken whole or not at all, is made up by single documents.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tokens import VOCABULARY, with_tokens
from factloom.session import stage

#: Most membership patterns of all mixes; beyond it the network is refused rather than cut. k sources make at most 2^k - 1.
MAX_PATTERNS = 50_000
#: Documents of one slice of the seeded order.
SLICE_DOCUMENTS = 2_000
#: Passes that take a document out of stretches with too much, and that add one to those with too little.
DROPS, FILLS = 1, 2
#: Largest texts that fit a gap, of which a pass takes one after the other.
CANDIDATES = 32


class Flow:
    """Largest flow through layers, by level graphs; room may be added between runs."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = defaultdict(list)
        self.to: list[object] = []
        self.room: list[int] = []

    def arc(self, a: object, b: object, capacity: int) -> int:
        for x, y, room in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc + 1]

    def levels(self, source: object) -> dict[object, int]:
        """Distance of every node that ``source`` still reaches."""
        far, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and self.to[e] not in far:
                    far[self.to[e]] = far[x] + 1
                    queue.append(self.to[e])
        return far

    def run(self, source: object, sink: object) -> int:
        total = 0
        while sink in (far := self.levels(source)):
            at = {x: 0 for x in far}
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    total += amount
                    cut = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs = self.out[x]
                while at[x] < len(arcs) and not (
                    self.room[arcs[at[x]]] > 0 and far.get(self.to[arcs[at[x]]], -1) == far[x] + 1
                ):
                    at[x] += 1
                if at[x] < len(arcs):
                    path.append(arcs[at[x]])
                    x = self.to[arcs[at[x]]]
                elif x == source:
                    break
                else:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    at[x] += 1
        return total


def _network(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[Flow, dict, dict]:
    """The network, its arcs into patterns with their tokens and most uses, and its arcs from patterns to sources."""
    net, into, across = Flow(), {}, {}
    for pattern, tokens in sorted(patterns.items()):
        own = [s for s in pattern if s in quotas]
        if own and tokens > 0:
            into[pattern] = (net.arc("from", ("pattern", pattern), 0), tokens, min(repeats[s] for s in own))
            for s in own:
                across[pattern, s] = net.arc(("pattern", pattern), ("source", s), tokens * repeats[s])
    for s, quota in sorted(quotas.items()):
        net.arc(("source", s), "to", quota)
    return net, into, across


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict]:
    """(total, {(pattern, source): tokens}) of a cheapest largest flow into the quotas.

    A pattern gives its tokens as often as its strictest source in the mix
    allows; the k-th use costs k - 1, so unused texts go before used ones.
    Only the arcs into patterns cost anything, and a cheapest path has one of
    them: so the flow is cheapest if it's the largest with one use first, then
    with two, and so on.
    """
    net, into, across = _network(patterns, quotas, repeats)
    total = 0
    for use in range(1, max((most for _, _, most in into.values()), default=0) + 1):
        for arc, tokens, most in into.values():
            if use <= most:
                net.room[arc] += tokens
        total += net.run("from", "to")
    return total, {k: net.used(e) for k, e in across.items() if net.used(e)}


def largest_budget(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The most tokens at which every source that has texts still gets its share.

    A budget that is too large leaves a least cut; the cut gives the budget at
    which it just doesn't bind. After few such steps no cut binds, and what is
    left is the rounding of the quotas, found by halving.
    """

    def quotas(size: float) -> dict[str, int]:
        return {s: int(size * w) for s, w in shares.items()}

    def solve(size: float) -> tuple[bool, Flow, dict]:
        wanted = quotas(size)
        net, into, _ = _network(patterns, wanted, repeats)
        for arc, tokens, most in into.values():
            net.room[arc] += tokens * most
        return net.run("from", "to") == sum(wanted.values()), net, into

    high = sum(t * max(repeats[s] for s in p if s in repeats) for p, t in patterns.items() if any(s in repeats for s in p))
    size = int(high / max(1e-12, sum(shares.values()))) + 1
    while True:
        enough, net, into = solve(size)
        if enough:
            break
        near = net.levels("from")
        supply = sum(tokens * most for p, (_, tokens, most) in into.items() if ("pattern", p) not in near)
        supply += sum(net.room[e] + net.room[e ^ 1] for x in near if x[0] == "pattern" for e in net.out[x] if e % 2 == 0 and net.to[e] not in near)
        held = sum(w for s, w in shares.items() if ("source", s) not in near)
        size = min(size - 1, int(supply / held)) if held > 0 else size - 1
        if size <= 0:
            return 0
    low, high = size, size + int(1 / min(w for w in shares.values() if w > 0)) + 1
    while low < high:
        middle = (low + high + 1) // 2
        if solve(middle)[0]:
            low = middle
        else:
            high = middle - 1
    return low


def _distinct_texts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each distinct text: its sources, and for each the smallest doc_id; combined before the shuffle."""
    sized = with_tokens(
        documents.where((F.col("text") != "") & F.col("source").isNotNull()).select("doc_id", "source", "text", F.md5("text").alias("text_key")),
        path=vocabulary,
    ).where(F.col("n_tokens") > 0)
    by_source = sized.groupBy("text_key", "n_tokens", "source").agg(F.min("doc_id").alias("doc_id"))
    return stage(
        by_source.groupBy("text_key", "n_tokens").agg(
            F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members")
        ),
        "distinct-texts",
    )


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    budget: int | None = None,
    seed: int = 17,
    vocabulary: str = VOCABULARY,
    slice_documents: int = SLICE_DOCUMENTS,
) -> DataFrame:
    """Documents of each mix: mix_id, source, doc_id, uses, n_tokens.

    ``targets``: mix_id, source, target_share, max_repeats (small and fixed;
    collected and refused beyond 10,000 rows; null or non-positive shares and
    repeats are none). The size of a mix is ``budget`` tokens, by default the
    most at which every source that has texts gets its share; a source without
    texts gets nothing and its share stays open. With a larger budget sources
    give what they can. Texts that are equal are one document, whatever their
    doc_ids: used as often as the strictest of its sources in the mix allows,
    in all, and given under the smallest doc_id of the source it is used for.
    Null and empty texts and texts without a source are left out. An empty
    table gives no rows.
    """
    plan = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).distinct().limit(10_001).collect()
    if len(plan) > 10_000:
        raise ValueError("more than 10,000 targets")
    spark = documents.sparkSession
    schema = "mix_id int, source string, doc_id bigint, uses bigint, n_tokens bigint"
    mixes = {m: {r.source: r for r in plan if r.mix_id == m} for m in sorted({r.mix_id for r in plan})}
    if not mixes:
        return spark.createDataFrame([], schema)
    sources = F.transform("members", lambda m: m.getField("source"))

    def pattern(own: dict):
        return F.filter(sources, lambda s: s.isin(list(own)))

    each = F.array(*(F.struct(F.lit(m).alias("mix_id"), pattern(own).alias("pattern")) for m, own in mixes.items()))
    texts = _distinct_texts(documents, vocabulary)
    held = texts.select("*", F.explode(each).alias("m")).select("members", "text_key", "n_tokens", "m.*").where(F.size("pattern") > 0)
    sums = held.groupBy("mix_id", "pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    # Each pattern's uses lie on a line: use r of a text has its middle at r x all tokens + its place; sources own stretches of it.
    rows = []
    for mix, own in mixes.items():
        patterns = {tuple(r.pattern): r.tokens for r in sums if r.mix_id == mix}
        present = {s for p in patterns for s in p}
        shares = {s: own[s].target_share for s in own if s in present}
        repeats = {s: own[s].max_repeats for s in shares}
        if not shares:
            continue
        size = budget if budget is not None else largest_budget(patterns, shares, repeats)
        _, flows = route(patterns, {s: int(size * w) for s, w in shares.items()}, repeats)
        for p, tokens in patterns.items():
            at, stretches = 0, []
            for s in p:
                if amount := flows.get((p, s), 0):
                    stretches.append((s, at, at + amount))
                    at += amount
            if stretches:
                rows.append((mix, list(p), tokens, min(repeats[s] for s in p), stretches))
    if not rows:
        return spark.createDataFrame([], schema)
    # At most a row for each pattern of a mix, so never more than MAX_PATTERNS.
    wanted = spark.createDataFrame(
        rows, "mix_id int, pattern array<string>, all_tokens bigint, most bigint, stretches array<struct<source:string,low:bigint,high:bigint>>"
    )
    slices = max(1, min(65_536, sum(r.n for r in sums) // slice_documents))
    placed = held.join(F.broadcast(wanted), ["mix_id", "pattern"]).withColumn(
        "slice", F.pmod(F.xxhash64("text_key", F.col("mix_id") + F.lit(seed)), F.lit(slices))
    )
    line = ["mix_id", "pattern"]
    in_slice = Window.partitionBy(*line, "slice").orderBy(F.xxhash64("text_key", F.lit(seed)), "text_key")
    by_slice = placed.groupBy(*line, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    before = by_slice.withColumn(
        "before", F.sum("slice_tokens").over(Window.partitionBy(*line).orderBy("slice")) - F.col("slice_tokens")
    ).select(*line, "slice", "before")
    placed = (
        placed.withColumn("within", F.sum("n_tokens").over(in_slice) - F.col("n_tokens"))
        .join(before, [*line, "slice"])
        .withColumn("place", F.col("before") + F.col("within") + F.col("n_tokens") / 2)
    )

    def uses_in(s):  # uses r with low <= r x all + place < high
        first = F.ceil((s.getField("low") - F.col("place")) / F.col("all_tokens"))
        after = F.ceil((s.getField("high") - F.col("place")) / F.col("all_tokens"))
        uses = (F.greatest(after, F.lit(0)) - F.greatest(first, F.lit(0))).cast("bigint")
        return F.struct(s.getField("source").alias("source"), uses.alias("uses"))

    placed = stage(
        placed.select(*line, "text_key", "n_tokens", "members", "most", F.transform("stretches", uses_in).alias("parts")), "mix-places"
    )
    chosen = _exchange(placed, {(m, tuple(p), s): high - low for m, p, _, _, st in rows for s, low, high in st}, seed)
    member = F.element_at(F.filter("members", lambda m: m.getField("source") == F.col("source")), 1)
    return (
        chosen.where(F.col("uses") > 0)
        .select("mix_id", "source", member.getField("doc_id").alias("doc_id"), "uses", "n_tokens")
    )


def _exchange(placed: DataFrame, quotas: dict[tuple, int], seed: int) -> DataFrame:
    """(placed columns, source, uses): uses of texts, with the ends of the stretches made up.

    A stretch with more tokens than its quota gives back a use of the largest
    of its texts that fit what is over; then one with fewer takes, pass by
    pass, one more use of the largest texts of its pattern that fit what is
    missing and have uses left. A pass changes at most ``CANDIDATES`` texts of
    a stretch, so changes are bounded by the stretches and are broadcast.
    """
    spark = placed.sparkSession
    line = ["mix_id", "pattern"]
    changes: dict[tuple, int] = defaultdict(int)

    def changed() -> DataFrame:
        rows = [(m, k, s, d) for (m, k, s), d in changes.items()]
        table = spark.createDataFrame(rows, "mix_id int, text_key string, __source string, __delta bigint")
        table = table.groupBy("mix_id", "text_key").agg(
            F.map_from_entries(F.collect_list(F.struct("__source", "__delta"))).alias("__deltas")
        )
        joined = placed.join(F.broadcast(table), ["mix_id", "text_key"], "left")
        plus = lambda p: F.struct(
            p.getField("source").alias("source"),
            (p.getField("uses") + F.coalesce(F.try_element_at("__deltas", p.getField("source")), F.lit(0))).alias("uses"),
        )
        return joined.withColumn("parts", F.transform("parts", plus)).drop("__deltas")

    for turn in range(DROPS + FILLS):
        now = changed()
        parts = now.select(*line, "n_tokens", F.explode("parts").alias("p"))
        got = {
            (r.mix_id, tuple(r.pattern), r.source): r.tokens
            for r in parts.groupBy(*line, F.col("p.source").alias("source")).agg(F.sum(F.col("p.uses") * F.col("n_tokens")).alias("tokens")).collect()
        }
        gaps = {k: q - got.get(k, 0) for k, q in quotas.items()}
        drop = turn < DROPS
        open_ = [(m, list(p), s, abs(g)) for (m, p, s), g in gaps.items() if (g < 0 if drop else g > 0)]
        if not open_:
            continue
        table = spark.createDataFrame(open_, "mix_id int, pattern array<string>, source string, gap bigint")
        used = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p.getField("uses"))
        own = F.element_at(F.filter("parts", lambda p: p.getField("source") == F.col("source")), 1).getField("uses")
        fits = now.join(F.broadcast(table), line).where(F.col("n_tokens") <= F.col("gap"))
        fits = fits.where(own > 0) if drop else fits.where(used < F.col("most"))
        order = Window.partitionBy(*line, "source").orderBy(F.desc("n_tokens"), F.xxhash64("text_key", F.lit(seed)), "text_key")
        largest = fits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= CANDIDATES)
        left, taken = {k: abs(g) for k, g in gaps.items()}, set()
        for r in sorted(
            largest.select(*line, "source", "gap", "nth", "n_tokens", "text_key").collect(),
            key=lambda r: (-r.gap, r.mix_id, r.pattern, r.source, r.nth),
        ):
            stretch = (r.mix_id, tuple(r.pattern), r.source)
            if (r.mix_id, r.text_key) not in taken and r.n_tokens <= left[stretch]:  # a text may have one use left only
                taken.add((r.mix_id, r.text_key))
                left[stretch] -= r.n_tokens
                changes[r.mix_id, r.text_key, r.source] += -1 if drop else 1
    return changed().select("*", F.explode("parts").alias("p")).select("mix_id", "members", "n_tokens", "p.source", "p.uses")


def mix_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every source of a mix; sources that gave nothing have 0."""
    by_source = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"),
        F.count(F.lit(1)).alias("n_documents"),
        F.max("uses").alias("most_uses"),
    )
    total = by_source.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    return (
        targets.select("mix_id", "source", "target_share", "max_repeats")
        .distinct()
        .join(by_source, ["mix_id", "source"], "left")
        .join(total, "mix_id", "left")
        .select(
            "mix_id",
            "source",
            "target_share",
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            "max_repeats",
        )
    )
