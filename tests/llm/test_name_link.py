import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm.minhash import band_hashes, collision, padded_qgrams, tune_bands
from factloom.llm.name_link import (
    FAMILY_SIMILARITY,
    JOINED_SIMILARITY,
    JOINED_TARGET,
    MOST_HASHES,
    PART_SIMILARITY,
    TARGET_RECALL,
    TARGET_SIMILARITY,
    WHOLE_HASHES,
    WHOLE_Q,
    WHOLE_RECALL,
    WHOLE_SIMILARITY,
    WHOLE_TARGET,
    Q,
    linked_slugs,
    monge_elkan,
    slug_classes,
    star_clusters,
    whole_name_stars,
    word_pairs,
)
from factloom.llm.name_words import KNOWN_GIVEN, parse_credit

SCHEMA = "slug string, author string, author_name string, text string, word string, weight int"


def links(spark, rows):
    df = spark.createDataFrame([(s, a, n, "x", "y", 1) for s, a, n in rows], SCHEMA)
    return {tuple(r) for r in linked_slugs(df).collect()}


def test_variants_link_and_namesakes_do_not(spark):
    groups = [
        ["Margaret Kelvonarski", "Peggy Kelvonarski", "KELVONARSKI Margaret", "Kelvonarski, Margaret L.", "Marraret Kelvonarski", "Margaret Kelvonraski", 'Margaret "Meg" Kelvonarski', "margaretkelvonarski", "Dr. Margaret Kelvonarski, M.Sc.", "M. Kelvonarski"],
        ["Bogdan Kelvonarski", "Bogdan  Kelvonarski (dev)", "bkelvonarski"],
        ["Kelvonarski Software GmbH", "Kelvonarski SW", "KelvonarskiSoftware", "Team Kelvonarski Software"],
        ["Turbenolix Web Solutions Ltd", "Turbenolix Web Soln.", "Web Solutions Turbenolix", "TURBENOLIX WEB SOLUTIONS", "Turben olix Web Solutions", "Turbennolix Web Solutions"],
        ["Turbenolix Media Group", "Turbenolix Media Grp, Incorporated"],
        ["Jörg Ånvik", "Joerg Anvik", "Anvik, Jörg"],
        ["Leo Tarkonnasen", "Leonnard Tarkonnasen"],
        ["B. Weskalotti", "bogdanweskalotti"],
    ]
    rows, want = [], set()
    for g, names in enumerate(groups):
        slugs = [f"s{g}-{i}" for i in range(len(names))]
        rows += [(s, f"<b>{n}</b>", n if i % 2 else None) for i, (s, n) in enumerate(zip(slugs, names))]
        want |= set(combinations(sorted(slugs), 2))
    rows += [(f"n{i}", n, n) for i, n in enumerate(["Anonymous", "anonymous", "n/a", "", "Plugin Author", "admin", "admin"])]
    rows += [("u1", "Turbenolix", "Turbenolix"), ("u2", None, None), (None, "Bogdan Kelvonarski", None)]
    rows += rows[:5]
    assert links(spark, rows) == want


def test_ambiguous_initial_links_nothing(spark):
    rows = [("a", None, "Maria Solvenga"), ("b", None, "Martin Solvenga"), ("c", None, "M. Solvenga"), ("d", None, "Solvenga, Maria K."), ("e", None, "M. K. Solvenga")]
    assert links(spark, rows) == {("a", "d"), ("a", "e"), ("d", "e")}


def test_nothing(spark):
    assert links(spark, []) == set()
    assert links(spark, [("a", None, "x" * 30_000), ("b", None, "x" * 30_000)]) == {("a", "b")}


def test_banding_reaches_its_recall():
    bands, rows = tune_bands(0.5, 0.95)
    assert collision(0.5, bands, rows) >= 0.95 and collision(0.1, bands, rows) < 0.05
    words = [f"w{i}ord{i * 7}name" for i in range(300)]
    swapped = [w[:3] + w[4] + w[3] + w[5:] for w in words]
    a, b = band_hashes(words, 3, bands, rows), band_hashes(swapped, 3, bands, rows)
    similarity = [len(x & y) / len(x | y) for x, y in zip(map(lambda w: padded_qgrams(w, 3), words), map(lambda w: padded_qgrams(w, 3), swapped))]
    hit = (a == b).any(axis=1)
    assert hit.mean() > np.mean([collision(s, bands, rows) for s in similarity]) - 0.06


def test_monge_elkan(spark):
    df = spark.createDataFrame([("anna berg", "berg anna"), ("anna berg", "anna bergs"), ("anna", "otto"), ("ab", "ba")], "a string, b string")
    got = [r.s for r in df.select(monge_elkan(F.split("a", " "), F.split("b", " ")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.9) and got[2] < 0.4 and got[3] == 0.5


def test_stars_do_not_chain(spark):
    nodes = spark.createDataFrame([("x", w, n) for w, n in (("a", 9), ("b", 5), ("c", 7), ("d", 1))], "space string, word string, weight int")
    pairs = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "d")], "space string, a string, b string")
    got = {(r.word, r.center) for r in star_clusters(nodes, pairs).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


@pytest.mark.parametrize("text", ["", " ", "&nbsp;", "<a></a>", "N/A", "The Author", "Your Name", "-", "123"])
def test_names_of_nobody(text):
    assert parse_credit(text) is None


@pytest.mark.parametrize(
    ("length", "rest", "q", "target", "recall"),
    [(4, 5, WHOLE_Q, WHOLE_TARGET, WHOLE_RECALL), (7, 0, Q, TARGET_SIMILARITY, TARGET_RECALL), (10, 0, Q, JOINED_TARGET, TARGET_RECALL)],
)
def test_bands_reach_the_shortest_accepted_swaps(length, rest, q, target, recall):
    rng = random.Random(5)
    words = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", length)) + (" " + "".join(rng.sample("klmnopqrstuvwxyz", rest)) if rest else "") for _ in range(600)]
    swapped = [w[:1] + w[2] + w[1] + w[3:] for w in words]
    bands, rows = tune_bands(target, recall, WHOLE_HASHES if rest else MOST_HASHES)
    a, b = band_hashes(words, q, bands, rows), band_hashes(swapped, q, bands, rows)
    assert (a == b).any(axis=1).mean() >= recall - 0.03


def test_whole_names_of_a_house(spark):
    rows = [("berg", "karoline", 5), ("berg", "karolnie", 1), ("berg", "marta", 2), ("berg", "marat", 9), ("berg", "otto", 1), ("talberg", "karolina", 1), ("berg", "anna", 1), ("berg", "hanna", 3)]
    stars = whole_name_stars(spark.createDataFrame(rows, "house string, name string, weight int"), KNOWN_GIVEN)
    assert {tuple(r) for r in stars.collect()} == {("berg", "karolnie", "karoline"), ("berg", "marta", "marat")}


def test_every_candidate_is_verified_whatever_its_edits(spark):
    words = [("s", "gabriela montenegro salvatierra", 2), ("s", "montenegro gabriela salvatierra", 2), ("s", "abcdefghijklmnopqrstuvwxyz", 2), ("s", "bacdefghjiklmnopqrstuvwxzy", 2), ("s", "otto", 2)]
    got = {frozenset((r.a, r.b)) for r in word_pairs(spark.createDataFrame(words, "space string, word string, side int"), 0.75).collect()}
    assert got == {frozenset(w[1] for w in words[:2]), frozenset(w[1] for w in words[2:4])}


def test_classes_hold_the_links_of_the_pairs(spark):
    rows = [(f"s{i}", None, n) for i, n in enumerate(["Maria Solvenga", "Solvenga, Maria", "MARIA SOLVENGA", "Otto Brandel", "Anonymous", None])] + [("s3", None, "Otto Brandel")]
    df = spark.createDataFrame([(s, a, n, "x", "y", 1) for s, a, n in rows], SCHEMA)
    assert {tuple(r) for r in slug_classes(df).collect()} == {("s0", "s0", 2), ("s1", "s0", 2), ("s2", "s0", 2), ("s3", "s3", 0)}
    assert slug_classes(df.limit(0)).count() == 0


def _slipped(rng, word, letters):
    """A word after one slip: a letter changed, dropped, added or moved, or two letters swapped, however far apart."""
    at, to, kind, w = rng.randrange(len(word)), rng.randrange(len(word)), rng.randrange(5), list(word)
    if kind == 0:
        w[at] = rng.choice(letters)
    elif kind == 1 and len(w) > 1:
        del w[at]
    elif kind == 2:
        w.insert(to, rng.choice(letters))
    elif kind == 3:
        w[at], w[to] = w[to], w[at]
    else:
        w.insert(to, w.pop(at))
    return "".join(w)


@pytest.mark.parametrize("least", [FAMILY_SIMILARITY, JOINED_SIMILARITY, 0.6])
def test_every_pair_that_is_similar_enough_is_found(spark, least):
    rng, words = random.Random(11), {}
    for i in range(260):
        letters = "ab" if i % 9 == 0 else "abcdefghijklmnopqrstuvwxyz"
        longest = (8, 16, 30, 70)[i % 4]
        parts = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range((1, 1, 1, 2, 3, 4)[i % 6])]
        other = list(parts)
        for _ in range(rng.randint(1, max(1, int((1 - least) * sum(map(len, other)))))):
            at = rng.randrange(len(other))
            other[at] = _slipped(rng, other[at], letters)
        rng.shuffle(other)
        words |= {(f"s{i % 5}", " ".join(parts)): rng.randrange(3), (f"s{i % 5}", " ".join(other)): rng.randrange(3)}
    df = spark.createDataFrame([(s, w, side) for (s, w), side in words.items()], "space string, word string, side int").repartition(4)
    a, b = (df.select("space", F.col("word").alias(c), F.col("side").alias(f"side_{c}")) for c in "ab")
    once = F.when(F.col("side_a") + F.col("side_b") == 4, F.col("a") < F.col("b")).otherwise((F.col("side_a") != 1) & (F.col("side_b") != 0))
    want = a.join(b, "space").where("a <> b").where(once).where(monge_elkan(F.split("a", " "), F.split("b", " ")) >= least)
    pair = lambda rows: {(r.space, frozenset((r.a, r.b))) for r in rows.collect()}
    assert pair(word_pairs(df, least)) == pair(want) and want.count() > 60


def test_every_pair_of_whole_names_is_found(spark):
    rng = random.Random(3)
    names = ["".join(rng.sample("abcdefghijklm", rng.randint(4, 11))) for _ in range(120)]
    rows = [(f"h{i} noq", n) for i, n in enumerate(names)] + [(f"h{i} noq", n[-1] + n[1:-1] + n[0]) for i, n in enumerate(names)]
    df = spark.createDataFrame([(h, f"{n} {h}", n, 2) for h, n in rows], "space string, word string, name string, side int")
    got = word_pairs(df, WHOLE_SIMILARITY, WHOLE_Q, WHOLE_TARGET, WHOLE_RECALL, WHOLE_HASHES, "name", PART_SIMILARITY)
    assert {r.space for r in got.collect()} == {h for h, _ in rows}
    stars = whole_name_stars(df.select(F.col("space").alias("house"), "name", F.lit(1).alias("weight")), [])
    assert {r.house for r in stars.collect()} == {h for h, _ in rows}


def test_a_slip_of_letters_far_apart_links(spark):
    rows = [("a", None, "Maria Kelvona"), ("b", None, "Maria Aelvonk"), ("c", None, "Otto Brindel"), ("d", None, "Otto Lrindeb")]
    assert links(spark, rows) == {("a", "b"), ("c", "d")}
