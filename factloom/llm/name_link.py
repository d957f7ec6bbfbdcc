"""Variant spellings of persons and organisations, linked to one entity.

Credits are parsed into parts once per distinct text. Names are compared as
distinct spellings, twice: first the family names and the first words of
organisations, then whole names. Each time MinHash banding over padded q-grams
and exact keys, which miss no pair, find candidates, Monge-Elkan similarity over the parts of a name verifies
them, and star clustering gives each spelling the one it stands for. Whole
names are those of persons (given name and family), of organisations (first
word and line of business) and names run together in one word. Short forms,
initials and bare first words stand for a whole name where only one fits;
this is done by joins and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.edit_keys import BOTH, INDEX, PROBE, with_keys
from factloom.llm.minhash import tune_bands, with_buckets
from factloom.llm.name_words import BUSINESS_LINES, FIELDS, KNOWN_GIVEN, parse_credit
from factloom.session import stage

#: Length of a q-gram.
Q = 3
#: A swap of neighbouring letters in a word of seven, the shortest that verification accepts, leaves this much of the
#: padded 3-grams; recall that banding must reach there.
TARGET_SIMILARITY, TARGET_RECALL = 5 / 13, 0.97
#: Of a whole name with a family of four letters or more, a swap in a given name of four leaves this much of the padded
#: 2-grams; longer names leave more.
WHOLE_Q, WHOLE_TARGET, WHOLE_RECALL = 2, 1 / 2, 0.97
#: Names run together are verified more strictly: a swap in a word of ten leaves 8 / 16.
JOINED_SIMILARITY, JOINED_TARGET = 0.9, 7 / 15
#: Most hashes of a word; fewer would take flatter curves and more chance candidates. Whole names meet within their house
#: only, where chance candidates are few, so few hashes do.
MOST_HASHES, WHOLE_HASHES = 640, 64
#: Least Monge-Elkan similarity of two spellings of a family name or first word: one slip in seven letters or two in thirteen.
FAMILY_SIMILARITY = 0.835
#: Least similarity of the part that differs most in two whole names of one family: one slip in four letters.
PART_SIMILARITY = 0.74
#: Least Monge-Elkan similarity of two whole names of one family: of two parts one may have that slip.
WHOLE_SIMILARITY = (1 + PART_SIMILARITY) / 2

_MENTION = "kind string, family string, given string, alternatives array<string>, middle string, line string, joined string"


def monge_elkan(a: Column, b: Column) -> Column:
    """Symmetric Monge-Elkan similarity of two arrays of tokens.

    The inner similarity is 1 - edits / longer length, where a swap of
    neighbouring letters is one edit. Empty against anything is 0.
    """

    def inner(x: Column, y: Column) -> Column:
        edits = F.levenshtein(x, y)
        swap = (edits == 2) & (F.length(x) == F.length(y)) & (
            F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))
        )
        return 1 - F.when(swap, 1).otherwise(edits) / F.greatest(F.length(x), F.length(y))

    def one_way(p: Column, r: Column) -> Column:
        best = F.transform(p, lambda x: F.array_max(F.transform(r, lambda y: inner(x, y))))
        return F.aggregate(best, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / F.size(p)

    return F.coalesce(F.least(one_way(a, b), one_way(b, a)), F.lit(0.0))


def word_pairs(
    words: DataFrame,
    least: float,
    q: int = Q,
    target: float = TARGET_SIMILARITY,
    recall: float = TARGET_RECALL,
    most_hashes: int = MOST_HASHES,
    own: str = "word",
    own_least: float | None = None,
) -> DataFrame:
    """All pairs (space, a, b) of different words of one space that are similar enough, each verified.

    ``words``: space, word, side; a pair needs a left word of side 0 or 2 and
    a right one of side 1 or 2, and is given once where both may be either.
    Parts of a word are told by blanks. Candidates share a band, or one of the
    exact keys of ``edit_keys``: banding finds a pair by chance, and seldom
    where edits lie far apart, the keys find every pair. Where the caller
    wants a column ``own`` of the words to be similar by itself, by
    ``own_least``, the keys are made of that. Every candidate is verified; one of
    two single parts with more than twice the edits that the similarity
    allows (a swap is two plain ones) can't be similar enough and is left out
    before. A bucket that holds many words is split by
    the join's skew handling, as what follows needs a shuffle of its own.
    """
    bands, rows = tune_bands(target, recall, most_hashes)
    numbered = words.select("space", "word", F.xxhash64("space", "word").alias("id"), "side")
    keyed = words.select("space", F.col(own).alias("word"), F.xxhash64("space", "word").alias("id"), "side")
    buckets = with_buckets(numbered, q, bands, rows).withColumn("role", F.lit(BOTH).cast("tinyint")).unionByName(
        with_keys(keyed, least if own_least is None else own_least)
    )
    # Both sides come from one exchange: the test of the sides needs both of them, so that it can't move below the join.
    left = buckets.select("bucket", F.col("id").alias("id_a"), F.col("side").alias("side_a"), F.col("role").alias("role_a"))
    right = buckets.select("bucket", F.col("id").alias("id_b"), F.col("side").alias("side_b"), F.col("role").alias("role_b"))
    meets = lambda a, b: (F.col(a).bitwiseAND(INDEX) > 0) & (F.col(b).bitwiseAND(PROBE) > 0)
    roles = meets("role_a", "role_b") | meets("role_b", "role_a")
    sides = F.col("side_a") * 3 + F.col("side_b")
    once = F.when(sides == 8, F.col("id_a") < F.col("id_b")).otherwise(sides.isin(1, 2, 7))
    # Sizes of what Python makes are guessed from its input: a hint, lest the buckets be broadcast.
    pairs = left.join(right.hint("merge"), "bucket").where(once & roles).select("id_a", "id_b").distinct()
    longer = F.greatest(F.length("a"), F.length("b"))
    far = F.levenshtein("a", "b") > F.lit(2 * (1 - least)) * longer + 1e-9
    single = ~F.contains("a", F.lit(" ")) & ~F.contains("b", F.lit(" "))
    return (
        pairs.join(numbered.select(F.col("id").alias("id_a"), F.col("word").alias("a"), "space").hint("merge"), "id_a")
        .join(numbered.select(F.col("id").alias("id_b"), F.col("word").alias("b")).hint("merge"), "id_b")
        .where(~(single & far))
        .where((F.col("a") == F.col("b")) | (monge_elkan(F.split("a", " "), F.split("b", " ")) >= least))
        .select("space", "a", "b")
        .distinct()
    )


def star_clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Star clustering: (space, word, center) for the words that have a pair.

    ``nodes``: space, word, weight; ``pairs``: space, a, b. In each round a
    word that outranks all its undecided neighbours (weight, then the word)
    becomes a center and takes them; the best center wins. A center is no
    other's satellite, and two satellites are linked through their center
    only. Rounds end when no pair of undecided words is left; each round
    decides at least the best word of every component.
    """
    rank = F.struct(F.col("weight"), F.col("word"))
    ranked = nodes.select("space", "word", rank.alias("rank"))
    both = pairs.select("space", F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select("space", F.col("b").alias("word"), F.col("a").alias("other"))
    ).where(F.col("word") != F.col("other"))
    edges = stage(
        both.join(ranked, ["space", "word"])
        .join(ranked.select("space", F.col("word").alias("other"), F.col("rank").alias("other_rank")), ["space", "other"]),
        "star-edges",
    )
    done = None
    while not edges.isEmpty():
        best = edges.groupBy("space", "word", "rank").agg(F.max("other_rank").alias("best"))
        centers = best.where(F.col("rank") > F.col("best")).select("space", F.col("word").alias("center"), "rank")
        taken = (
            edges.join(centers.select("space", F.col("center").alias("other")), ["space", "other"], "left_semi")
            .groupBy("space", "word")
            .agg(F.max("other_rank").getField("word").alias("center"))
        )
        decided = stage(taken.unionByName(centers.select("space", F.col("center").alias("word"), "center")), "star-round")
        done = decided if done is None else done.unionByName(decided)
        gone = decided.select("space", "word")
        edges = stage(
            edges.join(gone, ["space", "word"], "left_anti").join(
                gone.select("space", F.col("word").alias("other")), ["space", "other"], "left_anti"
            ),
            "star-edges",
        )
    return stage(done, "stars") if done is not None else nodes.select("space", "word", F.col("word").alias("center")).limit(0)


def whole_name_stars(names: DataFrame, known: list[str]) -> DataFrame:
    """(house, name, center) of names that stand for another one of their house, by whole names.

    ``names``: house, name, weight. A whole name is a name and its house; whole
    names of one house are candidates by MinHash banding and keys, verified by
    Monge-Elkan over their parts, where the part that differs most must be
    similar enough by itself. Two names that are both in ``known`` are two,
    however alike. Star clustering by weight names the center.
    """
    whole = F.concat_ws(" ", "name", "house")
    several = names.groupBy("house").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("house")
    nodes = stage(names.join(several, "house", "left_semi").select("house", "name", "weight", whole.alias("word")), "whole-names")
    pairs = word_pairs(
        nodes.select(F.col("house").alias("space"), "word", "name", F.lit(2).alias("side")),
        WHOLE_SIMILARITY, WHOLE_Q, WHOLE_TARGET, WHOLE_RECALL, WHOLE_HASHES, "name", PART_SIMILARITY,
    )
    cut = lambda c: F.expr(f"substring({c}, 1, length({c}) - length(space) - 1)")
    listed = F.array(*map(F.lit, known))
    pairs = pairs.select("space", cut("a").alias("a"), cut("b").alias("b"))
    pairs = pairs.where(monge_elkan(F.split("a", " "), F.split("b", " ")) >= PART_SIMILARITY)
    pairs = pairs.where(~(F.array_contains(listed, F.col("a")) & F.array_contains(listed, F.col("b"))))
    stars = star_clusters(nodes.select(F.col("house").alias("space"), F.col("name").alias("word"), "weight"), stage(pairs, "whole-pairs"))
    return stars.select(F.col("space").alias("house"), F.col("word").alias("name"), "center").where(F.col("name") != F.col("center"))


def parse_credits(texts: DataFrame) -> DataFrame:
    """Distinct credits (text) with their parts; credits that name nobody are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [(t, p) for t in batch["text"] if (p := parse_credit(t))]
            yield pd.DataFrame([(t, *p) for t, p in parsed], columns=["text", *FIELDS])

    return texts.mapInPandas(run, "text string, " + _MENTION)


def credit_entities(credits: DataFrame) -> DataFrame:
    """(text, entity) for each distinct credit that names somebody.

    ``credits``: text, weight. Initials that fit two persons of a family, and
    a bare first word that two organisations share, are left on their own:
    they have no entity.
    """
    mentions = stage(parse_credits(credits.select("text")).join(credits, "text"), "mentions")
    person, org, bare = (mentions.where(F.col("kind") == k) for k in ("person", "org", "bare"))
    handle = mentions.where(F.col("kind") == "handle")

    # A lower-case word that is a given name and a family name of other credits, in one way only, is a person.
    cut = handle.select("*", F.explode(F.sequence(F.lit(3), F.greatest(F.length("family") - 3, F.lit(3)))).alias("at"))
    cut = cut.select("text", F.expr("substring(family, 1, at)").alias("given"), F.expr("substring(family, at + 1)").alias("family"))
    names = person.where(F.length("given") > 1).groupBy("given").agg(F.max("alternatives").alias("alternatives"))
    apart = cut.join(person.select("family").distinct(), "family", "left_semi").join(names, "given")
    one_way = apart.groupBy("text").agg(F.count(F.lit(1)).alias("ways")).where("ways = 1").select("text")
    taken = apart.join(one_way, "text").join(handle.select("text", "kind", "middle", "line", "joined", "weight"), "text")
    person = stage(person.unionByName(taken.select(*person.columns)), "persons")
    single = bare.unionByName(handle.join(one_way, "text", "left_anti"))

    # Families: distinct spellings, by what kind of name they are.
    def counted(rows: DataFrame, space: str, column: str, side: int) -> DataFrame:
        return rows.groupBy(F.col(column).alias("word")).agg(F.sum("weight").alias("weight")).select(
            F.lit(space).alias("space"), "word", "weight", F.lit(side).alias("side")
        )

    # A single word may be a slip of an organisation's first word, but two single words are not compared.
    words = stage(
        counted(person, "person", "family", 2)
        .unionByName(counted(org, "org", "family", 2))
        .unionByName(counted(bare, "org", "family", 0))
        .groupBy("space", "word")
        .agg(F.sum("weight").alias("weight"), F.max("side").alias("side")),
        "words",
    )
    pairs = stage(word_pairs(words, FAMILY_SIMILARITY), "word-pairs")
    centers = star_clusters(words, pairs)

    def family_of(rows: DataFrame, space: str) -> DataFrame:
        own = centers.where(F.col("space") == space).select(F.col("word").alias("family"), "center")
        return rows.join(own, "family", "left").withColumn("house", F.coalesce("center", "family")).drop("center")

    # Persons with a full given name: short forms stand for the formal name that their family has, else for the first.
    # Tables are cut here and below, so that no plan holds another one many times over.
    persons = stage(family_of(person, "person"), "persons-house")
    full = persons.where(F.length("given") > 1)
    literal = full.groupBy("house", "given").agg(F.sum("weight").alias("weight"))
    present = literal.select("house", F.col("given").alias("formal"))
    options = full.where(F.size("alternatives") > 0).select("house", "given", F.posexplode("alternatives").alias("at", "formal")).distinct()
    chosen = (
        options.join(present.withColumn("here", F.lit(1)), ["house", "formal"], "left")
        .groupBy("house", "given")
        .agg(F.min_by("formal", F.struct(F.coalesce(-F.col("here"), F.lit(0)), "at")).alias("formal"))
    )
    given = (
        literal.join(chosen, ["house", "given"], "left")
        .withColumn("name", F.coalesce("formal", "given"))
        .select("house", "given", "name", "weight")
    )
    given = stage(given, "given-names")
    given = stage(
        given.select("house", "given", F.col("name").alias("said"))
        .join(whole_name_stars(given.groupBy("house", "name").agg(F.sum("weight").alias("weight")), KNOWN_GIVEN).withColumnRenamed("name", "said"), ["house", "said"], "left")
        .select("house", "given", F.coalesce("center", "said").alias("name")),
        "given",
    )
    full = full.join(given, ["house", "given"]).select("text", "house", "middle", "joined", "name", "weight")
    full = stage(full.withColumn("entity", F.concat_ws("|", F.lit("p"), "house", "name")), "persons-full")

    # Initials: the one person of the family that they fit; a middle initial may decide.
    people = full.groupBy("house", "name").agg(F.collect_set("middle").alias("middles")).withColumn("initial", F.substring("name", 1, 1))
    initials = persons.where(F.length("given") == 1).select(
        "text", "house", F.col("given").alias("initial"), F.coalesce("middle", F.lit("")).alias("middle")
    )
    has_middle, said = F.col("middle") != "", F.array_contains("middles", F.col("middle"))
    fits = (
        initials.select("house", "initial", "middle")
        .distinct()
        .join(people, ["house", "initial"])
        .withColumn("agrees", has_middle & said)
        .withColumn("differs", has_middle & (F.size("middles") > 0) & ~said)
        .groupBy("house", "initial", "middle")
        .agg(
            F.count_if(~F.col("differs")).alias("n"),
            F.count_if("agrees").alias("n_agree"),
            F.min(F.when(F.col("agrees"), F.col("name"))).alias("agreed"),
            F.min(F.when(~F.col("differs"), F.col("name"))).alias("only"),
        )
        .select(
            "house",
            "initial",
            "middle",
            F.lit(True).alias("has"),
            F.when(F.col("n_agree") == 1, F.col("agreed"))
            .when((F.col("n") == 1) & (F.col("n_agree") == 0), F.col("only"))
            .alias("name"),
        )
    )
    named = stage(initials.join(fits, ["house", "initial", "middle"], "left").select(
        "text",
        F.when(F.col("name").isNotNull(), F.concat_ws("|", F.lit("p"), "house", "name"))
        .when(F.col("has").isNull(), F.concat_ws("|", F.lit("i"), "house", "initial"))
        .alias("entity"),
    ), "initials")

    # Organisations: the line of business tells them apart.
    orgs = stage(family_of(org, "org"), "orgs-house")
    business = orgs.where(F.col("line") != "").groupBy("house", F.col("line").alias("name")).agg(F.sum("weight").alias("weight"))
    lined = whole_name_stars(business, sorted({*BUSINESS_LINES})).withColumnsRenamed({"name": "line", "center": "right_line"})
    orgs = orgs.join(lined, ["house", "line"], "left").withColumn("line", F.coalesce("right_line", "line")).drop("right_line")
    orgs = stage(orgs.withColumn("entity", F.concat_ws("|", F.lit("o"), "house", "line")), "orgs")
    lines = stage(
        orgs.where(F.col("line") != "").groupBy("house").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")), "lines"
    )

    def by_house(rows: DataFrame) -> DataFrame:
        return rows.join(lines, "house", "left").withColumn(
            "entity",
            F.when(F.col("lo").isNull(), F.concat_ws("|", F.lit("o"), F.col("house"), F.lit("")))
            .when(F.col("lo") == F.col("hi"), F.col("lo")),
        )

    whole = orgs.where(F.col("line") != "").select("text", "entity")
    lineless = by_house(orgs.where(F.col("line") == "").select("text", "house")).select("text", "entity")

    # Single words: a person's name run together, else an organisation's first word.
    handles = single.select(F.lit("joined").alias("space"), F.col("joined").alias("word")).distinct()
    solid = F.replace("house", F.lit(" "), F.lit(""))
    forms = F.array("joined", F.concat("name", solid), F.concat(F.substring("name", 1, 1), solid))
    together = full.select(F.lit("joined").alias("space"), F.explode(forms).alias("word"), "entity").unionByName(
        named.where(F.col("entity").startswith("i|"))
        .join(persons.select("text", "joined"), "text")
        .select(F.lit("joined").alias("space"), F.col("joined").alias("word"), "entity")
    ).distinct()
    together = stage(together, "together")
    either = stage(
        handles.withColumn("side", F.lit(0)).unionByName(together.select("space", "word").distinct().withColumn("side", F.lit(1))),
        "joined-words",
    )
    run_together = (
        stage(word_pairs(either, JOINED_SIMILARITY, target=JOINED_TARGET), "joined-pairs")
        .join(together.select(F.col("word").alias("b"), "entity"), "b")
        .withColumn("exact", F.col("a") == F.col("b"))
        .groupBy(F.col("a").alias("joined"))
        .agg(
            F.count_distinct(F.when(F.col("exact"), F.col("entity"))).alias("n_exact"),
            F.min(F.when(F.col("exact"), F.col("entity"))).alias("exact_entity"),
            F.count_distinct("entity").alias("n"),
            F.min("entity").alias("any_entity"),
        )
        .select(
            "joined",
            F.when(F.col("n_exact") == 1, F.col("exact_entity"))
            .when((F.col("n") == 1) & (F.col("n_exact") == 0), F.col("any_entity"))
            .alias("person_entity"),
        )
    )
    alone = (
        by_house(family_of(single, "org").select("text", "house", "joined"))
        .join(run_together, "joined", "left")
        .select("text", F.coalesce("person_entity", "entity").alias("entity"))
    )
    return (
        full.select("text", "entity").unionByName(named).unionByName(whole).unionByName(lineless).unionByName(alone)
        .where(F.col("entity").isNotNull())
    )


def slug_entities(plugins: DataFrame) -> DataFrame:
    """(slug, entity) for each slug whose credit names somebody.

    The credit is author_name or, where that is null, the text of author. Null
    slugs and slugs without a credit are left out; repeated rows count once.
    """
    credit = plugins.select("slug", F.coalesce("author_name", "author").alias("text")).where(
        F.col("slug").isNotNull() & F.col("text").isNotNull()
    ).distinct()
    credits = stage(credit, "credits")
    weights = credits.groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    return credits.join(credit_entities(weights), "text").select("slug", "entity").distinct()


def linked_slugs(plugins: DataFrame) -> DataFrame:
    """Pairs slug_a < slug_b that are credited to one entity."""
    linked = stage(slug_entities(plugins), "slug-entities")
    a = linked.select("entity", F.col("slug").alias("slug_a"))
    b = linked.select("entity", F.col("slug").alias("slug_b"))
    return a.join(b, "entity").where(F.col("slug_a") < F.col("slug_b")).select("slug_a", "slug_b").distinct()


def slug_classes(plugins: DataFrame) -> DataFrame:
    """(slug, class_id, n_links): a row for each credited slug, its class told by the smallest slug, and its number of links.

    The same links as ``linked_slugs``, without the pairs: a class of any size
    is counted, not joined with itself.
    """
    linked = stage(slug_entities(plugins), "slug-entities")
    classes = linked.groupBy("entity").agg(F.min("slug").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return linked.join(classes, "entity").select("slug", "class_id", "n_links")
