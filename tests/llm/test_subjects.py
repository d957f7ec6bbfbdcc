import math
import random

from factloom.llm.subjects import FUNCTIONS, decode, document_subjects, learn_accuracies, paragraphs_of, parse, parsed

TERMS = {
    "boats": "anchor rope|harbour light|sail cloth|keel bolt|tiller arm|mast step".split("|"),
    "bread": "rye dough|oven stone|yeast jar|crust knife|flour sack|proofing basket".split("|"),
    "birds": "nest box|wing feather|beak ring|seed tray|owl call|heron pond".split("|"),
}
FRAMES = ["A shortcode prints the {} here.", "My {} shows twice today.", "Version two keeps one {} for all.", "We miss a better {} now."]


def block(rng, subject, n=4):
    return " ".join(rng.choice(FRAMES).format(rng.choice(TERMS[subject])) for _ in range(n))


def test_parse_reads_blocks():
    text = "=== Title Words ===\n\nOne. Two!\n- item a\n- item b\n\n```php\n$x = render_oven_stone();\n```\n`get_rye_dough`, `get_yeast_jar`\n<h2>3</h2><pre>code</pre>"
    paragraphs, headings = parse(text)
    assert headings[0] == "Title Words"
    assert paragraphs == [["One.", "Two!"], ["- item a", "- item b"], ["rye dough", "yeast jar"]]


def test_parsed_table_holds_what_parse_gives(spark):
    texts = ["# A head\n\nOne. Two!\n- item a\n- item b\n\nThree.", "\x1d odd \x1e signs", "```\ncode\n```", "x" * 30_000]
    rows = parsed(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        paragraphs, headings = parse(texts[r.doc_id].replace("\x1d", " ").replace("\x1e", " "))
        assert paragraphs_of(r.body) == paragraphs and [h for h in r.headings.split("\x1e") if h] == headings


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(6)
    names = sorted(TERMS)
    docs, truth = [], {}
    for i in range(600):
        own = rng.sample(names, rng.choice([1, 1, 2]))
        other = rng.choice([n for n in names if n not in own])
        parts = [block(rng, s) for s in own] + ["Thanks to everyone. Nothing is sent to other servers."]
        parts[0] += f" It runs next to one with a {rng.choice(TERMS[other])}."
        docs.append((i, "\n\n".join(parts), "en", "readme", "x-plug", "z"))
        truth[i] = set(own)
    docs += [(900, None, "en", "readme", None, "z"), (901, "  ", None, None, None, "z"), (902, "Nothing is sent to other servers.", "en", None, None, "z"), (903, block(rng, "bread", 9000), "en", None, None, "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, slug string, subject string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 600, 3) for s in truth[i]] + [(1, None), (2, "unheard of")], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([(n, "about") for n in names] + [(None, "x")], "subject string, description string")
    got = document_subjects(d, labels, subjects).collect()
    pairs = {(r.doc_id, r.subject) for r in got}
    assert len(pairs) == len(got)
    held = {(i, s) for i in truth if i % 3 for s in truth[i]}
    found = {p for p in pairs if p[0] < 600 and p[0] % 3}
    assert len(held & found) / len(held) > 0.95 and len(held & found) / len(found) > 0.95
    assert {p for p in pairs if p[0] >= 900} == {(903, "bread")}


def test_subjects_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "Some text. More text.", "a", "b-c")], "doc_id bigint, text string, source string, slug string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([("boats",), ("bread",)], "subject string")
    assert document_subjects(d, labels, subjects).count() == 0
    assert document_subjects(d.limit(0), labels, subjects).count() == 0
    assert document_subjects(d, labels, subjects.limit(0)).count() == 0


def test_accuracies_follow_known_truth():
    patterns, below = [], math.prod(FUNCTIONS.values()) // FUNCTIONS["lexicon"]
    for lexicon, yes, no in ((0, 5, 900), (1, 2, 98), (4, 95, 0)):
        p = lexicon * below
        patterns += [(p, 1, yes), (p, 0, no), (p, None, 10 * (yes + no))]
        assert decode(p)[0] == lexicon
    posterior = learn_accuracies(patterns)
    assert posterior[4 * below] > 0.9 and posterior[below] < 0.5 and posterior[0] < 0.1
