"""Subject areas of documents by weak supervision.

Labelling functions look at a document's lexicon (the longest run of
sentences, list items or names that speak of one subject), its address (the
kind of plugin it belongs to), its sections (paragraphs, lists and blocks that
speak of nothing else), its headings and its source. Their accuracies are
learned by a latent model over the counts of vote patterns of all documents,
in which the labelled documents are known; subjects are assigned from the
posterior.

The lexicon itself is a classifier: it is fitted on a bounded sample of
labelled documents (``FIT_DOCUMENTS``), so its size has that bound as well.
Everything else covers all documents and whole texts. Each text is parsed
once, into a table that both the fit and the votes read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stage

#: Most labelled documents that the lexicon and the associations are fitted on.
FIT_DOCUMENTS = 20_000
#: Signs between the paragraphs and between the sentences of a parsed text.
PARAGRAPH, SENTENCE = "\x1d", "\x1e"
#: Least share of one subject in the uses of an entry.
PURITY = 0.6
#: A sentence speaks of a subject from this score on, and this far ahead of the next.
LEAST_SCORE, LEAD = 1.2, 0.8
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe"})
_FENCE = re.compile(r"```.*?(?:```|\Z)|<(pre|code|script|style)\b.*?(?:</\1>|\Z)", re.S | re.I)
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={1,6}[^=].*=+\s*$|<h\d\b)", re.I)
_PROGRAM = re.compile(r"[$;{}]|=>|->|::|\bfunction\b.*\(|^\s*(?://|/\*)")
_NAMES = re.compile(r"[^\W\d_]+(?:_[^\W_]+)+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def parse(text: str) -> tuple[list[list[str]], list[str]]:
    """(paragraphs of sentences, headings) of a whole text.

    Program excerpts are left out. An item of a list is a sentence, as is each
    name_with_underscores, read as words.
    """
    paragraphs: list[list[str]] = []
    headings: list[str] = []
    listed = False
    for i, line in enumerate(_FENCE.sub("\n", text).splitlines()):
        line = line.strip()
        if not line:
            listed = False
            continue
        if _HEADING.match(line):
            headings.append(re.sub(r"<[^<>]*>", " ", line).strip("#= "))
            continue
        if _PROGRAM.search(line):
            continue
        line = re.sub(r"<[^<>]*>", " ", line)
        names = _NAMES.findall(line)
        if len(names) > 1 or (names and len(names[0]) * 2 > len(line)):
            paragraphs.append([" ".join(n.split("_")[1:]) for n in names])
            line = _NAMES.sub(" ", line)
        sentences = [s for s in _SENTENCE.split(line) if _WORD.search(s)]
        item = bool(_ITEM.match(line))
        if item and listed and paragraphs:
            paragraphs[-1] += sentences
            continue
        listed = item
        if i == 0 and len(sentences) == 1 and len(line) < 90 and not line.endswith((".", "!", "?")):
            headings.append(line)
        elif sentences:
            paragraphs.append(sentences)
    return paragraphs, headings


def parsed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``body`` (sentences in paragraphs) and ``headings`` in place of ``text``."""
    kept = [(n, t) for n, t in documents.dtypes if n != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, titles = [], []
            for text in batch["text"]:
                paragraphs, headings = parse(text.replace(PARAGRAPH, " ").replace(SENTENCE, " "))
                bodies.append(PARAGRAPH.join(SENTENCE.join(p) for p in paragraphs))
                titles.append(SENTENCE.join(headings))
            yield batch.drop(columns=["text"]).assign(body=bodies, headings=titles)

    schema = ", ".join(f"`{n}` {t}" for n, t in kept) + ", body string, headings string"
    return documents.select(*(n for n, _ in kept), "text").mapInPandas(run, schema)


def paragraphs_of(body: str) -> list[list[str]]:
    return [p.split(SENTENCE) for p in body.split(PARAGRAPH)] if body else []


def grams(sentence: str) -> tuple[str, ...]:
    """Distinct runs of one, two and three words."""
    w = _WORD.findall(fold(sentence))
    return tuple({*w, *map(" ".join, zip(w, w[1:])), *map(" ".join, zip(w, w[1:], w[2:]))})


class Lexicon:
    """Entries with the subject they speak of and their weight."""

    def __init__(self, entries: dict[str, tuple[int, float]], subjects: int):
        self.entries, self.subjects, self.memo = entries, subjects, {}
        self.subject_memo: dict[str, int] = {}

    def scores(self, sentence: str) -> dict[int, float]:
        """Weight of the entries of a sentence by subject."""
        got = self.memo.get(sentence)
        if got is None:
            got = {}
            for g in grams(sentence):
                if e := self.entries.get(g):
                    got[e[0]] = got.get(e[0], 0.0) + e[1]
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[sentence] = got
        return got

    def speaks_of(self, sentence: str) -> int:
        """The subject of a sentence, or -1."""
        got = self.subject_memo.get(sentence)
        if got is None:
            s = self.scores(sentence)
            best = min(s, key=lambda i: (-s[i], i), default=-1)
            rest = max((x for i, x in s.items() if i != best), default=0.0)
            got = best if s and s[best] >= LEAST_SCORE and s[best] - rest >= LEAD else -1
            if len(self.subject_memo) > 100_000:
                self.subject_memo.clear()
            self.subject_memo[sentence] = got
        return got


def _responsibilities(paragraph: list[str], allowed: list[int], lexicon: Lexicon | None) -> dict[int, float]:
    """How much a paragraph belongs to each of the allowed subjects; without a lexicon, evenly. Nothing if the lexicon can't tell."""
    if lexicon is None or len(allowed) == 1:
        return {i: 1 / len(allowed) for i in allowed}
    total = dict.fromkeys(allowed, 0.0)
    for s in paragraph:
        for i, x in lexicon.scores(s).items():
            if i in total:
                total[i] += x
    best = max(total.values())
    if best < LEAST_SCORE:
        return {}
    weights = {i: math.exp(max(-30.0, x - best)) for i, x in total.items()}
    whole = sum(weights.values())
    return {i: w / whole for i, w in weights.items()}


def fit_lexicon(sample: DataFrame, subjects: list[str], rounds: int = 3) -> Lexicon:
    """Fit on ``sample``: body and labels (array of subject numbers).

    The first round spreads a document evenly over its subjects, the next ones
    by what the lexicon says of each paragraph. Uses count once a document and
    subject. The lexicon is read into the driver and handed to the workers: it
    is as large as the sample makes it, and the sample is bounded.
    """
    n = len(subjects)
    lexicon: Lexicon | None = None
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(lexicon.entries if lexicon else None)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = Lexicon(shared.value, n) if shared.value is not None else None
            uses: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
            for batch in batches:
                for body, labels in zip(batch["body"], batch["labels"]):
                    allowed = [int(x) for x in labels]
                    seen: dict[str, dict[int, float]] = {}
                    for paragraph in paragraphs_of(body):
                        r = _responsibilities(paragraph, allowed, own)
                        for g in {g for s in paragraph for g in grams(s)} if r else ():
                            before = seen.get(g)
                            seen[g] = r if before is None or before is r else {i: max(x, before.get(i, 0.0)) for i, x in r.items()}
                    for g, r in seen.items():
                        for i, x in r.items():
                            if x > 0.01:
                                uses[g][i] += x
            rows = [(g, i, x) for g, of in uses.items() for i, x in of.items()]
            yield pd.DataFrame(rows, columns=["gram", "subject", "uses"])

        counted = sample.select("body", "labels").mapInPandas(count, "gram string, subject int, uses double")
        best = (
            counted.groupBy("gram", "subject")
            .agg(F.sum("uses").alias("uses"))
            .groupBy("gram")
            .agg(F.sum("uses").alias("all"), F.max("uses").alias("most"), F.max_by("subject", F.struct("uses", -F.col("subject"))).alias("subject"))
            .withColumn("purity", (F.col("most") + 0.2 / n) / (F.col("all") + 0.2))
            .where((F.col("all") >= 1.5) & (F.col("purity") >= PURITY))
            .withColumn("weight", (F.log(F.col("purity") * n)) * (F.col("purity") - 0.5) * F.least(F.lit(1.0), F.col("all") / 4))
        )
        lexicon = Lexicon({r.gram: (r.subject, r.weight) for r in best.select("gram", "subject", "weight").toLocalIterator()}, n)
        shared.unpersist()
    return lexicon


def fit_associations(sample: DataFrame, column: str, subjects: int, least: float = 3.0) -> dict[str, list[float]]:
    """How much more often than overall each subject goes with a value of ``column``, from labelled documents."""
    rows = (
        sample.where(F.col("labels").isNotNull() & F.col(column).isNotNull())
        .select(column, F.explode("labels").alias("subject"))
        .groupBy(column, "subject")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    of: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for r in rows:
        of[r[column]][r.subject] += r.n
        total[r.subject] += r.n
    everything = sum(total.values()) or 1
    return {
        v: [(c[i] + 0.5) / (sum(c.values()) + 0.5 * subjects) / ((total[i] + 0.5) / (everything + 0.5 * subjects)) for i in range(subjects)]
        for v, c in of.items()
        if sum(c.values()) >= least
    }


def level(lift: float | None) -> int:
    """0 unknown, 1 against, 2 neutral, 3 for."""
    return 0 if lift is None else 1 if lift < 0.4 else 3 if lift > 2.5 else 2


#: Names of the labelling functions and their levels.
FUNCTIONS = {"lexicon": 5, "address": 4, "section": 3, "heading": 2, "source": 4}


def votes(documents: DataFrame, lexicon: Lexicon, address: dict, source: dict, subjects: int) -> DataFrame:
    """(doc_id, patterns): for every document the pattern of each subject.

    ``documents``: doc_id, body, headings, address, source. A pattern is the
    number made of the levels of all functions.
    """
    shared = documents.sparkSession.sparkContext.broadcast((lexicon.entries, address, source))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, by_address, by_source = shared.value
        own = Lexicon(entries, subjects)
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("doc_id", "body", "headings", "address", "source"))
            for doc, body, headings, addr, src in zip(*columns):
                paragraphs = [[own.speaks_of(s) for s in p] for p in paragraphs_of(body)]
                titles = {own.speaks_of(h) for h in headings.split(SENTENCE)}
                runs, whole, last, length = [0] * subjects, Counter(), -1, 0
                for p in paragraphs:
                    about = Counter(k for k in p if k >= 0)
                    if len(about) == 1 and sum(about.values()) > 1:
                        whole.update(about.keys())
                    for k in p:
                        if k >= 0:
                            length = length + 1 if k == last else 1
                            last = k
                            runs[k] = max(runs[k], length)
                a, b = by_address.get(addr), by_source.get(src)
                patterns = []
                for i in range(subjects):
                    levels = (
                        min(runs[i], 4),
                        level(a[i] if a else None),
                        min(whole[i], 2),
                        int(i in titles),
                        level(b[i] if b else None),
                    )
                    pattern = 0
                    for x, size in zip(levels, FUNCTIONS.values()):
                        pattern = pattern * size + x
                    patterns.append(pattern)
                out.append((doc, patterns))
            yield pd.DataFrame(out, columns=["doc_id", "patterns"])

    return documents.select("doc_id", "body", "headings", "address", "source").mapInPandas(
        run, "doc_id bigint, patterns array<int>"
    )


def decode(pattern: int) -> list[int]:
    out = []
    for size in reversed(FUNCTIONS.values()):
        out.append(pattern % size)
        pattern //= size
    return out[::-1]


def learn_accuracies(patterns: list[tuple[int, int | None, float]], rounds: int = 60) -> dict[int, float]:
    """Posterior that a document has a subject, for each pattern.

    ``patterns``: pattern, known truth (1, 0 or None), count. Expectation and
    maximisation over a latent truth on which the functions' levels depend
    independently; known truths stay fixed.
    """
    if not patterns:
        return {}
    sizes = list(FUNCTIONS.values())
    levels = np.array([decode(p) for p, _, _ in patterns])
    counts = np.array([c for _, _, c in patterns], dtype=float)
    known = np.array([-1 if t is None else t for _, t, _ in patterns])
    posterior = np.where(known >= 0, known, np.where(levels[:, 0] >= 3, 0.95, 0.02)).astype(float)
    told = counts[known >= 0].sum()
    untold = counts[known < 0].sum()
    # Documents with a known truth count as much as all others together, or the truth would drift to what varies most.
    weight = counts * np.where(known >= 0, max(1.0, untold / told) if told else 1.0, 1.0)
    for _ in range(rounds):
        logs = np.zeros((len(patterns), 2))
        for y in (0, 1):
            w = weight * (posterior if y else 1 - posterior)
            logs[:, y] = math.log((w.sum() + 1) / (weight.sum() + 2))
            for j, size in enumerate(sizes):
                table = np.bincount(levels[:, j], weights=w, minlength=size) + 0.1
                logs[:, y] += np.log(table / table.sum())[levels[:, j]]
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        fresh = np.where(known >= 0, known, fresh)
        if np.abs(fresh - posterior).max() < 1e-6:
            break
        posterior = fresh
    free = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return {p: float(x) for (p, _, _), x in zip(patterns, free)}


def document_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, fit_documents: int = FIT_DOCUMENTS, least: float = 0.5
) -> DataFrame:
    """(doc_id, subject, posterior) of each subject that a document has.

    ``documents``: doc_id, text, source, slug; ``labels``: doc_id, subject;
    ``subjects``: subject (a small fixed list; it is collected and refused
    beyond 1,000). At most ``fit_documents`` of the labelled documents are
    fitted on, a fixed choice by hash. Null and empty texts have no subject. Equal texts under
    different doc_ids get equal votes for their text. Without any labels there
    is no lexicon and no document has a subject. Extra columns are ignored.
    """
    listed = sorted(r.subject for r in subjects.select("subject").where(F.col("subject").isNotNull()).distinct().limit(1001).collect())
    if len(listed) > 1000:
        raise ValueError("more than 1000 subjects")
    n = len(listed)
    numbers = F.create_map(*(x for i, s in enumerate(listed) for x in (F.lit(s), F.lit(i)))) if n else F.create_map()
    docs = documents.where(F.trim("text") != "").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_extract(F.coalesce("slug", F.lit("")), r"([^-]+-[^-]+)$", 1).alias("address"),
    )
    known = (
        labels.where(F.col("subject").isin(listed)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.array_sort(F.collect_set(F.try_element_at(numbers, F.col("subject")))).alias("labels"))
    )
    if not listed:
        return docs.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("posterior")).limit(0)
    docs = stage(parsed(docs), "subject-parsed")
    known = stage(known, "subject-labels")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    sample = stage(docs.join(chosen, "doc_id"), "subject-sample", 24)
    lexicon = fit_lexicon(sample, listed)
    address = fit_associations(sample.withColumn("address", F.nullif("address", F.lit(""))), "address", n)
    source = fit_associations(sample.withColumn("source", F.nullif("source", F.lit(""))), "source", n)
    voted = stage(votes(docs, lexicon, address, source, n), "subject-votes")
    truth = F.when(F.col("labels").isNotNull(), F.array_contains("labels", F.col("subject")).cast("int"))
    each = voted.join(known, "doc_id", "left").select("labels", F.posexplode("patterns").alias("subject", "pattern"))
    patterns = each.groupBy("pattern", truth.alias("truth")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most levels x 3 rows
    posterior = learn_accuracies([(r.pattern, r.truth, r.n) for r in patterns])
    merged: dict[int, float] = {}
    for p, x in posterior.items():
        merged[p] = max(x, merged.get(p, 0.0))
    kept = {p: x for p, x in merged.items() if x >= least}
    if not kept:
        return voted.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("posterior")).limit(0)
    table = F.create_map(*(x for p, v in kept.items() for x in (F.lit(p), F.lit(v))))
    names = F.array(*map(F.lit, listed))
    return (
        voted.select("doc_id", F.posexplode("patterns").alias("subject", "pattern"))
        .withColumn("posterior", F.try_element_at(table, F.col("pattern")))
        .where(F.col("posterior").isNotNull())
        .select("doc_id", F.element_at(names, F.col("subject") + 1).alias("subject"), "posterior")
    )
