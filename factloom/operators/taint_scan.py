"""Scan of program files: facts, summaries to a fixpoint, findings with access context.

Everything between callables is relational: references are resolved by joins,
a pass interprets the callables whose callees' summaries changed, and entry
points and checks are handed down the call edges. Only one callable at a time
is evaluated in Python. All tables carry the root of their program, so one run
scans any number of programs.
"""

from __future__ import annotations

import json
import pickle
import sys
import threading
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.access import ROLE_LEVEL, access_severity, derive_access, minimum_role, role_level, tier_weight
from factloom.functions.scores import exploitability
from factloom.operators import taint_guards as G
from factloom.operators import taint_models as M
from factloom.operators import taint_surfaces
from factloom.operators.closure import propagate_sets, reach
from factloom.operators.taint_interpreter import NUMERIC, Interpreter, constant_name, nameless
from factloom.session import stage
from factloom.sources.php_parser import PhpError, parse_php

#: Passes after which a fixpoint counts as missed and the scan fails; passes of the handing down of context and constants.
MAX_PASSES, CONTEXT_PASSES = 200, 8
#: Helpers that call helpers: how deep their checks are looked up.
HELPER_ROUNDS = 3
#: Depth and stack of the evaluation; the reader refuses deeper programs first.
DEPTH, STACK = 100_000, 512 << 20
#: Operations of sinks that a scan looks for.
#: ``surface``, for signals of weak design, is left out unless it is asked for.
OPERATIONS = ("include", "read", "open", "delete", "write", "output", "sql", "action", "call")
#: Lines before a sink within which a local check counts.
LOCAL_LINES = 48
_COLUMNS = ["root", "key", "name", "kind", "class", "parent", "method", "path", "line", "record", "error", "refs", "calls", "seed", "special"]
_CALLABLE = (
    "root string, key string, name string, kind string, class string, parent string, method string, path string, line int,"
    " record binary, error string, refs array<string>, calls array<string>, seed boolean, special boolean"
)
#: Functions and methods without which a callable matters to a scan only through others.
_SEEDS = {n for row in [*M.FUNCTION_SINKS, *M.METHOD_SINKS] for n in row[2].split()} | {
    *M.LINK_FIRST, *M.DYNAMIC_CALLS, *M.JSON_OUTPUT, *M.ROLE_FUNCTIONS, *(n for row in M.STORE_WRITES for n in row[0].split())
}


def callables_of(path: str, source: str, program: list | None = None) -> list[dict]:
    """All callables of a file: its top level, functions, methods and closures, wherever they are nested."""
    program = parse_php(source) if program is None else program
    text = source.replace("\r\n", "\n").split("\n")
    found: list[dict] = []

    def add(key, kind, line, params, body, cls=None, parent=None, method=None, uses=None):
        numbers: set[int] = {line}

        def lines(node):
            if isinstance(node, tuple) and len(node) > 1 and isinstance(node[0], str) and isinstance(node[1], int):
                numbers.add(node[1])
            if isinstance(node, (tuple, list)):
                for x in node:
                    lines(x)

        lines(body)
        found.append(
            {
                "key": key, "kind": kind, "class": cls, "parent": parent, "method": method, "path": path, "line": line,
                "params": params, "uses": uses, "body": body,
                "lines": {n: text[n - 1].strip() for n in numbers if 0 < n <= len(text)},
            }
        )

    def visit(node, cls=None, parent=None):
        if not isinstance(node, (tuple, list)):
            return
        if isinstance(node, tuple) and node and node[0] == "function" and len(node) == 5:
            add(f"f:{node[2].lower()}", "function", node[1], node[3], node[4] or [])
        elif isinstance(node, tuple) and node and node[0] == "class" and len(node) == 7:
            cls, parent = nameless(node[2], path), (node[3] or "").lstrip("\\").lower() or None
            for name, line, params, body, _ in node[4]:
                add(f"m:{cls}::{name.lower()}", "method", line, params, body, cls, parent, name.lower())
        elif isinstance(node, tuple) and node and node[0] == "closure" and len(node) == 6:
            add(f"closure:{path}:{node[5]}", "closure", node[1], node[2], node[4], cls, parent, None, node[3])
        for x in node:
            visit(x, cls, parent)

    visit(program)
    add(f"file:{path}", "file", 1, [], [s for s in program if s[0] not in ("function", "class")])
    return found


def constants_of(program: list, path: str) -> list[tuple[str, list]]:
    """(name, parts) of the constants of a file that are made of texts and other constants: a part is a text or [name]."""
    out = []

    def parts(e, cls) -> list | None:
        if e[0] == "literal" and e[2] in ("string", "number"):
            return [e[3]]
        if e[0] == "concat" or (e[0] == "binary" and e[2] == "."):
            sides = [parts(x, cls) for x in (e[2] if e[0] == "concat" else e[3:5])]
            return None if None in sides else [p for s in sides for p in s]
        if e[0] == "name":
            return [[constant_name(e[2])]]
        if e[0] == "cconst" and isinstance(e[2], str) and isinstance(e[3], str):
            owner = e[2].lstrip("\\").lower()
            return [[f"{cls if owner in ('self', 'static') else owner}::{e[3]}"]]
        return None

    def visit(node, cls=None):
        if isinstance(node, tuple) and len(node) == 7 and node[0] == "class":
            cls = nameless(node[2], path)
            for name, e in node[6]:
                if (p := parts(e, cls)) is not None:
                    out.append((f"{cls}::{name}", p))
        elif isinstance(node, tuple) and len(node) == 4 and node[0] == "call" and isinstance(node[2], str) and G.short(node[2]) == "define":
            if len(node[3]) > 1 and (name := G.literal_text(node[3][0])) and (p := parts(node[3][1], cls)) is not None:
                out.append((constant_name(name), p))
        if isinstance(node, (tuple, list)):
            for x in node:
                visit(x, cls)

    visit(program)
    return out


def outline(c: dict) -> tuple[list[str], list[str], bool, bool]:
    """Of a callable: constants it names, bare names it may call, whether it matters to a scan by itself, whether a text given to it decides what it does."""
    refs, calls, seed = set(), set(), c["kind"] == "file"
    params = {p[0] for p in c["params"]}
    is_param = lambda n: isinstance(n, tuple) and n[0] == "var" and n[2] in params
    special = any(
        (n[0] == "binary" and n[2] in (*G.SAME, *G.DIFFERENT) and (is_param(n[3]) or is_param(n[4])))
        or (n[0] in ("call", "method") and is_param(n[2] if n[0] == "call" else n[3]))
        for n in G.nodes(c["body"])
    )
    for n in G.nodes(c["body"]):
        if n[0] == "name":
            refs.add(constant_name(n[2]))
        elif n[0] == "cconst" and isinstance(n[2], str) and isinstance(n[3], str):
            owner = n[2].lstrip("\\").lower()
            refs.add(f"{c['class'] if owner in ('self', 'static') else c['parent'] if owner == 'parent' else owner}::{n[3]}")
        elif n[0] in ("call", "method", "scall"):
            name = n[2] if n[0] == "call" else n[3]
            if not isinstance(name, str):
                seed = True
                continue
            name = G.short(name)
            seed = seed or name in _SEEDS or name.startswith(("add_", "register_", "do_action", "apply_filters"))
            calls.add(name)
        elif n[0] in ("echo", "print", "exit", "eval", "shell", "include", "new", "return", "assign") or (n[0] == "literal" and n[2] == "string" and len(n[3] or "") < 200):
            seed = seed or n[0] not in ("literal", "return", "new", "assign")
            if n[0] == "assign" and n[2][0] == "prop":
                seed = True
            if n[0] == "literal":  # it may name a callback
                calls.add(G.short(n[3].split("::")[-1]))
            elif n[0] == "new":
                calls.add("__construct")
    return sorted(refs), sorted(calls), seed, special


def class_parents(program: list, path: str) -> list[tuple[str, str]]:
    """(class, parent) of all classes of a file that extend one or use a trait, with or without methods."""
    out = []

    def visit(node):
        if isinstance(node, tuple) and len(node) == 7 and node[0] == "class" and node[3]:
            out.append((nameless(node[2], path), node[3].lstrip("\\").lower()))
        if isinstance(node, tuple) and len(node) == 7 and node[0] == "class":
            traits = [p[0][4:] for p in node[5] if p[0].startswith("use ")]
            out.extend((nameless(node[2], path), t.lstrip("\\").lower()) for t in traits)
        if isinstance(node, (tuple, list)):
            for x in node:
                visit(x)

    visit(program)
    return out


def extract_callables(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Callables of ``files`` (root, path, source); an unreadable file gives one row of kind ``error``, or fails the job.

    Definitions of one name in a program are all kept: the name is theirs
    together, the key each one's own.
    """
    return extract_program(files, fail_fast).where("kind not in ('class', 'const')").drop("refs", "calls", "seed", "special")


def extract_program(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Rows of ``extract_callables``, one of kind ``class`` for each class that extends another one, one ``const`` for each constant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for root, path, source in zip(batch["root"], batch["path"], batch["source"]):
                try:
                    program = parse_php(source or "")
                    for cls, parent in class_parents(program, path):
                        rows.append((root, f"class:{cls}", f"class:{cls}", "class", cls, parent, None, path, 0, None, None, None, None, False, False))
                    for name, parts in constants_of(program, path):
                        rows.append((root, f"const:{name}", name, "const", None, None, None, path, 0, json.dumps(parts).encode(), None, None, None, False, False))
                    for c in callables_of(path, source or "", program):
                        rows.append((root, c["key"], c["key"], c["kind"], c["class"], c["parent"], c["method"], path, c["line"], pickle.dumps(c), None, *outline(c)))
                except (PhpError, RecursionError) as ex:
                    if fail_fast:
                        raise
                    rows.append((root, f"error:{path}", f"error:{path}", "error", None, None, None, path, 0, None, str(ex), None, None, False, False))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    nth = F.row_number().over(Window.partitionBy("root", "name").orderBy("path", "line", "record"))
    own = F.when(F.col("__n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.col("__n").cast("string")))
    found = files.select("root", "path", "source").mapInPandas(run, _CALLABLE).withColumn("__n", nth)
    return found.withColumn("key", own).drop("__n")


def deep(work: Callable[[], list]) -> list:
    """Run ``work`` with a stack that any program the reader accepts fits; what it raises is raised."""
    out: list = []

    def run() -> None:
        try:
            out.append((work(), None))
        except BaseException as ex:  # handed on to the caller
            out.append((None, ex))

    limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    sys.setrecursionlimit(max(limit, DEPTH))
    try:
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def constants(callables: DataFrame) -> DataFrame:
    """(root, name, text) of constants, in at most ``CONTEXT_PASSES`` passes over those made of others; several texts give none."""
    given = callables.where("kind = 'const'").select("root", "name", F.from_json(F.col("record").cast("string"), "array<string>").alias("parts"))
    each = given.select("root", "name", F.md5(F.to_json("parts")).alias("which"), F.posexplode("parts").alias("at", "part"), F.size("parts").alias("n"))
    other = F.from_json("part", "array<string>")[0]
    each = stage(
        each.withColumn("other", F.when(F.col("part").startswith("["), other)).withColumn("text", F.when(F.col("other").isNull(), F.col("part"))), "constants"
    )
    known = None
    for _ in range(CONTEXT_PASSES):
        now = each
        if known is not None:
            found = known.select("root", F.col("name").alias("other"), F.col("text").alias("found"))
            now = each.join(found, ["root", "other"], "left").withColumn("text", F.coalesce("text", "found"))
        whole = now.groupBy("root", "name", "which", "n").agg(
            F.count("text").alias("have"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts")
        )
        texts = F.array_join(F.transform("texts", lambda t: t.getField("text")), "")
        whole = whole.where("have = n").groupBy("root", "name").agg(F.min(texts).alias("text"), F.max(texts).alias("other"))
        fresh = stage(whole.where(F.col("text") == F.col("other")).select("root", "name", "text"), "constants-known")
        if known is not None and fresh.count() == known.count():
            break
        known = fresh
        if each.where("other is not null").isEmpty():
            break
    return known


def with_constants(callables: DataFrame) -> DataFrame:
    """``callables`` with a map of the constants that each one names."""
    none = F.create_map().cast("map<string,string>")
    if callables.where("kind = 'const'").isEmpty():
        return callables.withColumn("constants", none)
    named = callables.where("kind not in ('error', 'class', 'const')").select("root", "key", F.explode("refs").alias("name"))
    maps = named.join(constants(callables), ["root", "name"]).groupBy("root", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("constants")
    )
    return callables.join(maps, ["root", "key"], "left").withColumn("constants", F.coalesce("constants", none))


def relevant_callables(callables: DataFrame) -> DataFrame:
    """(root, key) of the callables that can take part in a finding.

    Those that hold a sink, a registration or anything uncertain, all that may
    call them, and all that those may call. Calls are by bare name, so more is
    kept than may run, never less.
    """
    code = callables.where("kind not in ('error', 'class', 'const')")
    node = F.concat_ws("\n", "root", "key")
    bare = F.when(F.col("method").isNotNull(), F.col("method")).otherwise(F.regexp_extract("name", r"([^:\\\\]+)$", 1))
    own = code.where("kind in ('function', 'method')").select("root", bare.alias("bare"), node.alias("dst"))
    edges = code.select("root", F.explode("calls").alias("bare"), node.alias("src")).join(own, ["root", "bare"]).select("src", "dst")
    edges = stage(edges.distinct(), "outline-edges")
    up = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), code.where("seed").select(node.alias("node"))).select("node")
    down = reach(edges, up).select("node")
    parts = F.split("node", "\n", 2)
    return down.union(code.where("kind = 'closure'").select(node)).distinct().select(parts[0].alias("root"), parts[1].alias("key"))


def _interpret(inputs: DataFrame, strict: bool, models: dict | None = None) -> DataFrame:
    """(root, key, summary) of callables with (record, constants, callees: array of ref and summary)."""
    shared = inputs.sparkSession.sparkContext.broadcast(models or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[c] for c in ("root", "key", "record", "constants", "literals", "callees")]

            def work(columns=columns) -> list:
                rows = []
                for root, key, record, texts, literals, callees in zip(*columns):
                    known: dict[str, list[dict]] = {}
                    for c in sorted(callees if callees is not None else [], key=lambda c: (c["ref"], c["summary"])):
                        known.setdefault(c["ref"], []).append(json.loads(c["summary"]))
                    r = pickle.loads(record)
                    more = {"key": key.split("@")[0], "name": r["key"], "literals": dict(literals or {}), "constants": dict(texts or {}), "models": shared.value}
                    rows.append((root, key, json.dumps(Interpreter(r | more, known, strict).run(), sort_keys=True)))
                return rows

            yield pd.DataFrame(deep(work), columns=["root", "key", "summary"])

    return inputs.select("root", "key", "record", "constants", "literals", "callees").mapInPandas(run, "root string, key string, summary string")


def _facts(summaries: DataFrame, name: str) -> DataFrame:
    return summaries.select(
        "root", "key", F.explode(F.from_json(F.get_json_object("summary", f"$.{name}"), "array<array<string>>")).alias("x")
    )


def class_ancestors(callables: DataFrame) -> DataFrame:
    """(root, class, up, depth): every class with all that it inherits from, by the shortest way; cycles end.

    Parents don't change from pass to pass, so chains are walked once, to
    their end, and references are then resolved by joins alone.
    """
    parents = stage(callables.where("kind = 'class'").select("root", "class", F.col("parent").alias("up")).distinct(), "parents")
    walk = parents.withColumn("depth", F.lit(1))
    found = [walk]
    above = parents.select("root", F.col("class").alias("up"), F.col("up").alias("next"))
    while not walk.isEmpty():
        seen = found[0] if len(found) == 1 else stage(reduce(DataFrame.unionByName, found), "ancestors")
        found = [seen]
        further = walk.join(above, ["root", "up"]).groupBy("root", "class", F.col("next").alias("up")).agg((F.min("depth") + 1).alias("depth"))
        walk = stage(further.join(seen, ["root", "class", "up"], "left_anti"), "ancestors-walk")
        found.append(walk)
    return found[0]


def resolve(
    refs: DataFrame, callables: DataFrame, registered: DataFrame, props: DataFrame | None = None, ancestors: DataFrame | None = None
) -> DataFrame:
    """(root, ref, callee): what references mean.

    Functions and closures by name, a function of a namespace before a global
    one; methods by the nearest class of the chain that has them; methods of
    unknown objects only where the program has one method of that name; hooks
    by what is registered on them. A name means all of its definitions. Names
    with holes (``{}``) mean all that have their start and their end; methods
    of a property mean those of the one class that is ever assigned to it
    (``props``: root, prop, type).
    """
    refs = refs.select("root", "ref").distinct()
    hole = F.col("ref").contains("{}")
    fits = lambda name, ref: name.startswith(F.substring_index(ref, "{}", 1)) & name.endswith(F.substring_index(ref, "{}", -1))
    on = registered.select(F.col("root").alias("__root"), "hook", "target")
    called = refs.where(F.col("ref").startswith("h:"))
    same = F.col("root") == F.col("__root")
    hooks = called.join(on, same & (F.col("ref") == F.col("hook"))).unionByName(
        called.join(on, same & (hole | F.col("hook").contains("{}")) & (F.col("ref") != F.col("hook")) & (fits(F.col("hook"), F.col("ref")) | fits(F.col("ref"), F.col("hook"))))
    ).select("root", "ref", "target")
    named = callables.where("kind in ('function', 'method')").select(F.col("root").alias("__root"), F.col("name").alias("target")).distinct()
    holes = refs.where(hole & ~F.col("ref").startswith("h:")).join(named, same & fits(F.col("target"), F.col("ref"))).select("root", "ref", "target")
    direct = refs.where(~hole & ~F.col("ref").startswith("h:")).withColumn("target", F.col("ref"))
    if props is not None:
        one = props.groupBy("root", "prop").agg(F.min("type").alias("type"), F.max("type").alias("last")).where(F.col("type") == F.col("last")).drop("last")
        prop = F.regexp_extract("target", r"^m:\?(.+->.+)::[^:]*$", 1)
        direct = direct.withColumn("prop", prop).join(one, ["root", "prop"], "left").select(
            "root", "ref",
            F.when(F.col("prop") == "", F.col("target"))
            .otherwise(F.concat(F.lit("m:"), F.coalesce("type", F.lit("?")), F.lit("::"), F.substring_index("target", "::", -1))).alias("target"),
        )
    direct = direct.unionByName(hooks).unionByName(holes).distinct()
    keys = callables.where("kind not in ('error', 'class', 'const')").select("root", F.col("name").alias("target"), F.col("key").alias("callee"))
    either = F.col("target").startswith("f:") & F.col("target").contains("|")
    spaced = direct.where(either)
    first = F.when(either, F.replace("target", F.lit("|"), F.lit("\\"))).otherwise(F.col("target"))
    exact = direct.withColumn("said", F.col("target")).withColumn("target", first).join(keys, ["root", "target"])
    plain = exact.select("root", "ref", F.col("said").alias("target"), "callee")
    loose = spaced.join(plain.select("root", "target"), ["root", "target"], "left_anti").select(
        "root", "ref", F.concat(F.lit("f:"), F.substring_index("target", "|", -1)).alias("target")
    )
    plain = plain.unionByName(loose.join(keys, ["root", "target"]).select("root", "ref", "target", "callee"))
    methods = callables.where("method is not null").select("root", "class", "parent", "method", "name", "key")
    ancestors = class_ancestors(callables) if ancestors is None else ancestors
    split = F.regexp_extract("target", "^m:(.*)::", 1), F.regexp_extract("target", "::([^:]*)$", 1)
    open_ = direct.where(F.col("target").startswith("m:")).join(plain.select("root", "target"), ["root", "target"], "left_anti")
    walk = open_.where(~F.col("target").startswith("m:?")).select("root", "ref", "target", split[0].alias("at"), split[1].alias("method"))
    found = [plain.select("root", "ref", "callee")]
    own = methods.select("root", F.col("class").alias("up"), "method", F.col("key").alias("callee"))
    hits = walk.distinct().join(ancestors.withColumnRenamed("class", "at"), ["root", "at"]).join(own, ["root", "up", "method"])
    nearest = F.min("depth").over(Window.partitionBy("root", "ref", "target"))
    found.append(hits.withColumn("nearest", nearest).where("depth = nearest").select("root", "ref", "callee"))
    only = methods.groupBy("root", "method").agg(F.count_distinct("name").alias("n"), F.collect_set("key").alias("keys")).where("n = 1")
    only = only.select("root", "method", F.explode("keys").alias("callee"))
    unknown = open_.where(F.col("target").startswith("m:?")).select("root", "ref", split[1].alias("method"))
    found.append(unknown.join(only, ["root", "method"]).select("root", "ref", "callee"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _edges(summaries: DataFrame, callables: DataFrame, ancestors: DataFrame) -> tuple[DataFrame, DataFrame]:
    calls = _facts(summaries, "calls").select("root", F.col("key").alias("caller"), F.col("x")[0].alias("ref"))
    registered = _facts(summaries, "registered").select("root", F.col("x")[0].alias("hook"), F.col("x")[1].alias("target")).distinct()
    entries = _facts(summaries, "entries").select("root", F.col("x")[0].alias("ref"))
    wanted = calls.select("root", "ref").unionByName(entries).unionByName(registered.select("root", F.col("target").alias("ref")))
    helpers = _facts(summaries, "checks").where(F.col("x")[0].startswith("helper:")).select("root", F.col("x")[1].alias("ref"))
    props = _facts(summaries, "props").select("root", F.col("x")[0].alias("prop"), F.col("x")[1].alias("type")).distinct()
    meaning = stage(resolve(wanted.unionByName(helpers), callables, registered, props, ancestors), "taint-refs")
    edges = calls.join(meaning, ["root", "ref"]).select("root", "caller", "ref", "callee").distinct()
    return stage(edges, "taint-edges"), meaning


def _clones(summaries: DataFrame, meaning: DataFrame, special: DataFrame) -> DataFrame:
    """(root, caller, ref, given, callee, clone): calls that give texts to callables that these decide."""
    said = _facts(summaries, "variants").select("root", F.col("key").alias("caller"), F.col("x")[0].alias("ref"), F.col("x")[1].alias("given"))
    found = said.join(meaning, ["root", "ref"]).join(special, ["root", "callee"], "left_semi")
    return found.withColumn("clone", F.concat_ws("@", "callee", "given")).distinct()


def _clone_edges(clones: DataFrame) -> DataFrame:
    return clones.select("root", "caller", F.concat_ws("@", "ref", "given").alias("ref"), F.col("clone").alias("callee")).distinct()


#: Parts of a summary that references come from.
_REFERRING = ("calls", "registered", "entries", "checks", "props")


def summarise(
    callables: DataFrame, max_passes: int = MAX_PASSES, strict: bool = False, prune: bool = True, models: dict | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, edges, meaning of references) at the fixpoint; raises if it isn't reached in ``max_passes``.

    Each pass re-interprets the callers of callables whose summary changed, on
    the summaries of the pass before; results don't depend on any order.
    ``prune`` leaves out callables that can't take part in a finding. A
    callable that compares a parameter, or calls what it names, has a clone
    for each combination of texts that it is called with; such calls mean the
    clone. Clones make no further clones.
    """
    ancestors = class_ancestors(callables)
    special = stage(callables.where("special").select("root", F.col("key").alias("callee")), "special")
    code = with_constants(callables).where("kind not in ('error', 'class', 'const')").select("root", "key", "record", "constants")
    if prune:
        code = code.join(relevant_callables(callables), ["root", "key"], "left_semi")
    code = stage(code.withColumn("literals", F.create_map().cast("map<string,string>")), "taint-code")
    none = F.array().cast("array<struct<ref:string,summary:string>>")
    summaries = stage(_interpret(code.withColumn("callees", none), strict, models), "summaries")
    edges, meaning = _edges(summaries, callables, ancestors)
    clones = stage(_clones(summaries, meaning, special), "clones")
    cloned = not clones.isEmpty()
    if cloned:
        base = code.withColumnRenamed("key", "callee").drop("literals")
        given = clones.select("root", "callee", "clone", "given").distinct().join(base, ["root", "callee"])
        given = given.select("root", F.col("clone").alias("key"), "record", "constants", F.from_json("given", "map<string,string>").alias("literals"))
        code = stage(code.unionByName(given), "taint-code")
        fresh = _interpret(given.withColumn("callees", none), strict, models)
        summaries = stage(summaries.unionByName(fresh), "summaries")
        edges, meaning = _edges(summaries, callables, ancestors)
        edges = edges.unionByName(_clone_edges(clones))
    pending = edges.select("root", F.col("caller").alias("key")).distinct()
    for _ in range(max_passes):
        inputs = (
            edges.join(pending.select("root", F.col("key").alias("caller")), ["root", "caller"], "left_semi")
            .join(summaries.select("root", F.col("key").alias("callee"), "summary"), ["root", "callee"])
            .groupBy("root", F.col("caller").alias("key"))
            .agg(F.collect_list(F.struct("ref", "summary")).alias("callees"))
        )
        fresh = stage(_interpret(code.join(inputs, ["root", "key"]), strict, models), "summaries-fresh")
        old = summaries.select("root", "key", F.col("summary").alias("old"))
        part = lambda c: F.concat_ws("\n", *(F.get_json_object(c, f"$.{name}") for name in _REFERRING))
        changed = fresh.join(old, ["root", "key"]).where("summary <> old").withColumn("turned", part("summary") != part("old"))
        changed = stage(changed.select("root", "key", "summary", "turned"), "summaries-changed")
        if changed.isEmpty():
            return summaries, edges, meaning
        kept = summaries.join(changed, ["root", "key"], "left_anti")
        summaries = stage(kept.unionByName(changed.select("root", "key", "summary")), "summaries")
        if not changed.where("turned").isEmpty():  # else the references are what they were
            edges, meaning = _edges(summaries, callables, ancestors)
            if cloned:
                edges = edges.unionByName(_clone_edges(clones))
        moved = changed.select("root", F.col("key").alias("callee"))
        pending = edges.join(moved, ["root", "callee"], "left_semi").select("root", F.col("caller").alias("key")).distinct()
    raise RuntimeError(f"no fixpoint after {max_passes} passes")


def own_checks(summaries: DataFrame, meaning: DataFrame) -> DataFrame:
    """(root, key, kind, name, line, at): checks of callables with those of their helpers.

    Of a helper in a negated condition a login check means that nobody is
    logged in; of one that stands as a statement and ends the request, what it
    refuses is what the rest may count on.
    """
    every = _facts(summaries, "checks").select(
        "root", "key", F.col("x")[0].alias("kind"), F.col("x")[1].alias("name"), F.col("x")[2].cast("int").alias("line"), F.col("key").alias("at")
    )
    own = every.where(~F.col("kind").startswith("helper:"))
    helpers = every.where(F.col("kind").startswith("helper:")).select("root", "key", F.col("kind").alias("how"), F.col("name").alias("ref"))
    helpers = stage(helpers.join(meaning, ["root", "ref"]).select("root", "key", "how", F.col("callee").alias("helper")).distinct(), "helpers")
    found = stage(own.distinct(), "checks")
    if helpers.isEmpty():
        return found
    entered = _facts(summaries, "entries").select("root", F.col("x")[0].alias("ref")).join(meaning, ["root", "ref"]).select("root", F.col("callee").alias("helper"))
    for _ in range(HELPER_ROUNDS):
        theirs = found.withColumnRenamed("key", "helper")
        ending = theirs.where("kind = 'validation'").select("root", "helper").distinct().join(entered, ["root", "helper"], "left_anti")
        stated = helpers.where("how = 'helper:statement'").join(ending, ["root", "helper"], "left_semi")
        guarded = theirs.where("kind = 'capability'").select("root", "helper").distinct().withColumn("guarded", F.lit(True))
        taken = helpers.where("how <> 'helper:statement'").unionByName(stated).join(theirs, ["root", "helper"]).join(guarded, ["root", "helper"], "left")
        kind = (
            F.when((F.col("how") == "helper:statement") & (F.col("kind") == "unauth"), "auth")
            .when((F.col("how") == "helper:negative") & (F.col("kind") == "auth"), F.when(F.col("guarded"), "auth").otherwise("unauth"))
            .when((F.col("how") == "helper:negative") & (F.col("kind") == "unauth"), "auth")
            .otherwise(F.col("kind"))
        )
        fresh = taken.withColumn("kind", kind).select("root", "key", "kind", "name", "line", "at").distinct()
        fresh = stage(fresh.join(found, ["root", "key", "kind", "name", "line", "at"], "left_anti"), "checks-of-helpers")
        if fresh.isEmpty():
            break
        found = stage(found.unionByName(fresh), "checks")
    return found


def contexts(summaries: DataFrame, edges: DataFrame, meaning: DataFrame) -> DataFrame:
    """(root, key, kind, name, path, line, tier): checks and entries of callables and of those that call them.

    A permission callback's checks count for the route that it guards, and a
    helper's for those that call it in a condition, or as a statement if it
    ends the request itself.
    """
    checks = own_checks(summaries, meaning).select(
        "root", "key", F.to_json(F.struct(F.lit("check").alias("what"), "kind", "name", "line", "at")).alias("fact")
    )
    entries = _facts(summaries, "entries").select(
        "root", F.col("x")[0].alias("ref"), F.to_json(F.struct(F.lit("entry").alias("what"), F.col("x")[1].alias("kind"), F.col("x")[2].alias("name"), F.col("x")[3].alias("tier"))).alias("fact")
    )
    placed = entries.join(meaning, ["root", "ref"]).select("root", F.col("callee").alias("key"), "fact")
    guards = _facts(summaries, "registered").where(F.col("x")[0].startswith("g:")).select(
        "root", F.expr("substring(x[0], 3)").alias("ref"), F.col("x")[1].alias("guard")
    )
    route = guards.join(meaning, ["root", "ref"]).select("root", F.col("callee").alias("route"), F.col("guard").alias("ref"))
    lent = route.join(meaning, ["root", "ref"]).select("root", "route", F.col("callee").alias("key")).join(checks, ["root", "key"])
    facts = checks.unionByName(placed).unionByName(lent.select("root", F.col("route").alias("key"), "fact"))
    node = lambda c: F.concat_ws("\n", "root", c)
    spread = propagate_sets(
        edges.select(node("caller").alias("src"), node("callee").alias("dst")), facts.select(node("key").alias("node"), "fact"), CONTEXT_PASSES
    )
    parts = F.split("node", "\n", 2)
    return spread.select(
        parts[0].alias("root"),
        parts[1].alias("key"),
        F.from_json("fact", "what string, kind string, name string, tier string, line int, at string").alias("f"),
    ).select("root", "key", "f.*")


def stored_access(summaries: DataFrame, callables: DataFrame, access: DataFrame) -> DataFrame:
    """(root, path, line, stored_access): for each read of a store, the most reachable tier that writes request values to it.

    Writers are matched by store and key, and only where no writer has the key,
    by the store alone. ``access``: root, key, access of callables.
    """
    stores = summaries.select("root", "key", F.explode(F.from_json(F.get_json_object("summary", "$.stores"), "array<string>")).alias("x"))
    writers = (
        stores.where(F.get_json_object("x", "$[2][0]") == "S")
        .select("root", "key", F.get_json_object("x", "$[0]").alias("family"), F.get_json_object("x", "$[1]").alias("name"))
        .join(access, ["root", "key"], "left")
        .withColumn("access", F.coalesce("access", F.lit("unknown")))
    )
    widest = F.max_by("access", F.struct(tier_weight(F.col("access")), "access"))
    exact = writers.groupBy("root", "family", "name").agg(widest.alias("by_key"))
    loose = writers.groupBy("root", "family").agg(widest.alias("by_family"))
    reads = _facts(summaries, "reads").join(callables.select("root", "key", "path"), ["root", "key"]).select(
        "root", "path", F.col("x")[2].cast("int").alias("line"), F.col("x")[0].alias("family"), F.col("x")[1].alias("name")
    )
    got = reads.join(exact, ["root", "family", "name"], "left").join(loose, ["root", "family"], "left")
    tier = F.coalesce("by_key", "by_family")
    return got.where(tier.isNotNull()).groupBy("root", "path", "line").agg(
        F.max_by(tier, F.struct(tier_weight(tier), tier)).alias("stored_access")
    )


def query_parts(summaries: DataFrame, meaning: DataFrame) -> DataFrame:
    """Request values that callbacks of the filters of query clauses give back."""
    hooks = [f"h:{h}" for h in M.SQL_CLAUSE_HOOKS]
    on = _facts(summaries, "registered").where(F.col("x")[0].isin(*hooks)).select("root", F.col("x")[1].alias("ref"))
    back = on.join(meaning, ["root", "ref"]).select("root", F.col("callee").alias("key")).distinct()
    given = summaries.join(back, ["root", "key"], "left_semi").select(
        "root", "key", F.explode(F.from_json(F.get_json_object("summary", "$.returns"), "array<string>")).alias("x"),
        F.from_json(F.get_json_object("summary", "$.given"), "array<array<string>>")[0].alias("place"),
    )
    value = given.where((F.get_json_object("x", "$[1][0]") == "S") & (F.get_json_object("x", "$[2]").cast("int").bitwiseAND(F.lit(NUMERIC)) == 0))
    return value.select(
        "root",
        F.lit(M.SQL).alias("rule"),
        F.lit("sql").alias("op"),
        F.struct(
            F.get_json_object("x", "$[1][1]").alias("path"), F.get_json_object("x", "$[1][2]").cast("int").alias("line"), F.get_json_object("x", "$[1][3]").alias("snippet")
        ).alias("source"),
        F.struct(F.col("place")[2].alias("path"), F.col("place")[3].cast("int").alias("line"), F.col("place")[4].alias("snippet")).alias("sink"),
        F.col("key").alias("callable"),
    )


def scan(
    files: DataFrame,
    operations: tuple[str, ...] = OPERATIONS,
    max_passes: int = MAX_PASSES,
    strict: bool = False,
    fail_fast: bool = False,
    prune: bool = True,
    models: DataFrame | None = None,
) -> DataFrame:
    """Findings of ``files`` (root, path, source).

    Unreadable files are left out (see ``extract_callables``). ``strict`` runs
    loops twice. Rows of one program don't depend on the order of its files.
    ``models`` adds sinks, sources and sanitizers of one's own to the built-in
    ones (see ``taint_models.MODEL_SCHEMA``); callables are not pruned then.
    Result: root, rule_id, path, line, access, severity, required_capability,
    minimum_role, source, sink, callable, entrypoints, finding_key,
    stored_access, score.
    """
    callables = stage(extract_program(files.where("path is not null"), fail_fast), "callables")
    prune = prune and models is None and "surface" not in operations  # signals need callables without any sink
    own = M.further_models(models) if models is not None else None
    summaries, edges, meaning = summarise(callables, max_passes, strict, prune, own)
    c = stage(contexts(summaries, edges, meaning), "contexts")
    flow = F.from_json(F.get_json_object("summary", "$.sinks"), "array<string>")
    parsed = summaries.select("root", "key", F.explode(flow).alias("x")).select(
        "root",
        F.get_json_object("x", "$[0]").alias("rule"),
        F.get_json_object("x", "$[1]").alias("op"),
        F.get_json_object("x", "$[2][0]").alias("kind"),
        F.struct(
            F.get_json_object("x", "$[2][1]").alias("path"),
            F.get_json_object("x", "$[2][2]").cast("int").alias("line"),
            F.get_json_object("x", "$[2][3]").alias("snippet"),
        ).alias("source"),
        F.struct(
            F.get_json_object("x", "$[4][0]").alias("path"),
            F.get_json_object("x", "$[4][1]").cast("int").alias("line"),
            F.get_json_object("x", "$[4][2]").alias("snippet"),
        ).alias("sink"),
        F.get_json_object("x", "$[5]").alias("callable"),
    )
    said = F.when(F.col("op") == "dynamic", "call").when(F.col("op") == "redirect-strict", "action").otherwise(F.col("op"))
    flows = parsed.where((F.col("kind") == "S") & said.isin(*operations)).drop("kind").distinct()
    if "sql" in operations:
        flows = flows.unionByName(query_parts(summaries, meaning).select(*flows.columns)).distinct()
    if "surface" in operations:
        entered = c.where("what = 'entry'").select("root", "key", "kind").distinct()
        more = taint_surfaces.signals(summaries, edges, meaning, entered, callables)
        flows = flows.unionByName(more.select(*flows.columns)).distinct()
        rest = entered.where("kind = 'rest'").select("root", F.col("key").alias("callable"))
        filters = _facts(summaries, "registered").where(F.col("x")[0] == f"h:{M.UPLOAD_FILTER}").select("root", F.col("x")[1].alias("ref"))
        filters = filters.join(meaning, ["root", "ref"]).select("root", F.col("callee").alias("callable"))
        allowed = rest.select("*", F.lit(M.TOKEN).alias("rule")).unionByName(filters.select("*", F.lit(M.UPLOAD_API).alias("rule"))).distinct()
        bound = F.col("rule").isin(M.TOKEN, M.UPLOAD_API)
        flows = flows.where(~bound).unionByName(flows.where(bound).join(allowed, ["root", "callable", "rule"], "left_semi").select(*flows.columns))
    is_check = lambda k: (F.col("what") == "check") & (F.col("kind") == k)
    low = F.coalesce(role_level(minimum_role(F.lower("name"))) <= ROLE_LEVEL["subscriber"], F.lit(False))
    privileged = is_check("capability") & ~low
    folded = c.groupBy("root", "key").agg(
        F.bool_or(privileged).alias("privileged"),
        F.bool_or(is_check("capability")).alias("capability"),
        F.bool_or(is_check("auth")).alias("auth"),
        F.bool_or(is_check("unauth")).alias("unauth"),
        F.bool_or(is_check("nonce")).alias("nonce"),
        F.array_sort(F.collect_set(F.when(F.col("what") == "entry", F.struct(F.col("kind"), F.col("name"), F.col("tier").alias("access"))))).alias("entrypoints"),
        F.min(F.when(is_check("capability") & (F.col("name") != ""), F.struct(F.coalesce(role_level(minimum_role(F.lower("name"))), F.lit(99)), F.lower("name").alias("name")))).alias("cap"),
        F.collect_set(F.when(privileged, F.struct("at", "line"))).alias("cap_places"),
        F.collect_set(F.when(is_check("nonce") | is_check("validation"), F.struct("at", "line"))).alias("nonce_places"),
    )
    tiers = F.transform(F.coalesce("entrypoints", F.array().cast("array<struct<kind:string,name:string,access:string>>")), lambda x: x.getField("access"))
    access = derive_access(F.col("privileged"), F.col("capability"), F.col("auth"), F.col("unauth"), F.col("nonce"), tiers)
    folded = folded.withColumn("access", access)
    stored = stored_access(summaries, callables, folded.select("root", "key", "access"))
    found = (
        flows.withColumn("sp", F.col("source.path"))
        .withColumn("sl", F.col("source.line"))
        .join(folded.withColumnRenamed("key", "callable"), ["root", "callable"], "left")
        .withColumn("access", F.coalesce("access", F.lit("unknown")))
        .join(stored.withColumnsRenamed({"path": "sp", "line": "sl"}), ["root", "sp", "sl"], "left")
    )

    def local(places: str):
        return F.exists(
            F.coalesce(places, F.array().cast("array<struct<at:string,line:int>>")),
            lambda p: (p.getField("at") == F.col("callable")) & (F.col("sink.line") - p.getField("line")).between(0, LOCAL_LINES),
        )

    kinds = F.transform(F.coalesce("entrypoints", F.array().cast("array<struct<kind:string,name:string,access:string>>")), lambda x: x.getField("kind"))
    both = F.array_contains(kinds, "admin_page") & F.array_contains(kinds, "ajax")
    guarded = F.coalesce("privileged", F.lit(False)) & F.when(both, local("cap_places") & local("nonce_places")).otherwise(True)
    rule = F.when((F.col("op") == "delete") & ~guarded & (F.col("access") != "unknown"), M.DELETE).otherwise(F.col("rule"))
    found = found.withColumn("rule_id", rule).where(~(F.col("rule_id").isin(*M.GUARDED_RULES) & guarded))
    found = found.where((F.col("op") != "dynamic") | ~F.coalesce("capability", F.lit(False)))
    best = (
        found.groupBy("root", "rule_id", "source", "sink", "callable")
        .agg(*(F.first(x, ignorenulls=True).alias(x) for x in ("access", "entrypoints", "cap", "stored_access")))
        .withColumn("required_capability", F.col("cap.name"))
    )
    return best.select(
        "root",
        "rule_id",
        F.col("sink.path").alias("path"),
        F.col("sink.line").alias("line"),
        "access",
        access_severity(F.col("access")).alias("severity"),
        "required_capability",
        minimum_role(F.col("required_capability")).alias("minimum_role"),
        "source",
        "sink",
        "callable",
        F.coalesce("entrypoints", F.array().cast("array<struct<kind:string,name:string,access:string>>")).alias("entrypoints"),
        F.concat_ws("|", "rule_id", F.concat_ws(":", "sink.path", F.col("sink.line").cast("string")), F.concat_ws(":", "source.path", F.col("source.line").cast("string"))).alias("finding_key"),
        "stored_access",
        exploitability(F.col("rule_id"), F.col("access"), F.col("stored_access"), F.col("source"), F.col("sink")).alias("score"),
    )
