"""Signals of weak design, for scans that ask for the operation ``surface``.

Each callable gives facts about itself: links that it issues, logins that it
makes, callbacks that it handles, names that it makes up. What a signal needs
beyond one callable is found by joins: the login that takes an issued link in
the same class, the cookie that a callback reaches over calls, the generator
behind a file name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import taint_guards as G
from factloom.operators import taint_models as M
from factloom.operators.closure import reach

#: Pieces of names that tell what something is.
SECRET_KEYS = "bearer token secret api_key apikey auth_key authkey".split()
TOKEN_FIELDS, TOKEN_NAMES = ("token", "bearer"), ("token", "signature", "bearer", "auth")
ISSUING, ISSUED = ("create", "generate", "issue", "refresh"), ("token", "nonce", "auth")
LINK_FIELDS, LOGIN_KEYS = ("login_url", "loginurl", "auth_url", "authurl"), ("login", "auth")
CALLBACK_NAMES, CALLBACK_KEYS = ("callback", "oauth", "login"), "provider code state oauth_token oauth_verifier token userid user_id".split()
CALLBACK_ENTRIES = ("ajax", "admin_post", "front_hook", "rest")
ARTIFACTS, ARTIFACT_TEXTS = ("export", "download", "snapshot"), ("snapshot", "download", "export", ".sql", ".gz", ".zip", "/")
IDENTIFIERS = "token nonce secret uid key snapshot".split()
#: Fixed value: an identifier of fewer bits can be guessed.
WEAK_BITS = 40


def has(text: str | None, pieces) -> bool:
    return any(p in (text or "").lower() for p in pieces)


def number(node) -> int:
    text = G.literal_text(node)
    return int(text) if text and text.isdigit() and node[2] == "number" else 0


def items(node) -> dict[str, tuple]:
    """Values of an array literal by their literal keys."""
    if not isinstance(node, tuple) or node[0] != "array":
        return {}
    return {k.lower(): v for key, v in node[2] if v is not None and isinstance(key, tuple) and (k := G.literal_text(key))}


def name_of(node) -> str:
    """The name of a variable, property, class or called function."""
    if isinstance(node, str):
        return node
    if not isinstance(node, tuple) or len(node) < 3:
        return ""
    at = 3 if node[0] in ("prop", "sprop", "method", "scall") else 2
    return node[at] if isinstance(node[at], str) else ""


def looks_issued(node) -> bool:
    """Whether an expression gives a token: a variable named so, or a call that makes one."""
    if not isinstance(node, tuple):
        return False
    if node[0] == "var":
        return "token" in name_of(node).lower()
    if node[0] not in ("call", "method", "scall"):
        return False
    name = G.short(name_of(node)).lower()
    receiver = name_of(node[2]) if node[0] != "call" else ""
    return has(name, ISSUING) and (has(receiver, TOKEN_NAMES) or has(name, ISSUED))


def token_values(node) -> list[tuple]:
    """Values under token-like keys of what a route returns."""
    if isinstance(node, tuple) and node[0] == "call" and G.short(name_of(node)) in ("rest_ensure_response", "wp_send_json", "wp_send_json_success") and node[3]:
        node = node[3][0]
    elif isinstance(node, tuple) and node[0] == "new" and name_of(node).lower().endswith("wp_rest_response") and node[3]:
        node = node[3][0]
    return [v for k, v in items(node).items() if has(k, TOKEN_FIELDS) and looks_issued(v)]


def validates_token_before(body, line: int) -> bool:
    for n in G.nodes(body):
        if n[0] in ("call", "method", "scall") and n[1] < line:
            name, args = G.short(name_of(n)), n[3] if n[0] == "call" else n[4]
            if name.startswith("validate") and has(name, ("token", "signature", "auth")):
                if not args or any(has(name_of(a) or G.literal_text(a), TOKEN_NAMES) or "header" in name_of(a).lower() for a in args):
                    return True
    return False


def unsafe_upload_test(cond) -> list[tuple]:
    """File names that a condition tests for a piece only, with no comparison of the extension itself."""
    tests = [n[3][0] for n in G.nodes(cond) if n[0] == "call" and G.short(name_of(n)) in ("strpos", "stripos", "str_contains") and n[3] and n[3][0][0] == "var"]
    exact = any(
        n[0] == "binary" and n[2] in G.SAME and any(G.literal_text(a) and b[0] in ("var", "call") and (has(name_of(b), ("ext",)) or G.short(name_of(b)) == "pathinfo") for a, b in ((n[3], n[4]), (n[4], n[3])))
        for n in G.nodes(cond)
    )
    return [] if exact else tests


def query_key(text: str | None) -> str | None:
    """The first key of a query in a piece of an address."""
    for sign in ("?", "&"):
        head, found, rest = (text or "").partition(sign)
        if found and "=" in rest and rest.split("=")[0].strip():
            return rest.split("=")[0].strip()
    return None


def generator_bits(node, params: list[str]) -> tuple[int, int, int] | None:
    """(bits of a character, length, parameter that gives the length or -1) of characters drawn from a shuffled alphabet."""
    if not (isinstance(node, tuple) and node[0] == "call" and G.short(name_of(node)) == "substr" and len(node[3]) > 2):
        return None
    shuffled = node[3][0]
    if not (shuffled[0] == "call" and G.short(name_of(shuffled)) == "str_shuffle" and shuffled[3]):
        return None
    repeated = shuffled[3][0]
    if not (repeated[0] == "call" and G.short(name_of(repeated)) == "str_repeat" and len(repeated[3]) > 1):
        return None
    alphabet = len(set(G.literal_text(repeated[3][0]) or ""))
    if alphabet < 2:
        return None
    lengths = [n for n in (number(repeated[3][1]), number(node[3][2])) if n]
    given = [params.index(name_of(n)) for n in (repeated[3][1], node[3][2]) if n[0] == "var" and name_of(n) in params]
    return math.ceil(math.log2(alphabet)), min(lengths, default=0), given[0] if given else -1


def facts(record: dict, class_name, lines: dict[int, str]) -> list[list]:
    """[kind, one, two, line, text] of a callable."""
    body, cls = record["body"], (record["class"] or "").lower()
    assigned = {n[2][2]: n[3] for n in G.nodes(body) if n[0] == "assign" and len(n) == 5 and n[2][0] == "var"}
    follow = lambda n: assigned.get(n[2], n) if isinstance(n, tuple) and n[0] == "var" else n
    own = record["key"].rsplit("::", 1)[-1].rsplit(":", 1)[-1]
    params = [p[0] for p in record["params"]]
    out: list[list] = []

    def add(kind, one, two, line) -> None:
        out.append([kind, one, two, str(line), lines.get(line, "")])

    def ref(n) -> str | None:
        if n[0] == "call" and isinstance(n[2], str):
            return "f:" + n[2].lstrip("\\").lower()
        if n[0] == "method" and isinstance(n[3], str) and n[2][0] == "var" and n[2][2] == "this" and cls:
            return f"m:{cls}::{n[3].lower()}"
        if n[0] == "scall" and isinstance(n[2], str) and isinstance(n[3], str):
            return f"m:{class_name(n[2])}::{n[3].lower()}"
        return None

    asked = sorted({n[1] for n in G.nodes(body) if n[0] == "index" and n[2][0] == "var" and n[2][2] in ("_GET", "_POST", "_REQUEST") and n[3] and (G.literal_text(n[3]) or "").lower() in CALLBACK_KEYS})
    closed = [n[1] for n in G.nodes(body) if n[0] == "if" and any("users_can_register" in repr(c) and G.aborts(b) for c, b in n[2])]
    for n in G.nodes(body):
        if n[0] == "call" and G.short(name_of(n)) in M.JSON_OUTPUT and n[3]:
            for field, value in items(follow(n[3][0])).items():
                if field in LINK_FIELDS:
                    for piece in G.nodes(follow(value)):
                        key = query_key(G.literal_text(piece))
                        if key and has(key, LOGIN_KEYS):
                            add("issues", cls, key.lower(), value[1])
        elif n[0] == "index" and n[2][0] == "var" and n[2][2] in ("_GET", "_REQUEST") and n[3] and G.literal_text(n[3]):
            add("takes", cls, G.literal_text(n[3]).lower(), n[1])
        if n[0] == "call" and G.short(name_of(n)) == "wp_set_auth_cookie":
            add("cookie", cls, "", n[1])
        if n[0] in ("method", "scall") and (has(own, CALLBACK_NAMES) or has(name_of(n), CALLBACK_NAMES)) and ref(n):
            before = [x for x in asked if x < n[1]]
            if before and not any(x < n[1] for x in closed):
                add("handles", ref(n), "", before[-1])
        if n[0] == "return" and n[2] is not None:
            value = follow(n[2])
            if has(own, IDENTIFIERS) and (bits := generator_bits(value, params)):
                out.append(["generates", ",".join(map(str, bits)), "", str(n[1]), lines.get(n[1], "")])
            if has(own, ARTIFACTS) and any(has(G.literal_text(x), ARTIFACT_TEXTS) for x in G.nodes(n[2])):
                for x in G.nodes(n[2]):
                    made = follow(x) if x[0] == "var" else x
                    if made[0] in ("call", "method", "scall") and (at := ref(made)):
                        lengths = ",".join(str(number(a)) for a in (made[3] if made[0] == "call" else made[4]))
                        add("names", at, lengths, n[1])
    return out


def signals(summaries: DataFrame, edges: DataFrame, meaning: DataFrame, entries: DataFrame, callables: DataFrame) -> DataFrame:
    """(root, rule, op, source, sink, callable) of the signals that need joins.

    ``entries``: root, key, kind of the entry points that reach a callable.
    """
    f = summaries.select("root", "key", F.explode(F.from_json(F.get_json_object("summary", "$.facts"), "array<array<string>>")).alias("x")).select(
        "root", "key", *(F.col("x")[i].alias(n) for i, n in enumerate(("fact", "one", "two"))), F.col("x")[3].cast("int").alias("line"), F.col("x")[4].alias("text")
    ).join(callables.select("root", "key", "path"), ["root", "key"])
    place = lambda path="path", line="line", text="text": F.struct(F.col(path).alias("path"), F.col(line).alias("line"), F.col(text).alias("snippet"))
    kind = lambda k: f.where(F.col("fact") == k)
    cookie = kind("cookie").select("root", F.col("key").alias("at"), place().alias("sink"))

    def out(df: DataFrame, rule: str) -> DataFrame:
        return df.select("root", F.lit(rule).alias("rule"), F.lit("surface").alias("op"), "source", "sink", F.col("key").alias("callable"))

    takes = kind("takes").select("root", F.col("key").alias("at"), "one", "two").distinct().join(cookie, ["root", "at"])
    issued = kind("issues").where("one <> ''").withColumn("source", place()).join(takes, ["root", "one", "two"]).where(F.col("key") != F.col("at"))
    handled = kind("handles").withColumn("source", place()).withColumnRenamed("one", "ref").join(meaning, ["root", "ref"])
    handled = handled.join(entries.where(F.col("kind").isin(*CALLBACK_ENTRIES)).select("root", "key").distinct(), ["root", "key"], "left_semi")
    node = lambda c: F.concat_ws("\n", "root", c)
    # Back from the cookies over the calls; every cookie keeps its own way.
    marked = cookie.select("root", "at", node("at").alias("start")).distinct()
    back = reach(edges.select(node("callee").alias("src"), node("caller").alias("dst")), marked.select(F.col("start").alias("node"))).select(F.split("node", "\n", 2).alias("p"))
    setting = back.select(F.col("p")[0].alias("root"), F.col("p")[1].alias("callee")).distinct()
    first = cookie.groupBy("root").agg(F.min("sink").alias("sink"))
    called = handled.join(setting, ["root", "callee"], "left_semi").join(first, "root")
    made = kind("generates").select("root", F.col("key").alias("callee"), F.split("one", ",").cast("array<int>").alias("g"), place().alias("source")).join(
        meaning, ["root", "callee"]
    )
    named = kind("names").withColumn("sink", place()).withColumnRenamed("one", "ref").join(made, ["root", "ref"])
    said = F.coalesce(F.try_element_at(F.split("two", ",").cast("array<int>"), F.col("g")[2] + 1), F.lit(0))
    lengths = F.filter(F.array(F.col("g")[1], F.when(F.col("g")[2] >= 0, said)), lambda n: n > 0)
    named = named.where((F.size(lengths) > 0) & (F.col("g")[0] * F.array_min(lengths) < WEAK_BITS))
    return out(issued, M.AUTH_LINK).unionByName(out(called, M.OAUTH)).unionByName(out(named, M.IDENTIFIER))
