"""Flow-sensitive evaluation of one callable to a summary of its data flow.

A summary tells what the callable returns, which parameters reach which sinks,
what it writes to stores, which findings are certain, whom it calls, what it
checks and what it registers. It holds plain JSON values. Calls take effect
through the summaries of the callees; no other callable is looked into.
"""

from __future__ import annotations

import json
import re

from factloom.functions import sql_text
from factloom.operators import taint_guards as G
from factloom.operators import taint_models as M
from factloom.operators import taint_surfaces as S

PERSISTENT, PATH_SAFE, HTML_SAFE, HTML_UNSAFE, NUMERIC, SECRET = 1, 2, 4, 8, 16, 32
#: Most segments of a path; a longer one is cut, which keeps recursion finite.
DEPTH = 16
#: Fixed value: a format that takes a text.
_TAKES_TEXT = re.compile(r"(?:^|[^%])(?:%%)*%[0-9$.+ '#-]*s")
_FUNCTIONS = M.by_name(M.FUNCTION_SINKS, 2)
_METHODS = M.by_name(M.METHOD_SINKS, 2)
_READS = M.by_name(M.STORE_READS, 0)
_WRITES = M.by_name(M.STORE_WRITES, 0)
_CHECKS = {n for names in M.CHECKS.values() for n in names.split()}


class Value:
    """Origins (key to flags), and values under keys; ``*`` stands for any key."""

    __slots__ = ("origins", "fields", "type", "text")

    def __init__(self, origins=None, fields=None, type=None, text=None):
        self.origins: dict[tuple, int] = dict(origins or {})
        self.fields: dict[str, Value] = dict(fields or {})
        self.type: str | None = type
        self.text: str | None = text

    def join(self, other: Value) -> Value:
        out = Value(self.origins, self.fields, self.type if self.type == other.type else None)
        for k, f in other.origins.items():
            out.origins[k] = out.origins.get(k, 0) | f
        for k, v in other.fields.items():
            out.fields[k] = out.fields[k].join(v) if k in out.fields else v
        return out

    def all(self) -> dict[tuple, int]:
        """Origins of the value and of everything under it."""
        out = dict(self.origins)
        for v in self.fields.values():
            for k, f in v.all().items():
                out[k] = out.get(k, 0) | f
        return out

    def flat(self, flag: int = 0, clear: int = 0) -> Value:
        return Value({k: (f | flag) & ~clear for k, f in self.all().items()})

    def at(self, key: str) -> Value:
        """What stands under a key: the field if it is known, else what the whole value carries."""
        out = Value({deeper(k, key): f for k, f in self.origins.items()})
        if key == "*":
            for v in self.fields.values():
                out = out.join(v)
            return out
        for k in (key, "*"):
            if k in self.fields:
                out = out.join(self.fields[k])
        return out

    def paths(self, prefix: tuple = (), depth: int = 0):
        for k, f in self.origins.items():
            yield prefix, k, f
        if depth < DEPTH:
            for name, v in self.fields.items():
                yield from v.paths((*prefix, name), depth + 1)


def deeper(key: tuple, name: str) -> tuple:
    """The origin of an element: parameters and receivers keep the path to it."""
    if key[0] in ("P", "R"):
        path = key[-1]
        return (*key[:-1], (*path, name)[:DEPTH])
    return key


def literal(node) -> str | None:
    """Text of a literal, of joined literals, and of magic directory constants as nothing."""
    if not isinstance(node, tuple):
        return None
    if node[0] == "literal":
        return node[3] if node[2] in ("string", "number") else None
    if node[0] == "concat":
        parts = [literal(p) for p in node[2]]
        return None if None in parts else "".join(parts)
    if node[0] == "binary" and node[2] == ".":
        a, b = literal(node[3]), literal(node[4])
        return None if a is None or b is None else a + b
    if node[0] == "name" and node[2] in ("__DIR__", "__FILE__"):
        return ""
    return None


class Stop(Exception):
    """The path ends: return, exit, throw."""


class Exit(Stop):
    """The request ends with the path."""


class Interpreter:
    def __init__(self, record: dict, summaries: dict[str, list[dict]], strict: bool = False):
        self.r = record
        self.summaries = summaries
        self.strict = strict
        self.env: dict[str, Value] = {}
        self.returns = Value()
        self.sinks: dict[tuple, list] = {}
        self.stores: dict[tuple, list] = {}
        self.calls: dict[str, int] = {}
        self.checks: set[tuple] = set()
        self.entries: set[tuple] = set()
        self.registered: set[tuple] = set()
        self.reads: set[tuple] = set()
        self.models: dict[str, dict[str, list]] = record.get("models") or {}
        self.literals: dict[str, str] = record.get("literals") or {}
        self.variants: set[tuple] = set()
        self.props: set[tuple] = set()
        self.returns_none = True
        self.given: list[tuple] = []
        self.constants: dict[str, str] = record.get("constants") or {}
        self.real_paths: set[str] = set()
        self.assigned: dict[str, tuple] = {}
        self.looked: set[str] = set()
        self.sanitized = G.sanitized_returns(record["body"])
        self.record_read = any(
            isinstance(name, str) and M.reads_records(name)
            for n in G.nodes(record["body"])
            for name in [n[2] if n[0] == "call" else n[3] if n[0] in ("method", "scall") else None]
        )

    # Results
    def run(self) -> dict:
        for i, (name, hint, default, spread) in enumerate(self.r["params"]):
            own = Value({("P", i, ()): 0}, type=hint.lstrip("?\\").lower() or None)
            self.env[name] = Value(fields={"*": own}) if spread else own
            if not spread and str(i) in self.literals:  # a clone for calls that give this text
                self.env[name] = Value(text=self.literals[str(i)])
        for name in self.r.get("uses") or []:
            self.env.setdefault(name, Value())
        if self.r["kind"] == "file" and not any("defined(" in t.replace(" ", "") for n, t in self.r["lines"].items() if n <= 24):
            self.entries.add((self.r.get("name", self.r["key"]), "file", self.r["path"], "unknown"))  # may be requested by itself
        if self.r["class"]:
            self.env["this"] = Value({("R", ()): 0}, type=self.r["class"].lower())
        own = (self.r["class"] or "").lower() or None
        guards = G.Guards(self.r["body"], own, self.class_name, self.from_request)
        self.checks, self.assigned = guards.found, guards.assigned
        ends = False
        try:
            self.walk(self.r["body"])
        except Exit:
            ends = self.returns_none
        except Stop:
            pass
        return {
            "returns": sorted([list(p), _plain(k), f] for p, k, f in self.returns.paths()),
            "sinks": sorted(self.sinks.values(), key=repr),
            "stores": sorted(self.stores.values(), key=repr),
            "calls": sorted(self.calls.items()),
            "checks": sorted(self.checks),
            "entries": sorted(self.entries),
            "registered": sorted(self.registered),
            "reads": sorted(self.reads),
            "type": self.returns.type,
            "text": self.returns.text,
            "props": sorted(self.props),
            "facts": S.facts(self.r, self.class_name, self.r["lines"]),
            "ends": ends,
            "variants": sorted(self.variants),
            "given": sorted({(_plain_text(k), f, *place) for k, f, place in self.given}),
        }

    @staticmethod
    def from_request(node) -> bool:
        """Whether an expression names request data itself."""
        return any(n[0] == "var" and n[2] in M.SUPERGLOBALS for n in G.nodes(node))

    def text(self, node) -> str | None:
        """Text of an expression where it is certain: literals, joined ones, constants, and variables that hold such."""
        if not isinstance(node, tuple):
            return None
        if node[0] == "concat" or (node[0] == "binary" and node[2] == "."):
            parts = [self.text(p) for p in (node[2] if node[0] == "concat" else node[3:5])]
            return None if None in parts else "".join(parts)
        if node[0] == "name" and node[2] not in ("__DIR__", "__FILE__"):
            return self.constants.get(constant_name(node[2]))
        if node[0] == "cconst" and isinstance(node[2], str) and isinstance(node[3], str):
            return self.constants.get(f"{self.class_name(node[2])}::{node[3]}")
        if node[0] == "var":
            held = self.env.get(node[2])
            return held.text if held is not None and not held.origins else None
        if node[0] == "call" and isinstance(node[2], str):
            known = self.summaries.get("f:" + node[2].lstrip("\\").lower()) or []
            texts = {s.get("text") for s in known}
            return texts.pop() if len(texts) == 1 else None
        return literal(node)

    def pattern(self, node) -> str | None:
        """Text with ``{}`` for what isn't certain; None where nothing is."""
        if isinstance(node, tuple) and (node[0] == "concat" or (node[0] == "binary" and node[2] == ".")):
            parts = [self.pattern(p) or "{}" for p in (node[2] if node[0] == "concat" else node[3:5])]
            joined = "".join(parts).replace("{}{}", "{}")
            return joined if joined.replace("{}", "") else None
        known = self.text(node)
        if known is None and isinstance(node, tuple) and node[0] == "var" and node[2] in self.assigned and node[2] not in self.looked:
            self.looked.add(node[2])
            known = self.pattern(self.assigned[node[2]])
            self.looked.discard(node[2])
        return known

    def place(self, line: int) -> tuple:
        return (self.r["path"], line, self.r["lines"].get(line, ""))

    def emit(self, rule: str, op: str, value: Value, line: int) -> None:
        for key, flags in value.all().items():
            self.emit_one(rule, op, key, flags, self.place(line), self.r["key"])

    def output(self, value: Value, line: int) -> None:
        """What is shown: stored values, and request values; those that choose records have a rule of their own."""
        for key, flags in value.all().items():
            if self.record_read:
                self.emit_one(M.RECORD, "output", key, flags, self.place(line), self.r["key"])
            if not self.record_read or flags & PERSISTENT or key[0] != "S":
                self.emit_one(M.REFLECTED, "output", key, flags, self.place(line), self.r["key"])

    def emit_one(self, rule: str, op: str, key: tuple, flags: int, sink: tuple, holder: str) -> None:
        """Keep a flow unless what is known of it makes it harmless; parameters stay open."""
        concrete = key[0] == "S"
        if op == "sql" and flags & NUMERIC:
            return
        if op in ("read", "open", "delete", "include") and flags & (PATH_SAFE | NUMERIC):
            return
        if op == "output" and rule != M.RECORD:
            unsafe = bool(flags & HTML_UNSAFE)
            if flags & PERSISTENT:
                if flags & HTML_SAFE and not unsafe:
                    return
                rule = M.STORED
            elif flags & (HTML_SAFE | NUMERIC):
                return
            elif concrete or rule != M.STORED:
                rule = M.REFLECTED
        if op == "redirect-strict" and flags & HTML_SAFE:
            return
        self.sinks.setdefault((rule, op, key, sink), [rule, op, _plain(key), flags, list(sink), holder])[3] |= flags

    # Statements
    def walk(self, body: list[tuple]) -> None:
        for s in body:
            getattr(self, "s_" + s[0], self.s_other)(s)

    def branches(self, bodies: list) -> None:
        """Run each body on its own copy of the state and join what goes on; end if nothing does."""
        start, left, exits = self.env, [], bool(bodies)
        for body in bodies:
            self.env = dict(start)
            try:
                body() if callable(body) else self.walk(body)
            except Stop as stop:
                exits = exits and isinstance(stop, Exit)
                continue
            left.append(self.env)
        if not left:
            self.env = start
            raise Exit if exits else Stop
        joined = left[0]
        for other in left[1:]:
            for k in joined.keys() | other.keys():
                a, b = joined.get(k), other.get(k)
                joined[k] = a.join(b) if a and b and a is not b else (a or b)
        self.env = joined

    def s_other(self, s) -> None:
        return

    def s_expr(self, s) -> None:
        self.eval(s[2])

    def s_block(self, s) -> None:
        self.walk(s[2])

    def s_echo(self, s) -> None:
        for e in s[2]:
            self.output(self.eval(e), s[1])

    def s_if(self, s) -> None:
        arms, other = s[2], s[3]
        bodies = []
        for cond, body in arms:
            known = truth(cond, self.text)
            self.eval(cond)
            if known is False:
                continue
            safe = G.safe_in_branch(cond, self.real_paths, self.text)
            bodies.append(self.proved(safe, body) if safe else body)
            self.upload_test(cond, body)
            if known is True:
                break
        else:
            bodies.append(other or [])
        self.branches(bodies)
        if len(arms) == 1 and not other and G.aborts(arms[0][1]):
            if name := G.equals_its_realpath(arms[0][0], G.DIFFERENT):
                self.mark_paths({name})

    def upload_test(self, cond, body) -> None:
        """An upload's type set because its name holds a piece of text."""
        first = self.r["params"][0][0] if self.r["params"] else None
        names = S.unsafe_upload_test(cond) if first else []
        for n in body if names else ():
            target = n[2][2] if n[0] == "expr" and n[2][0] == "assign" else None
            if target and target[0] == "index" and target[2] == ("var", target[2][1], first) and literal(target[3]) in ("ext", "type"):
                for name in names:
                    self.emit(M.UPLOAD_API, "surface", Value({("S", *self.place(name[1])): 0}), target[1])

    def mark_paths(self, names: set[str]) -> None:
        for name in names:
            if name in self.env:
                self.env[name] = self.env[name].flat(PATH_SAFE)

    def proved(self, names: set[str], body):
        def run():
            before = {n: self.env[n] for n in names if n in self.env}
            self.mark_paths(names)
            marked = {n: self.env[n] for n in before}
            self.walk(body)
            for n, v in marked.items():  # the proof ends with the branch
                if self.env.get(n) is v:
                    self.env[n] = before[n]

        return run

    def s_while(self, s) -> None:
        self.eval(s[2])
        self.loop(s[3])

    def loop(self, body) -> None:
        """A body that may run or not; the strict profile runs it twice, for what one turn hands to the next."""
        for _ in range(2 if self.strict else 1):
            self.branches([body, []])

    def s_for(self, s) -> None:
        for e in s[2]:
            self.eval(e)
        self.loop(s[3])

    def s_foreach(self, s) -> None:
        v = self.eval(s[2])
        if s[3]:
            self.assign(s[3], Value(v.origins))
        self.assign(s[4], v.at("*"))
        self.loop(s[5])

    def s_switch(self, s) -> None:
        self.eval(s[2])
        bodies = []
        for i, (test, _) in enumerate(s[3]):
            if test is not None:
                self.eval(test)
            through: list[tuple] = []
            for _, body in s[3][i:]:
                through += body
                if any(x[0] in ("break", "return", "continue") for x in body):
                    break
            bodies.append(through)
        if not any(t is None for t, _ in s[3]):
            bodies.append([])
        self.branches(bodies)

    def s_return(self, s) -> None:
        self.returns_none = False
        if s[2] is not None:
            v = self.eval(s[2])
            kind = v.type
            if s[2][0] == "var" and s[2][2] in self.sanitized:
                v = v.flat(PATH_SAFE)
            for token in S.token_values(s[2]):
                if not S.validates_token_before(self.r["body"], s[1]):
                    fresh = {k: f for k, f in self.eval(token).all().items() if not f & PERSISTENT}
                    self.emit(M.TOKEN, "surface", Value(fresh), token[1])
            self.given += [(k, f, self.place(s[1])) for k, f in v.all().items()]
            self.returns = self.returns.join(v)
            self.returns.type = kind
            self.returns.text = self.text(s[2]) if len(self.r["body"]) == 1 else None
        raise Stop

    def s_throw(self, s) -> None:
        self.eval(s[2])
        raise Stop

    def s_try(self, s) -> None:
        start = dict(self.env)

        def caught(body):
            def run():
                self.env = {k: v.join(self.env[k]) if k in self.env else v for k, v in start.items()} | {
                    k: v for k, v in self.env.items() if k not in start
                }
                self.walk(body)

            return run

        self.branches([s[2], *(caught(b) for _, b in s[3])])
        self.walk(s[4])

    def s_unset(self, s) -> None:
        for e in s[2]:
            self.assign(e, Value())

    def s_static(self, s) -> None:
        for e in s[2]:
            self.eval(e)

    # Assignment
    def assign(self, target, value: Value) -> None:
        kind = target[0]
        if kind == "var":
            self.env[target[2]] = value
            self.real_paths.discard(target[2])
        elif kind == "array":
            for i, (key, item) in enumerate(target[2]):
                if item is not None:
                    self.assign(item, value.at(literal(key) or str(i) if key else str(i)))
        elif kind in ("index", "prop"):
            base, name = target[2], self.key(target[3])
            old = self.eval(base)
            new = Value(old.origins, old.fields, old.type)
            if kind == "prop" and base[0] == "var" and base[2] == "this" and value.type and isinstance(target[3], str):
                self.props.add((f"{(self.r['class'] or '').lower()}->{name}", value.type))
            if name == "*" or target[3] is None:
                new.fields["*"] = new.fields["*"].join(value) if "*" in new.fields else value
            else:
                new.fields[name] = value
            if base[0] in ("var", "index", "prop", "sprop"):
                self.assign(base, new)
        elif kind == "sprop":
            self.env[f"::{target[2]}::{target[3]}"] = value

    def key(self, node) -> str:
        if isinstance(node, str):
            return node
        return self.text(node) or "*" if node is not None else "*"

    # Expressions
    def eval(self, e) -> Value:
        if not isinstance(e, tuple):
            return Value()
        return getattr(self, "e_" + e[0], self.e_other)(e)

    def e_other(self, e) -> Value:
        return Value()

    def e_literal(self, e) -> Value:
        return Value(text=e[3])

    def e_var(self, e) -> Value:
        name = e[2]
        if name in M.SUPERGLOBALS or name == "_SERVER":
            return Value({("S", *self.place(e[1])): 0})
        return self.env.get(name, Value())

    def e_varvar(self, e) -> Value:
        return self.eval(e[2])

    def e_index(self, e) -> Value:
        if e[2][0] == "var" and e[2][2] == "_SERVER":
            key = (literal(e[3]) or "").upper()
            return Value({("S", *self.place(e[1])): 0}) if key in M.SERVER_KEYS or key.startswith("HTTP_") else Value()
        if e[3] is not None:
            self.eval(e[3])
        return self.eval(e[2]).at(self.key(e[3]))

    def e_prop(self, e) -> Value:
        out = self.eval(e[2]).at(self.key(e[3]))
        if out.type is None and e[2][0] == "var" and e[2][2] == "this" and isinstance(e[3], str):
            out = Value(out.origins, out.fields, f"?{(self.r['class'] or '').lower()}->{e[3]}", out.text)
        return out

    def e_name(self, e) -> Value:
        return Value(text=self.text(e))

    e_cconst = e_name

    def e_sprop(self, e) -> Value:
        return self.env.get(f"::{e[2]}::{e[3]}", Value())

    def e_array(self, e) -> Value:
        out = Value()
        for i, (key, item) in enumerate(e[2]):
            if item is None:
                continue
            v = self.eval(item)
            if key == ("spread",):
                out = out.join(v)
                continue
            name = str(i) if key is None else self.key(key)
            if isinstance(key, tuple):
                self.eval(key)
            out.fields[name] = out.fields[name].join(v) if name in out.fields else v
        return out

    def e_concat(self, e) -> Value:
        out = Value()
        for part in e[2]:
            out = out.join(self.eval(part).flat())
        return out

    def e_binary(self, e) -> Value:
        a = self.eval(e[3])
        b = self.maybe(e[4]) if e[2] in ("&&", "||", "and", "or", "??") else self.eval(e[4])
        if e[2] == "??":
            return a.join(b)
        if e[2] == ".":
            return a.flat().join(b.flat())
        if e[2] in ("+", "-", "*", "/", "%", "**", "<<", ">>", "|", "&", "^"):
            return a.flat(NUMERIC | HTML_SAFE).join(b.flat(NUMERIC | HTML_SAFE)) if e[2] != "+" else a.join(b)
        return Value()

    def maybe(self, e) -> Value:
        """A part that may not be evaluated: if it ends the path, the path goes on without it."""
        try:
            return self.eval(e)
        except Stop:
            return Value()

    def e_unary(self, e) -> Value:
        v = self.eval(e[3])
        if e[2] in ("!",):
            return Value()
        return v if e[2] in ("@", "&") else v.flat(NUMERIC | HTML_SAFE)

    def e_cast(self, e) -> Value:
        v = self.eval(e[3])
        if e[2] in ("int", "integer", "float", "double", "bool", "boolean"):
            return v.flat(NUMERIC | HTML_SAFE)
        return v

    def e_ternary(self, e) -> Value:
        c = self.eval(e[2])
        a = c if e[3] is None else self.maybe(e[3])
        return a.join(self.maybe(e[4]))

    def e_match(self, e) -> Value:
        self.eval(e[2])
        out = Value()
        for tests, value in e[3]:
            for t in tests or []:
                self.eval(t)
            out = out.join(self.maybe(value))
        return out

    def e_isset(self, e) -> Value:
        return Value()

    def e_print(self, e) -> Value:
        self.output(self.eval(e[2]), e[1])
        return Value()

    def e_clone(self, e) -> Value:
        return self.eval(e[2])

    e_yield = e_clone

    def e_throw(self, e) -> Value:
        self.eval(e[2])
        raise Stop

    def e_exit(self, e) -> Value:
        for a in e[2]:
            self.output(self.eval(a), e[1])
        raise Exit

    def e_eval(self, e) -> Value:
        for a in e[2]:
            self.emit(M.USE, "call", self.eval(a), e[1])
        return Value()

    def e_shell(self, e) -> Value:
        self.emit(M.USE, "call", self.eval(e[2]), e[1])
        return Value()

    def e_include(self, e) -> Value:
        self.emit(M.INCLUDE, "include", self.eval(e[2]), e[1])
        if text := literal(e[2]) or self.text(e[2]):
            parts: list[str] = self.r["path"].split("/")[:-1]
            for part in text.split("/"):
                if part == "..":
                    parts = parts[:-1]
                elif part not in ("", "."):
                    parts.append(part)
            self.apply("file:" + "/".join(parts), [], None, e[1])
        return Value()

    def e_closure(self, e) -> Value:
        return Value(type=f"closure:{self.r['path']}:{e[5]}")

    def e_assign(self, e) -> Value:
        v = self.eval(e[3])
        if e[4] == ".=":
            v = self.eval(e[2]).flat().join(v.flat())
        elif e[4] == "??=":
            v = self.eval(e[2]).join(v)
        elif e[4] != "=":
            v = self.eval(e[2]).flat(NUMERIC | HTML_SAFE).join(v.flat(NUMERIC | HTML_SAFE))
        if e[4] == "=" and e[2][0] == "var":
            if v.text is None and (text := self.text(e[3])) is not None:
                v = Value(v.origins, v.fields, v.type, text)
        self.assign(e[2], v)
        if e[4] == "=" and e[2][0] == "var" and e[3][0] == "call" and isinstance(e[3][2], str) and G.short(e[3][2]) == "realpath":
            self.real_paths.add(e[2][2])
        return v

    def e_new(self, e) -> Value:
        args = [self.eval(a) for a in e[3]]
        if not isinstance(e[2], str):
            if isinstance(e[2], tuple) and e[2][0] == "class":
                return Value(type=nameless(e[2][2], self.r["path"]))
            self.emit(M.USE, "dynamic", self.eval(e[2]), e[1])
            return Value()
        name = self.class_name(e[2])
        if name == "rawsql" and args:
            self.emit(M.SQL, "sql", args[0], e[1])
        out = self.apply(f"m:{name}::__construct", args, None, e[1])
        held = Value(type=name)
        if out is None and args:
            held.origins = {k: f for a in args for k, f in a.all().items()}
        return held

    def class_name(self, name: str) -> str:
        low = name.lstrip("\\").lower()
        if low in ("self", "static"):
            return (self.r["class"] or "").lower()
        if low == "parent":
            return (self.r["parent"] or "").lower()
        return low

    # Calls
    def callback(self, node) -> str | None:
        """Reference of a callback given as a string, a pair or a closure."""
        if node[0] == "closure":
            return f"closure:{self.r['path']}:{node[5]}"
        text = self.text(node)
        if text:
            low = text.lstrip("\\").lower()
            return f"m:{self.class_name(low.split('::')[0])}::{low.split('::')[1]}" if "::" in low else f"f:{low}"
        if node[0] == "array" and len(node[2]) == 2 and node[2][1][1] is not None:
            method, owner = self.pattern(node[2][1][1]), node[2][0][1]
            if method and owner is not None:
                if self.text(owner):
                    return f"m:{self.class_name(self.text(owner))}::{method.lower()}"
                if owner[0] == "cconst":
                    return f"m:{self.class_name(owner[2]) if isinstance(owner[2], str) else '?'}::{method.lower()}"
                kind = self.eval(owner).type
                return f"m:{kind or '?'}::{method.lower()}"
        return None

    def apply(self, ref: str, args: list[Value], receiver: Value | None, line: int) -> Value | None:
        """Effects of a call through the callees' summaries; None where none is known."""
        self.calls[ref] = min(line, self.calls.get(ref, line))
        known = self.summaries.get(ref)
        if texts := {str(i): a.text for i, a in enumerate(args) if a.text is not None and not a.all()}:
            given = json.dumps(texts, sort_keys=True)
            known = self.summaries.get(f"{ref}@{given}") or known
            if not self.literals:  # clones make no clones, or texts could grow for ever
                self.variants.add((ref, given))
        if not known:
            return None
        out = Value()
        for s in known:

            def back(key) -> dict[tuple, int]:
                key = _key(key)
                if key[0] == "S":
                    return {key: 0}
                if key[0] == "P":
                    got = args[key[1]] if key[1] < len(args) else Value()
                else:
                    got = receiver or Value()
                for name in key[-1]:
                    got = got.at(name)
                return got.all()

            for path, key, flags in s["returns"]:
                at = out
                for name in path:
                    at = at.fields.setdefault(name, Value())
                for k, f in back(key).items():
                    at.origins[k] = at.origins.get(k, 0) | f | flags
            for rule, op, key, flags, sink, holder in s["sinks"]:
                if key[0] != "S":
                    for k, f in back(key).items():
                        self.emit_one(rule, op, k, f | flags, tuple(sink), holder)
            for family, name, key, flags, place in s["stores"]:
                if key[0] != "S":
                    for k, f in back(key).items():
                        self.store(family, name, k, f | flags, tuple(place))
            out.type = s.get("type") or out.type
        if all(s.get("ends") for s in known):
            raise Exit
        return out

    def store(self, family: str, name: str, key: tuple, flags: int, place: tuple) -> None:
        self.stores.setdefault((family, name, key, place), [family, name, _plain(key), flags, list(place)])[3] |= flags

    def e_call(self, e) -> Value:
        if not isinstance(e[2], str):
            callee = self.eval(e[2])
            args = [self.eval(a) for a in e[3]]
            if callee.type and callee.type.startswith("closure:"):
                got = self.apply(callee.type, args, None, e[1])
                return got if got is not None else _union(args)
            if callee.all():
                self.emit(M.USE, "dynamic", callee, e[1])
            if named := self.pattern(e[2]):
                got = self.apply("f:" + named.lstrip("\\").lower(), args, None, e[1])
                if got is not None:
                    return got
            return _union(args)
        full = e[2].lstrip("\\").lower()
        name = full.rsplit("|", 1)[-1]
        args = [self.eval(a) for a in e[3]]
        line = e[1]
        if name in _CHECKS:
            return Value()
        if name in ("wp_die", "die"):
            if args:
                self.output(args[0], line)
            raise Exit
        if name in M.JSON_OUTPUT:
            if args and self.record_read:
                self.output_records(args[0], line)
            raise Exit
        if self.hooks(name, e, args):
            return args[1] if name.startswith("apply_filters") and len(args) > 1 else Value()
        if name in M.NUMERIC:
            return _union(args).flat(NUMERIC | HTML_SAFE)
        if name in M.PATH_SAFE:
            return _union(args).flat(PATH_SAFE)
        if name == "compact":
            return Value(fields={t: self.env.get(t, Value()) for a in e[3] if (t := literal(a))})
        if name == "extract" and args:
            for k, v in args[0].fields.items():
                self.env[k] = v
            return Value()
        if name in M.DYNAMIC_CALLS and args and not (e[3] and self.callback(e[3][0])):
            self.emit(M.USE if e[3][0][0] == "array" else M.RENDER, "dynamic", args[0], line)
        if name in M.ROLE_FUNCTIONS and args:
            self.grant(args[0].at(M.ROLE_KEY), e[3][0], line)
            return Value()
        if name in M.RIGHTS_META_FUNCTIONS and len(args) > 2 and (self.text(e[3][1]) or "").lower().strip("\"'").endswith(M.RIGHTS_META):
            self.emit(M.PRIVILEGE, "call", args[2], line)
            return Value()
        if name in ("array_map", "array_walk") and len(args) > 1 and (self.text(e[3][0 if name == "array_map" else 1]) or "") in ("unserialize", "maybe_unserialize"):
            self.emit(M.OBJECT, "call", args[1 if name == "array_map" else 0], line)
        if name in M.DOWNLOADS and self.record_read and self.attachment_before(line):
            for key in {k for v in self.env.values() for k in v.all()}:
                self.emit_one(M.ACTION, "action", key, 0, self.place(line), self.r["key"])
        if name in self.models.get("source", {}):
            return Value({("S", *self.place(line)): 0})
        for _, flag, _, _ in self.models.get("sanitizer", {}).get(name, []):
            return _union(args).flat({"html": HTML_SAFE, "path": PATH_SAFE, "number": NUMERIC | HTML_SAFE}.get(flag, 0))
        for rule, op, _, positions in [*_FUNCTIONS.get(name, []), *self.models.get("function", {}).get(name, [])]:
            if rule == M.OBJECT and len(e[3]) > 1 and "allowed_classes" in repr(e[3][1]) and "'false'" in repr(e[3][1]):
                continue
            if name in ("printf", "vprintf") and (form := self.text(e[3][0]) if e[3] else None) is not None and not _TAKES_TEXT.search(form):
                continue
            for i in positions:
                if i < len(args):
                    if op == "output":
                        self.output(args[i], line)
                    else:
                        self.emit(rule, op, args[i], line)
        if name in M.LINK_FIRST and args:
            self.emit(M.SQL, "sql", args[1 if len(args) > 1 else 0], line)
        if name in M.DYNAMIC_CALLS and e[3] and (ref := self.callback(e[3][0])):
            got = self.apply(ref, args[1:], None, line)
            return got if got is not None else _union(args[1:])
        if name in M.REQUEST_FUNCTIONS or (name in M.BODY_READERS and e[3] and self.text(e[3][0]) == "php://input"):
            return Value({("S", *self.place(line)): 0})
        if name in M.REMOTE_FUNCTIONS:
            return Value({("S", *self.place(line)): 0})
        for _, family, key_at, value_at in _WRITES.get(name, []):
            if value_at < len(args):
                key = self.text(e[3][key_at]) or "*"
                for k, f in args[value_at].all().items():
                    self.store(family, key, k, f, self.place(line))
            return Value()
        for _, family, key_at in _READS.get(name, []):
            key = self.text(e[3][key_at]) if key_at < len(e[3]) else None
            self.reads.add((family, key or "*", line))
            secret = SECRET if family == "option" and S.has(key, S.SECRET_KEYS) else 0
            return Value({("S", *self.place(line)): PERSISTENT | secret})
        if name in M.HTML_UNSAFE:
            return _union(args).flat(HTML_UNSAFE)
        if name in M.HTML_SAFE:
            out = _union(args).flat(HTML_SAFE, HTML_UNSAFE)
            if name in ("esc_html_e", "esc_attr_e"):
                return Value()
            return out
        if name == "array_merge":
            out = Value()
            for a in args:
                out = out.join(a)
            return out
        if name in M.PROPAGATORS:
            return _union(args)
        got = self.apply(f"f:{full}", args, None, line)
        return got if got is not None else _union(args)

    def hooks(self, name: str, e, args: list[Value]) -> bool:
        """Registrations and dispatches of hooks, routes, shortcodes and pages."""
        given = e[3]
        if name in ("add_action", "add_filter") and len(given) > 1:
            hook, ref = self.pattern(given[0]), self.callback(given[1])
            if hook and ref:
                self.registered.add((f"h:{hook}", ref))
                for start, kind, tier in M.ENTRY_HOOKS if name == "add_action" else ():
                    if hook == start or (start.endswith("_") and hook.startswith(start)):
                        self.entries.add((ref, kind, hook, tier))
                        break
            return True
        if name in ("do_action", "apply_filters", "do_action_ref_array", "apply_filters_ref_array") and given:
            hook = self.pattern(given[0])
            if hook:
                self.apply(f"h:{hook}", args[1:], None, e[1])
            return True
        if name == "add_shortcode" and len(given) > 1:
            if ref := self.callback(given[1]):
                self.entries.add((ref, "shortcode", self.text(given[0]) or "", "unauthenticated"))
            return True
        if name in ("add_menu_page", "add_submenu_page", "add_options_page") and given:
            for a in given:
                if a[0] in ("array", "closure") and (ref := self.callback(a)):
                    self.entries.add((ref, "admin_page", name, "authenticated"))
            return True
        if name == "add_meta_box" and len(given) > 2:
            if ref := self.callback(given[2]):
                self.entries.add((ref, "admin_page", self.text(given[0]) or "", "authenticated"))
            return True
        if name == "register_block_type" and len(given) > 1 and given[1][0] == "array":
            for k, v in given[1][2]:
                if isinstance(k, tuple) and literal(k) == "render_callback" and (ref := self.callback(v)):
                    self.entries.add((ref, "block", self.text(given[0]) or "", "unauthenticated"))
            return True
        if name == "register_rest_route" and len(given) > 2 and given[2][0] == "array":
            routes = [i for _, i in given[2][2] if i is not None and i[0] == "array" and any(literal(k) == "callback" for k, _ in i[2] if isinstance(k, tuple))]
            for route in routes or [given[2]]:
                named = {literal(k): v for k, v in route[2] if isinstance(k, tuple) and literal(k)}
                ref = self.callback(named["callback"]) if "callback" in named else None
                guard = named.get("permission_callback")
                open_ = guard is None or literal(guard) == "__return_true" or guard == ("literal", guard[1], "bool", "true")
                if ref:
                    path = M.join_route(self.text(given[0]) or "", self.text(given[1]) or "")
                    self.entries.add((ref, "rest", path, "unauthenticated" if open_ else "permission_callback"))
                    if guard is not None and (other := self.callback(guard)):
                        self.registered.add((f"g:{ref}", other))
            shown = S.items(given[2]).get("show_in_index")
            if shown is None or G.is_bool(shown) is not False:
                for key, flags in args[0].join(args[1]).all().items():
                    if flags & SECRET:
                        self.emit_one(M.DISCLOSURE, "surface", key, flags, self.place(e[1]), self.r["key"])
            return True
        return False

    def e_method(self, e) -> Value:
        owner = self.eval(e[2])
        args = [self.eval(a) for a in e[4]]
        if not isinstance(e[3], str):
            self.emit(M.USE, "dynamic", self.eval(e[3]), e[1])
            if (named := self.pattern(e[3])) and "{}" in named and owner.type and not owner.type.startswith("?"):
                self.apply(f"m:{owner.type}::{named.lower()}", args, owner, e[1])
            return _union([owner, *args])
        name, line = e[3].lower(), e[1]
        receiver = (e[2][2] if e[2][0] == "var" else e[2][3] if e[2][0] == "prop" else "")
        receiver = receiver.lower() if isinstance(receiver, str) else ""
        if name in M.REQUEST_METHODS and owner.type != (self.r["class"] or "").lower():
            return Value({("S", *self.place(line)): 0})
        ref = f"m:{owner.type or '?'}::{name}"
        got = self.apply(ref, args, owner, line)
        if got is not None:
            return got
        for rule, op, _, positions in [*_METHODS.get(name, []), *self.models.get("method", {}).get(name, [])]:
            wanted = M.METHOD_RECEIVERS.get(name)
            if wanted and not any(w in receiver for w in wanted):
                continue
            if rule == M.PRIVILEGE and e[4] and self.text(e[4][0]) in M.LOW_ROLES:
                continue
            if name == "prepare" and e[4] and self.constant_like(e[4][0]):
                continue
            for i in positions:
                if i < len(args):
                    self.emit(rule, op, args[i], line)
        if name == "prepare":
            return _union(args).flat(NUMERIC)
        if receiver == "wpdb" and name in ("insert", "replace", "update"):
            for a in args[1:3]:
                for k in a.fields:
                    if k == "*":
                        self.emit(M.SQL, "sql", Value(a.origins), line)
            table = sql_text.table_key(self.pattern(e[4][0]) if e[4] else None)
            if table and len(args) > 1:
                for k, v in args[1].fields.items():
                    for key, f in v.all().items():
                        self.store(f"table:{table}", k, key, f, self.place(line))
            return Value()
        if receiver == "wpdb" and name in ("get_results", "get_row", "get_var", "get_col"):
            query = self.pattern(inner_query(e[4][0])) if e[4] else None
            if sql_text.is_aggregate(query):
                return Value()
            held = Value({("S", *self.place(line)): PERSISTENT})
            for table in sql_text.read_tables(query):
                for column, _ in sql_text.select_columns(query) or [("*", "*")]:
                    self.reads.add((f"table:{table}", column, line))
            return held
        return _union([owner, *args])

    def constant_like(self, node) -> bool:
        """Whether a query's text is made of constants and table names only."""
        if not isinstance(node, tuple):
            return False
        if node[0] == "concat" or (node[0] == "binary" and node[2] == "."):
            return all(self.constant_like(p) for p in (node[2] if node[0] == "concat" else node[3:5]))
        if node[0] == "prop":
            return node[2][0] == "var" and node[2][2] == "wpdb"
        return node[0] in ("literal", "name", "cconst") or self.text(node) is not None

    def output_records(self, value: Value, line: int) -> None:
        for key, flags in value.all().items():
            self.emit_one(M.RECORD, "output", key, flags, self.place(line), self.r["key"])

    def grant(self, role: Value, node, line: int) -> None:
        """A role given to a user, unless it is one that anyone may have."""
        given = [self.text(v) for k, v in node[2] if isinstance(k, tuple) and literal(k) == M.ROLE_KEY] if node[0] == "array" else []
        if not given or given[0] not in M.LOW_ROLES:
            self.emit(M.PRIVILEGE, "call", role, line)

    def attachment_before(self, line: int) -> bool:
        """Whether a header before a line makes the answer a download."""
        for n in G.nodes(self.r["body"]):
            if n[0] == "call" and isinstance(n[2], str) and G.short(n[2]) == "header" and n[1] <= line and n[3]:
                text = (self.pattern(n[3][0]) or "").lower().strip().strip("\"'")
                if text.startswith("content-disposition:") and "attachment" in text:
                    return True
        return False

    def e_scall(self, e) -> Value:
        args = [self.eval(a) for a in e[4]]
        if not isinstance(e[2], str) or not isinstance(e[3], str):
            return _union(args)
        cls = self.class_name(e[2])
        got = self.apply(f"m:{cls}::{e[3].lower()}", args, self.env.get("this"), e[1])
        return got if got is not None else _union(args)


def nameless(cls: str, path: str) -> str:
    """Class of a definition: one without a name is told by its file as well."""
    return f"class@{path}:{cls[6:]}".lower() if cls.startswith("class@") else cls.lower()


def _union(values: list[Value]) -> Value:
    out = Value()
    for v in values:
        out = out.join(v.flat())
    return out


def constant_name(name: str) -> str:
    return name.rsplit("|", 1)[-1].rsplit("\\", 1)[-1]


def inner_query(node):
    """The query text of a call of prepare, or the node itself."""
    return node[4][0] if isinstance(node, tuple) and node[0] == "method" and node[3] == "prepare" and node[4] else node


def _plain_text(key: tuple) -> str:
    return key[0]


def _plain(key: tuple) -> list:
    return [list(x) if isinstance(x, tuple) else x for x in key]


def _key(key: list) -> tuple:
    return tuple(tuple(x) if isinstance(x, list) else x for x in key)


def typed(node, text=literal) -> tuple[str, str | None] | None:
    """A literal scalar with its type, so that '1', 1 and true differ; None where it isn't certain."""
    if not isinstance(node, tuple):
        return None
    if node[0] == "literal":
        if node[2] == "bool":
            return "bool", node[3].lower()
        return {"null": ("null", None), "number": ("num", node[3]), "string": ("str", node[3])}.get(node[2])
    known = text(node)
    return None if known is None else ("str", known)


def truth(node, text=literal) -> bool | None:
    """Truth of a condition where it is certain: three-valued, with short cuts for and and or."""
    if not isinstance(node, tuple):
        return None
    if node[0] == "unary" and node[2] == "!":
        t = truth(node[3], text)
        return None if t is None else not t
    if node[0] == "binary" and node[2] in (*G.BOTH, *G.EITHER):
        a, b = truth(node[3], text), truth(node[4], text)
        if node[2] in G.BOTH:
            return False if a is False or b is False else None if a is None or b is None else True
        return True if a is True or b is True else None if a is None or b is None else False
    if node[0] == "binary" and node[2] in (*G.SAME, *G.DIFFERENT):
        a, b = typed(node[3], text), typed(node[4], text)
        if a is None or b is None or (a[0] != b[0] and node[2] in ("==", "!=", "<>")):
            return None
        return (a == b) == (node[2] in G.SAME)
    value = typed(node, text)
    if value is None:
        return None
    return {"bool": value[1] == "true", "null": False}.get(value[0], value[1] not in ("", "0"))
