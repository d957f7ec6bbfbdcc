"""What the conditions of a callable check, and which variables they prove to be safe paths.

Only conditions and returns count for capability and login checks, by their
polarity; nonce checks that stop the request themselves count wherever they
stand. Calls of other callables in conditions, and calls that stand as
statements, are given as helpers: the scan looks up what those check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Calls that end the request unless the nonce is right; calls that end it with a message.
STOPPING_NONCE = ("check_ajax_referer", "check_admin_referer")
STOPPING = ("wp_send_json_error", "wp_die")
#: Functions and methods that test a capability; functions that test a login.
CAPABILITY = ("current_user_can", "user_can")
CAPABILITY_METHODS = ("current_user_can", "user_can", "has_cap")
LOGIN = ("is_user_logged_in", "get_current_user_id")
#: Functions that hand a condition on as their later arguments.
PASSTHROUGH = ("apply_filters", "apply_filters_ref_array")
#: Pieces of a path that no trusted path has.
FORBIDDEN = ("php:", "://", "..", "|", "\x00", "%00")
SAME, DIFFERENT = ("===", "=="), ("!==", "!=", "<>")
BOTH, EITHER = ("&&", "and"), ("||", "or")


def short(name: str) -> str:
    """A function's name without its namespace."""
    return name.lstrip("\\").lower().rsplit("|", 1)[-1].rsplit("\\", 1)[-1]


def literal_text(node) -> str | None:
    return node[3] if isinstance(node, tuple) and node[0] == "literal" and node[2] in ("string", "number") else None


def nodes(node) -> Iterator[tuple]:
    """All nodes of a body but those of callables within it."""
    if isinstance(node, tuple) and node and isinstance(node[0], str):
        if node[0] in ("closure", "function", "class"):
            return
        yield node
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from nodes(x)


def is_bool(node) -> bool | None:
    """True or False for that literal, None for anything else."""
    if isinstance(node, tuple) and node[0] == "literal" and node[2] == "bool":
        return node[3].lower() == "true"
    return None


class Guards:
    """Checks of a body as (kind, name, line); helpers have the kind ``helper:`` and how they stand, and their reference."""

    def __init__(self, body, cls: str | None, class_name: Callable[[str], str], from_request: Callable[[object], bool]):
        self.cls, self.class_name, self.from_request = cls, class_name, from_request
        self.found: set[tuple] = set()
        self.assigned: dict[str, tuple] = {}
        every = list(nodes(body))
        for n in every:
            if n[0] == "assign" and len(n) == 5 and n[2][0] == "var":
                self.assigned[n[2][2]] = n[3]
        for n in every:
            self.node(n)

    def node(self, n: tuple) -> None:
        if n[0] == "call" and len(n) == 4 and isinstance(n[2], str):
            if short(n[2]) in STOPPING_NONCE:
                self.found.add(("nonce", "", n[1]))
            elif short(n[2]) in STOPPING:
                self.found.add(("validation", "", n[1]))
        elif n[0] == "exit":
            self.found.add(("validation", "", n[1]))
        elif n[0] == "expr" and len(n) == 3:
            self.helper(n[2], "statement")
        elif n[0] == "if" and len(n) == 4:
            for cond, _ in n[2]:
                self.condition(cond, True)
        elif n[0] == "while" and len(n) == 4:
            self.condition(n[2], True)
        elif n[0] == "for" and len(n) == 4:
            for cond in n[2]:
                self.condition(cond, True)
        elif n[0] == "return" and len(n) == 3:
            self.condition(n[2], True)

    def helper(self, e, how: str) -> None:
        if not isinstance(e, tuple):
            return
        if e[0] == "call" and isinstance(e[2], str):
            ref = "f:" + e[2].lstrip("\\").lower()
        elif e[0] == "method" and isinstance(e[3], str) and e[2] == ("var", e[2][1], "this") and self.cls:
            ref = f"m:{self.cls}::{e[3].lower()}"
        elif e[0] == "scall" and isinstance(e[2], str) and isinstance(e[3], str):
            ref = f"m:{self.class_name(e[2])}::{e[3].lower()}"
        else:
            return
        self.found.add((f"helper:{how}", ref, e[1]))

    def condition(self, e, positive: bool, seen: frozenset = frozenset()) -> None:
        if not isinstance(e, tuple):
            return
        kind = e[0]
        if kind == "call" and isinstance(e[2], str):
            if not self.check(short(e[2]), e[3], e[1], positive):
                if short(e[2]) in PASSTHROUGH:
                    for a in e[3][1:]:
                        self.condition(a, positive, seen)
                else:
                    self.helper(e, "positive" if positive else "negative")
        elif kind in ("method", "scall"):
            if isinstance(e[3], str) and e[3].lower() in CAPABILITY_METHODS:
                self.capability(e[4], e[1])
            else:
                self.helper(e, "positive" if positive else "negative")
        elif kind == "var" and e[2] in self.assigned and e[2] not in seen:
            self.condition(self.assigned[e[2]], positive, seen | {e[2]})
        elif kind == "unary" and e[2] == "!":
            self.condition(e[3], not positive, seen)
        elif kind == "unary" and e[2] == "@":
            self.condition(e[3], positive, seen)
        elif kind == "binary":
            op, a, b = e[2], e[3], e[4]
            if op in BOTH or op in EITHER:
                self.condition(a, positive, seen)
                self.condition(b, positive, seen)
            elif op in SAME or op in DIFFERENT:
                for value, other in ((is_bool(a), b), (is_bool(b), a)):
                    if value is not None:
                        self.condition(other, positive == (value == (op in SAME)), seen)
            elif op in (">", ">=") and positive:
                for side, other in ((a, b), (b, a)):
                    if literal_text(other) is not None:
                        self.condition(side, True, seen)
        elif kind == "ternary":
            self.condition(e[2], positive, seen)

    def capability(self, args, line: int) -> None:
        """A test of a capability, unless the request may choose which."""
        if not args or not self.weak(args[0]):
            self.found.add(("capability", (literal_text(args[0]) or "") if args else "", line))

    def weak(self, node, seen: frozenset = frozenset()) -> bool:
        if not isinstance(node, tuple) or node[0] in ("literal", "name", "cconst"):
            return False
        if node[0] == "var":
            if node[2] in seen:
                return True
            if node[2] in self.assigned:
                return self.weak(self.assigned[node[2]], seen | {node[2]})
            return self.from_request(node)
        if node[0] == "call" and isinstance(node[2], str) and short(node[2]) in PASSTHROUGH:
            return not node[3] or not literal_text(node[3][0]) or any(self.from_request(a) for a in node[3][1:])
        return node[0] == "call" or self.from_request(node)

    def check(self, name: str, args, line: int, positive: bool) -> bool:
        if name in CAPABILITY:
            self.capability(args, line)
        elif name == "wp_verify_nonce":
            self.found.add(("nonce", "", line))
        elif name in LOGIN:
            self.found.add(("auth" if positive else "unauth", "", line))
        elif name == "hash_equals":
            self.found.add(("auth", "", line))
        elif name not in ("is_admin", "wp_doing_ajax"):
            return False
        return True


# Paths
def _var(node) -> str | None:
    return node[2] if isinstance(node, tuple) and node[0] == "var" and isinstance(node[2], str) else None


def _call(node, *names: str) -> list | None:
    """Arguments of a call of one of the functions."""
    return node[3] if isinstance(node, tuple) and node[0] == "call" and isinstance(node[2], str) and short(node[2]) in names else None


def equals_its_realpath(cond, ops: tuple[str, ...]) -> str | None:
    """The variable that is compared to its own real path."""
    if isinstance(cond, tuple) and cond[0] == "binary" and cond[2] in ops:
        for a, b in ((cond[3], cond[4]), (cond[4], cond[3])):
            args = _call(b, "realpath")
            if _var(a) and args and len(args) == 1 and _var(args[0]) == _var(a):
                return _var(a)
    return None


def trusted_root(text: str | None) -> bool:
    """An absolute path of two segments or more, or one below a drive."""
    if not text or "http://" in text.lower() or "https://" in text.lower() or "\x00" in text:
        return False
    segments = [s for s in text.replace("\\", "/").split("/") if s.strip()]
    if text.startswith("/"):
        return len(segments) >= 2
    return len(text) > 3 and text[0].isalpha() and text[1] == ":" and text[2] in "\\/" and len(segments) >= 2


def proved_inside(cond, name: str, root_text: Callable[[object], str | None]) -> set[str]:
    """What a conjunction proves of a variable: that it exists, and that it starts with a trusted root."""
    if not isinstance(cond, tuple):
        return {"no"}
    if cond[0] == "binary" and cond[2] in BOTH:
        return proved_inside(cond[3], name, root_text) | proved_inside(cond[4], name, root_text)
    if _var(cond) == name:
        return set()
    if (args := _call(cond, "file_exists", "is_file", "is_dir")) and _var(args[0]) == name:
        return {"exists"}
    if (args := _call(cond, "str_starts_with")) and len(args) > 1 and _var(args[0]) == name and trusted_root(root_text(args[1])):
        return {"inside"}
    if cond[0] == "binary" and cond[2] in SAME:
        for zero, test in ((cond[3], cond[4]), (cond[4], cond[3])):
            args = _call(test, "strpos", "stripos")
            if literal_text(zero) == "0" and args and len(args) > 1 and _var(args[0]) == name and trusted_root(root_text(args[1])):
                return {"inside"}
    return {"no"}


def safe_in_branch(cond, real: set[str], root_text: Callable[[object], str | None]) -> set[str]:
    """Variables that are safe paths where ``cond`` holds; ``real``: those that hold a real path."""
    out = {n for n in [equals_its_realpath(cond, SAME)] if n}
    return out | {n for n in real if proved_inside(cond, n, root_text) == {"exists", "inside"}}


def aborts(body) -> bool:
    """Whether a branch surely ends: by its last statement."""
    last = body[-1] if body else None
    if not isinstance(last, tuple):
        return False
    if last[0] == "expr":
        return last[2][0] in ("exit", "throw") or _call(last[2], "wp_die", "wp_send_json_error", "wp_send_json_success", "wp_send_json") is not None
    return last[0] in ("return", "break", "continue", "throw")


def sanitized_returns(body) -> set[str]:
    """Variables that a helper gives back only after it tested them for forbidden pieces and for existence."""
    proved: dict[str, set[str]] = {}
    for s in body:
        if isinstance(s, tuple) and s[0] == "if" and len(s[2]) == 1 and not s[3] and aborts(s[2][0][1]):
            for n in nodes(s[2][0][0]):
                if (args := _call(n, "strpos", "stripos", "str_contains")) and len(args) > 1 and _var(args[0]):
                    if any(piece in (literal_text(args[1]) or "").lower() for piece in FORBIDDEN):
                        proved.setdefault(_var(args[0]), set()).add("token")
                if (args := _call(n, "file_exists", "is_dir")) and _var(args[0]):
                    proved.setdefault(_var(args[0]), set()).add("exists")
    return {n for n, what in proved.items() if what == {"token", "exists"}}
