"""A PHP reader for fact extraction: text to plain tuples.

Nodes are tuples ``(kind, line, ...)``. The grammar covers functions, classes,
closures, control flow, calls, arrays, assignment, interpolation, match, and
inline HTML. What it cannot read raises ``PhpError`` with the line. Names are
resolved by namespace and imports: ``a\\b`` is a full name, ``\\b`` a global
one, and ``a|b`` a function of namespace ``a`` or else a global one.
"""

from __future__ import annotations

import re
import sys

#: Most nesting of expressions and blocks before a file counts as unreadable.
MAX_DEPTH = 400


class PhpError(ValueError):
    pass


_TOKEN = re.compile(
    r"""
    (?P<space>\s+|\#(?!\[)[^\n]*?(?=\?>|\n|$)|//[^\n]*?(?=\?>|\n|$)|/\*.*?(?:\*/|\Z)|\#\[[^\]]*\])
  | (?P<close>\?>\n?)
  | (?P<heredoc><<<[ \t]*(?P<hq>["']?)(?P<label>\w+)(?P=hq)[ \t]*\n(?P<hbody>.*?)\n?[ \t]*(?P=label)\b)
  | (?P<cast>\(\s*(?:int|integer|float|double|string|bool|boolean|array|object|unset|binary)\s*\))
  | (?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)
  | (?P<var>\$[A-Za-z_\x80-￿][\w\x80-￿]*)
  | (?P<name>\\?[A-Za-z_\x80-￿][\w\x80-￿]*(?:\\[A-Za-z_\x80-￿][\w\x80-￿]*)*)
  | (?P<single>'(?:[^'\\]|\\.)*')
  | (?P<double>"(?:[^"\\]|\\.)*")
  | (?P<back>`(?:[^`\\]|\\.)*`)
  | (?P<op>\?->|\?\?=|<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|->|=>|::|\+\+|--|&&|\|\||\?\?|==|!=|<>|<=|>=|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?()\[\]{}&|^~@$\\])
    """,
    re.X | re.S | re.I,
)
_OPEN = re.compile(r"<\?(?:php\b|=)", re.I)


def tokenize(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of every token; text outside of code is ``html``."""
    out: list[tuple[str, str, int]] = []
    at, line, inside = 0, 1, False
    while at < len(source):
        if not inside:
            m = _OPEN.search(source, at)
            html = source[at : m.start() if m else len(source)]
            if html:
                out.append(("html", html, line))
            line += html.count("\n")
            if not m:
                break
            if m.group() == "<?=":
                out.append(("name", "echo", line))
            at, inside = m.end(), True
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise PhpError(f"line {line}: unreadable {source[at : at + 12]!r}")
        kind = m.lastgroup if m.lastgroup not in ("hq", "label", "hbody") else "heredoc"
        text = m.group()
        if m.group("heredoc"):
            quoted = m.group("hq") == "'"
            out.append(("raw" if quoted else "template", m.group("hbody"), line))
        elif kind == "close":
            out.append(("op", ";", line))
            inside = False
        elif kind == "double":
            out.append(("template", text[1:-1], line))
        elif kind == "back":
            out.append(("shell", text[1:-1], line))
        elif kind == "single":
            out.append(("raw", re.sub(r"\\([\\'])", r"\1", text[1:-1]), line))
        elif kind != "space":
            out.append((kind, text, line))
        line += text.count("\n")
        at = m.end()
    out.append(("end", "", line))
    return out


_LEFT = {
    "or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12,
    "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, "<=": 14, ">": 14, ">=": 14,
    ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21,
}
#: Names that stand for a class by where they are used, and types that are no classes.
_OWN = {"self", "static", "parent"}
_BUILT_IN = _OWN | set("array bool callable false float int iterable mixed never null object string true void".split())
_ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
_INTERPOLATED = re.compile(
    r"\{(\$.+?)\}(?![\]'])|\$\{(\w+)\}|(\$\w+)(?:\[(\$?\w+|'[^']*'|-?\d+)\]|->(\w+))?|\\(?:u\{[0-9a-fA-F]+\}|.)", re.S
)


class Parser:
    def __init__(self, source: str, first_line: int = 1):
        self.tokens = [(k, t, n + first_line - 1) for k, t, n in tokenize(source)]
        self.i = 0
        self.depth = 0
        self.namespace = ""
        self.imports: dict[str, dict[str, str]] = {"class": {}, "function": {}}
        self.numbered: dict[int, int] = {}

    # Names
    def qualify(self, name: str) -> str:
        return f"{self.namespace}\\{name}" if self.namespace else name

    def number(self, n: int) -> str:
        """A line, with a count where it has several nameless definitions."""
        self.numbered[n] = self.numbered.get(n, 0) + 1
        return str(n) if self.numbered[n] == 1 else f"{n}.{self.numbered[n]}"

    def class_name(self, name: str) -> str:
        if name.lower() in _OWN:
            return name
        if name.startswith("\\"):
            return name
        first, _, rest = name.partition("\\")
        if first.lower() == "namespace" and rest:
            return self.qualify(rest)
        if first.lower() in self.imports["class"]:
            return self.imports["class"][first.lower()] + (f"\\{rest}" if rest else "")
        return self.qualify(name)

    def function_name(self, name: str) -> str:
        if "\\" in name:
            return self.class_name(name)
        if name.lower() in self.imports["function"]:
            return "\\" + self.imports["function"][name.lower()]
        return f"{self.namespace}|{name}" if self.namespace else name

    # Tokens
    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str, int]:
        t = self.peek()
        self.i += 1
        return t

    def at(self, *texts: str) -> bool:
        k, t, _ = self.peek()
        return k in ("op", "name", "cast") and t.lower() in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            k, t, n = self.peek()
            raise PhpError(f"line {n}: {text!r} wanted, {t!r} found")

    @property
    def line(self) -> int:
        return self.peek()[2]

    # Statements
    def program(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            if (s := self.statement()) is not None:
                out.append(s)
        return out

    def block(self, *ends: str) -> list[tuple]:
        """A braced block, one statement, or statements up to one of ``ends`` after a colon."""
        if self.take("{"):
            out = []
            while not self.take("}"):
                if self.peek()[0] == "end":
                    raise PhpError(f"line {self.line}: block isn't closed")
                if (s := self.statement()) is not None:
                    out.append(s)
            return out
        if ends and self.take(":"):
            out = []
            while not self.at(*ends):
                if self.peek()[0] == "end":
                    raise PhpError(f"line {self.line}: block isn't closed")
                if (s := self.statement()) is not None:
                    out.append(s)
            return out
        s = self.statement()
        return [s] if s is not None else []

    def statement(self) -> tuple | None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise PhpError(f"line {self.line}: nested too deeply")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> tuple | None:
        kind, text, n = self.peek()
        word = text.lower() if kind == "name" else ""
        if kind == "html":
            self.next()
            return ("html", n, text)
        if self.take(";"):
            return None
        if self.at("{"):
            return ("block", n, self.block())
        method = getattr(self, f"_s_{word}", None) if word else None
        following = self.peek(1)[1]
        if method and following not in ("::", "\\") and not (word in ("static", "function", "fn") and following == "("):
            if word == "static" and self.peek(1)[0] != "var":
                method = None
            if word == "function" and not (self.peek(1)[0] == "name" or (following == "&" and self.peek(2)[0] == "name")):
                method = None
            if word == "enum" and self.peek(1)[0] != "name":
                method = None
            if method:
                return method(n)
        if word in ("abstract", "final", "readonly") and self.peek(1)[0] == "name":
            self.next()
            return self.statement()
        e = self.expression()
        self.end()
        return ("expr", n, e)

    def end(self) -> None:
        if not self.take(";") and self.peek()[0] not in ("end", "html"):
            k, t, n = self.peek()
            raise PhpError(f"line {n}: end of statement wanted, {t!r} found")

    def _s_echo(self, n):
        self.next()
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        self.end()
        return ("echo", n, out)

    def _s_if(self, n):
        self.next()
        arms, other = [(self.condition(), self.block("elseif", "else", "endif"))], None
        while True:
            if self.take("elseif") or (self.at("else") and self.peek(1)[1].lower() == "if" and (self.next(), self.next())):
                arms.append((self.condition(), self.block("elseif", "else", "endif")))
            elif self.take("else"):
                other = self.block("endif")
            else:
                break
        if self.take("endif"):
            self.end()
        return ("if", n, arms, other)

    def condition(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def _s_while(self, n):
        self.next()
        c, body = self.condition(), self.block("endwhile")
        if self.take("endwhile"):
            self.end()
        return ("while", n, c, body)

    def _s_do(self, n):
        self.next()
        body = self.block()
        self.need("while")
        c = self.condition()
        self.end()
        return ("while", n, c, body)

    def _s_for(self, n):
        self.next()
        self.need("(")
        heads = []
        for stop in (";", ";", ")"):
            while not self.take(stop):
                heads.append(self.expression())
                self.take(",")
        body = self.block("endfor")
        if self.take("endfor"):
            self.end()
        return ("for", n, heads, body)

    def _s_foreach(self, n):
        self.next()
        self.need("(")
        subject = self.expression()
        self.need("as")
        self.take("&")
        key, value = None, self.expression()
        if self.take("=>"):
            self.take("&")
            key, value = value, self.expression()
        self.need(")")
        body = self.block("endforeach")
        if self.take("endforeach"):
            self.end()
        return ("foreach", n, subject, key, value, body)

    def _s_switch(self, n):
        self.next()
        subject = self.condition()
        alternative = not self.take("{") and (self.need(":") or True)
        cases = []
        while not self.take("}", "endswitch"):
            test = None
            if self.take("case"):
                test = self.expression()
            elif not self.take("default"):
                if self.peek()[0] == "html" and not self.peek()[1].strip():
                    self.next()
                    continue
                raise PhpError(f"line {self.line}: case wanted")
            if not self.take(":"):
                self.need(";")
            body = []
            while not self.at("case", "default", "}", "endswitch"):
                if self.peek()[0] == "end":
                    raise PhpError(f"line {self.line}: switch isn't closed")
                if (s := self.statement()) is not None:
                    body.append(s)
            cases.append((test, body))
        if alternative:
            self.end()
        return ("switch", n, subject, cases)

    def _s_return(self, n):
        self.next()
        e = None if self.at(";") or self.peek()[0] in ("end", "html") else self.expression()
        self.end()
        return ("return", n, e)

    def _jump(self, n):
        word = self.next()[1].lower()
        if self.peek()[0] == "number":
            self.next()
        self.end()
        return (word, n)

    _s_break = _s_continue = _jump

    def _names(self, n):
        word = self.next()[1].lower()
        out = []
        while True:
            e = self.expression()
            out.append(e)
            if not self.take(","):
                break
        self.end()
        return (word, n, out)

    _s_global = _s_static = _names

    def _s_const(self, n):
        self.next()
        out = []
        while True:
            name = self.next()[1]
            self.need("=")
            out.append(("expr", n, ("call", n, "define", [("literal", n, "string", name), self.expression()])))
            if not self.take(","):
                break
        self.end()
        return ("block", n, out)

    def _s_unset(self, n):
        self.next()
        args = [a for a, _ in self.arguments()]
        self.end()
        return ("unset", n, args)

    def _s_try(self, n):
        self.next()
        body, catches, last = self.block(), [], []
        while self.take("catch"):
            self.need("(")
            var = None
            while not self.take(")"):
                k, t, _ = self.next()
                var = t[1:] if k == "var" else var
            catches.append((var, self.block()))
        if self.take("finally"):
            last = self.block()
        return ("try", n, body, catches, last)

    def _s_throw(self, n):
        self.next()
        e = self.expression()
        self.end()
        return ("throw", n, e)

    def _s_namespace(self, n):
        self.next()
        self.namespace = "" if self.at("{") else self.next()[1]
        self.imports = {"class": {}, "function": {}}
        if self.at("{"):
            body = self.block()
            self.namespace = ""
            return ("block", n, body)
        self.end()
        return None

    def _s_use(self, n):
        self.next()
        kind = self.next()[1].lower() if self.at("function", "const") else "class"
        while True:
            path = self.next()[1].lstrip("\\")
            if self.take("\\") and self.take("{"):
                while not self.take("}"):
                    own = self.next()[1].lower() if self.at("function", "const") and self.peek(1)[0] == "name" else kind
                    self._import(own, f"{path}\\{self.next()[1]}")
                    self.take(",")
                    if self.peek()[0] == "end":
                        raise PhpError(f"line {n}: use isn't closed")
            else:
                self._import(kind, path)
            if not self.take(","):
                break
        self.end()
        return None

    def _import(self, kind: str, path: str) -> None:
        alias = self.next()[1] if self.take("as") else path.rsplit("\\", 1)[-1]
        self.imports.setdefault(kind, {})[alias.lower()] = path

    def _skip(self, n):
        while not self.take(";"):
            if self.next()[0] == "end":
                break

    _s_declare = _skip

    def _s_function(self, n):
        self.next()
        self.take("&")
        name = self.next()[1]
        return ("function", n, self.qualify(name), self.parameters(), self.body())

    def body(self):
        if self.take(":"):
            self.type()
        return self.block() if self.at("{") else self.end()

    def type(self) -> str:
        out = ""
        self.take("?")
        while self.peek()[0] == "name" or self.at("|", "&", "(", ")"):
            if self.at("&") and self.peek(1)[0] == "var" or self.at(")") and "(" not in out:
                break
            k, t, _ = self.next()
            out += self.class_name(t) if k == "name" and t.lower() not in _BUILT_IN else t
        return out

    def parameters(self) -> list[tuple]:
        self.need("(")
        out = []
        while not self.take(")"):
            while self.at("public", "private", "protected", "readonly"):
                self.next()
            hint = self.type() if self.peek()[0] == "name" or self.at("?", "(") else ""
            self.take("&")
            spread = self.take("...")
            k, t, n = self.next()
            if k != "var":
                raise PhpError(f"line {n}: parameter wanted")
            default = self.expression() if self.take("=") else None
            out.append((t[1:], hint, default, spread))
            self.take(",")
        return out

    def _s_class(self, n):
        self.next()
        return self.class_body(n, self.qualify(self.next()[1]))

    _s_interface = _s_trait = _s_enum = _s_class

    def class_body(self, n, name):
        parent = None
        while not self.at("{"):
            if self.take("extends"):
                parent = self.class_name(self.next()[1])
            elif self.next()[0] == "end":
                raise PhpError(f"line {n}: class has no body")
        self.need("{")
        methods, props, consts = [], [], []
        while not self.take("}"):
            flags = set()
            while self.at("public", "private", "protected", "static", "final", "abstract", "var", "readonly"):
                flags.add(self.next()[1].lower())
            m = self.line
            if self.take("function"):
                self.take("&")
                method = self.next()[1]
                params, body = self.parameters(), self.body()
                methods.append((method, m, params, body or [], "static" in flags))
            elif self.take("const"):
                while True:
                    key = self.next()[1]
                    if self.peek()[0] == "name":
                        key = self.next()[1]
                    self.need("=")
                    consts.append((key, self.expression()))
                    if not self.take(","):
                        break
                self.end()
            elif self.at("use"):  # traits stand among the properties, under names that no property has
                self.next()
                while not self.at(";", "{"):
                    k, t, _ = self.next()
                    if k == "end":
                        raise PhpError(f"line {m}: class isn't closed")
                    if k == "name":
                        props.append(("use " + self.class_name(t), None))
                if self.take("{"):  # which methods stand for which, and under what names
                    while not self.take("}"):
                        if self.next()[0] == "end":
                            raise PhpError(f"line {m}: class isn't closed")
                else:
                    self.end()
            elif self.take("case"):
                while not self.at(";", "{"):
                    if self.next()[0] == "end":
                        raise PhpError(f"line {m}: class isn't closed")
                if self.at("{"):
                    self.block()
                else:
                    self.end()
            else:
                if self.peek()[0] == "name" or self.at("?"):
                    self.type()
                k, t, m = self.next()
                if k != "var":
                    raise PhpError(f"line {m}: member wanted, {t!r} found")
                props.append((t[1:], self.expression() if self.take("=") else None))
                while self.take(","):
                    t = self.next()[1]
                    props.append((t[1:], self.expression() if self.take("=") else None))
                self.end()
        return ("class", n, name, parent, methods, props, consts)

    # Expressions
    def expression(self, least: int = 0) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise PhpError(f"line {self.line}: nested too deeply")
        try:
            return self._expression(least)
        finally:
            self.depth -= 1

    def _expression(self, least: int) -> tuple:
        left = self.unary()
        while True:
            k, t, n = self.peek()
            word = t.lower()
            if k == "op" and t in _ASSIGN and least <= 22:
                self.next()
                self.take("&")
                left = ("assign", n, left, self.expression(4), t)
            elif k == "op" and t == "?" and least <= 6:
                self.next()
                if self.take(":"):
                    left = ("ternary", n, left, None, self.expression(7))
                else:
                    then = self.expression(5)
                    self.need(":")
                    left = ("ternary", n, left, then, self.expression(7))
            elif k in ("op", "name") and word in _LEFT and _LEFT[word] >= least:
                self.next()
                power = _LEFT[word]
                left = ("binary", n, word, left, self.expression(power + (0 if word in ("??", "**") else 1)))
            else:
                return left

    def unary(self) -> tuple:
        k, t, n = self.peek()
        word = t.lower()
        if k == "op" and t in ("!", "-", "+", "~", "@", "&"):
            self.next()
            return ("unary", n, t, self.expression(19 if t == "!" else 20))
        if k == "op" and t in ("++", "--"):
            self.next()
            return ("unary", n, t, self.unary())
        if k == "cast":
            self.next()
            return ("cast", n, t.strip("() \t\n").lower(), self.expression(20))
        if k == "name":
            if word == "new":
                return self.postfix(self.new(n))
            if word in ("clone", "print", "throw"):
                self.next()
                return (word, n, self.expression(4))
            if word in ("include", "include_once", "require", "require_once"):
                self.next()
                return ("include", n, self.expression(4))
            if word == "yield":
                self.next()
                self.take("from")
                if self.at(";", ")", ",", "]"):
                    return ("literal", n, "null", None)
                e = self.expression(4)
                return ("yield", n, self.expression(4) if self.take("=>") else e)
        return self.postfix(self.primary())

    def new(self, n):
        self.next()
        if self.at("class"):
            self.next()
            args = [a for a, _ in self.arguments()] if self.at("(") else []
            return ("new", n, self.class_body(n, f"class@{self.number(n)}"), args)
        if self.peek()[0] == "name":
            cls: object = self.class_name(self.next()[1])
        elif self.at("("):
            self.next()
            cls = self.expression()
            self.need(")")
        else:
            cls = self.postfix(self.primary(), calls=False)
        return ("new", n, cls, [a for a, _ in self.arguments()] if self.at("(") else [])

    def arguments(self) -> list[tuple]:
        """(value, name or None) of each argument."""
        self.need("(")
        out = []
        while not self.take(")"):
            if self.take("..."):
                if self.take(")"):
                    break
            name = None
            if self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek(2)[1] != ":":
                name = self.next()[1]
                self.next()
            out.append((self.expression(), name))
            if not self.at(")"):
                self.need(",")
        return out

    def primary(self) -> tuple:
        k, t, n = self.next()
        word = t.lower()
        if k == "var":
            return ("var", n, t[1:])
        if k == "raw":
            return ("literal", n, "string", t)
        if k == "template":
            return self.template(t, n)
        if k == "shell":
            return ("shell", n, self.template(t, n))
        if k == "number":
            return ("literal", n, "number", t)
        if k == "op":
            if t == "(":
                e = self.expression()
                self.need(")")
                return e
            if t == "[":
                return self.items(n, "]")
            if t == "$":
                if self.take("{"):
                    e = self.expression()
                    self.need("}")
                    return ("varvar", n, e)
                return ("varvar", n, self.primary())
        if k == "name":
            if word in ("array", "list") and self.at("("):
                self.next()
                return self.items(n, ")")
            if word == "__namespace__":
                return ("literal", n, "string", self.namespace)
            if word in ("true", "false", "null"):
                return ("literal", n, "null" if word == "null" else "bool", word)
            if word == "isset":
                return ("isset", n, [a for a, _ in self.arguments()])
            if word == "empty":
                return ("isset", n, [a for a, _ in self.arguments()])
            if word in ("exit", "die"):
                return ("exit", n, [a for a, _ in self.arguments()] if self.at("(") else [])
            if word == "eval" and self.at("("):
                return ("eval", n, [a for a, _ in self.arguments()])
            if word == "static" and self.at("function", "fn"):
                return self.primary()
            if word == "function":
                self.take("&")
                params, uses = self.parameters(), []
                if self.take("use"):
                    uses = [p[0] for p in self.parameters()]
                return ("closure", n, params, uses, self.body() or [], self.number(n))
            if word == "fn":
                self.take("&")
                params = self.parameters()
                if self.take(":"):
                    self.type()
                self.need("=>")
                return ("closure", n, params, None, [("return", n, self.expression(4))], self.number(n))
            if word == "match" and self.at("("):
                subject = self.condition()
                self.need("{")
                arms = []
                while not self.take("}"):
                    tests = None
                    if not self.take("default"):
                        tests = [self.expression()]
                        while self.take(",") and not self.at("=>"):
                            tests.append(self.expression())
                    self.need("=>")
                    arms.append((tests, self.expression()))
                    self.take(",")
                return ("match", n, subject, arms)
            return ("name", n, t)
        raise PhpError(f"line {n}: {t!r} isn't expected here")

    def items(self, n, close):
        out = []
        while not self.take(close):
            if self.take(","):
                out.append((None, None))
                continue
            spread = self.take("...")
            self.take("&")
            value, key = self.expression(), None
            if self.take("=>"):
                self.take("&")
                key, value = value, self.expression()
            out.append((("spread",) if spread else key, value))
            if not self.at(close):
                self.need(",")
        return ("array", n, out)

    def member(self):
        k, t, n = self.next()
        if k == "name":
            return t
        if k == "var":
            return ("var", n, t[1:])
        if k == "op" and t == "{":
            e = self.expression()
            self.need("}")
            return e
        raise PhpError(f"line {n}: member wanted, {t!r} found")

    def postfix(self, e: tuple, calls: bool = True) -> tuple:
        while True:
            k, t, n = self.peek()
            if k != "op":
                return e
            if t == "[" or (t == "{" and e[0] == "never"):
                self.next()
                key = None if self.at("]") else self.expression()
                self.need("]")
                e = ("index", n, e, key)
            elif t in ("->", "?->"):
                self.next()
                name = self.member()
                if calls and self.at("("):
                    e = ("method", n, e, name, [a for a, _ in self.arguments()])
                else:
                    e = ("prop", n, e, name)
            elif t == "::":
                self.next()
                cls = self.class_name(e[2]) if e[0] == "name" else e
                if self.peek()[0] == "var":
                    name = self.next()[1][1:]
                    e = ("sprop", n, cls, name)
                    continue
                name = self.member()
                if calls and self.at("("):
                    e = ("scall", n, cls, name, [a for a, _ in self.arguments()])
                else:
                    e = ("cconst", n, cls, name)
            elif t == "(" and calls:
                args = [a for a, _ in self.arguments()]
                e = ("call", n, self.function_name(e[2]) if e[0] == "name" else e, args)
            elif t in ("++", "--"):
                self.next()
                e = ("unary", n, t, e)
            else:
                return e

    def template(self, text: str, n: int) -> tuple:
        parts: list[tuple] = []
        plain, at = "", 0

        def flush():
            nonlocal plain
            if plain:
                parts.append(("literal", n, "string", plain))
            plain = ""

        for m in _INTERPOLATED.finditer(text):
            plain += text[at : m.start()]
            at = m.end()
            braced, dollar, var, key, prop = m.groups()
            if braced:
                flush()
                inner = Parser("<?php " + braced.replace('\\"', '"') + ";", n)
                parts.append(inner.expression())
            elif dollar:
                flush()
                parts.append(("var", n, dollar))
            elif var:
                flush()
                e: tuple = ("var", n, var[1:])
                if key:
                    k = ("var", n, key[1:]) if key[0] == "$" else ("literal", n, "string", key.strip("'"))
                    e = ("index", n, e, k)
                elif prop:
                    e = ("prop", n, e, prop)
                parts.append(e)
            else:
                plain += {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\$": "$", '\\"': '"', "\\\\": "\\"}.get(m.group(), m.group())
        plain += text[at:]
        flush()
        if not parts:
            return ("literal", n, "string", "")
        return parts[0] if len(parts) == 1 and parts[0][0] == "literal" else ("concat", n, parts)


def parse_php(source: str) -> list[tuple]:
    """Statements of a file; raises ``PhpError``."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    return Parser(source.replace("\r\n", "\n")).program()
