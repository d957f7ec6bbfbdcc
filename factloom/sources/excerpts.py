"""Program text in documents: fenced, marked up, escaped, indented, or plain lines between prose."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_BLOCK = re.compile(
    r"```[ \t]*(?P<tag>php\b|[\w+#-]*(?=[ \t]*\n))(?P<fence>.*?)(?:```|</code>\s*</pre>)"
    r"|~~~[ \t]*(?P<tilde_tag>[\w+#-]*)[ \t]*\n(?P<tilde>.*?)~~~"
    r"|<pre\b[^>]*>(?P<pre>.*?)</pre>"
    r"|<code\b[^>]*>(?P<code>.*?)</code>"
    r"|\[(?P<bb>code|php)\](?P<bracket>.*?)\[/(?P=bb)\]",
    re.S | re.I,
)
#: Tags of fences that may hold PHP; no tag may hold anything.
_TAGS = {"", "php", "php5", "php7", "php8", "phtml", "html+php", "html", "wordpress", "text", "txt", "code"}
#: What is left of a block that was opened or closed only.
_MARKER = re.compile(r"```[ \t]*(?:php\b)?|~~~|</?(?:pre|code)\b[^>]*>|\[/?(?:code|php)\]", re.I)
_ENTITY = re.compile(r"&(?:lt|gt|amp|quot|apos|#0*39|#0*34|#0*36|#x27|#x22|#x24|nbsp);", re.I)
_ESCAPED_BLOCK = re.compile(r"&lt;(?:/?(?:pre|code)\b|\?(?:php|=))", re.I)
#: Markup of paragraphs around a line.
_EDGES = re.compile(r"^\s*(?:</?(?:p|div|li|br|blockquote)\b[^<>]*>\s*)+|(?:\s*</?(?:p|div|li|br|blockquote)\b[^<>]*>)+\s*$", re.I)
_QUOTED = re.compile(r"^(?:>[ \t]?)+(?!=)")

_END = r"[;{}:,(\[]\s*(?:(?://|\#|/\*).*)?$"
#: A line that starts a statement.
_START = re.compile(
    r"""^\s*(?:
      <\?(?:php\b|=)
    | .*<\?(?:php\b|=)
    | @?\$\w+ (?:\s*(?:->|\?->|::)\s*\$?\w+ | \s*\[[^\]]*\])* \s* (?:(?:[-+*/.%&|^]|\*\*|\?\?|<<|>>)?=(?![=]) | \( | \[ | -> | \+\+ | --)
    | (?:(?:abstract|final|public|private|protected|static)\s+)* function\s+&?\s*\w+\s*\(
    | (?:(?:abstract|final|readonly)\s+)* (?:class|interface|trait|enum)\s+\w+ (?:\s+(?:extends|implements)\s+[\w\\,\s]+)? \s* \{
    | (?:(?:abstract|final|readonly)\s+)* (?:class|interface|trait)\s+\w+ (?:\s+(?:extends|implements)\s+[\w\\,\ \t]+)? \s* $
    | (?:if|elseif|else\ ?if|while|for|foreach|switch|declare)\s*\( .* (?:[;{}(\[]\s*(?:(?://|/\*).*)?$ | \)\s*:\s*$ | \$[a-z_])
    | (?:return|echo|print|throw|include|include_once|require|require_once|global|static|unset|new|yield)\b \s* [^\n]* (?:\$|\(|'|"|\\|->|::) .* ;
    | (?:exit|die|return)\s*(?:\([^)]*\))?\s*;\s*$
    | namespace\s+\w+(?:\\\w+)*\s*[;{]\s*$
    | use\s+(?:function\s+|const\s+)?\\?\w+(?:\\\w+)+[^.]*;\s*$
    | (?:const|define)\s+\w+\s*=.*;
    | (?:try|do)\s*\{\s*$
    | [!@]?\s*\\?\w+(?:\\\w+)*(?:(?:::|->)\w+)?\( .* (?:;|[{,(\[]\s*$)
    | !\s*\w+\(
    )""",
    re.X | re.I,
)
_ASSIGNS = re.compile(r"^\s*@?\$\w+")
#: A line that may only go on with a run.
_MORE = re.compile(r"^\s*(?:[}\])]|//|\#(?!\#*\s)|/\*|->|\?->|\.\s|&&|\|\||\?\s|:\s|else\b|catch\b|finally\b|case\b.*:|default\s*:|(?:break|continue)\s*\d*;|@?\$\w+.*[;,]\s*$)", re.I)
_PIECE = re.compile(r"""<<<[ \t]*["']?(?P<label>\w+)["']?[ \t]*$|/\*|//.*|\#(?!\[).*|['"]|[(\[{]|[)\]}]""")
_CLOSERS = {"'": re.compile(r"(?:[^'\\]|\\.)*?'"), '"': re.compile(r'(?:[^"\\]|\\.)*?"'), "/*": re.compile(r".*?\*/")}


class _Balance:
    """What is still open after the lines seen so far: brackets, a string, a comment or a heredoc."""

    def __init__(self):
        self.depth, self.inside = 0, ""

    def feed(self, line: str) -> None:
        at = 0
        if self.inside.startswith("<<<"):
            if not re.match(rf"\s*{self.inside[3:]}\b", line):
                return
            at, self.inside = re.match(rf"\s*{self.inside[3:]}", line).end(), ""
        while True:
            if self.inside:
                m = _CLOSERS[self.inside].match(line, at)
                if not m:
                    return
                at, self.inside = m.end(), ""
            m = _PIECE.search(line, at)
            if not m:
                return
            at, piece = m.end(), m.group()
            if m.group("label"):
                self.inside = "<<<" + m.group("label")
                return
            if piece in ("'", '"', "/*"):
                self.inside = piece
            elif piece in ("(", "[", "{"):
                self.depth += 1
            elif piece in (")", "]", "}"):
                self.depth = max(self.depth - 1, 0)

    @property
    def open(self) -> bool:
        return bool(self.depth or self.inside)


def _plain(code: str) -> str:
    """Entities as characters, where the text is escaped as a whole: it then has none of them bare."""
    if _ENTITY.search(code) and not re.search(r"[<>]|&&", code):
        return html.unescape(code).replace("\xa0", " ")
    return code


def _starts(line: str) -> bool:
    m = _START.match(line)
    return bool(m) and (not _ASSIGNS.match(line) or bool(re.search(_END + r"|[.=?&|]\s*$|['\")\]]\s*$|;", line)))


def _runs(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the first line, text) of each run of program lines."""
    i = 0
    while i < len(lines):
        if not _starts(lines[i]):
            i += 1
            continue
        balance, end, last = _Balance(), i, i
        while end < len(lines):
            line = lines[end]
            if not balance.open and end > i:
                before = lines[last].rstrip()
                goes_on = not before.endswith((";", "}", "{", ":", ">")) and (line.startswith((" ", "\t")) or before.endswith((".", ",", "=", "(", "&&", "||", "?")))
                if line.strip() and not (_starts(line) or _MORE.match(line) or line.strip() == "{" or goes_on):
                    break
            if line.strip():
                last = end
            balance.feed(line)
            end += 1
        if balance.open:  # never closed: what looks like a program, up to the first line that doesn't
            last = i
            while last + 1 < len(lines) and (_starts(lines[last + 1]) or _MORE.match(lines[last + 1]) or lines[last + 1].startswith(("  ", "\t"))):
                last += 1
        yield i, "\n".join(lines[i : last + 1])
        i = last + 1


def program_excerpts(text: str) -> list[str]:
    """Program text of a document, in its order.

    PHP fences and ``<pre><code>`` are taken as they are; other blocks where
    they have a program line; outside of blocks, runs of program lines.
    """
    text = re.sub(r"\r\n?", "\n", text)
    if _ESCAPED_BLOCK.search(text) and not re.search(r"<(?:pre|code)\b|<\?php", text, re.I):
        text = html.unescape(text)
    found: list[tuple[int, str]] = []

    def plain(start: int, stop: int) -> None:
        piece = text[start:stop]
        marked = _MARKER.sub(lambda m: "\n" * len(m.group()), piece)  # as long as before, so that places stay
        offsets, lines, at = [], [], 0
        for line in marked.split("\n"):
            offsets.append(at)
            at += len(line) + 1
            lines.append(_plain(_EDGES.sub("", _QUOTED.sub("", line))))
        found.extend((start + offsets[n], run) for n, run in _runs(lines))

    at = 0
    for m in _BLOCK.finditer(text):
        plain(at, m.start())
        at = m.end()
        g = m.groupdict()
        code = next(g[k] for k in ("fence", "tilde", "pre", "code", "bracket") if g[k] is not None)
        tag = (g["tag"] or g["tilde_tag"] or g["bb"] or "").lower()
        inner = re.fullmatch(r"(?is)\s*<code\b[^>]*>(.*?)(?:</code>\s*)?", code) if g["pre"] is not None else None
        code = _plain(inner.group(1) if inner else code).strip("\n")
        sure = tag == "php" or inner is not None
        if code.strip() and (sure or (tag in _TAGS and any(map(_starts, code.split("\n"))))):
            found.append((m.start(), code.strip()))
    plain(at, len(text))
    return [code for _, code in sorted(found, key=lambda f: f[0])]


def as_program(code: str) -> str:
    """An excerpt as a file: code without an opening tag gets one."""
    return code if re.search(r"<\?(?:php\b|=)", code, re.I) and not re.match(r"\s*[$\w@!/#]", code) else "<?php\n" + re.sub(r"(?i)^\s*<\?php\b", "", code)


def document_programs(documents: DataFrame) -> DataFrame:
    """(root, path, source): the excerpts of each of ``documents`` (root, text) as files of a program of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (root, f"excerpt-{n}.php", as_program(code))
                for root, text in zip(batch["root"], batch["text"])
                for n, code in enumerate(program_excerpts(text or ""))
            ]
            yield pd.DataFrame(rows, columns=["root", "path", "source"])

    return documents.select("root", "text").mapInPandas(run, "root string, path string, source string")
