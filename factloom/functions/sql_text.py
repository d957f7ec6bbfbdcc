"""A reader of query text, as far as stored columns need it: tables, columns, scalar aggregates.

The text may hold ``{}`` where a part isn't known. Null and odd text gives nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions whose result is a number or one value of no stored text.
AGGREGATES = "count sum avg min max".split()
_FROM = re.compile(r"\b(?:from|join|into|update)\s+([`\w{}$.>-]+)", re.I)
_SELECT = re.compile(r"^\s*select\s+(?:distinct\s+)?(.*?)\s+from\b", re.I | re.S)
_ALIAS = re.compile(r"^(.*?)\s+(?:as\s+)?([`\"\w]+)$", re.I | re.S)


def identifier(text: str) -> str:
    """The last part of a name, without quotes, in lower case."""
    return text.strip().strip("`\"'[]").split(".")[-1].strip("`\"' ").lower()


def table_key(text: str | None) -> str | None:
    """A table's name without its prefix, which is a hole or the usual one."""
    if not text:
        return None
    name = re.sub(r"^(?:\{[^{}]*\}|\$wpdb->prefix|\$\w+->)+", "", text.strip().strip("`\"' "))
    name = identifier(name.replace("{}", ""))
    return name.removeprefix("wp_") or None


def split_list(text: str) -> list[str]:
    """Parts at the commas that stand in no bracket and in no quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def select_columns(query: str | None) -> list[tuple[str, str]]:
    """(column, name in the result) of a select list; an expression is a column of its own text."""
    found = _SELECT.match(query or "")
    out = []
    for item in split_list(found[1]) if found else []:
        m = _ALIAS.match(item)
        if m and not m[1].rstrip().endswith((",", "(")) and item.count("(") == item.count(")") and not re.search(r"[(]\s*$", m[1]):
            out.append((identifier(m[1]) if "(" not in m[1] else m[1].strip().lower(), identifier(m[2])))
        else:
            name = identifier(item) if "(" not in item else item.lower()
            out.append((name, name))
    return out


def read_tables(query: str | None) -> list[str]:
    """Tables that a query reads or writes, in order."""
    return list(dict.fromkeys(k for m in _FROM.finditer(query or "") if (k := table_key(m[1]))))


def write_columns(query: str | None) -> tuple[str, list[str]] | None:
    """(table, columns) of an insert or update."""
    text = query or ""
    if m := re.match(r"\s*(?:insert|replace)\s+(?:ignore\s+)?into\s+([`\w{}$.>-]+)\s*\(([^()]*)\)", text, re.I):
        return table_key(m[1]) or "", [identifier(c) for c in split_list(m[2])]
    if m := re.match(r"\s*update\s+([`\w{}$.>-]+)\s+set\s+(.*?)(?:\s+where\b.*)?$", text, re.I | re.S):
        return table_key(m[1]) or "", [identifier(c.split("=")[0]) for c in split_list(m[2])]
    return None


def is_aggregate(query: str | None) -> bool:
    """Whether a query gives one aggregate and no stored text."""
    items = select_columns(query)
    return len(items) == 1 and items[0][0].split("(")[0].strip() in AGGREGATES and "(" in items[0][0]


def table_key_of(name: Column) -> Column:
    """``table_key`` over a column."""
    bare = F.regexp_replace(F.btrim(F.btrim(name), F.lit("`\"' ")), r"^(?:\{[^{}]*\}|\$wpdb->prefix|\$\w+->)+", "")
    last = F.lower(F.btrim(F.element_at(F.split(F.replace(bare, F.lit("{}"), F.lit("")), r"\."), -1), F.lit("`\"'[] ")))
    return F.nullif(F.regexp_replace(last, "^wp_", ""), F.lit(""))
