"""Text functions over columns: markup, hosts, format strings, fingerprints, tolerant scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references that directory texts use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&nbsp;": " ", "&ndash;": "–", "&#8211;": "–"}
#: Words that stand for "no value" where a string was expected.
NO_VALUE = ("false", "null", "none", "")


def strip_tags(text: Column) -> Column:
    """Text without tags, each replaced by nothing."""
    return F.regexp_replace(text, r"<[^<>]*>", "")


def unescape(text: Column) -> Column:
    """Named references resolved, the ampersand last so that nothing is resolved twice."""
    for reference, char in ENTITIES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def plain_text(text: Column) -> Column:
    """Tags out, references resolved, runs of blanks one blank."""
    return F.trim(F.regexp_replace(unescape(strip_tags(text)), r"\s+", " "))


def tolerant_string(value: Column) -> Column:
    """A string, or null where the text says that there is none."""
    return F.when(~F.lower(F.trim(value)).isin(*NO_VALUE), value)


def url_host(url: Column) -> Column:
    """Host of an absolute URL in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def controls_host(prefix: Column) -> Column:
    """Whether text appended to the literal ``prefix`` of a URL can choose its host."""
    return F.regexp_extract(prefix, r"^https?://[^/?#]*[/?#]", 0) == ""


def has_string_conversion(template: Column) -> Column:
    """Whether a printf format takes a string; an unknown format does."""
    return F.coalesce(template.rlike(r"(?:^|[^%])(?:%%)*%[0-9$.+ '#-]*s"), F.lit(True))


def fingerprint(parts: Column) -> Column:
    """SHA-1 over parts that each end in NUL; a single part is its own fingerprint, null parts are empty."""
    clean = F.transform(parts, lambda p: F.coalesce(p, F.lit("")))
    joined = F.array_join(F.transform(clean, lambda p: F.concat(p, F.decode(F.unhex(F.lit("00")), "UTF-8"))), "")
    return F.when(F.size(clean) == 1, clean[0]).when(F.size(clean) > 1, F.sha1(joined))


def wildcard_pattern(template: Column) -> Column:
    """An anchored regular expression for a name with {holes}; a hole at the end leaves it open."""
    return F.concat(
        F.lit("^"), F.regexp_replace(F.regexp_replace(template, r"([.\\+*?\[^\]$()|])", r"\\$1"), r"\{[^{}]*\}", ".*"), F.lit("$")
    )
