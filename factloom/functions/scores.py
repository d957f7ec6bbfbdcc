"""Scores of findings: how exposed one is, and how well it stands for its copies.

Every part of a score is a row of a table: the rules it holds for, the text it
looks at, the pieces that it looks for, and its points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.access import tier_weight

#: Rules that end like this are signals, and weigh this much less.
SIGNAL_SUFFIX, SIGNAL_DISCOUNT = "-surface", 150
_RENDER, _RIGHTS, _OBJECT = "render-callback-execution", "wp-request-tainted-privilege-mutation", "unsafe-deserialization"
_OUTPUT = ("wp-request-record-read-to-output-without-cap-check", "wp-stored-xss-persistent-read-to-output")
_PATHS = ("wp-request-file-delete-without-cap-check", "request-path-read-delete", "path-transversal")
#: Fixed values: (rules, side, points, alternatives, pieces of which one must be there too). Pieces are in lower case.
SIGNALS: list[tuple[tuple[str, ...], str, int, tuple[str, ...], tuple[str, ...]]] = [
    ((_RENDER,), "source", 160, ("apply_filters(", "apply_filters_ref_array("), ()),
    ((_RENDER,), "source", 48, ("prepare_post_data(", "stripslashes_deep($_post['data'])", "stripslashes_deep( $_post['data'] )"), ()),
    ((_RIGHTS,), "source", 96, ("json_decode(",), ("$_post", "$_request")),
    ((_RIGHTS,), "source", 72, ("new_role", "['role']", '"role"'), ()),
    ((_RIGHTS,), "source", -64, ("file_get_contents(",), ("$_files",)),
    (_OUTPUT, "sink", 160, ("preg_replace(",), ()),
    (_OUTPUT, "sink", 144, ("call_user_func(", "call_user_func_array("), ()),
    (_OUTPUT, "sink", 112, ("echo $", "<?= $", "print $"), ()),
    (_OUTPUT, "sink", 48, ('href="<?php echo', 'src="<?php echo', 'title="<?php echo'), ()),
    (_OUTPUT, "sink", 24, ("esc_url(", "esc_attr("), ()),
    (_OUTPUT, "sink", -16, ("esc_html(", "number_format_i18n("), ()),
    (_PATHS, "source", 96, ("file_path", "tmp_name", "filepath"), ()),
    (_PATHS, "source", 40, ("path", "file"), ()),
    (_PATHS, "source", -24, ("text",), ()),
]
#: Points of a source that is there, of one that names request data, and of its sanitizers.
SOURCE_SIGNALS: list[tuple[int, tuple[str, ...]]] = [
    (64, ("$_get", "$_post", "$_request", "$_files", "$_cookie", "$_server", "php://input")),
    (48, ("filter_input(",)),
    (16, ("sanitize_text_field(", "sanitize_textarea_field(", "sanitize_key(", "wp_unslash(")),
]
#: Points of a known writer by its tier, beside those that any has.
WRITER_POINTS, WRITER_TIERS = 64, {"unauthenticated": 112, "nonce_only": 96, "authenticated": 32, "capability_checked": -32}
#: Points of a deprecated filter, of a definition as source, of a source in another file.
DEPRECATED, DEFINITION, OTHER_FILE = 80, -128, 32


def _any(text: Column, pieces: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | F.contains(text, F.lit(p))
    return out


def rule_score(rule: Column, source: Column, sink: Column) -> Column:
    """Points of a finding by what the texts of its source and sink (structs: path, line, snippet) tell for its rule."""
    texts = {"source": F.lower(F.coalesce(source.getField("snippet"), F.lit(""))), "sink": F.lower(F.coalesce(sink.getField("snippet"), F.lit("")))}
    total = F.lit(0)
    for rules, side, points, pieces, also in SIGNALS:
        met = rule.isin(*rules) & _any(texts[side], pieces)
        total = total + F.when(met & _any(texts[side], also) if also else met, points).otherwise(0)
    plain = _any(texts["source"], ("apply_filters(", "apply_filters_ref_array("))
    total = total + F.when((rule == _RENDER) & ~plain & _any(texts["source"], ("apply_filters_deprecated(",)), DEPRECATED).otherwise(0)
    total = total + F.when((rule == _OBJECT) & F.ltrim(texts["source"]).startswith("function "), DEFINITION).otherwise(0)
    paths = [F.coalesce(x.getField("path"), F.lit("")) for x in (source, sink)]
    other = (rule == "path-transversal") & (paths[0] != "") & (paths[1] != "") & (paths[0] != paths[1])
    return total + F.when(other, OTHER_FILE).otherwise(0)


def exploitability(
    rule: Column, access: Column, stored_access: Column | None = None, source: Column | None = None, sink: Column | None = None
) -> Column:
    """Weight of the more reachable of both tiers, less the discount of signals, with the points of the rule."""
    weight = tier_weight(access)
    if stored_access is not None:
        weight = F.greatest(weight, F.when(F.coalesce(stored_access, F.lit("")) != "", tier_weight(stored_access)))
    known = F.coalesce(rule, F.lit(""))
    score = weight - F.when(known.endswith(SIGNAL_SUFFIX), SIGNAL_DISCOUNT).otherwise(0)
    return score if source is None or sink is None else score + rule_score(known, source, sink)


def concrete(place: Column) -> Column:
    """Whether a place tells anything."""
    return place.isNotNull() & (
        (F.coalesce(place.getField("path"), F.lit("")) != "")
        | (F.coalesce(place.getField("line"), F.lit(0)) != 0)
        | (F.coalesce(place.getField("snippet"), F.lit("")) != "")
    )


def visible_callable(name: Column) -> Column:
    """A callable's name, or nothing for the top level of a file."""
    name = F.coalesce(name, F.lit(""))
    return F.when(name.startswith("file:"), "").otherwise(name)


def standing(rule: Column, source: Column, sink: Column, name: Column, stored_access: Column | None = None) -> Column:
    """How well a finding stands for its copies: places that are told, request data in the source, points of the rule and the writer."""
    text = F.lower(F.coalesce(source.getField("snippet"), F.lit("")))
    told = F.coalesce(name, F.lit(""))
    total = F.when(concrete(source), 4).otherwise(0) + F.when(concrete(sink), 2).otherwise(0)
    total = total + F.when(visible_callable(name) != "", 2).when(told != "", 1).otherwise(0) + F.when(text != "", 4).otherwise(0)
    for points, pieces in SOURCE_SIGNALS:
        total = total + F.when(_any(text, pieces), points).otherwise(0)
    total = total + rule_score(F.coalesce(rule, F.lit("")), source, sink)
    if stored_access is not None:
        by_tier = F.create_map(*(x for k, v in WRITER_TIERS.items() for x in (F.lit(k), F.lit(v))))
        writer = F.lit(WRITER_POINTS) + F.coalesce(F.try_element_at(by_tier, stored_access), F.lit(0))
        total = total + F.when(F.coalesce(stored_access, F.lit("")) != "", writer).otherwise(0)
    return total
