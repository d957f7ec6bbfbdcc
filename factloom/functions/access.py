"""Access tiers of program entry: derivation, weight, severity, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How reachable each tier is.
TIER_WEIGHT = {
    "unauthenticated": 1000,
    "permission_callback": 700,
    "nonce_only": 600,
    "authenticated": 400,
    "unknown": 200,
    "capability_checked": 50,
}
#: Fixed value: weight of a tier that is not listed.
OTHER_WEIGHT = 100
#: Fixed value: rules that end like this are signals, and weigh this much less.
SIGNAL_SUFFIX, SIGNAL_DISCOUNT = "-surface", 150
#: Severity of each tier; any other is info.
TIER_SEVERITY = {"unauthenticated": "critical", "authenticated": "high", "nonce_only": "medium", "capability_checked": "low"}
#: Levels of roles, lowest privilege first.
ROLE_LEVEL = {
    "subscriber": 1,
    "customer": 1,
    "student": 1,
    "contributor": 2,
    "author": 3,
    "shop_manager": 4,
    "editor": 4,
    "administrator": 5,
    "super_admin": 6,
}
#: Fixed value: role of a capability that isn't listed.
UNKNOWN_ROLE = "unknown_role"
#: Lowest default role that holds a capability.
CAPABILITY_ROLE = {
    "subscriber": "read",
    "contributor": "edit_posts delete_posts",
    "author": "upload_files publish_posts edit_published_posts delete_published_posts",
    "editor": "edit_others_posts delete_others_posts edit_pages edit_others_pages publish_pages delete_pages"
    " delete_others_pages edit_published_pages delete_published_pages manage_categories manage_links"
    " moderate_comments read_private_posts read_private_pages unfiltered_html",
    "administrator": "manage_options activate_plugins install_plugins delete_plugins edit_plugins install_themes"
    " edit_themes switch_themes delete_themes edit_theme_options manage_network manage_network_options"
    " update_plugins update_themes update_core create_users delete_users edit_users list_users promote_users"
    " remove_users import export edit_dashboard manage_privacy_options",
    "shop_manager": "manage_woocommerce view_woocommerce_reports",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))))


def tier_weight(access: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TIER_WEIGHT), access), F.lit(OTHER_WEIGHT))


def access_severity(access: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TIER_SEVERITY), access), F.lit("info"))


def minimum_role(capability: Column) -> Column:
    """Lowest role with a capability; ``unknown_role`` for one that isn't listed, null for null."""
    known = _map({c: r for r, cs in CAPABILITY_ROLE.items() for c in cs.split()})
    return F.when(capability.isNotNull(), F.coalesce(F.try_element_at(known, capability), F.lit(UNKNOWN_ROLE)))


def role_level(role: Column) -> Column:
    return F.try_element_at(_map(ROLE_LEVEL), role)


def derive_access(
    privileged: Column, capability: Column, auth: Column, unauth: Column, nonce: Column, entries: Column
) -> Column:
    """Tier of a flow from what guards it; the order of the tests is part of the meaning.

    The first five tell whether a check of that kind was seen (null: not seen),
    ``entries`` is the array of the tiers of the entry points.
    """
    p, c, a, u, n = (F.coalesce(x, F.lit(False)) for x in (privileged, capability, auth, unauth, nonce))
    entry = F.coalesce(entries, F.array().cast("array<string>"))

    def has(tier: str) -> Column:
        return F.array_contains(entry, tier)

    return (
        F.when(p, "capability_checked")
        .when((a | c) & ~u, "authenticated")
        .when(u & ~a, "unauthenticated")
        .when(n & ~a, "nonce_only")
        .when(has("permission_callback"), "permission_callback")
        .when(has("unauthenticated"), "unauthenticated")
        .when(has("authenticated"), "authenticated")
        .when(n, "nonce_only")
        .otherwise("unknown")
    )
