"""Permalinks, handles and native post identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two hosts and the permalink path forms that name one post.
PERMALINK = r"^https://(?:x\.com|twitter\.com)/(?:[A-Za-z0-9_]{1,15}|i/web)/status/([1-9][0-9]*)/?(?:[?#].*)?\z"
EXACT_POST = r"^https://x\.com/[A-Za-z0-9_]{1,15}/status/[0-9]+\z"
HANDLE = r"^[A-Za-z0-9_]{1,15}\z"
CANONICAL_ID = r"^[1-9][0-9]*\z"
PLATFORM = r"^[a-z][a-z0-9_-]*\z"
EVIDENCE_PREFIXES = ("https://x.com/", "https://twitter.com/")


def post_id(url: Column) -> Column:
    """Status id of a permalink; both hosts and the anonymous path collapse to one id."""
    found = F.regexp_extract(url, PERMALINK, 1)
    return F.when(found != "", found)


def belongs_to(url: Column, account: Column) -> Column:
    """True when the url is a permalink of exactly this account."""
    owner = F.regexp_extract(url, r"(?i)^https://x\.com/([A-Za-z0-9_]{1,15})/status/[1-9][0-9]*\z", 1)
    return (owner != "") & (F.lower(owner) == F.lower(account))


def is_exact_post(url: Column) -> Column:
    return url.rlike(EXACT_POST)


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def member_key(member_id: Column, handle: Column) -> Column:
    """Stable id when known, otherwise the case-folded handle."""
    return F.when(
        member_id.isNotNull() & (member_id != ""), F.concat(F.lit("id:"), member_id)
    ).otherwise(F.concat(F.lit("handle:"), F.lower(handle)))


def key_mode(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def is_canonical_id(raw: Column) -> Column:
    return F.coalesce(raw.rlike(CANONICAL_ID), F.lit(False))


def native_identity_ok(platform: Column, native_id: Column, url: Column) -> Column:
    """Canonical platform label, exact id, decimal id on x, and a url that names the same id."""
    label_ok = platform.rlike(PLATFORM) & (platform != "twitter")
    exact = (F.trim(native_id) == native_id) & (F.length(native_id) > 0)
    decimal = (platform != "x") | native_id.rlike(CANONICAL_ID)
    https = url.rlike(r"^https://[^/?#]+[^?#]*\z")
    named = F.regexp_extract(url, r"^https://x\.com/[A-Za-z0-9_]{1,15}/status/([0-9]+)\z", 1)
    url_ok = url.isNull() | (https & ((platform != "x") | (named == native_id)))
    return F.coalesce(label_ok & exact & decimal & url_ok, F.lit(False))
