"""URL columns, all native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import strip

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# Schemes whose last path segment may carry ``;parameters``.
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp",
    "rtsp", "sip", "sips", "mms", "sftp", "tel",
)

# File types that are never followed.
BLOCKED_FILE_TYPES = (".pdf", ".jpg", ".png", ".gif", ".zip", ".doc")


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 1)


def netloc(url: Column) -> Column:
    """Host part as written: case, port and user info are kept."""
    return F.regexp_extract(url, URL_RE, 2)


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, URL_RE, 3)
    return F.when(
        F.lower(scheme(url)).isin(*PARAM_SCHEMES), F.regexp_replace(raw, ";[^/]*$", "")
    ).otherwise(raw)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 4)


def after_netloc(url: Column) -> Column:
    """Path with parameters, query and fragment; ``/`` when there is none."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def normalize_url(url: Column) -> Column:
    u = strip(F.lower(url))
    q = query(u)
    joined = F.concat(
        scheme(u),
        F.lit("://"),
        netloc(u),
        path(u),
        F.when(
            q != "",
            F.concat(F.lit("?"), F.array_join(F.sort_array(F.split(q, "&")), "&")),
        ).otherwise(F.lit("")),
    )
    slashes = F.length(joined) - F.length(F.replace(joined, F.lit("/"), F.lit("")))
    return F.when(
        F.endswith(joined, F.lit("/")) & (slashes > 3), F.rtrim(joined, F.lit("/"))
    ).otherwise(joined)


def page_id(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def _trail(url: Column) -> Column:
    """Non-empty path parts joined by single slashes."""
    return F.trim(F.regexp_replace(path(url), "/{2,}", "/"), F.lit("/"))


def section(url: Column) -> Column:
    return F.split_part(_trail(url), F.lit("/"), F.lit(1))


def subsection(url: Column) -> Column:
    return F.split_part(_trail(url), F.lit("/"), F.lit(2))


def page_type(url: Column) -> Column:
    parts = F.split(_trail(url), "/")

    def has(*names: str) -> Column:
        return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(_trail(url) == "", "home")
        .when(has("blog"), "blog")
        .when(has("docs", "documentation"), "documentation")
        .when(has("about"), "about")
        .when(has("contact"), "contact")
        .otherwise("article")
    )


def link_type(href: Column, page_url: Column) -> Column:
    """``anchor`` needs an unresolved ``#…``; a resolved one is internal."""
    return (
        F.when(F.startswith(href, F.lit("#")), "anchor")
        .when(netloc(href) == netloc(page_url), "internal")
        .otherwise("external")
    )


def has_blocked_file_type(url: Column) -> Column:
    names = "|".join(t[1:] for t in BLOCKED_FILE_TYPES)
    return F.lower(path(url)).rlike(f"\\.({names})")


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | url.rlike(pattern)
    return hit


def is_http_url(url: Column) -> Column:
    return F.coalesce(
        url.rlike(r"(?i)^https?://[^\s/?#]+[^\s]*$") & (F.length(url) <= 2083), F.lit(False)
    )
