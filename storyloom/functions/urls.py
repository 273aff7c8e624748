"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = "^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\s]+)([^?#]*)(\\?[^#]*)?"


def _base(url: Column) -> Column:
    """scheme://host/path with the scheme and host in lower case, default ports dropped."""
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    authority = F.regexp_extract(url, _PARTS, 2)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    path = F.trim(F.regexp_extract(url, _PARTS, 3))
    return F.concat(scheme, F.lit("://"), user, host, F.when(path == "", F.lit("/")).otherwise(path))


def is_absolute(url: Column) -> Column:
    return url.rlike(_PARTS)


def normalize_url(url: Column | str) -> Column:
    """No query or fragment, lower-case host, one trailing slash off; other text only trimmed."""
    u = F.nullif(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_replace(F.when(is_absolute(u), _base(u)).otherwise(F.trim(u)), "/$", "")


def has_specific_path(normalized: Column | str) -> Column:
    """Whether a normalized URL points below the site root."""
    n = F.col(normalized) if isinstance(normalized, str) else normalized
    relative = F.regexp_replace(n, "(?i)^https?://[^/]+", "")
    return F.coalesce(
        F.when(is_absolute(n), n.rlike("^[^:/?#]+://[^/]+/+[^/]")).otherwise(relative.rlike("/[^/]+")),
        F.lit(False),
    )


def strip_tracking(url: Column | str) -> Column:
    """The URL without ``utm_*`` parameters and fragment."""
    u = F.col(url) if isinstance(url, str) else url
    query = F.regexp_replace(F.regexp_extract(u, _PARTS, 4), "^\\?", "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_")), "&")
    return F.when(
        is_absolute(u), F.concat(_base(u), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    ).otherwise(u)
