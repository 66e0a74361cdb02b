"""URL functions: canonical form as an Arrow UDF, since its rules need a real URL parser; host and origin as Columns."""

from __future__ import annotations

import posixpath
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that a scheme implies (fixed values).
IMPLIED_PORT = {"http": 80, "https": 443}


def canonical(url: str) -> str:
    """One spelling per page: lower-case scheme and host, no user, default port, fragment or trailing slash, clean path, sorted query.

    Anything that is not http(s) with a host, or cannot be split, is only stripped.
    """
    bare = url.strip()
    try:
        parts = urlsplit(bare)
        host, port = parts.hostname, parts.port
    except ValueError:
        return bare
    if parts.scheme not in IMPLIED_PORT or not host:
        return bare
    place = host if port in (None, IMPLIED_PORT[parts.scheme]) else f"{host}:{port}"
    path = posixpath.normpath("/" + parts.path.lstrip("/"))
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((parts.scheme, place, path, query, ""))


def host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def _mapped(fn, c: Column) -> Column:  # noqa: ANN001
    @F.pandas_udf("string")
    def apply(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else fn(u))

    return apply(c)


def canonical_url(c: Column) -> Column:
    return _mapped(canonical, c)


#: Scheme and authority of a URL.
_SCHEME, _PLACE = r"^([A-Za-z][A-Za-z0-9+.\-]*):", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_host(c: Column) -> Column:
    """The host in lower case, without user, port and brackets; empty where there is none."""
    place = F.regexp_replace(F.regexp_extract(F.trim(c), _PLACE, 1), r"^.*@", "")
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(place, r"^\[([^\]]*)", 1), F.lit("")), F.regexp_extract(place, r"^([^:\[]*)", 1)))


def url_origin(c: Column) -> Column:
    """Scheme and authority, as in scheme://host:port."""
    return F.concat(F.lower(F.regexp_extract(F.trim(c), _SCHEME, 1)), F.lit("://"), F.regexp_extract(F.trim(c), _PLACE, 1))
