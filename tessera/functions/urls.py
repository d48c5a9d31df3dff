"""URL and identity functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without the scheme's default port; null where there is no scheme and host."""
    s, h = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    bare = F.when(s == "http", F.regexp_replace(h, ":80$", "")).when(s == "https", F.regexp_replace(h, ":443$", "")).otherwise(h)
    return F.when((s != "") & (h != ""), F.concat(s, F.lit("://"), bare))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize(url: Column) -> Column:
    """Origin and path; query, fragment and a slash at the end go."""
    return F.concat(origin(url), F.regexp_replace(path(url), "/+$", ""))


def normalize_keep_query(url: Column) -> Column:
    """As normalize(), with the query's parameters in sorted order."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.split(q, "&")), "&")
    return F.concat(normalize(url), F.when(q == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def rejection(url: Column) -> Column:
    """First reason not to take a URL: malformed, scheme, credentials, private_host; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    private = r"^(localhost|.*\.localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[::1?\]|\[f[cd].*|\[fe80.*)$"
    return (
        F.when(url.isNull() | origin(url).isNull(), "malformed")
        .when(~F.regexp_like(F.lower(url), F.lit("^(https?|mcp)://")), "scheme")
        .when(F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")), "credentials")
        .when(F.regexp_like(host, F.lit(private)), "private_host")
    )


def identity_key(kind: Column, url: Column, method_or_tool: Column) -> Column:
    """http|origin|path|METHOD or mcp|url|tool."""
    http = F.concat_ws("|", F.lit("http"), origin(url), path(url), F.upper(method_or_tool))
    return F.when(kind == "mcp", F.concat_ws("|", F.lit("mcp"), normalize(url), method_or_tool)).otherwise(http)


def content_id(key: Column, prefix: str = "eco-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 16))


def declaration_hash(*columns: str) -> Column:
    """sha256 of the columns as JSON with keys in byte order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
