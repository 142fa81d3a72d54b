"""URL structure columns used by the link-priority rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: scheme://authority then path ---
URL_PARTS_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS_RE, 1))


def url_segments(url: Column) -> Column:
    path = F.regexp_extract(url, URL_PARTS_RE, 2)
    return F.filter(F.split(path, "/"), lambda s: s != F.lit(""))


def url_silo(url: Column) -> Column:
    """Host plus first path segment: pages of one section of one site."""
    return F.concat(url_host(url), F.lit("/"),
                    F.coalesce(F.get(url_segments(url), 0), F.lit("")))


def url_depth(url: Column) -> Column:
    return F.size(url_segments(url))
