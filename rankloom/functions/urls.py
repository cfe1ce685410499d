"""URL normalisation and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def normalised(url: Column, force_https: bool = False) -> Column:
    """Scheme and host in lower case without www., no trailing slash, query sorted, fragment dropped."""
    scheme = F.lit("https") if force_https else F.coalesce(F.lower(_part(url, "PROTOCOL")), F.lit("https"))
    host = F.regexp_replace(F.lower(F.coalesce(_part(url, "AUTHORITY"), F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: p.rlike("^[^=]+=.+")))
    query = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, "PROTOCOL")).isin("http", "https"), F.lit(False))


def is_internal(url: Column, host: str) -> Column:
    own = F.regexp_replace(F.lower(_part(url, "HOST")), r"^www\.", "")
    return F.coalesce((own == host) | own.endswith("." + host), F.lit(False))


def is_category(url: Column, word: str = "scholarship") -> Column:
    path = F.lower(F.coalesce(_part(url, "PATH"), F.lit("")))
    return path.contains("/students/") & path.contains(word)


def slug(url: Column) -> Column:
    """The last part of the path, other characters as hyphens; `home` for the root and `detail` where nothing is left."""
    path = F.regexp_replace(F.lower(F.coalesce(_part(url, "PATH"), F.lit(""))), "^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(path == "", "home").when(bare == "", "detail").otherwise(bare)


def cache_slug(url: Column) -> Column:
    return F.concat(F.lit("detail-"), slug(url), F.lit("-"), F.substring(F.sha1(url), 1, 8))
