"""URL checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def http_url(url: Column, most: int = 4096) -> Column:
    """The URL if it is http or https, has a host and is not too long."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host(url).isNotNull() & (F.length(url) <= most), url)


def on_hosts(url: Column, hosts: list[str]) -> Column:
    """Whether the host is one of these or below one of them."""
    own = host(url)
    test = F.lit(False)
    for h in hosts:
        test = test | (own == h) | own.endswith("." + h)
    return F.coalesce(test, F.lit(False))


def permalink_id(url: Column) -> Column:
    """The digits after /status/ in a path."""
    return F.nullif(F.regexp_extract(url, "/status/([0-9]{1,25})(?:[/?#]|$)", 1), F.lit(""))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def safe_archive_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9._\\-/]+$") & ~name.contains("..") & ~name.startswith("/"), F.lit(False))


def https_on(url: Column, hosts: list[str], most: int = 2000) -> Column:
    """The URL if it is https and its host is one of these; null otherwise."""
    sound = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host(url).isin(hosts) & (F.length(url) <= most)
    return F.when(F.coalesce(sound, F.lit(False)), url)


def post_url(url: Column, post_id: Column, hosts: list[str], fallback: str) -> Column:
    """A post's URL if it is https on one of the hosts, else the fallback followed by its id."""
    return F.coalesce(https_on(url, hosts, 300), F.concat(F.lit(fallback), post_id))


def larger_avatar(url: Column) -> Column:
    """An avatar's URL with its size suffix replaced by the largest."""
    return F.regexp_replace(url, r"(?i)_(normal|bigger|mini|reasonably_small)(\.\w+)$", "_400x400$2")


def archived_image(url: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), url)


def data_image(value: Column, most: int = 4 * 1024 * 1024) -> Column:
    """An embedded picture of a known kind in base64, up to a length; null otherwise."""
    sound = value.rlike(r"\Adata:image/(?:png|jpeg|jpg|gif|webp);base64,[A-Za-z0-9+/]+={0,2}\z") & (F.length(value) <= most)
    return F.when(F.coalesce(sound, F.lit(False)), value)
