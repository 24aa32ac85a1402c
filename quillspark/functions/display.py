"""Routes, relative times, kinds of files and names of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mime_for(variants: Column, kind: Column, index: int = 0) -> Column:
    """The content type of a variant (the last, if there are fewer; else the first's), else by kind, else empty."""
    some = lambda v: F.when(v["content_type"] != "", v["content_type"])
    at = F.get(variants, F.least(F.lit(index), F.size(variants) - 1))
    by_kind = F.when(kind == "photo", "image/jpeg").when(kind.isin("video", "animated_gif"), "video/mp4").otherwise("")
    return F.coalesce(some(at), some(F.get(variants, F.lit(0))), by_kind)


def relative_time(at: Column, now: Column) -> Column:
    """`now`, `5 min`, `3 h`, `12 d` before now; a date and time from 30 days on and for the future; a dash for null."""
    # Two times without a zone are subtracted as they are, so no zone's change of clocks comes in; nor does half a second count as none.
    gap = now - at
    part = lambda unit: F.extract(F.lit(unit), gap)
    text = lambda unit, name: F.concat(part(unit).cast("string"), F.lit(name))
    full = F.substring_index(at.cast("string"), ":", 2)
    return (
        F.when(at.isNull(), "—").when(at > now, full).when(part("DAY") >= 30, full).when(part("DAY") > 0, text("DAY", " d"))
        .when(part("HOUR") > 0, text("HOUR", " h")).when(part("MINUTE") > 0, text("MINUTE", " min")).otherwise("now")
    )


def _decoded(value: Column) -> Column:
    """Percent-decoded, as it is where that fails. A plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def query_value(query: Column, key: str) -> Column:
    """The first value of a key in a query string, decoded; empty if there is none."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(
        _decoded(F.replace(F.regexp_extract(p, "^([^=]*)", 1), F.lit("+"), F.lit(" "))).alias("k"), _decoded(F.replace(F.regexp_replace(p, "^[^=]*=?", ""), F.lit("+"), F.lit(" "))).alias("v")))
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"], F.lit(""))


def route_of(fragment: Column) -> Column:
    """(name, handle, id, q) of an address fragment: timeline, me, search, account, post or unknown."""
    raw = F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#?/?", "")
    path, query = F.regexp_extract(raw, "^([^?]*)", 1), F.regexp_replace(raw, r"^[^?]*\??", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n, first = F.size(parts), F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    handle = _decoded(F.substring(first, F.lit(2), F.length(first)))
    post = (n == 3) & first.startswith("@") & (F.get(parts, F.lit(1)) == "status")
    name = (
        F.when(n == 0, "timeline").when((n == 1) & (first == "me"), "me").when((n == 1) & (first == "search"), "search").when(post, "post")
        .when((n == 1) & first.startswith("@") & (handle != ""), "account").otherwise("unknown")
    )
    return F.struct(
        name.alias("name"), F.when(name.isin("post", "account"), handle).alias("handle"), F.when(name == "post", _decoded(F.get(parts, F.lit(2)))).alias("id"),
        F.when(name == "search", query_value(query, "q")).alias("q"),
    )


def route_href(route: Column) -> Column:
    """The address fragment of a route."""
    # A blank is %20 in an address, not the plus sign of a form.
    code = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return (
        F.when(route["name"] == "me", "#/me").when((route["name"] == "search") & (F.coalesce(route["q"], F.lit("")) != ""), F.concat(F.lit("#/search?q="), code(route["q"])))
        .when(route["name"] == "search", "#/search").when(route["name"] == "account", F.concat(F.lit("#/@"), code(route["handle"])))
        .when(route["name"] == "post", F.concat(F.lit("#/@"), code(route["handle"]), F.lit("/status/"), code(route["id"]))).otherwise("#/")
    )


def export_name(stem: str, handle: Column, day: Column, extension: str) -> Column:
    """stem-handle-date.extension; without a handle the part goes."""
    return F.concat(F.lit(stem), F.when(F.coalesce(handle, F.lit("")) != "", F.concat(handle, F.lit("-"))).otherwise(""), F.date_format(day, "yyyy-MM-dd"), F.lit("." + extension))


def merged_export_name(stem: str, handle: Column, day: Column, extension: str) -> Column:
    """stem-handle-merged-date.extension, other than letters, digits and underscores of the handle replaced."""
    safe = F.regexp_replace(F.coalesce(handle, F.lit("archive")), "[^A-Za-z0-9_]", "_")
    return F.concat(F.lit(stem), safe, F.lit("-merged-"), F.date_format(day, "yyyy-MM-dd"), F.lit("." + extension))


def grid_shape(count: Column) -> Column:
    """The layout of a post's pictures: as many places as there are, 1 to 4."""
    return F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)), F.lit(4))
