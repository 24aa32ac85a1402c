"""Formatting and taking apart text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_count(n: Column) -> Column:
    """1234 as 1.2K, 12345 as 12K, 3400000 as 3.4M; empty for null, negative and non-finite counts."""
    x = n.cast("double")

    def scaled(unit: float, suffix: str) -> Column:
        v = x / unit
        # One decimal of the double's exact value: 2^52 times it is a whole number.
        scaled_up = (v * float(1 << 52)).cast("decimal(20,0)") * 10 + F.lit(1 << 51).cast("decimal(20,0)")
        rest = scaled_up % F.lit(1 << 52).cast("decimal(20,0)")
        tenths = ((scaled_up - rest) / F.lit(1 << 52).cast("decimal(20,0)")).cast("bigint")
        short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.when(v < 10, F.concat(short, F.lit(suffix))).otherwise(F.concat(F.round(v).cast("bigint").cast("string"), F.lit(suffix)))

    return (
        F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), "")
        .when(x < 1000, F.floor(x).cast("string")).when(x < 1e6, scaled(1e3, "K")).otherwise(scaled(1e6, "M"))
    )


def byte_count(n: Column) -> Column:
    """512 B, 1.5 KB, 2.0 MB, 3.00 GB; a dash for null, negative and NaN counts."""
    x = n.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (x < 0), "\u2014").when(x < 1024, F.concat(F.floor(x).cast("string"), F.lit(" B")))
        .when(x < 1024**2, F.concat(F.format_string("%.1f", x / 1024), F.lit(" KB")))
        .when(x < 1024**3, F.concat(F.format_string("%.1f", x / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", x / 1024**3), F.lit(" GB")))
    )


def duration(ms: Column) -> Column:
    """m:ss or h:mm:ss."""
    s = F.floor(ms / 1000)
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(ms.isNull() | (ms < 0), "").when(s < 3600, short).otherwise(long)


def csv_cell(value: Column) -> Column:
    """A cell, quoted only if it holds a quote, a comma or a line end, with quotes doubled; null is an empty cell.

    Text that a spreadsheet would take for a formula gets an apostrophe before it.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(guarded.rlike('[",\n\r]'), quoted).otherwise(guarded)


def escape_markup(value: Column) -> Column:
    out = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def strip_tags(html: Column) -> Column:
    """Markup removed, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def safe_name(value: Column) -> Column:
    """For file names: other than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(value, "[^A-Za-z0-9._-]", "_")


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("@([A-Za-z0-9_]{1,15})"), F.lit(1))


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each value, in order."""
    return F.aggregate(
        values, F.array().cast("array<string>"),
        lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))),
    )


def short_url(url: Column, most: int = 42) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://(www\\.)?", ""), "/$", "")
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most - 1), F.lit("…"))).otherwise(bare)


def digest(record: Column) -> Column:
    """A fingerprint of a whole record, for comparing copies."""
    return F.xxhash64(F.to_json(record))


def avatar_colour(handle: Column) -> Column:
    """One of 8 colours, by the 31-polynomial of a handle's code points in 32 bits."""
    codes = F.transform(F.split(F.coalesce(handle, F.lit("")), ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32))) % 8


def resolve_spans(spans: Column) -> Column:
    """Of overlapping spans (kind, start, end) the earlier and longer stay; empty and inverted ones go."""
    sound = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["end"] > s["start"]))
    ordered = F.array_sort(sound, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return F.aggregate(
        ordered, F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc),
    )


def utf16_offset(text: Column, code_points: Column) -> Column:
    """A code-point offset as an offset in UTF-16 units."""
    before = F.substring(text, F.lit(1), code_points)
    return code_points + F.length(before) - F.length(F.regexp_replace(before, "[\\x{10000}-\\x{10FFFF}]", ""))


def magic_extension(content: Column) -> Column:
    """A file extension by a blob's first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("1A45DFA3"), "webm")
        .when(F.substring(head, 9, 8) == "66747970", "mp4").otherwise("bin")
    )


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of a text within another, one after the other without overlap; empty for an empty needle."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    ends = lambda i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda acc, p: acc + F.length(p)) + i * F.length(needle)
    found = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), ends)
    return F.when((F.length(needle) > 0) & (F.size(parts) > 1), found).otherwise(F.array().cast("array<int>"))


def link_spans(text: Column, urls: Column) -> Column:
    """(kind, start, end) of links that a text shows: each url's display form wherever it occurs, else its short form.

    urls is an array of (url, expanded_url, display_url); those that lead nowhere are passed over.
    """
    def one(u: Column) -> Column:
        safe = F.coalesce(F.coalesce(u["expanded_url"], u["url"]).rlike("(?i)^https?://"), F.lit(False))
        shown, short = occurrences(text, F.coalesce(u["display_url"], F.lit(""))), occurrences(text, F.coalesce(u["url"], F.lit("")))
        at = lambda starts, needle: F.transform(starts, lambda s: F.struct(F.lit("url").alias("kind"), s.alias("start"), (s + F.length(needle)).alias("end")))
        return F.when(safe & (F.size(shown) > 0), at(shown, u["display_url"])).when(safe, at(short, u["url"])).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))

    return F.flatten(F.transform(urls, one))


def listed_only(found: Column, listed: Column) -> Column:
    """Of tags or handles found in a text those that a list names, whatever their case."""
    known = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.lower(x))
    return F.filter(found, lambda x: F.array_contains(known, F.lower(x)))
