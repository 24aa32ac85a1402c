"""Coercing and bounding raw values: what does not fit becomes null rather than an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_INTEGER = 2**53 - 1
TEXT_LIMIT = 200_000


def clean_string(value: Column, limit: int = TEXT_LIMIT) -> Column:
    """Cut to a number of characters; null stays."""
    return F.substring(value, 1, limit)


def non_empty(value: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.nullif(clean_string(value, limit), F.lit(""))


def is_record_id(value: Column) -> Column:
    """Ids are 1 to 25 digits; null for null."""
    return value.cast("string").rlike("^[0-9]{1,25}$")


def record_id(value: Column) -> Column:
    """An id, kept as text since it may exceed 64 bits."""
    return F.when(is_record_id(value), value.cast("string"))


def finite_number(value: Column) -> Column:
    number = F.expr("cast(null as double)") if value is None else value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def safe_integer(value: Column) -> Column:
    """Whole numbers that a double holds exactly."""
    number = finite_number(value)
    return F.when((number == F.floor(number)) & (F.abs(number) <= SAFE_INTEGER), number.cast("bigint"))


def handle(value: Column) -> Column:
    """A handle without its @, of 1 to 15 letters, digits and underscores."""
    bare = F.regexp_replace(F.trim(value), "^@", "")
    return F.when(bare.rlike("^[A-Za-z0-9_]{1,15}$"), bare)


def iso_timestamp(value: Column, fallback: Column | None = None) -> Column:
    """A timestamp out of ISO text, the fallback where it does not parse."""
    parsed = F.try_to_timestamp(value)
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def platform_timestamp(value: Column) -> Column:
    """Out of `Wed Oct 10 20:19:24 +0000 2018`; the weekday is not looked at."""
    return F.try_to_timestamp(F.substring(value, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def iso_text(value: Column) -> Column:
    """A timestamp as ISO text with milliseconds, in UTC if the session is."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strictly_true(value: Column) -> Column:
    return F.coalesce(value == F.lit(True), F.lit(False))


def parsed_record(text: Column) -> Column:
    """A variant out of JSON text that is one value from end to end, null otherwise. Within brackets the parser sees what follows a value, too."""
    within = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(within, "$[1]", "variant").isNull(), F.try_variant_get(within, "$[0]", "variant"))


def patched_settings(current: Column, patch: Column, flags: list[str], ranges: dict[str, tuple[int, int]], texts: list[str] = ()) -> Column:
    """Settings (a struct) with what a patch (JSON text) sets: booleans, whole numbers in a range and strings, each only as such.

    A value of another type or out of its range is ignored, not bent to fit.
    """
    at = lambda name: F.try_variant_get(F.try_parse_json(patch), f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(at(name)), F.lit(""))
    fields = {}
    for name in flags:
        fields[name] = F.when(kind(name) == "BOOLEAN", at(name).cast("boolean"))
    for name, (low, high) in ranges.items():
        n = F.when(kind(name).startswith("BIGINT"), F.try_variant_get(F.try_parse_json(patch), f"$.{name}", "bigint"))
        fields[name] = F.when(n.between(low, high), n)
    for name in texts:
        fields[name] = F.when(kind(name).startswith("STRING"), at(name).cast("string"))
    return F.struct(*[F.coalesce(value, current[name]).alias(name) for name, value in fields.items()])


def message_refusal(payload: Column, most_text: int, most_chars: int) -> Column:
    """Why a message (JSON text) is refused: its id, text, media, author or size; null if it is sound."""
    whole = F.try_parse_json(payload)
    at = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(at(name)), F.lit("VOID"))
    text = F.when(kind("text").startswith("STRING"), at("text").cast("string"))
    return (
        F.when(~F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False)), "no object").when(~kind("id").startswith("STRING") | record_id(at("id").try_cast("string")).isNull(), "id")
        .when(text.isNull() | (F.length(text) > most_text), "text").when(~kind("media").startswith("ARRAY") & (kind("media") != "VOID"), "media")
        .when(~kind("author").startswith("OBJECT") & (kind("author") != "VOID"), "author").when(F.length(payload) > most_chars, "size")
    )
