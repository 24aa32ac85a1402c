"""Merges of records without a schema: JSON taken apart into paths, merged by path, built again by depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Tables, materialize, small

#: Levels of nesting that are taken apart; an object below them counts as a value of its own.
LEVELS = 32


def merge_records(rows: DataFrame, key: str, record: str, order: Sequence[str]) -> DataFrame:
    """(key, record): the JSON objects of each key folded in an order, as JSON with sorted keys.

    Objects are merged member by member at any depth, and what only earlier ones have stays. Of other
    values (lists whole) the later one counts unless it is null, an empty text or an empty list; where
    none is an answer the first stays. A value that replaces an object, or an object that replaces a
    value, ends what was below it. Records that are no JSON objects are left out, and so are keys
    without any; a null key is a key; rows that are equal in order are folded by their text.

    No copies are collected: at each depth a path knows the last value and the last object, by
    aggregates with partial sums, and members from before the last value above them are gone.
    """
    held = Tables()
    parsed = rows.select(F.col(key).alias("__id"), F.struct(*order, F.col(record).alias("__text")).alias("t"), F.try_parse_json(F.col(record)).alias("v"))
    level = held.keep(parsed.where(F.schema_of_variant("v").startswith("OBJECT")).select("__id", F.lit("").alias("path"), F.lit("").alias("parent"), F.lit("").alias("name"), "t", "v"))
    answers: list[DataFrame] = []
    for depth in range(LEVELS + 1):
        shape, text = F.schema_of_variant("v"), F.to_json("v")
        is_object = shape.startswith("OBJECT") & F.lit(depth < LEVELS)
        absent = F.col("v").isNull() | (shape == "VOID") | (text == '""') | (text == "[]")
        value = ~is_object & ~absent
        last = held.keep(level.groupBy("__id", "path", "parent", "name").agg(
            F.max(F.when(value, F.col("t"))).alias("value_at"), F.max_by(F.when(value, text), F.when(value, F.col("t"))).alias("value"),
            F.max(F.when(is_object, F.col("t"))).alias("object_at"), F.min_by(F.when(absent, text), F.when(absent, F.col("t"))).alias("nothing"),
        ).withColumn("is_object", F.col("object_at").isNotNull() & F.coalesce(F.col("object_at") > F.col("value_at"), F.lit(True))))
        answers.append(last)
        inner = last.where("is_object").select(F.col("__id").alias("__i"), F.col("path").alias("__p"), "value_at")
        opened = level.where(is_object).join(small(inner, last), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("path") == F.col("__p")))
        members = opened.where(F.coalesce(F.col("t") > F.col("value_at"), F.lit(True))).select("__id", "path", "t", F.explode(F.col("v").cast("map<string,variant>")).alias("name", "v"))
        # A path is its names as JSON texts, so no name can look like two.
        named = F.concat("path", F.lit("/"), F.to_json(F.struct(F.col("name").alias("n"))))
        below = held.keep(members.select("__id", named.alias("path"), F.col("path").alias("parent"), "name", "t", "v"))
        held.drop(level)
        level = below
        if below.isEmpty():
            break
    built = None
    for last in reversed(answers):
        text = F.coalesce("value", "nothing", F.lit("null"))
        if built is None:
            own = F.when(F.col("is_object"), "{}").otherwise(text)
            done = last.select("__id", "path", "parent", "name", own.alias("json"))
        else:
            inside = held.keep(built.groupBy(F.col("__id").alias("__i"), F.col("parent").alias("__p")).agg(F.sort_array(F.collect_list(F.struct("name", "json"))).alias("members")))
            # A name as a JSON text: what to_json makes of {"n": name}, without what is around it.
            quoted = lambda m: F.regexp_extract(F.to_json(F.struct(m["name"].alias("n"))), r"(?s)\A\{\"n\":(.*)\}\z", 1)
            whole = F.concat(F.lit("{"), F.array_join(F.transform("members", lambda m: F.concat(quoted(m), F.lit(":"), m["json"])), ","), F.lit("}"))
            met = last.join(small(inside), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("path") == F.col("__p")), "left")
            done = met.select("__id", "path", "parent", "name", F.when(F.col("is_object"), F.coalesce(whole, F.lit("{}"))).otherwise(text).alias("json"))
        built = held.keep(done)
    out = materialize(built.select(F.col("__id").alias(key), F.col("json").alias(record)))
    held.close()
    return out
