"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, Tables, materialize, small

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: Neither a source nor a document is taken more often than this.
MOST = 3.0
#: Documents that one task rounds together at a level of the reduction tree.
GROUP = 128
#: Copies of one text that a task writes; what comes oftener is dealt to several first.
COPIES = 1_000
_TINY = 1e-9


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    The sum of all sizes is shared by weight; a source's target stops at `most` times its size and
    what is left over is shared again by weight. That fixed point is found without iterating: with
    sources ordered by cap over weight, those up to the first below the common level are capped.
    A source of size 0 has target 0. The table has one row a source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = by_source.withColumn("weight", share).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    # Up to the first source that stays under its cap the level rises, beyond it falls.
    common = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(every)
    return (
        weighed.withColumn("level", level).withColumn("common", common)
        .select("source", "source_size", "source_rows",
                F.when(F.col("common").isNull(), F.col("cap"))
                .otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"))
    )


def _u(key: Column, level: int) -> Column:
    """A number in [0, 1) that depends on the document and the level only."""
    return (F.pmod(F.xxhash64(key, F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40)))


def _pivot_fold(units: Column, unit: str, done: str) -> Column:
    """Fold units (key, size, whole, part, u) into struct(done: array, left: unit or null).

    One unit is carried along. It and the next exchange words, size times part staying constant in
    sum, until the copy probability of one of them is 0 or 1; that one is done, the other is
    carried on. The direction is drawn with the odds that keep each expectation. unit and done are
    the two SQL types.
    """
    zero = F.struct(F.array().cast(f"array<{done}>").alias("done"), F.lit(None).cast(unit).alias("left"))

    def settle(x: Column, up: Column) -> Column:
        return F.struct(x["key"].alias("key"), (x["size"] * (x["whole"] + up.cast("bigint"))).alias("taken"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        sa, sb = a["size"].cast("double"), b["size"].cast("double")
        # Words that can move from b to a, and from a to b.
        rise = F.least((1.0 - a["part"]) * sa, b["part"] * sb)
        fall = F.least(a["part"] * sa, (1.0 - b["part"]) * sb)
        up = b["u"] * (rise + fall) < fall
        moved = F.when(up, rise).otherwise(-fall)
        pa, pb = a["part"] + moved / sa, b["part"] - moved / sb
        # Exactly the unit that set the bound is integral now, whatever the rounding of the division.
        a_done = F.when(up, (1.0 - a["part"]) * sa <= b["part"] * sb).otherwise(a["part"] * sa <= (1.0 - b["part"]) * sb)
        b_high = ~up
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("left"))).otherwise(
            F.when(a_done, F.struct(
                F.concat(acc["done"], F.array(settle(a, up))).alias("done"),
                b.withField("part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), pb))).alias("left"),
            )).otherwise(F.struct(
                F.concat(acc["done"], F.array(settle(b, b_high))).alias("done"),
                a.withField("part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), pa))).alias("left"),
            ))
        )

    return F.aggregate(units, zero, step)


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, group: int = GROUP) -> DataFrame:
    """(doc_id, text_hash, copies, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    copies is how often the mix holds the document, taken the words it thus gives. A document's
    expected copies are target / source_size; their whole part is certain, the rest is rounded by
    pairs so that a source's taken words keep their sum up to the last unit of each source, which
    is rounded alone. Large units go first in a group, so the one left over tends to be small.

    Rounding is a reduction tree: groups of about `group` documents of a source (dealt by hash, so
    a source with a third of all rows is spread over many tasks) are folded with aggregate(), each
    leaves at most one fractional unit, and those are grouped again. Deterministic: groups, order
    and draws depend on doc_id and text only. Nulls: a null text or one without words has size 0
    and is taken 0 words; null doc_id and null source are kept, null source sorting last. Rows
    equal in doc_id, text and source share one key; they are counted, numbered and dealt to groups
    as separate units, so a million repeats are many small groups. Empty input gives no rows; other
    columns are ignored. Shares are worked out in one task, over one row a source.
    """
    held = Tables()
    counted = docs.select(
        "doc_id", "source",
        F.xxhash64("text").alias("text_hash"),
        F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint").alias("size"),
    ).groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").cast("int").alias("rows"))
    sized = held.keep(counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows"))
    targets = held.keep(source_targets(sized, weights, most))
    unit = F.struct(
        F.struct("doc_id", "source", "text_hash", "size", "source_size", "target").alias("key"),
        F.col("size"), F.col("whole"), F.col("part"), F.col("u"),
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sized.join(small(targets), sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("share", share)
        .withColumn("whole", F.floor(F.col("share") + _TINY).cast("bigint"))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("share") - F.col("whole")))
        .withColumn("groups", F.ceil(F.col("source_rows") / group))
        .withColumn("u", _u(F.concat_ws(":", "doc_id", "text_hash", "nth"), 0))
        .select("source", "groups", F.xxhash64("doc_id", "text_hash", "nth", F.lit("group")).alias("deal"), unit.alias("unit"))
    )
    unit_type = units.schema["unit"].dataType.simpleString()
    key_type = units.schema["unit"].dataType["key"].dataType.simpleString()
    fixed = (F.col("unit.part") <= _TINY) | (F.col("unit.size") == 0)
    plain = units.where(fixed).select(F.col("unit.key").alias("key"), (F.col("unit.size") * F.col("unit.whole")).alias("taken"))
    open_units = units.where(~fixed)
    done = [plain]
    groups_left = targets.agg(F.max(F.ceil(F.col("source_rows") / group))).first()[0] or 0
    level = 0
    while groups_left:
        folded = (
            open_units.withColumn("g", F.pmod("deal", "groups"))
            .groupBy("source", "groups", "g")
            .agg(F.collect_list("unit").alias("units"))
            .withColumn("units", F.array_sort("units", lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1)
                                              .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
            .withColumn("folded", _pivot_fold(F.col("units"), unit_type, f"struct<key:{key_type},taken:bigint>"))
            .select("source", "groups", "g", "folded")
        )
        folded = held.keep(folded)
        done.append(folded.select(F.explode("folded.done").alias("d")).select("d.key", "d.taken"))
        left = folded.where("folded.left is not null").select("source", "groups", "g", F.col("folded.left").alias("unit"))
        level += 1
        if groups_left == 1:
            up = _u(F.col("unit.key"), -1) < F.col("unit.part")
            done.append(left.select(F.col("unit.key").alias("key"), (F.col("unit.size") * (F.col("unit.whole") + up.cast("bigint"))).alias("taken")))
            break
        groups_left = -(-groups_left // group)
        open_units = left.select(
            "source", F.ceil(F.col("groups") / group).alias("groups"), F.col("g").alias("deal"),
            F.col("unit").withField("u", _u(F.col("unit.key"), level)).alias("unit"),
        )
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = materialize(out.select(
        "key.doc_id", "key.source", "key.text_hash",
        F.when(F.col("key.size") > 0, F.col("taken") / F.col("key.size")).otherwise(F.lit(0)).cast("bigint").alias("copies"),
        "key.size", "key.source_size", "key.target", "taken",
    ))
    held.close()
    return out


def repeat(docs: DataFrame, weights=WEIGHTS, most: float = MOST, group: int = GROUP) -> DataFrame:
    """The rows of docs as often as mix() takes them, 0 times too, with the columns of docs.

    Rows equal in doc_id, source and text share their copies, which all come from one of them; only
    such rows are made distinct. Texts are shuffled once, for the join with their copies. Other
    columns stay, whatever their names.
    """
    mixed = mix(docs, weights, most, group).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    mixed = materialize(mixed.where("copies > 0"))
    keyed = docs.select(F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def met(of: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c in ("doc_id", "source", "text_hash"):
            same = same & F.col(f"k.key.{c}").eqNullSafe(F.col(f"m.{c}"))
        return keyed.alias("k").join(small(of, mixed).alias("m"), same).select("key", "row", "copies")

    once = met(mixed.where("rows = 1"))
    if not mixed.where("rows > 1").isEmpty():
        once = once.union(met(mixed.where("rows > 1")).dropDuplicates(["key"]))
    if not mixed.where(F.col("copies") > COPIES).isEmpty():
        # A text that comes very often is dealt to several tasks before it is multiplied.
        parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))
        once = once.withColumn("part", parts).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES)).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
