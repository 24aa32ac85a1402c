"""Ordered reading: keyset pages, search, sampling and jumps in time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.scratch import Tables, materialize, small


def keyset_page(rows: DataFrame, keys: Sequence[str], limit: int = 30, after: Sequence | None = None, where: Column | None = None) -> DataFrame:
    """The next `limit` rows in descending order of keys, strictly beyond the key `after`.

    One comparison of structs, so the bound reaches the scan; only `limit` rows leave each task.
    """
    if after is not None:
        bound = [F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]
        # The leading column by itself can be pushed into the scan.
        rows = rows.where((F.col(keys[0]) <= bound[0]) & (F.struct(*keys) < F.struct(*bound)))
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(*[F.col(k).desc() for k in keys]).limit(limit)


def page_status(page: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """(items, has_more, next_*) of a page: it may go on if it is full."""
    last = F.min(F.struct(*keys))
    return page.agg(F.count("*").alias("items"), (F.count("*") >= limit).alias("has_more"), last.alias("last")).select(
        "items", "has_more", *[F.when(F.col("has_more"), F.col(f"last.{k}")).alias(f"next_{k}") for k in keys]
    )


def scanned_page(rows: DataFrame, keys: Sequence[str], limit: int, budget: int, after: Sequence | None = None, where: Column | None = None) -> DataFrame:
    """(items, scanned, has_more, exhausted_scan, next_*): a page of matches for which at most `budget` rows are looked at.

    Rows are looked at in descending order of keys until the page is full or the budget used up. The
    next key is the last item's on a full page, else the last row's that was looked at; at the end
    of the rows there is none. items is an array of the matches' keys. The head of at most budget
    rows is numbered in one task, which the budget bounds.
    """
    if after is not None:
        bound = [F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]
        rows = rows.where((F.col(keys[0]) <= bound[0]) & (F.struct(*keys) < F.struct(*bound)))
    order = [F.col(k).desc() for k in keys]
    head = rows.select(*keys, F.coalesce(where if where is not None else F.lit(True), F.lit(False)).alias("hit")).orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = head.select(F.struct(*keys).alias("key"), "hit", F.count("*").over(w).alias("n"), F.count_if("hit").over(w).alias("hits"))
    full = F.min(F.when(F.col("hit") & (F.col("hits") == limit), F.col("n")))
    found = ranked.crossJoin(F.broadcast(ranked.agg(full.alias("full"), F.count("*").alias("looked")))).where(F.col("n") <= F.coalesce("full", "looked"))
    summed = found.agg(
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("key"))), asc=False).alias("items"), F.count("*").alias("scanned"),
        F.max("full").isNotNull().alias("page_full"), F.min("key").alias("last"),
    )
    more = F.col("page_full") | (F.col("scanned") >= budget)
    return summed.select("items", "scanned", more.alias("has_more"), (~F.col("page_full") & (F.col("scanned") >= budget)).alias("exhausted_scan"),
                         *[F.when(more, F.col(f"last.{k}")).alias(f"next_{k}") for k in keys])


def phrase_match(columns: Sequence[Column], phrase: str | None, as_is: Sequence[Column] = ()) -> Column:
    """One trimmed phrase, in lower case, within any column; an empty one matches all. as_is are not lower-cased."""
    term = (phrase or "").strip().lower()
    if not term:
        return F.lit(True)
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(term), F.lit(False))
    for c in as_is:
        test = test | F.coalesce(c.contains(term), F.lit(False))
    return test


def all_terms_match(columns: Sequence[Column], query: str) -> Column:
    """Every blank-separated term, in lower case, somewhere in the columns joined by line feeds."""
    hay = F.lower(F.concat_ws("\n", *columns))
    test = F.lit(True)
    for term in dict.fromkeys(query.lower().split()):
        test = test & hay.contains(term)
    return test


def merged_order(rows: DataFrame, created: str, captured: str, source: str, local: str) -> DataFrame:
    """Newest first by creation, else capture; ties by source and place."""
    return rows.orderBy(*merged_keys(created, captured, source, local))


def merged_keys(created: str, captured: str, source: str, local: str) -> list[Column]:
    """Sort keys of the merged order; rows with neither time come last, as if from 1970."""
    time = F.coalesce(F.col(created), F.col(captured), F.timestamp_seconds(F.lit(0)))
    return [time.desc(), F.col(source).asc(), F.col(local).asc()]


def numeric_id_order(ids: Column) -> list[Column]:
    """Sort keys that order digit strings as numbers of any length."""
    return [F.length(ids).asc(), ids.asc()]


def collated(text: Column, order: str = "UNICODE") -> Column:
    """Text that sorts and ranges as people expect it in all scripts: punctuation before digits before letters, small before large."""
    return F.collate(text, order)


def spread_sample(rows: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """`count` rows evenly spread over an order: positions floor((n - 1) k / (count - 1)).

    All rows if there are no more; the first if count is at most 1. Positions come from a global
    sort (range-partitioned) and the sizes of its partitions, not from one window over all rows.
    """
    placed = materialize(with_positions(rows, order))
    n = placed.agg(F.count("*")).first()[0]
    if n <= max(1, count):
        wanted = list(range(n if count > 1 else min(n, 1)))
    elif count <= 1:
        wanted = [0]
    else:
        wanted = sorted({(n - 1) * k // (count - 1) for k in range(count)})
    return placed.where(F.col("position").isin(wanted)) if wanted else placed.limit(0)


def with_positions(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with position (long, from 0) in a total order, by a distributed sort.

    The range-sorted partitions are written once, each row with its partition and its place there,
    to the folder in spark.checkpoint.dir. What is counted and what is numbered is then one table:
    a second sort would sample other bounds, and adaptive execution merge other partitions. Only
    the sizes of partitions, one number each, are gathered. Ties are broken by a hash of the whole
    row, so rows that share a key with a third of the table are still dealt to many tasks; rows
    that are equal in all columns take neighbouring positions. Empty input gives no rows.
    """
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    whole = [*order, F.xxhash64(*hashed)] if hashed else list(order)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]
    dealt = rows.repartitionByRange(*whole).sortWithinPartitions(*whole)
    placed = materialize(dealt.select(F.monotonically_increasing_id().alias("at"), *columns))
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    shift = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = materialize(sizes.select("part", F.coalesce(shift, F.lit(0)).alias("shift")))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)]
    return placed.withColumn("part", part).join(F.broadcast(shifts), "part").select(
        *[b for b, c in zip(back, rows.columns, strict=True) if c != "position"], (F.col("shift") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("position")
    )


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their place (long, from 0) in the order within each group.

    One sort by group and order, dealt by range, so a group with a third of all rows is many tasks;
    a group's first position, one row a group, is subtracted.
    """
    placed = with_positions(rows.drop("position"), [*[F.col(f"`{g}`").asc_nulls_first() for g in groups], *order])
    first = materialize(placed.groupBy(*groups).agg(F.min("position").alias("first")))
    test = F.lit(True)
    for g in groups:
        test = test & placed[g].eqNullSafe(first[g])
    met = placed.join(small(first), test)
    return met.select(*[placed[c] for c in rows.columns if c != name], (F.col("position") - F.col("first")).alias(name))


def running_max(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """rows with the greatest value (null, if none) of the rows before each in its group's order.

    Rows are dealt by ranges of group and order and written once, so a group with a third of all
    rows is many tasks: a window runs within each task's part of a group, and one over the parts,
    one row each, carries their maxima on.
    """
    whole = [*[F.col(f"`{g}`").asc_nulls_first() for g in groups], *order]
    placed = materialize(rows.repartitionByRange(*whole).sortWithinPartitions(*whole).select("*", F.monotonically_increasing_id().alias("__at")))
    placed = placed.withColumn("__part", F.shiftrightunsigned("__at", 33))
    parts = placed.groupBy(*groups, "__part").agg(F.max(value).alias("__most"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), F.max("__most").over(earlier).alias("__carried")))
    test = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        test = test & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    local = Window.partitionBy(*groups, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumn("__local", F.max(value).over(local)).join(small(carried), test)
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.greatest("__local", "__carried").alias(name))


def placed_parts(rows: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows dealt by ranges of group and order and sorted, with __at, which grows with the order; to be written before it is used twice.

    The upper bits of __at are the range's number. Ties are broken by a hash of the whole row.
    """
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    whole = [*[F.col(f"`{g}`").asc_nulls_first() for g in groups], *order, *([F.xxhash64(*hashed)] if hashed else [])]
    return rows.repartitionByRange(*whole).sortWithinPartitions(*whole).select("*", F.monotonically_increasing_id().alias("__at"))


def running_sum(placed: DataFrame, groups: Sequence[str], value: str, name: str, held: Tables) -> DataFrame:
    """A written table of placed_parts() with the sum of value over the rows before each in its group (0 for the first).

    A window runs within each range's part of a group; one over the parts, one row each, carries
    their sums on, so a group with a third of all rows is many tasks.
    """
    part = F.shiftrightunsigned("__at", 33)
    sums = placed.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups], part.alias("__p")).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*[f"__g_{g}" for g in groups]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.keep(sums.select("*", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carried")).drop("__sum"))
    cut = placed.withColumn("__part", part)
    local = Window.partitionBy(*groups, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    test = F.col("__part") == F.col("__p")
    for g in groups:
        test = test & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    met = cut.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(small(carried), test)
    return met.select(*[F.col(f"`{c}`") for c in placed.columns], (F.col("__local") + F.col("__carried")).alias(name))


def order_of(sampled: DataFrame, position: str, time: str) -> DataFrame:
    """(direction): asc, desc or mixed by steps between sampled neighbours; a nine-tenths rule."""
    step = F.col(time) > F.lag(time).over(Window.orderBy(position))
    back = F.col(time) < F.lag(time).over(Window.orderBy(position))
    counts = sampled.select(step.alias("up"), back.alias("down")).agg(
        F.count("*").alias("n"), F.count_if("up").alias("up"), F.count_if("down").alias("down")
    )
    moves = F.col("up") + F.col("down")
    return counts.select(
        F.when((F.col("n") < 3) | (moves == 0), "asc").when(F.col("down") >= 0.9 * moves, "desc")
        .when(F.col("up") >= 0.9 * moves, "asc").otherwise("mixed").alias("direction")
    )


def local_day(time: Column, offset_minutes: int) -> Column:
    """The date at a fixed offset from UTC."""
    return F.to_date(time + F.expr(f"interval {int(offset_minutes)} minutes"))


def jump_to_day(rows: DataFrame, time: str, tie: str, day: date, offset_minutes: int = 0) -> DataFrame:
    """The first row of a newest-first list that is not after a day, marked exact if it lies on it."""
    own = local_day(F.col(time), offset_minutes)
    return (
        rows.where(own <= F.lit(day)).orderBy(F.col(time).desc(), F.col(tie).desc()).limit(1)
        .withColumn("exact", own == F.lit(day))
    )


def jump(placed: DataFrame, time: str, day: date, direction: str, offset_minutes: int = 0, stride: int = 200, shown: Column | None = None) -> DataFrame:
    """(position, exact, shown): where a day begins in a list of any direction; no row if it lies before all of them.

    placed has position. In a list that falls the first row before the day's end counts, in one that
    rises the first that is not before its start. In a mixed list every stride-th row is looked at
    and the nearest to the day's start taken, the first of equals. exact tells whether the row lies
    on the day, shown whether it is among what a filter leaves.
    """
    start = F.lit(day).cast("timestamp_ntz") - F.expr(f"interval {int(offset_minutes)} minutes")
    end = start + F.expr("interval 1 day")
    known = placed.where(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp_ntz")).withColumn("shown", F.coalesce(shown if shown is not None else F.lit(True), F.lit(False)))
    row = F.struct("at", "shown")
    if direction == "mixed":
        gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("at"), start))
        found = known.where(F.col("position") % stride == 0).agg(F.min(F.struct(gap.alias("gap"), "position")).alias("best"), F.min_by(row, F.struct(gap, "position")).alias("row"))
        found = found.select(F.col("best.position").alias("position"), "row")
    else:
        fits = F.col("at") < end if direction == "desc" else F.col("at") >= start
        found = known.where(fits).agg(F.min("position").alias("position"), F.min_by(row, "position").alias("row"))
    return found.where("position is not null").select("position", ((F.col("row.at") >= start) & (F.col("row.at") < end)).alias("exact"), F.col("row.shown").alias("shown"))


def failure_streak(outcomes: DataFrame, partition: str, order: Sequence[str], failed: Column, stop: int = 5) -> DataFrame:
    """(partition, longest, stopped): the longest run of failures in a row, by gaps and islands."""
    w = Window.partitionBy(partition).orderBy(*order)
    marked = outcomes.withColumn("__failed", failed).withColumn(
        "__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = marked.groupBy(partition, "__island").agg(F.count_if("__failed").alias("run"))
    return runs.groupBy(partition).agg(F.max("run").alias("longest"), (F.max("run") >= stop).alias("stopped"))
