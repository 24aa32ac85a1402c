"""Greedy shards in parallel: what closes a shard depends on all before it, yet no group passes through one task.

Records are cut into blocks by their running sum of sizes, each some budgets wide. Wherever a walk
enters a block, its first close there is one of few records, and from each of these the walk through
the rest of the block is known beforehand. So a block is a map from what is used at its beginning to
what is used at its end; maps are put together by doubling, and each block is then walked once from
what it really begins with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.timeline import placed_parts, running_sum
from quillspark.scratch import Tables, small

#: Budgets that a block is wide, at least 3 so that every block but the last of a group closes a shard.
SPAN = 16


def _next_starts(sizes: np.ndarray, budget: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, next): running sums from 0, and the record that closes the shard that begins at each record (n if none)."""
    n = len(sizes)
    sums = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes, out=sums[1:])
    filled = np.searchsorted(sums[1:], sums[:-1], side="right")  # the first of any size; before it nothing closes
    over = np.searchsorted(sums[1:], sums[:-1] + budget, side="right")
    following = np.minimum(np.maximum(over, filled + 1), np.arange(n) + most)
    return sums, np.minimum(following, n)


def _first_close(sums: np.ndarray, budget: int, most: int, used: int, count: int) -> int:
    """The record before which a shard that comes in with so many bytes and records is closed, n if none."""
    n = len(sums) - 1
    at = int(np.searchsorted(sums[1:], budget - used, side="right"))
    if used == 0 and at < n and sums[at] == 0:
        at += 1  # an oversize record that comes first has the shard for itself
    return min(at, max(most - count, 0), n)


class _Block:
    """A block's records, walked from each of its records that can begin a shard first."""

    def __init__(self, sizes: np.ndarray, budget: int, most: int):
        self.budget, self.most, self.n = budget, most, len(sizes)
        self.sums, self.following = _next_starts(sizes, budget, most)
        self.last_first = _first_close(self.sums, budget, most, 0, 0)

    def exits(self) -> list[tuple[int, int, int, int]]:
        """(bound, used, count, closed) for each record that may be the first to close a shard here.

        bound is the running sum with the record; used (at most budget + 1, beyond which all is one),
        count and closed are what the walk ends with if a shard begins there.
        """
        n, following = self.n, self.following.tolist()
        ends: list[tuple[int, int, int]] = [(0, 0, 0)] * n
        for j in range(n - 1, -1, -1):
            k = following[j]
            ends[j] = (min(int(self.sums[n] - self.sums[j]), self.budget + 1), n - j, 0) if k >= n else (ends[k][0], ends[k][1], ends[k][2] + 1)
        return [(int(self.sums[j + 1]), *ends[j]) for j in range(min(self.last_first, n - 1) + 1)]

    def starts(self, used: int, count: int) -> list[int]:
        """The records that begin a shard, for a walk that comes in like this."""
        out, j = [], _first_close(self.sums, self.budget, self.most, used, count)
        while j < self.n:
            out.append(j)
            j = int(self.following[j])
        return out


def _blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[dict, pa.Table]]:
    """Runs of rows that are equal in keys, as (keys, rows); rows come sorted by them, one block is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if now is not None and rows[start] != now:
                    yield dict(zip(keys, now, strict=True)), pa.Table.from_batches(held)
                    held = []
                now = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield dict(zip(keys, now, strict=True)), pa.Table.from_batches(held)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    test = F.lit(True)
    for a, b in zip(left, right, strict=True):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def greedy(records: DataFrame, group: Sequence[str], order: Sequence[str], size: Column, budget: int, most: int | None = None, span: int = SPAN) -> DataFrame:
    """records with shard (from 0 in each group): closed before the record that would exceed the budget, or `most` records.

    A record that is larger than the budget by itself has its own shard, after records of no size at
    most. Null sizes are 0, negative ones an error of the caller. Records are ordered by order, ties
    by a hash of the whole row; null groups are a group; a column named shard is replaced. An empty
    table gives no rows. A block of `span` budgets is what a task holds of sizes, so a group of any
    size is many tasks; records of size 0 count as they come.
    """
    if span < 3:
        raise ValueError("a block must be at least 3 budgets wide")
    held = Tables()
    limit = most if most is not None else 1 << 62
    g = [f"__g{i}" for i in range(len(group))]
    rows = records.drop("shard")
    keyed = rows.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(group, g, strict=True)], F.coalesce(size.cast("bigint"), F.lit(0)).alias("__size"), *[F.col(f"`{c}`") for c in rows.columns])
    placed = held.keep(placed_parts(keyed, g, [F.col(f"`{c}`").asc() for c in order]))
    summed = running_sum(placed.select(*g, "__at", "__size"), g, "__size", "__start", held)
    cut = held.keep(summed.select(*g, F.floor(F.col("__start") / F.lit(span * budget)).cast("bigint").alias("__block"), "__at", "__size"))
    kinds = [T.StructField(c, placed.schema[c].dataType) for c in g]
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    in_order = lambda df: df.repartition(*g, "__block").sortWithinPartitions(*g, "__block", "__at")
    one = T.StructType(long("bound", "used", "count", "closed"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches, [*g, "__block"]):
            walked = _Block(block.column("__size").to_numpy(), budget, limit)
            first = [dict(zip(("bound", "used", "count", "closed"), e, strict=True)) for e in walked.exits()]
            # Only the last block of a group, or one behind an oversize record, may close no shard whatever comes in.
            ends = first if walked.last_first < walked.n else first[:1]
            known = sorted({(e["used"], e["count"] if most else 0) for e in ends})
            yield pa.RecordBatch.from_pylist([keys | {
                "first": first, "total": int(walked.sums[-1]), "records": walked.n, "zero": walked.last_first, "ends": [{"used": u, "count": c} for u, c in known],
            }], schema=pa.schema([*[(f, block.schema.field(f).type) for f in g], ("__block", pa.int64()), ("first", pa.list_(pa.struct([(f.name, pa.int64()) for f in one.fields]))),
                                  ("total", pa.int64()), ("records", pa.int64()), ("zero", pa.int64()), ("ends", pa.list_(pa.struct([("used", pa.int64()), ("count", pa.int64())])))]))

    pair = T.ArrayType(T.StructType(long("used", "count")))
    maps = held.keep(in_order(cut).mapInArrow(described, T.StructType([
        *kinds, *long("__block"), T.StructField("first", T.ArrayType(one)), *long("total", "records", "zero"), T.StructField("ends", pair)
    ])))
    before = maps.select(*[F.col(c).alias(f"__p{c}") for c in g], (F.col("__block") + 1).alias("__next"), F.col("ends").alias("entries"))
    whole = lambda used, count: F.array(F.struct(F.lit(used).cast("bigint").alias("used"), F.lit(count).cast("bigint").alias("count")))
    # A group begins with nothing used. A block without one before it lies behind an oversize record, which nothing may join.
    entries = F.when(F.col("__block") == 0, whole(0, 0)).otherwise(F.coalesce("entries", whole(budget + 1, 1 if most else 0)))
    met = maps.join(before, _same([*g, "__block"], [*[f"__p{c}" for c in g], "__next"]), "left").select(*g, "__block", "first", "total", "records", "zero", entries.alias("entries"))

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = row["first"]
                bounds = np.array([e["bound"] for e in first], dtype=np.int64)
                for entry in row["entries"]:
                    used, count = entry["used"], entry["count"]
                    at = row["zero"] if used == 0 else int(np.searchsorted(bounds, budget - used, side="right"))
                    at = min(at, max(limit - count, 0))
                    if at < len(first) and at < row["records"]:
                        e = first[at]
                        end = e["used"], e["count"] if most else 0, e["closed"] + 1
                    else:
                        end = min(used + row["total"], budget + 1), count + row["records"] if most else 0, 0
                    out.append({c: row[c] for c in g} | {
                        "__block": row["__block"], "used": used, "count": count, "known": len(row["entries"]) == 1, "to_used": end[0], "to_count": end[1], "closed": end[2]
                    })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[(c, batch.schema.field(c).type) for c in g], ("__block", pa.int64()), ("used", pa.int64()), ("count", pa.int64()), ("known", pa.bool_()),
                                                                    ("to_used", pa.int64()), ("to_count", pa.int64()), ("closed", pa.int64())]))

    nodes = held.keep(met.mapInArrow(evaluated, T.StructType([*kinds, *long("__block", "used", "count"), T.StructField("known", T.BooleanType()), *long("to_used", "to_count", "closed")])))
    key = [*g, "__block", "used", "count"]
    real = held.keep(_walked(nodes, g, key, held))
    base = F.coalesce(F.sum("closed").over(Window.partitionBy(*g).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = held.keep(real.select(*[F.col(c).alias(f"__p{c}") for c in g], F.col("__block").alias("__b"), "used", "count", base.alias("base")))
    told = cut.join(small(begun), _same([*g, "__block"], [*[f"__p{c}" for c in g], "__b"])).select(*g, "__block", "__at", "__size", "used", "count", "base")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, [*g, "__block"]):
            used, count, base = (block.column(c)[0].as_py() for c in ("used", "count", "base"))
            marks = np.zeros(block.num_rows, dtype=np.int64)
            marks[_Block(block.column("__size").to_numpy(), budget, limit).starts(used, count)] = 1
            for part in pa.Table.from_arrays([block.column("__at"), pa.chunked_array([pa.array((base + np.cumsum(marks)).astype(np.int32))])], names=["__n", "shard"]).to_batches(10_000):
                yield part

    numbers = held.keep(in_order(told).mapInArrow(numbered, "__n long, shard int"))
    out = placed.join(small(numbers), F.col("__at") == F.col("__n")).select(*[F.col(f"`{c}`") for c in rows.columns], "shard")
    held.close(placed, numbers)
    return out


def _walked(nodes: DataFrame, g: Sequence[str], key: Sequence[str], held: Tables) -> DataFrame:
    """The nodes that walks really come through: those known beforehand, and what these lead to.

    Links from node to node are doubled until none is left, then followed from the longest to the
    shortest, each of which at most doubles what is known. Mostly walks through a block end alike
    wherever they came in, and there is nothing to follow.
    """
    known = nodes.where("known").select(*key)
    if nodes.where("not known").isEmpty():
        return nodes.where("known").select(*key, "closed")
    to = [f"__t{i}" for i in range(len(key))]
    open_ = nodes.where("not known").select(*[F.col(c).alias(a) for c, a in zip(key, to, strict=True)])
    leads = nodes.select(*key, *[F.col(c).alias(f"__l{i}") for i, c in enumerate(g)], (F.col("__block") + 1).alias("__lb"), "to_used", "to_count")
    links = [held.keep(leads.join(open_, _same([*[f"__l{i}" for i in range(len(g))], "__lb", "to_used", "to_count"], to)).select(*key, *to))]
    while not links[-1].isEmpty():
        step = links[-1]
        again = step.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"__u{i}") for i, c in enumerate(to)])
        longer = step.join(again, _same(to, [f"__k{i}" for i in range(len(key))])).select(*key, *[F.col(f"__u{i}").alias(c) for i, c in enumerate(to)])
        links.append(held.keep(longer))
    found = held.keep(known)
    for step in reversed(links[:-1]):
        ends = step.join(found.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(key)]), _same(key, [f"__f{i}" for i in range(len(key))]), "left_semi")
        found = held.keep(found.union(ends.select(*[F.col(a).alias(c) for a, c in zip(to, key, strict=True)])).distinct())
    return nodes.join(found.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(key)]), _same(key, [f"__f{i}" for i in range(len(key))]), "left_semi").select(*key, "closed")
