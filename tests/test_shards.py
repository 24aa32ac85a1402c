"""Greedy shards in parallel against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import shards


def sequential(rows, budget, most=None):
    """{place: shard} of rows (group, place, size), one after another."""
    out, now = {}, object()
    used = count = shard = 0
    for group, place, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        size = size or 0
        if group != now:
            now, used, count, shard = group, 0, 0, 0
        elif (used and used + size > budget) or (most and count == most):
            used, count, shard = 0, 0, shard + 1
        used, count = used + size, count + 1
        out[group, place] = shard
    return out


def cases():
    rng = random.Random(8)
    yield "one group of equal sizes", [("a", i, 7) for i in range(3000)], 100, None
    yield "one group of all rows", [("a", i, rng.randrange(1, 60)) for i in range(4000)], 100, None
    yield "oversize and empty records", [("a", i, rng.choice([0, 0, 1, 5, 30, 90, 101, 500, 5000])) for i in range(2500)], 100, None
    yield "many groups, nulls", [(rng.choice(["a", "b", None, "c"]), i, rng.choice([None, 0, 3, 40, 120])) for i in range(1500)], 100, None
    yield "records counted", [("a", i, rng.randrange(0, 30)) for i in range(3000)], 100, 6
    yield "records counted, small", [("a", i, rng.choice([0, 1, 2, 400])) for i in range(2000)], 100, 9
    yield "only oversize", [("a", i, 1000) for i in range(200)], 100, None
    yield "one of no size", [("a", 0, 0)], 100, None


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_equals_the_sequential_rule(spark, case):
    _, rows, budget, most = case
    df = spark.createDataFrame(rows, "g string, place long, size long").withColumn("shard", F.lit("clash")).repartition(7)
    got = shards.greedy(df, ["g"], ["place"], F.col("size"), budget, most, span=3)
    assert got.columns == ["g", "place", "size", "shard"]
    assert {(r["g"], r["place"]): r["shard"] for r in got.collect()} == sequential(rows, budget, most)


def test_no_rows(spark):
    assert shards.greedy(spark.createDataFrame([], "g string, place long, size long"), ["g"], ["place"], F.col("size"), 10).collect() == []


def test_walks_through_a_block_from_any_entry():
    rng = random.Random(1)
    for _ in range(300):
        budget, most = rng.randrange(5, 40), rng.choice([1 << 62, 3, 7])
        sizes = [rng.choice([0, 1, 3, 8, 50]) for _ in range(rng.randrange(1, 60))]
        block = shards._Block(shards.np.array(sizes), budget, most)
        used, count = rng.randrange(0, budget + 2), rng.randrange(0, 4)
        count = max(count, used > 0)
        starts, u, c = [], used, count
        for i, s in enumerate(sizes):
            if (u and u + s > budget) or c == most:
                starts.append(i)
                u = c = 0
            u, c = u + s, c + 1
        assert block.starts(used, count) == starts


def test_one_group_is_many_even_tasks(spark):
    rows = spark.range(60_000).select(F.lit("all").alias("g"), F.col("id").alias("place"), (F.col("id") % 90 + 10).alias("size"))
    seen = shards.greedy(rows, ["g"], ["place"], F.col("size"), 1000)
    assert seen.count() == 60_000 and seen.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 1000
    # What a task holds at once is a block: some budgets of sizes.
    assert spark.range(1).select(F.lit(shards.SPAN * 1000 / 55)).first()[0] < 60_000 / 100
