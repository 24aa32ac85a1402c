"""The index of pieces against the scan of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.timeline import all_terms_match


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    words = ["apple", "Äpfel", "pie", "an", "x", "snapple", "日本語", "a.b", "", "pineapple pie"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), [rng.choice(words)]) for i in range(1, 400)]
    rows += [(40_000, "apple far away", None), (70_000, None, ["apple"]), (None, "apple", None)]
    return spark.createDataFrame(rows, "id long, text string, tags array<string>")


@pytest.mark.parametrize("query", ["apple", "APPLE pie", "äpf 日本語", "an", "zebra", "a.b x apple", "napp"])
def test_equals_the_scan(table, query):
    hay = search.haystack([F.col("text")], [F.col("tags")])
    built = search.index(table, "id", hay)
    got = sorted(r["id"] for r in search.search(table, "id", hay, built, query).where("id is not null").collect())
    expected = sorted(r["id"] for r in table.where("id is not null").where(all_terms_match([hay], query)).collect())
    assert got == expected
    tab = search.list_bitmaps(table.where("id % 3 = 0"), "id")
    assert sorted(r["id"] for r in search.search(table, "id", hay, built, query, [tab]).where("id is not null").collect()) == [i for i in expected if i % 3 == 0]


def test_few_texts_are_looked_at_and_few_row_groups_read(spark, table):
    hay = search.haystack([F.col("text")], [F.col("tags")])
    built = search.index(table, "id", hay)
    hits = search.candidates(built, "far away").collect()
    assert [r["bucket"] for r in hits] == [2] and sum(bin(b).count("1") for b in hits[0]["bits"]) == 1
    plan = search.candidates(built, "far away")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(piece" in plan and "Join" not in plan
