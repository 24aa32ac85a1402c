"""Schema-less merges against a fold of whole records."""

import json
import random

from quillspark.operators import records


def absent(v):
    return v is None or v == "" or v == []


def fold(before, after):
    if isinstance(before, dict) and isinstance(after, dict):
        return {k: fold(before[k], after[k]) if k in before and k in after else after.get(k, before.get(k)) for k in before.keys() | after.keys()}
    return before if absent(after) else after


def some(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind > 5:
        return {k: some(rng, depth + 1) for k in rng.sample(["a", "b", 'q"/x', "n"], rng.randrange(0, 4))}
    return [None, "", [], [1, {"a": None}], rng.choice(["t", "ü\n"]), rng.choice([0, False, 7, -2.5])][kind]


def test_equals_folding_whole_records(spark):
    rng = random.Random(12)
    rows = []
    for key in range(60):
        for place in range(rng.randrange(1, 6)):
            rows.append((key if key else None, place, json.dumps({k: some(rng) for k in rng.sample("abcd", rng.randrange(0, 4))}), "clash"))
    rows += [(99, 0, "no json", ""), (99, 1, "[1]", ""), (98, 0, None, ""), (97, 0, '{"a":1}', ""), (97, 0, '{"a":1}', "")]
    got = records.merge_records(spark.createDataFrame(rows, "id long, at int, body string, v string"), "id", "body", ["at"])
    expected = {}
    for key, place, body, _ in sorted(rows[:-5], key=lambda r: r[1]):
        new = json.loads(body)
        expected[key] = fold(expected[key], new) if key in expected else new
    expected[97] = {"a": 1}
    assert {r["id"]: json.loads(r["body"]) for r in got.collect()} == expected


def test_a_list_of_nothing_and_no_rows(spark):
    assert records.merge_records(spark.createDataFrame([], "id long, at int, body string"), "id", "body", ["at"]).collect() == []
    rows = spark.createDataFrame([(1, 0, '{"a":{"x":1,"y":{"z":[2]}}}'), (1, 1, '{"a":"text"}'), (1, 2, '{"a":{"k":3}}'), (1, 3, '{"a":null,"b":""}')], "id long, at int, body string")
    assert [r["body"] for r in records.merge_records(rows, "id", "body", ["at"]).collect()] == ['{"a":{"k":3},"b":""}']
