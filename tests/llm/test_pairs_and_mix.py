"""Joins, vectors and mixing against brute force on small fixtures."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import jaccard, mixing, vectors
from quillspark.llm.common import connected_components


def brute_components(ids, linked):
    label = {i: i for i in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b], key=lambda i: ids[i])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return [ids[label[i]] for i in range(len(ids))]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 6000 + i) for i in range(500)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()))
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    expected = dict(zip(nodes, brute_components(nodes, [(at[a], at[b]) for a, b in edges if a != b]), strict=True))
    assert got == expected
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_jaccard(spark):
    """Groups of near copies around the threshold, among them one with many members and chains."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(30)]
    texts = ["", None, "   ", "one", "ONE", "one two", "É é", "é É"]
    for size, copies, edits in ((40, 6, 1), (120, 70, 8), (60, 12, 2), (200, 25, 6)):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        last = base
        for k in range(copies):
            own = list(last if k % 3 == 2 else base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = word()
            last = own
            texts.append(("\t" if k % 2 else " ").join(own).upper() if k % 5 == 0 else " ".join(own))
    texts += [" ".join([word() for _ in range(25)] + passage) for _ in range(40)] + [texts[20]] * 3
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in docs]
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = dict(zip([d for d, _ in docs], zip(map(len, sets), brute_components([d for d, _ in docs], linked), strict=True), strict=True))
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, node int").repartition(7)
    got = {r[0]: (r[1], r[2]) for r in jaccard.components(frame).collect()}
    assert got == expected
    kept = {r[0] for r in jaccard.keep_first(frame).select("doc_id").collect()}
    assert kept == {d for d, (_, c) in expected.items() if d == c}
    assert jaccard.components(frame.limit(0)).count() == 0


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 24))
    x = np.concatenate([base] + [base[i % 120] + rng.normal(size=(1, 24)) * 0.05 for i in range(600)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = vectors._pruned(x)
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() <= 2 * vectors.DEGREE for r in table)
    found = list(zip(*vectors._range_search(x, table, x, 0.98), strict=True))
    true = set(zip(*np.nonzero(x @ x.T >= 0.98), strict=True))
    assert len(found) == len(set(found)) and set(found) <= true and len(found) >= 0.95 * len(true)
    a, b, _ = vectors._links(x, x, 0.98)
    assert set(zip(a, b, strict=True)) <= true
    for n in (1, 2, 3):
        assert vectors._pruned(x[:n]).shape[0] == n


def vectors_of(rng):
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[i % 5] + rng.normal(size=16) * 0.12 for i in range(300)]).reshape(-1, 16)
    x = np.concatenate([base, near, base[:3] * 2.0])
    rows = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x.astype(np.float32))]
    nan, none = float("nan"), None
    return rows + [(1000, none, 0), (1001, [0.0] * 16, 0), (1002, [1.0, none] + [0.0] * 14, 0), (1003, [nan] * 16, 1), (1004, rows[0][1], none), (1005, rows[0][1], 0), (1006, [], 0), (1007, [float("inf")] * 16, 1)]


def sound(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x)


def test_near_duplicates(spark, monkeypatch):
    rows = vectors_of(np.random.default_rng(2))
    unit = [np.array(x, dtype=float) / np.linalg.norm(x) if sound(x) and any(x) else None for _, x, _ in rows]
    ok = lambda a, b: rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.98
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if ok(a, b)]
    count = Counter(x for e in linked for x in e)
    component = brute_components([r[0] for r in rows], linked)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    # Small clusters and tasks, so that cells are split and one is cut into several tasks.
    monkeypatch.setattr(vectors, "CLUSTER", 16)
    monkeypatch.setattr(vectors, "TASK", 24)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and all(r["recall"] >= 0.9 for r in got.values())
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * 2 * len(linked) <= found <= 2 * len(linked)
    assert all(got[r[0]]["n_links"] <= count[i] for i, r in enumerate(rows))
    assert np.mean([got[r[0]]["component_id"] == component[i] for i, r in enumerate(rows)]) > 0.98
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(4096, 1024, 4), (32, 3, 1)])
def test_top_inner_products(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "ASK_BLOCK", "BAND"), sizes, strict=True):
        monkeypatch.setattr(vectors, name, value)
    rows = [(i, x) for i, x, _ in vectors_of(np.random.default_rng(4))] + [(2000 + i, [0.5] * 16) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted(tuple(r) for r in vectors.top_inner_products(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [int(np.floor(1024 * np.float64(np.float32(v)))) for v in x] for i, x in rows if sound(x)}
    expected = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:10]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)
    few = vectors.top_inner_products(frame.where("vec_id < 3"), F.lit(True)).count()
    assert few == 6 and vectors.top_inner_products(frame.limit(0), F.lit(True)).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(900)]
    docs += [(901, None, "a"), (902, "  ", "empty"), (None, "x y", "b"), (5, docs[5][1], docs[5][2])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(5)
    mixed = mixing.mix(frame, group=16)
    rows = mixed.collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 300 for s in names)
    again = mixing.mix(frame.repartition(2), group=16).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    repeated = Counter(r["doc_id"] for r in mixing.repeat(frame, group=16).collect())
    copies = Counter()
    for r in rows:
        copies[r["doc_id"]] += r["copies"]
    assert repeated == +copies
    assert mixing.mix(frame.limit(0)).count() == 0


def test_a_million_repeats_are_many_tasks(spark):
    """One text 40,000 times beside a few others: its copies are dealt to tasks before they are multiplied."""
    rows = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    rows = rows.union(spark.createDataFrame([(1, "four five", "b"), (2, "six", None)], "doc_id long, text string, source string"))
    mixed = mixing.mix(rows)
    assert mixed.count() == 40_002
    wanted = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum("copies")).collect() if r[1]}
    out = mixing.repeat(rows)
    assert out.columns == rows.columns
    assert {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.count("*")).collect()} == wanted
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.75 * sum(wanted.values())
