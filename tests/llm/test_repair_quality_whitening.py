"""Conversation repair, quality rules and whitening against brute force, and their odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import quality, repair, whitening

# -- conversation repair ---------------------------------------------------------------------------


def brute_repair(roles, faults):
    """Least (cost, audit) by trying all edits of a node, from the end, with no bound."""
    table = {}
    n = len(roles)
    for i in range(n, -1, -1):
        now = {s: (0, "") if i == n and s in (0, 3) else (10**9, "") for s in range(4)}
        for _ in range(4):  # inserts lead to other states of the same place
            for s in range(4):
                options = [now[s]]
                after = now[{0: 2, 1: 2, 2: 3, 3: 2}[s]]
                options.append((after[0] + 2, "I" + after[1]))
                if i < n:
                    nxt = table[i + 1]
                    options.append((nxt[s][0] + 3, "D" + nxt[s][1]))
                    if faults[i] not in "bd":
                        t = faults[i] == "t"
                        keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, roles[i]))
                        if keep:
                            options.append((nxt[keep][0] + t, "K" + nxt[keep][1]))
                        to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                        options.append((nxt[to][0] + 2 + t, "R" + nxt[to][1]))
                now[s] = min(options)
        table[i] = now
    return table[0][0]


def test_search_equals_trying_all_edits():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(0, 9)
        roles, faults = "".join(rng.choice("suuaa-") for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))
        found = repair.cheapest(roles, faults)
        assert min(v for s, v in found.items() if s in (0, 3)) == brute_repair(roles, faults), (roles, faults)
        assert list(repair.cheapest(roles, faults, first=True).values())[0] == brute_repair(roles, faults)
        cut = rng.randrange(0, n + 1)
        joined = repair._Joined()
        joined.add({0: repair.cheapest(roles[:cut], faults[:cut], 0, last=False)})
        joined.add({e: repair.cheapest(roles[cut:], faults[cut:], e, last=True) for e in range(4)})
        assert joined.end() == brute_repair(roles, faults)


def test_bound_is_admissible_and_looks_at_few_nodes():
    # A clean conversation goes straight through: one node a turn, however long it is.
    cost, audit = repair.cheapest("ua" * 3000, "-" * 6000, first=True)[3]
    assert (cost, audit) == (0, "K" * 6000)


TURNS = "conv_id long, turn long, role string, text string, extra int, n_turns string"


def brute_plan(rows):
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        groups[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text, turn))
    for conv, own in groups.items():
        own.sort()
        seen, faults = set(), ""
        for _, _, role, _, text, _ in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"
            seen.add((role, text))
        roles = "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "-" for r in own)
        turns = sorted({r[5] for r in own if r[5] is not None})
        cost, audit = brute_repair(roles, faults)
        out[conv] = (
            len(own), turns[-1] - turns[0] + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)), cost, audit,
        )
    return out


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(11)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?  ", " \n\t", "", None, f"t{turn}.", "Ü!"])
            rows.append((rng.choice([conv, conv, None]) if conv == 3 else conv, None if rng.random() < 0.1 else turn + (turn > 4), role, text, 1, "x"))
    rows += [(77, 1, "user", "same.", 1, "x")] * 9  # repeated rows
    rows += [(78, None, None, None, 1, "x"), (79, 5, "assistant", "long. " * 20_000, 1, "x")]
    return rows


@pytest.mark.parametrize("bits", [0, 1, 2, 10])
def test_plans_equal_brute_force_at_any_segment(spark, odd_turns, bits):
    got = repair.plan(spark.createDataFrame(odd_turns, TURNS), bits)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_plan(odd_turns)


def test_repaired_turns_and_their_digests(spark, odd_turns):
    turns = spark.createDataFrame(odd_turns, TURNS)
    plans = repair.plan(turns).cache()
    rows = repair.repaired(turns, plans).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        by[r["conv_id"]].append(r)
    for conv, own in by.items():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own)), conv
        assert all(r["text"] == "" for r in own if r["edit"] == "I")
    for r in plans.collect():
        assert Counter(x["edit"] for x in by.get(r["conv_id"], [])) == Counter(c for c in r["audit"] if c != "D")
    digests = dict(map(tuple, repair.digests(turns, plans).collect()))
    assert digests == {c: hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() for c, own in by.items()}


def test_repair_of_conversations_that_lose_all_rows_and_of_none(spark):
    ids = [i for i in range(4000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    got = repair.repair_damaged(spark.createDataFrame([(i, 0, "user", "Hi.") for i in ids], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
    assert repair.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# -- quality rules -----------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 4, "x " * 5, "x " * 6, "x " * 500, "# * $ %", "é à b 日本 𝒳", "l\nl\n \nm\nl", "a\x0bb\x0cc\x1cd\x85e", "w" * 100_000]
    for _ in range(60):
        out.append(" ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n", "\r\n a"]))
    return out


def test_measures_equal_brute_force(spark):
    for text in odd_texts():
        assert quality.measured(None if text is None else text.encode()) == brute_measures(text), text
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(odd_texts())], "doc_id long, text string, n_words int")
    got = quality.measure(docs)
    assert got.columns == ["doc_id", *quality.MEASURES]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: brute_measures(t) for i, t in enumerate(odd_texts())}


GOOD = "these are nine words and one more of them all"


def test_hosts_are_judged_by_shrunken_rates(spark):
    rows = [(i, GOOD, "good") for i in range(60)] + [(100 + i, "short" if i < 58 else GOOD, "bad") for i in range(60)]
    rows += [(200, GOOD, "one"), (201, "short", "tiny"), (202, GOOD, None), (202, GOOD, None), (None, GOOD, "good"), (203, None, "good")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"))
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["kept"] for i in range(60)) and len(by[202]) == 2 and all(r["kept"] and r["host_rate"] is None for r in by[202])
    assert not any(by[100 + i][0]["kept"] for i in range(60)) and not by[159][0]["base_failed"]
    assert by[200][0]["kept"] and by[None][0]["kept"] and not by[203][0]["kept"] and by[203][0]["n_words"] == 0
    assert 0 < by[200][0]["host_rate"] < 0.5 < by[201][0]["host_rate"] < 1  # drawn towards the rate of all


def test_prior_by_moments(spark):
    rng = np.random.default_rng(2)
    rates = rng.beta(2, 8, 3000)
    rows = [(int(n), int(rng.binomial(n, p))) for n, p in zip(rng.integers(5, 80, 3000), rates, strict=True)]
    rate, weight = quality.prior(spark.createDataFrame(rows, "documents long, failures long"))
    assert abs(rate - 0.2) < 0.02 and 8 < weight < 12.5
    assert quality.prior(spark.createDataFrame([], "documents long, failures long")) == (0.0, quality.STRONGEST)
    assert quality.prior(spark.createDataFrame([(10, 3)], "documents long, failures long")) == (0.3, quality.STRONGEST)


def test_no_documents_to_judge(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string"), F.col("source")).collect() == []


# -- whitening ---------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("x", T.StringType())])


def brute_whitening(vectors, k=4):
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fitted = np.array(sorted({tuple(v) for v in x.values()}), dtype=float)
    n = len(fitted)
    c = fitted - fitted.mean(axis=0)
    values, found = np.linalg.eigh(c.T @ c / n)
    return x, n, fitted.sum(axis=0).astype(int), values[::-1][:k], found[:, ::-1][:, :k], np.trace(c.T @ c / n)


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)
    vectors = {i: base[i].tolist() for i in range(300)} | {400 + i: base[7].tolist() for i in range(50)}
    odd = {500: None, 501: [None] + [1.0] * 23, 502: [float("nan")] * 24, 503: [float("inf")] * 24}
    rows = [(i, v, "clash", "clash") for i, v in (vectors | odd).items()]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    x, n, sums, values, found, trace = brute_whitening(vectors)
    assert {r["vec_id"] for r in got} == set(vectors) and len(got) == 4 * len(vectors) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        k = r["component"] - 1
        own = np.array(x[r["vec_id"]])
        assert r["deviation"] == int(((n * own - sums) ** 2).sum())
        exact = float((own - sums / n) @ found[:, k] / np.sqrt(values[k]))
        sign = signs.setdefault(k, np.sign(exact * r["whitened"]))
        assert abs(sign * exact - r["whitened"]) < 1e-9
        assert abs(r["explained"] - values[k] / trace) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_few_and_unequal_vectors(spark):
    make = lambda vs: whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vs)], VECTORS)).collect()
    assert make([]) == [] and make([None]) == [] and make([[1.0, 2.0]] * 3) == [] and make([[]]) == []  # nothing varies
    two = make([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], None])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in two] == [(i, 1, 2, 256 * 256, 1.0, 1.0) for i in range(3)]
    unequal = make([[1.0, 2.0, 0.0], [1.0, 2.0], [3.0], []])  # filled up with zeros: the first two are one vector
    assert {r["n"] for r in unequal} == {3} and {r["component"] for r in unequal} == {1, 2} and len(unequal) == 8
    huge = make([[1e30, 0.0], [-1e30, 0.0], [0.0, 1.0]])
    # Entries beyond a long become the largest or smallest; what varies next to nothing beside them is no component.
    assert len(huge) == 3 and [r["deviation"] for r in sorted(huge, key=lambda r: r["vec_id"])] == [None, None, 262145]


def test_lanczos_survives_breakdown_multiplicity_and_shrinking():
    rng = np.random.default_rng(9)
    width = 150
    basis = np.linalg.qr(rng.normal(size=(width, width)))[0]
    for values, options in [
        (np.array([5.0] * 6 + [1.0] * 4 + [0.0] * 140), {}),  # a few subspaces: blocks vanish
        (np.linspace(3, 1, width) ** 3, {"basis": 40, "block": 4, "tolerance": 1e-12}),  # does not fit the basis
        (np.ones(width), {}),
    ]:
        a = basis @ np.diag(values) @ basis.T
        got, vectors, report = whitening.block_lanczos(lambda b, a=a: a @ b, width, 4, **options)
        assert np.allclose(got, np.sort(values)[::-1][:4], atol=1e-9), report
        assert np.abs(a @ vectors - vectors * got).max() < 1e-9 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-9
    assert report["passes"] < 10
