"""Classifiers by held-out accuracy, and what they say of odd texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid, toxicity
from quillspark.llm.sampling import held_out


def test_language(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = langid.identify(docs.withColumn("score", F.lit("clash")), langid.fit(docs))
    right = named.where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "a", "en"), (5, "the and " * 90_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(odd.limit(0))
    assert langid.identify(odd, none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.withColumn("toxicity", F.lit("clash")), model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = scored.select("toxic", (F.col("toxicity") >= toxicity.THRESHOLD).cast("int")).collect()
    hits = sum(a and b for a, b in rows)
    assert hits / sum(a for a, _ in rows) >= 0.95 and hits / max(1, sum(b for _, b in rows)) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "fine " * 50_000), (4, "you are an 1d1ot and a m.o.r.o.n, l o s e r you " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(odd, model).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and max(got[1], got[2], got[3]) < 0.3
    assert toxicity.fit(docs.limit(0), labels).score(np.zeros((1, len(toxicity.FEATURES))))[0] < 0.3
    assert toxicity.fit(docs, labels.limit(0)).score(np.zeros((1, len(toxicity.FEATURES))))[0] < 0.3


def test_isotonic_is_nearest_nondecreasing():
    rng = random.Random(1)
    x = np.array([rng.random() for _ in range(200)])
    y = np.array([float(rng.random() < v) for v in x])
    out = toxicity.Isotonic().fit(x, y)(np.sort(x))
    assert (np.diff(out) >= -1e-12).all() and abs(out.mean() - y.mean()) < 0.05


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    margin = toxicity.Boosted().fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == (y[1500:] > 0)).mean() > 0.95


def test_subword_counts_equal_counting_one_by_one(monkeypatch):
    monkeypatch.setattr(langid, "_SLICE", 50)  # long texts are cut, with an overlap
    rng = random.Random(4)
    for text in ["a", "Hello, World!", "Größe  naïve", "日本 語", " ".join(rng.choice(["ab", "c", "Straße", "1", "!"]) for _ in range(80))]:
        raw = langid._CODES[np.frombuffer((" " + text + " ").encode(), dtype=np.uint8)].astype(int).tolist()
        expected = np.zeros(langid.BUCKETS, dtype=int)
        for order in langid._ORDERS:
            for i in range(len(raw) - order + 1):
                gram = raw[i:i + order]
                if (32 in gram[1:-1]) if order > 2 else gram == [32] * order or (order == 2 and gram == [32, 32]):
                    continue
                h = order
                for k, code in enumerate(gram):
                    h = ((h ^ code) * int(langid._FACTORS[k])) % 2**32
                    h ^= h >> 15
                expected[h % langid.BUCKETS] += 1
        assert langid.bucket_counts(text).tolist() == expected.tolist(), text


def test_features_equal_counting_one_by_one():
    lexicon, weak = ["idiot*", "moron*", "scum*"], ["stup*"]
    tokens = toxicity.Tokens(lexicon, weak)
    rng = random.Random(7)
    words = ["you", "idiots!", "1d1ot", "m.o.r.o.n", "scuuum", "FINE", "stupid,", "a", "x9", "so-so", "What?!", "Du", "ok", "mo*on", "naïve", "...", "b"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
        f = dict(zip(toxicity.FEATURES, tokens.features(text), strict=True))
        split = text.split()
        core = [t.lower().strip(".,;:!?*-") for t in split]
        n, rate = len(split), lambda test: sum(map(test, range(n))) / n
        assert f["lexicon"] == sum(c.startswith(("idiot", "moron", "scum")) for c in core)
        assert f["hidden"] >= sum(t in ("1d1ot", "m.o.r.o.n", "scuuum") for t in split)
        assert f["weak"] == sum(c.startswith("stup") for c in core)
        assert abs(f["second_person_rate"] - rate(lambda i: core[i] in ("you", "du"))) < 1e-12
        assert abs(f["capitals_rate"] - rate(lambda i: split[i].isupper() and len(core[i]) > 2)) < 1e-12
        assert abs(f["stress_rate"] - rate(lambda i: "!" in split[i] or "?" in split[i])) < 1e-12
        assert abs(f["digit_rate"] - rate(lambda i: any(c.isdigit() for c in core[i]) and any(c.isalpha() for c in core[i]))) < 1e-12
        assert abs(f["single_rate"] - rate(lambda i: len(core[i]) == 1 and core[i].isalpha())) < 1e-12
        assert abs(f["lengthened_rate"] - rate(lambda i: "uuu" in split[i])) < 1e-12


def test_what_is_remembered_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(200)) for k in range(1, 20)]
    whole = [toxicity.Tokens(["w1*"]).features(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE_TOKENS", 30)
    tokens = toxicity.Tokens(["w1*"])
    assert [tokens.features(t) for t in texts] == whole and tokens.older


def test_repeated_and_null_ids_are_rows_like_others(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (None, "le chat et le chien", "fr"), (None, None, None)], "doc_id long, text string, lang string")
    named = langid.identify(rows, langid.fit(rows)).collect()
    assert len(named) == 4 and len({r["lang_pred"] for r in named if r["doc_id"] == 1}) == 1
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(rows, toxicity.fit(rows, labels)).collect()
    assert len(scored) == 4 and all(0 <= r["toxicity"] <= 1 for r in scored) and len({r["toxicity"] for r in scored if r["doc_id"] == 1}) == 1
