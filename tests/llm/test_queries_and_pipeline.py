"""Queries against DuckDB, and the pipeline's stages against brute force on what each was given."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries, toxicity
from tests.llm.test_pairs_and_mix import brute_components, shingle_set
from tests.llm.test_text_operators import brute_lines, brute_spans


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    expected = con.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in expected.fetchall()))) == sorted(map(repr, (tuple(r) for r in got.select(*names).collect())))


def test_registered_pii(spark, sf_dir):
    """Base columns of the query against brute force, on all documents."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute_spans(texts[r["doc_id"]] or "")
        rendered = spans.split(",") if spans else []
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(f"{k}:") for s in rendered) for k in ("email", "ip", "card", "phone")]
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if not s.startswith("term:")] == rendered and len(every) == len(rendered) + r["n_term"]


ODD_DOCS = [
    (1, None, None, None), (2, "", "a", 0), (None, "x y z\nx y z\nx y z", "a", 11), (None, None, "b", None), (3, "one two three four five six", "b", 27), (3, "one two three four five six", "b", 27),
    (4, "one two three four five six", None, 27), (5, "w " * 20_000, "a", 40_000), (6, "line one is here\nline two is here\nline three is here\n" * 3, "b", 150), (7, "\n\n \n", "c", 4),
]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, sf_dir, number):
    """Nulls in all columns, empty and long texts, repeated rows, columns whose names operators use themselves, and no rows at all."""
    kind = "doc_id long, text string, source string, n_chars long"
    extra = ("__key", "__copies", "__at", "__covered", "__gone", "copies", "row", "key", "node", "size", "lang")
    docs = spark.createDataFrame(ODD_DOCS, kind).select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)]).repartition(3)
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, sf_dir).collect()
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.count() == 0
    if number < len(corpus_pipeline.STAGES) - 1:
        assert none.columns == docs.columns and all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in got)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    whole = sorted((d[0] is None, d[0] or 0) for d in ODD_DOCS)
    if name == "n-gram Jaccard join":
        # Rows 3, 3 and 4 say the same; those with the smallest id stay.
        assert ids == [i for i in whole if i[1] != 4]
    elif name == "mixing sources":
        assert set(ids) <= set(whole)
    else:
        assert ids == whole


def test_pipeline(spark, sf_dir, tmp_path, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [k.collect() for k in kept]

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: model.score(np.array([toxicity.Tokens(model.lexicon, model.weak).features(r["text"])]))[0] for r in rows[0]}
    assert {r["doc_id"] for r in rows[1]} == {d for d, s in scores.items() if s < toxicity.THRESHOLD}

    lines = brute_lines([(r["doc_id"], r["text"]) for r in rows[1]])
    assert {r["doc_id"]: r["text"] for r in rows[2]} == {d: t for (d, _), t in lines.items()}

    ids, sets = [r["doc_id"] for r in rows[2]], [shingle_set(r["text"]) for r in rows[2]]
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in rows[3]} == {d for d, c in zip(ids, brute_components(ids, linked), strict=True) if d == c}

    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]}
    texts = {r["doc_id"]: r["text"] for r in rows[3]}
    assert sorted(r["doc_id"] for r in rows[5]) == sorted(r["doc_id"] for r in rows[4])
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows[5])
    assert kept[5].where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0
