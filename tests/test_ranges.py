"""Archive files by byte ranges against the sequential reader, at many range sizes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import envelope, ranges


def corpus():
    """(name, bytes) of files whose arrays are odd in some way."""
    rng = random.Random(2)
    nasty = ["plain", 'a "quoted", [bracket] {brace}', "back\\slash\\\\", "日本語 😀,", "", "}],", '\\",\\"tweets\\":[', "\n\t,"]
    rows = [{"id": str(i), "text": rng.choice(nasty) * rng.randrange(0, 4), "deep": {"a": [1, [2, {"b": [rng.choice(nasty)]}]], "tweets": [1, 2]}} for i in range(120)]
    dump = lambda head, rows, **kw: json.dumps({**head, "tweets": rows, "count": len(rows), "connections": [{"tweets": [7]}]}, ensure_ascii=False, **kw)
    whole = dump({"schemaVersion": 1, "note": 'the "tweets": [ are, below', "a": {"tweets": [9]}}, rows)
    yield "compact", dump({}, rows, separators=(",", ":"))
    yield "plain", whole
    yield "indented", dump({"x": [1, {"tweets": [3]}]}, rows, indent=2)
    yield "empty array", dump({}, [])
    yield "primitives", '{"tweets": [1, "a,b", null, true, [1, 2], {"x": 1} , -2.5e3 ]}'
    yield "nothing between commas", '{"tweets":[1,,2, ,3,]}'
    yield "cut in an element", whole[: len(whole) // 2]
    yield "cut in a string", whole[: whole.index('"text"', 3000) + 12]
    yield "cut behind a comma", '{"tweets":[{"a":1},{"b":2},'
    yield "cut behind an element", '{"tweets":[{"a":1},{"b":2}'
    yield "imbalance", '{"tweets":[{"a":1},{"b":[2}]}],{"c":3}]}'
    yield "underflow", '{"tweets":[{"a":1},{"b":2}},{"c":3}]}'
    yield "no array", '{"other":[1,2],"a":{"tweets":[1]}}'
    yield "backslash outside strings", '{"x":\\"tweets":[{"a":1},{"b":"y"}]}'
    yield "one long element", json.dumps({"tweets": [{"text": "x, " * 3000}, {"text": "end"}]})
    yield "escaped key", '{"\\"tweets":[5],"tweets":[{"a":1}]}'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("ranges")
    for name, text in corpus():
        (out / f"{name}.json").write_text(text, encoding="utf-8")
    (out / "bytes.json").write_bytes(b'{"tweets":[{"a":"\xff\xfe"},2]}')
    return out


def named(df):
    return sorted((r["path"].rsplit("/", 1)[-1].replace("%20", " "), r["position"] is None, r["position"] or 0, r["record"] or "", r["error"] or "") for r in df.collect())


@pytest.mark.parametrize("size", [48, 2048, 1 << 27])
def test_equals_the_sequential_reader(spark, folder, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    names = sorted(p for p in folder.iterdir() if size > 500 or p.stat().st_size < 200)
    try:
        expected = [r for r in named(envelope.read_envelopes(spark, [str(p) for p in names])) if r[0] != "bytes.json"]
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = named(ranges.read_ranges(spark, [str(p) for p in names]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r for r in got if r[0] == "bytes.json"] == [("bytes.json", True, 0, "", "not UTF-8")]
    got = [r for r in got if r[0] != "bytes.json"]
    assert [r for r in got if r not in expected][:3] == [] and [r for r in expected if r not in got][:3] == []


def test_documents_as_one_file(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    path = tmp_path / "all.json"
    path.write_text(json.dumps({"head": 1, "tweets": rows}, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = ranges.read_ranges(spark, str(path))
        assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r["record"]) for r in got.orderBy("position").collect()] == rows


def test_which_files_are_zips(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK\x03\x04")
    (tmp_path / "b.json").write_bytes(b"{}")
    got = ranges.zips(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.json")])
    assert [r["path"].rsplit("/", 1)[-1] for r in got.collect()] == ["a.zip"]
    assert ranges.read_ranges(spark, str(tmp_path / "a.zip")).where(F.col("error").isNotNull()).count() == 0
