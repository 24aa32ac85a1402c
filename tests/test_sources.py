"""Reading and writing archives."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import envelope, sinks, zips

RECORDS = [
    {"id": "1", "text": 'brackets ] } [ {'}, {"id": "2", "text": 'quotes " and \\ backslash'}, {"id": "3", "text": "日本語 😇"}, {"id": "4", "text": "", "deep": [[[{"a": []}]]]},
]


def build(records=RECORDS, **more):
    return json.dumps({"schemaVersion": 5, "note": 'decoy "tweets": [1,2', "exportedAt": "2024-01-01", "tweets": records, "count": len(records), **more}, ensure_ascii=False)


def test_scanner():
    text = build()
    at = envelope.find_array(text, "tweets")
    ranges, closed, problems = envelope.array_elements(text, at)
    assert [json.loads(text[a:b]) for a, b in ranges] == RECORDS and closed and not problems
    assert envelope.array_elements("[]", 0) == ([], True, [])
    assert [x for x in envelope.array_elements("[1, true, \"a,]\"]", 0)[0]] == [(1, 2), (4, 8), (10, 15)]
    assert envelope.array_elements('[{"a":1},{"b"', 0)[1] is False
    assert envelope.array_elements("[}]", 0)[2] == ["depth-underflow"]
    assert envelope.find_array('{"a":{"tweets":[1]}}', "tweets") == -1


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(build(), encoding="utf-8")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("tweets.json", build(RECORDS[:2]))
    (tmp_path / "b.zip").write_bytes(buffer.getvalue())
    (tmp_path / "c.json").write_text(build()[:-80], encoding="utf-8")
    (tmp_path / "d.json").write_text("nothing", encoding="utf-8")
    (tmp_path / "e.zip").write_bytes(b"PK but no archive")
    read = envelope.read_envelopes(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[1]: (r["n"], r["e"]) for r in read.groupBy("path").agg(F.count("record").alias("n"), F.max("error").alias("e")).collect()}
    assert found["a.json"] == (4, None) and found["b.zip"] == (2, None)
    assert found["c.json"][1] == "truncated" and found["d.json"][1] == "no array tweets" and found["e.zip"][0] == 0
    report = {r["path"].rsplit("/", 1)[1]: r for r in envelope.integrity(read, envelope.envelope_heads(spark, str(tmp_path))).collect()}
    assert report["a.json"]["complete"] and report["a.json"]["stated"] == 4 and not report["c.json"]["complete"]


def test_zip_entry_beyond_64_mib(spark, tmp_path):
    records = [{"id": str(i), "text": "x" * (1 << 20)} for i in range(66)]
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("tweets.json", build(records))
        assert z.getinfo("tweets.json").file_size > 64 << 20
    read = envelope.read_envelopes(spark, str(tmp_path))
    ids = read.select("position", F.get_json_object("record", "$.id").alias("id"), F.length("record").alias("n"), "error").orderBy("position").collect()
    assert [tuple(r) for r in ids] == [(i, str(i), len(json.dumps(x)), None) for i, x in enumerate(records)]


def test_damaged_zip_gives_no_records(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("tweets.json", build())
    broken = bytearray(buffer.getvalue())
    broken[broken.index(b"brackets")] ^= 1
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    assert [(r["record"], "CRC" in r["error"]) for r in envelope.read_envelopes(spark, str(tmp_path)).collect()] == [(None, True)]


def test_large_directory_is_refused(monkeypatch):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("tweets.json", build())
    monkeypatch.setattr(envelope, "MOST_DIRECTORY_BYTES", 60)
    with pytest.raises(ValueError, match="directory"):
        envelope.envelope_bytes(buffer.getvalue())


def test_chunks_give_what_the_whole_text_gives():
    texts = [build(), build()[:-80], '{"a":{"tweets":[1]}, "tweets" : [ 1, true ,"a,]\\"", [[]], {"b":"\\\\"} ] }', '{"tweets":[}]}', '{"tweets":[]}', '{"tweets":[1,{}}]', '{"tweets":["x\\']
    for text in texts:
        at = envelope.find_array(text, "tweets")
        ranges, closed, problems = envelope.array_elements(text, at)
        expected = [(text[a:b].strip(), None) for a, b in ranges] + [(None, p) for p in problems] + [(None, "truncated")] * (not closed and not problems)
        for n in (1, 2, 3, 7, 1000):
            assert list(envelope.stream_elements(iter([text[i:i + n] for i in range(0, len(text), n)]), "tweets")) == expected


def test_bad_checksum_is_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("tweets.json", build())
    broken = bytearray(buffer.getvalue())
    broken[60] ^= 1
    with pytest.raises(ValueError):
        envelope.envelope_bytes(bytes(broken))


def test_envelope_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([("1", "a\n\"x\""), ("2", None)], "id string, text string")
    path = tmp_path / "out"
    sinks.write_envelopes(posts, [F.col("id").desc()], ["id", "text"], str(path), {"schemaVersion": 5}, {"deletions": [], "connections": [1]}, files=1)
    document = json.loads("".join(p.read_text(encoding="utf-8") for p in path.glob("part-*")))
    empty = tmp_path / "empty"
    sinks.write_envelopes(posts.limit(0), [F.col("id").desc()], ["id", "text"], str(empty), {"schemaVersion": 5}, {})
    assert [json.loads(p.read_text()) for p in empty.glob("part-*") if p.stat().st_size] == [{"schemaVersion": 5, "tweets": [], "count": 0}]
    assert list(document) == ["schemaVersion", "tweets", "count", "connections"]
    assert document["tweets"] == [{"id": "2", "text": None}, {"id": "1", "text": 'a\n"x"'}]


def test_shards(spark):
    table = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate([4, 4, 4, 40, 1])], "g string, i int, t string")
    got = {r["i"]: r["shard"] for r in sinks.shard_numbers(table, ["g"], ["i"], ["t"], 42).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_roster_zip_and_tree(spark, tmp_path):
    roster = spark.createDataFrame([("followers", "2", "=cmd"), ("followers", "1", 'q"q')], "list string, userId string, name string")
    sinks.write_roster(roster, str(tmp_path / "roster"))
    lines = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "roster").glob("part-*"))).split("\r\n")
    assert lines[0].startswith("list,userId,") and lines[1].count(",") == 13 and '"q""q"' in lines[1] and ",'=cmd," in lines[2]
    blobs = spark.createDataFrame([("media/1_a.jpg", bytearray(b"x")), ("../bad", bytearray(b"y"))], "name string, blob binary")
    zips.write_zip(blobs, str(tmp_path / "m.zip"))
    assert zipfile.ZipFile(tmp_path / "m.zip").namelist() == ["media/1_a.jpg"] and zipfile.ZipFile(tmp_path / "m.zip").read("media/1_a.jpg") == b"x"
    files = spark.sql("select id as post_id, 'm' as media_id, timestamp'2020-05-01' as created_at, '.jpg' as ext from range(5)")
    paths = sorted(r["path"] for r in sinks.hosted_layout(files, 2).collect())
    assert paths == ["media/2020/05-2/2_m.jpg", "media/2020/05-2/3_m.jpg", "media/2020/05-3/4_m.jpg", "media/2020/05/0_m.jpg", "media/2020/05/1_m.jpg"]
    index = spark.createDataFrame([("a/b", "1"), ("../x", "1"), ("a//b", "1"), ("a", "-1"), ("a", "1.5"), ("a", None)], "path string, bytes string")
    assert [r["valid"] for r in sinks.hosted_index_valid(index, 100).collect()] == [True, False, False, False, False, False]


def test_listing(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([["timestamp", "original"], ["20240101000000", "https://example.com/u/status/1"]]))
    assert [tuple(r) for r in envelope.listing(spark, str(tmp_path / "l.json")).collect()] == [("20240101000000", "https://example.com/u/status/1")]


def test_zip_of_many_tasks(spark, tmp_path):
    rows = [(f"media/{i}_u.bin", bytearray(bytes([i % 256]) * (i * 7 % 500)), f"20{i % 40 + 10}-03-0{i % 9 + 1} 12:3{i % 10}:41") for i in range(150)]
    entries = spark.createDataFrame([*rows, ("media/none", None, None), ("/root", bytearray(b"x"), None)], "name string, blob binary, at string").withColumn("at", F.to_timestamp("at")).repartition(6)
    written = zips.write_zip(entries, str(tmp_path / "all.zip"), "at").first()["bytes"]
    assert written == (tmp_path / "all.zip").stat().st_size and [p.name for p in tmp_path.iterdir()] == ["all.zip"]
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: bytes(b) for n, b, _ in rows}
        assert z.namelist() == sorted(z.namelist()) and z.getinfo("media/1_u.bin").date_time == (2011, 3, 2, 12, 31, 40)
    zips.write_zip(entries.limit(0), str(tmp_path / "empty.zip"))
    assert zipfile.ZipFile(tmp_path / "empty.zip").namelist() == []
    pieces = zips.zip_pieces(entries, "at")
    assert b"".join(r["bytes"] for r in pieces.orderBy("at").collect()) == (tmp_path / "all.zip").read_bytes()


def test_dos_times(spark):
    times = [("1979-12-31 23:59:59",), ("1980-01-01 00:00:00",), ("2024-02-29 13:45:59",), ("2108-01-01 00:00:00",), (None,)]
    got = [tuple(r["d"]) for r in spark.createDataFrame(times, "t string").select(zips.dos_time(F.to_timestamp("t")).alias("d")).collect()]
    assert got == [(33, 0), (33, 0), ((44 << 9) | (2 << 5) | 29, (13 << 11) | (45 << 5) | 29), ((127 << 9) | (12 << 5) | 31, (23 << 11) | (59 << 5) | 29), (33, 0)]


def test_zip_beyond_the_short_form(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zips, "MOST_BYTES", 300)  # from here on offsets take the long form
    monkeypatch.setattr(zips, "MOST_ENTRIES", 12)
    entries = spark.range(20).select(F.format_string("media/%02d.bin", "id").alias("name"), F.encode(F.repeat(F.lit("xy"), F.col("id").cast("int") * 3), "utf-8").alias("blob"))
    pieces = {r["kind"]: bytes(r["bytes"]) for r in zips.zip_pieces(entries).orderBy("at").collect()}
    assert len(pieces["end"]) == 98 and pieces["directory"][-12:-8] == b"\x01\x00\x08\x00"
    monkeypatch.undo()
    monkeypatch.setattr(zips, "MOST_ENTRIES", 12)  # the short form says 12, which readers take as "look further"
    monkeypatch.setattr(zips, "MOST_BYTES", (1 << 32) - 1)
    whole = b"".join(bytes(r["bytes"]) for r in zips.zip_pieces(entries).orderBy("at").collect())
    whole = whole[:-22] + whole[-22:].replace(b"\x0c\x00\x0c\x00", b"\xff\xff\xff\xff")
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        assert z.testzip() is None and z.read("media/07.bin") == b"xy" * 21 and len(z.namelist()) == 20
