"""Archives and snapshot listings as data sources."""

import json
import zipfile

import pytest

from quillspark.sources import datasource, envelope


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    datasource.register(spark)
    return [(str(r["page_id"]), r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").orderBy("page_id").collect()]


def test_archives_of_pages(spark, pages, tmp_path):
    for i in range(5):
        rows = [{"id": p, "url": u} for p, u in pages[i::5]]
        text = json.dumps({"tweets": rows, "count": len(rows)})
        if i % 2:
            with zipfile.ZipFile(tmp_path / f"{i}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("folder/tweets.json", text)
        else:
            (tmp_path / f"{i}.json").write_text(text)
    (tmp_path / "broken.json").write_text('{"tweets":[{"id":"x"},{"i')
    (tmp_path / "_hidden.json").write_text("no")
    df = spark.read.format("archive").option("partitionBytes", "2000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["position"], r["record"], r["error"])
    got = sorted(map(key, df.collect()), key=str)
    paths = [str(p) for p in tmp_path.iterdir() if not p.name.startswith("_")]
    assert got == sorted(map(key, envelope.read_envelopes(spark, paths).collect()), key=str)
    assert sorted(json.loads(r[2])["id"] for r in got if r[2] and r[0] != "broken.json") == sorted(p for p, _ in pages)


def test_listing_stream_goes_on_where_it_was(spark, pages, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    rows = [[f"{i:0>14}", pages[i % len(pages)][1]] for i in range(120)]
    write = lambda name, n: (source / name).write_text(json.dumps([["timestamp", "original"], *rows[:n]]))

    def run():
        stream = spark.readStream.format("snapshots").option("partitionRows", "15").load(str(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
        query.processAllAvailable()
        query.stop()

    write("a.json", 70)
    run()
    write("a.json", 90)  # listings grow by appending
    write("b.json", 30)
    (source / "c.json").write_text('[["timestamp","original"],["1')  # being written
    run()
    run()
    got = sorted((r["path"].rsplit("/", 1)[-1], r["position"], r["timestamp"], r["original"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([("a.json", i, *rows[i]) for i in range(90)] + [("b.json", i, *rows[i]) for i in range(30)])
    batch = spark.read.format("snapshots").load(str(source))
    assert batch.count() == 120
    (source / "a.json").write_text(json.dumps([["timestamp", "original"], *rows[:5]]))
    with pytest.raises(Exception, match="shorter"):
        run()
