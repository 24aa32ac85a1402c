"""Queries over archives written and read again, streams' batch forms, schema-less merges and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import records, relate, search, shards, timeline
from quillspark.plans import views
from quillspark.plans.registry import query
from quillspark.plans.views import sql
from quillspark.scratch import materialize, remove, scratch_dir
from quillspark.sources import datasource, ranges, sinks, zips
from quillspark.streaming import state


def _folder(spark) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("archive_by_ranges", "SELECT doc_id, lang, length(text)::BIGINT AS chars, sha256(coalesce(text, '')) AS digest FROM documents")
def _(read):
    """Documents written as envelopes by the tasks, and read again by byte ranges."""
    docs = read("documents").select("doc_id", "lang", "text")
    path = _folder(docs.sparkSession)
    sinks.write_envelopes(docs, [F.col("doc_id").asc()], ["doc_id", "lang", "text"], path, {"schemaVersion": 1, "note": '"tweets":['}, {"deletions": [{"id": "1"}]})
    found = ranges.read_ranges(docs.sparkSession, path).where("record is not null")
    remove(docs.sparkSession, path)
    row = F.from_json("record", "doc_id long, lang string, text string")
    return found.select(row.alias("r")).select("r.doc_id", "r.lang", F.length("r.text").cast("bigint").alias("chars"), F.sha2(F.coalesce("r.text", F.lit("")), 256).alias("digest"))


@query("archive_source", "SELECT page_id, length(html)::BIGINT AS chars, sha256(coalesce(html, '')) AS digest FROM pages")
def _(read):
    """Pages written as envelopes by the tasks, and read again through the data source."""
    pages = read("pages").select("page_id", "html")
    spark, path = pages.sparkSession, _folder(pages.sparkSession)
    datasource.register(spark)
    sinks.write_envelopes(pages, [F.col("page_id").asc()], ["page_id", "html"], path, {"schemaVersion": 1}, {})
    found = materialize(spark.read.format("archive").load(path).where("record is not null").select("record"))
    remove(spark, path)
    row = F.from_json("record", "page_id long, html string")
    return found.select(row.alias("r")).select("r.page_id", F.length("r.html").cast("bigint").alias("chars"), F.sha2(F.coalesce("r.html", F.lit("")), 256).alias("digest"))


@query("snapshot_source", "SELECT lpad(page_id::VARCHAR, 14, '0') AS timestamp, url AS original FROM pages")
def _(read):
    """Pages as snapshot listings, written by the tasks and read again through the data source."""
    pages = read("pages").select(F.lpad(F.col("page_id").cast("string"), 14, "0").alias("timestamp"), F.col("url").alias("original"))
    spark, path = pages.sparkSession, _folder(pages.sparkSession)
    datasource.register(spark)
    sinks.write_listings(pages, [F.col("timestamp").asc()], path)
    found = materialize(spark.read.format("snapshots").option("listingRows", str(1 << 40)).load(path).select("timestamp", "original"))
    remove(spark, path)
    return found


@query("zip_archive", """WITH e AS (SELECT 'media/' || doc_id || '_t.txt' AS name, coalesce(strlen(text), 0) AS size FROM documents),
 l AS (SELECT name, 30 + strlen(name) + size AS local, sum(30 + strlen(name) + size) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - (30 + strlen(name) + size) AS o FROM e),
 m AS (SELECT *, 46 + strlen(name) + CASE WHEN o >= 4294967295 THEN 12 ELSE 0 END AS central FROM l),
 p AS (SELECT *, sum(central) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - central AS c, sum(local) OVER () AS body, sum(central) OVER () AS listed FROM m)
 SELECT 'entry' AS kind, name, o::BIGINT AS at, local::BIGINT AS bytes FROM p UNION ALL SELECT 'directory', name, (body + c)::BIGINT, central::BIGINT FROM p UNION ALL SELECT 'end', NULL, max(body + listed)::BIGINT, CASE WHEN count(*) >= 65535 OR max(body) >= 4294967295 OR max(listed) >= 4294967295 THEN 98 ELSE 22 END FROM p""")
def _(read):
    """Texts as a stored ZIP, cut into the pieces that make up the file."""
    entries = read("documents").select(F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.lit("_t.txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("blob"))
    return zips.zip_pieces(entries).select("kind", "name", "at", F.octet_length("bytes").cast("bigint").alias("bytes"))


@query("dos_times", """SELECT event_id, ((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts))::INTEGER AS dos_date, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::INTEGER AS dos_time FROM events""")
def _(read):
    """Times as ZIPs have them."""
    return read("events").select("event_id", zips.dos_time(F.col("ts")).alias("d")).select("event_id", F.col("d.date").alias("dos_date"), F.col("d.time").alias("dos_time"))


@query("document_shards", """WITH RECURSIVE s AS (SELECT doc_id, strlen(coalesce(text, '')) AS b, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
 w AS (SELECT doc_id, n, b AS used, 1 AS records, 0 AS shard FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN f THEN w.used + s.b ELSE s.b END, CASE WHEN f THEN w.records + 1 ELSE 1 END, CASE WHEN f THEN w.shard ELSE w.shard + 1 END
   FROM w JOIN s ON s.n = w.n + 1, LATERAL (SELECT (w.used = 0 OR w.used + s.b <= 20000) AND w.records < 12 AS f))
 SELECT doc_id, shard FROM w""")
def _(read):
    """K2, T-2: all documents as one group, in shards of at most so many bytes and records."""
    sized = read("documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return shards.greedy(sized, [], ["doc_id"], F.col("bytes"), 20_000, most=12).select("doc_id", "shard")


@query("media_within_budget", sql("media", """u AS (SELECT post_id, media_id, source, size, sum(CASE WHEN size <= 45 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY post_id, media_id, part, cached_at ROWS UNBOUNDED PRECEDING) AS used FROM media)
 SELECT source, post_id, media_id, size <= 45 AND used <= 900 AS taken FROM u"""))
def _(read):
    """What of each source's files a budget takes, files beyond a size passed over."""
    files = views.media(read).select("source", "post_id", "media_id", "size", "part", "cached_at")
    order = [F.col(c).asc() for c in ("post_id", "media_id", "part", "cached_at")]
    return relate.within_budget(files, ["source"], order, "size", 900, 45).select("source", "post_id", "media_id", "taken")


@query("roster_collated", sql("roster", "SELECT list, handle, user_id, row_number() OVER (ORDER BY list, handle, user_id) - 1 AS position FROM roster"))
def _(read):
    """The whole roster in the order of people's scripts, with positions."""
    order = [timeline.collated(F.col("list")).asc(), timeline.collated(F.col("handle")).asc(), F.col("user_id").asc()]
    return timeline.with_positions(views.roster(read).select("list", "handle", "user_id"), order).select("list", "handle", "user_id", "position")


@query("session_windows", """WITH o AS (SELECT user_id, ts, value, event_type = 'error' AS failed, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
 SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", max(value) AS gauge, bool_or(failed) AS failed, count(*) AS updates FROM s GROUP BY user_id, n""")
def _(read):
    """A15, T-12: gauges of sessions; the same expression runs over a stream."""
    rows = read("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), "value", (F.col("event_type") == "error").alias("failed"))
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return state.session_gauges(rows, "6 hours").select(F.col("key").alias("user_id"), time("begin"), time("end"), "gauge", "failed", "updates")


@query("merge_schemaless", sql("captures", """k AS (SELECT id, kind, arg_max(event_id, (captured_at, event_id)) AS newest FROM captures GROUP BY ALL),
 f AS (SELECT id, arg_max(value, (captured_at, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(k, (captured_at, event_id)) FILTER (k IS NOT NULL) AS k FROM captures GROUP BY id)
 SELECT f.id, f.value, f.k, c.newest AS click, s.newest AS signup, e.newest AS error FROM f LEFT JOIN k c ON c.id = f.id AND c.kind = 'click' LEFT JOIN k s ON s.id = f.id AND s.kind = 'signup' LEFT JOIN k e ON e.id = f.id AND e.kind = 'error'"""))
def _(read):
    """M1, M2, M8: captures as JSON of unknown shape, each kind with a member of its own, merged at all depths."""
    body = F.concat(
        F.lit('{"value":'), F.coalesce(F.col("value").cast("string"), F.lit('""')), F.lit(',"k":'), F.coalesce(F.col("k").cast("string"), F.lit("null")),
        F.lit(',"seen":{"by":{"'), F.col("kind"), F.lit('":{"last":'), F.col("event_id").cast("string"), F.lit('}},"none":[]}}'),
    )
    merged = records.merge_records(views.captures(read).select("id", "captured_at", "event_id", body.alias("body")), "id", "body", ["captured_at", "event_id"])
    at = lambda path, kind: F.get_json_object("body", path).cast(kind)
    return merged.select("id", at("$.value", "double").alias("value"), at("$.k", "bigint").alias("k"), *[at(f"$.seen.by.{k}.last", "bigint").alias(k) for k in ("click", "signup", "error")])


@query("indexed_search", "SELECT doc_id FROM documents WHERE doc_id > 0 AND contains(lower(concat_ws(chr(10), text, lang, source)), 'the') AND contains(lower(concat_ws(chr(10), text, lang, source)), 'src1') AND contains(lower(concat_ws(chr(10), text, lang, source)), 'an') AND n_chars > 500")
def _(read):
    """An index of pieces and a tab's list, intersected as bitmaps and verified on the whole texts."""
    docs = read("documents").select("doc_id", "text", "lang", "source", "n_chars")
    hay = search.haystack([F.col("text"), F.col("lang"), F.col("source")])
    tab = search.list_bitmaps(docs.where("n_chars > 500"), "doc_id")
    return search.search(docs, "doc_id", hay, search.index(docs, "doc_id", hay), "The src1 an", [tab]).select("doc_id")
