"""The archive's queries over the test tables, each with its SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from quillspark.functions import coerce, text, urls
from quillspark.functions.absence import is_absent
from quillspark.operators import merge, relate, timeline
from quillspark.plans import views
from quillspark.plans.registry import query
from quillspark.plans.views import sql
from quillspark.sources import sinks

# -- reading in order --------------------------------------------------------------------------------


@query("timeline_page", sql("posts", "SELECT id, author_id, created_at, text FROM posts ORDER BY created_at DESC, id DESC LIMIT 30"))
def _(read):
    """O1: the newest page."""
    return timeline.keyset_page(views.posts(read).select("id", "author_id", "created_at", "text"), ["created_at", "id"])


@query("timeline_page_after_key", sql("posts", "SELECT id, created_at, text FROM posts WHERE (created_at, id) < (TIMESTAMP '1997-01-01', 5000) ORDER BY created_at DESC, id DESC LIMIT 30"))
def _(read):
    """O1: a page beyond a key."""
    return timeline.keyset_page(views.posts(read).select("id", "created_at", "text"), ["created_at", "id"], after=[datetime(1997, 1, 1), 5000])


@query("timeline_page_status", sql("posts", """p AS (SELECT created_at, id FROM posts WHERE text LIKE '%URGENT%' ORDER BY created_at DESC, id DESC LIMIT 30),
 l AS (SELECT created_at, id FROM p ORDER BY created_at, id LIMIT 1)
 SELECT (SELECT count(*) FROM p) AS items, (SELECT count(*) FROM p) >= 30 AS has_more,
  CASE WHEN (SELECT count(*) FROM p) >= 30 THEN (SELECT created_at FROM l) END AS next_created_at,
  CASE WHEN (SELECT count(*) FROM p) >= 30 THEN (SELECT id FROM l) END AS next_id"""))
def _(read):
    """O1, F1: the next key of a page of matches."""
    posts = views.posts(read)
    page = timeline.keyset_page(posts, ["created_at", "id"], where=timeline.phrase_match([posts["text"]], "urgent"))
    return timeline.page_status(page, ["created_at", "id"], 30)


@query("keyword_search", sql("posts authors", "SELECT id, created_at, handle FROM posts JOIN authors USING (author_id) WHERE contains(lower(text), 'low') OR contains(id::VARCHAR, 'low') OR contains(lower(handle), 'low')"))
def _(read):
    """one phrase in text, id or handle."""
    joined = views.posts(read).join(views.authors(read), "author_id")
    return joined.where(timeline.phrase_match([F.col("text"), F.col("handle")], " LOW ", as_is=[F.col("id").cast("string")])).select("id", "created_at", "handle")


@query("and_term_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text || chr(10) || source), 'the') AND contains(lower(text || chr(10) || source), 'src1')")
def _(read):
    """all terms somewhere."""
    return read("documents").where(timeline.all_terms_match([F.col("text"), F.col("source")], "The  SRC1")).select("doc_id", "lang")


@query("roster_filter", sql("roster", "SELECT list, user_id FROM roster WHERE contains(handle, 'supplier') AND contains(handle, '7')"))
def _(read):
    """all terms in a roster."""
    return views.roster(read).where(timeline.all_terms_match([F.col("handle")], "supplier 7")).select("list", "user_id")


@query("roster_page_desc", sql("roster", "SELECT list, handle, user_id FROM roster WHERE list = (SELECT min(list) FROM roster) ORDER BY handle DESC, user_id DESC LIMIT 50"))
def _(read):
    """A list's page, descending by handle."""
    roster = views.roster(read)
    first = roster.agg(F.min("list").alias("list"))
    return timeline.keyset_page(roster.join(F.broadcast(first), "list").select("list", "handle", "user_id"), ["handle", "user_id"], 50)


@query("roster_export_sorted", sql("roster", "SELECT list, handle, user_id FROM roster"))
def _(read):
    """The whole roster by list, handle and id."""
    return views.roster(read).select("list", "handle", "user_id").orderBy("list", "handle", "user_id")


@query("merged_timeline", sql("posts", "SELECT id, row_number() OVER (ORDER BY created_at DESC, author_id, id) - 1 AS position FROM posts"))
def _(read):
    """Positions in the merged order."""
    order = [F.col("created_at").desc(), F.col("author_id").asc(), F.col("id").asc()]
    return timeline.with_positions(views.posts(read).select("id", "created_at", "author_id"), order).select("id", "position")


@query("numeric_id_order_all", sql("posts", "SELECT id::VARCHAR AS id, row_number() OVER (ORDER BY length(id::VARCHAR), id::VARCHAR) - 1 AS position FROM posts"))
def _(read):
    """All digit strings with their positions as numbers."""
    ids = views.posts(read).select(F.col("id").cast("string").alias("id"))
    return timeline.with_positions(ids, timeline.numeric_id_order(F.col("id"))).select("id", "position")


@query("day_jump", sql("posts", "SELECT id, created_at, created_at::DATE = DATE '1996-06-15' AS exact FROM posts WHERE created_at::DATE <= DATE '1996-06-15' ORDER BY created_at DESC, id DESC LIMIT 1"))
def _(read):
    """The place of a day in a newest-first list."""
    return timeline.jump_to_day(views.posts(read).select("id", "created_at"), "created_at", "id", date(1996, 6, 15))


@query("day_buckets", "SELECT (ts + INTERVAL 480 MINUTE)::DATE::VARCHAR AS day, count(*) AS records FROM events GROUP BY day")
def _(read):
    """Days at a fixed offset."""
    return read("events").groupBy(timeline.local_day(F.col("ts"), 480).cast("string").alias("day")).agg(F.count("*").alias("records"))


@query("spread_sample", sql("posts", """r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS position, count(*) OVER () AS n FROM posts)
 SELECT id, position FROM r WHERE position IN (SELECT ((SELECT max(n) FROM r) - 1) * k // 8 FROM range(9) t(k))"""))
def _(read):
    """Evenly spaced rows."""
    rows = views.posts(read).select("id", "created_at")
    return timeline.spread_sample(rows, [F.col("created_at").asc(), F.col("id").asc()], 9).select("id", "position")


@query("order_detect", """WITH r AS (SELECT ts, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events),
 s AS (SELECT ts, p FROM r WHERE p IN (SELECT ((SELECT max(n) FROM r) - 1) * k // 8 FROM range(9) t(k))),
 d AS (SELECT ts > lag(ts) OVER (ORDER BY p) AS up, ts < lag(ts) OVER (ORDER BY p) AS down FROM s),
 c AS (SELECT count(*) AS n, count(*) FILTER (up) AS u, count(*) FILTER (down) AS d FROM d)
 SELECT CASE WHEN n < 3 OR u + d = 0 THEN 'asc' WHEN d >= 0.9 * (u + d) THEN 'desc' WHEN u >= 0.9 * (u + d) THEN 'asc' ELSE 'mixed' END AS direction FROM c""")
def _(read):
    """Which way a file is ordered."""
    sampled = timeline.spread_sample(read("events").select("event_id", "ts"), [F.col("event_id").asc()], 9)
    return timeline.order_of(sampled, "position", "ts")


@query("failure_streak", """WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
 r AS (SELECT user_id, island, count(*) FILTER (f) AS run FROM m GROUP BY ALL)
 SELECT user_id, max(run) AS longest, max(run) >= 5 AS stopped FROM r GROUP BY user_id""")
def _(read):
    """Failures in a row."""
    return timeline.failure_streak(read("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


# -- counts ------------------------------------------------------------------------------------------


@query("count_by_list", sql("roster", "SELECT list, count(*) AS members FROM roster GROUP BY list"))
def _(read):
    """A2."""
    return views.roster(read).groupBy("list").agg(F.count("*").alias("members"))


@query("purge_counts", sql("posts", "SELECT count(*) FILTER (status = 'F') AS superseded, count(*) FILTER (status = 'P') AS deleted FROM posts"))
def _(read):
    """Two counts in one pass."""
    return views.posts(read).agg(F.count_if(F.col("status") == "F").alias("superseded"), F.count_if(F.col("status") == "P").alias("deleted"))


@query("state_summary", sql("posts media authors roster deletions", """SELECT (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM media) AS media,
 (SELECT count(*) FROM authors) AS people, (SELECT count(*) FROM roster) AS roster, (SELECT count(*) FROM deletions) AS deletions"""))
def _(read):
    """A1, A4: all counts as a row."""
    tables = {"posts": views.posts(read), "media": views.media(read), "people": views.authors(read), "roster": views.roster(read), "deletions": views.deletions(read)}
    counts = None
    for name, table in tables.items():
        own = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = own if counts is None else counts.union(own)
    return counts.groupBy().pivot("name", list(tables)).agg(F.first("n"))


@query("records_per_source", "SELECT source, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def _(read):
    """A5."""
    return read("documents").groupBy("source").agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"))


@query("media_keys_per_group", sql("media", "k AS (SELECT source, count(DISTINCT (post_id, media_id)) AS keys FROM media GROUP BY source) SELECT source % 10 AS grp, sum(keys)::BIGINT AS keys FROM k GROUP BY grp"))
def _(read):
    """Keys summed over sources, not distinct across them."""
    keys = views.media(read).select("source", "post_id", "media_id").distinct().groupBy("source").agg(F.count("*").alias("keys"))
    return keys.groupBy((F.col("source") % 10).alias("grp")).agg(F.sum("keys").alias("keys"))


@query("group_updated", sql("posts authors", "SELECT nation, max(created_at)::DATE::VARCHAR AS updated FROM posts JOIN authors USING (author_id) GROUP BY nation"))
def _(read):
    """The day a group was last updated."""
    return views.posts(read).join(views.authors(read).select("author_id", "nation"), "author_id").groupBy("nation").agg(F.to_date(F.max("created_at")).cast("string").alias("updated"))


@query("media_total_bytes", sql("media", "SELECT sum(size)::BIGINT AS bytes, count(*) AS files FROM media"))
def _(read):
    """Bytes and files of all media."""
    return views.media(read).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("author_tally_top1", sql("posts", """h AS (SELECT author_id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM posts ORDER BY created_at DESC, id DESC LIMIT 2000)
 SELECT author_id, count(*) AS posts, min(r)::INTEGER AS first_rank FROM h GROUP BY author_id ORDER BY posts DESC, first_rank LIMIT 1"""))
def _(read):
    """The author of most of the newest posts."""
    return relate.top_author(views.posts(read), "author_id", [F.col("created_at").desc(), F.col("id").desc()])


@query("account_groups", """WITH f AS (SELECT doc_id, n_chars, CASE WHEN lang <> 'en' THEN 'id:' || lang WHEN source <> 'src0' THEN 'name:' || lower(source) ELSE 'file:' || doc_id::VARCHAR END AS account FROM documents)
 SELECT account, count(*) AS files, arg_max(doc_id, (n_chars, doc_id)) AS newest FROM f GROUP BY account""")
def _(read):
    """A10: files by account, with fallbacks of the key."""
    docs = read("documents")
    key = relate.account_key(F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("source") != "src0", F.col("source")), F.col("doc_id"))
    return relate.account_groups(docs, key, "n_chars", "doc_id")


@query("shared_profile", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS shared FROM documents GROUP BY source")
def _(read):
    """One value if all agree."""
    return read("documents").groupBy("source").agg(F.when(F.count_distinct("lang") == 1, F.min("lang")).alias("shared"))


@query("merged_envelope", "SELECT source, min(n_chars) AS schema_version, arg_min(lang, doc_id) AS first_lang, bool_or(n_chars > 20000) AS truncated FROM documents GROUP BY source")
def _(read):
    """The oldest version, the first value, any flag."""
    return read("documents").groupBy("source").agg(
        F.min("n_chars").alias("schema_version"), F.min_by("lang", "doc_id").alias("first_lang"), F.bool_or(F.col("n_chars") > 20000).alias("truncated")
    )


@query("lifetime_counters", "SELECT event_type, count(*) AS total FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY event_type")
def _(read):
    """Declared counters only."""
    return read("events").where(F.col("event_type").isin("click", "error", "purchase")).groupBy("event_type").agg(F.count("*").alias("total"))


@query("session_gauges", """WITH s AS (SELECT user_id, ts::DATE::VARCHAR AS session, max(value) AS gauge, bool_or(event_type = 'error') AS failed FROM events GROUP BY ALL)
 SELECT user_id, max(session) AS session, arg_max(gauge, session) AS gauge, arg_max(failed, session) AS failed FROM s GROUP BY user_id""")
def _(read):
    """A15, T-12: the greatest value within the latest session."""
    sessions = read("events").groupBy("user_id", F.to_date("ts").cast("string").alias("session")).agg(F.max("value").alias("gauge"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return sessions.groupBy("user_id").agg(F.max("session").alias("session"), F.max_by("gauge", "session").alias("gauge"), F.max_by("failed", "session").alias("failed"))


@query("batch_outcomes", """SELECT event_id // 200 AS batch, count(*) FILTER (event_type NOT IN ('error', 'view')) AS inserted, count(*) FILTER (event_type = 'view') AS skipped,
 count(*) FILTER (event_type = 'error') AS rejected, bool_and(event_type = 'error') AS failed FROM events GROUP BY batch""")
def _(read):
    """What became of each batch of 200."""
    kind = F.col("event_type")
    return read("events").groupBy(F.floor(F.col("event_id") / 200).alias("batch")).agg(
        F.count_if(~kind.isin("error", "view")).alias("inserted"), F.count_if(kind == "view").alias("skipped"),
        F.count_if(kind == "error").alias("rejected"), F.bool_and(kind == "error").alias("failed"),
    )


@query("integrity_report", """WITH r AS (SELECT o_orderkey AS id, count(l_orderkey) AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY id)
 SELECT count(*) AS records, count(*) FILTER (files = 0) AS empty, sum(files)::BIGINT AS files, (SELECT count(*) FROM lineitem) AS stated, (SELECT count(*) FROM lineitem) = sum(files) AS complete FROM r""")
def _(read):
    """Counts against what is stated."""
    files = read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"))
    joined = read("orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").agg(
        F.count("*").alias("records"), F.count_if(F.col("files").isNull()).alias("empty"), F.sum(F.coalesce("files", F.lit(0))).alias("files")
    )
    stated = read("lineitem").agg(F.count("*").alias("stated"))
    return joined.join(F.broadcast(stated)).withColumn("complete", F.col("stated") == F.col("files"))


@query("verify_records", "SELECT count(*) AS records, count(*) FILTER (try_cast(props AS JSON) IS NULL) AS unreadable, count(*) FILTER (props->>'$.k' IS NOT NULL) AS answered FROM events")
def _(read):
    """Every record parsed again."""
    parsed = F.try_parse_json("props")
    return read("events").agg(F.count("*").alias("records"), F.count_if(parsed.isNull()).alias("unreadable"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("answered"))


@query("run_summary", sql("posts media", """m AS (SELECT post_id, count(*) AS n FROM media GROUP BY post_id)
 SELECT count(*) AS posts, count(m.n) AS with_media, coalesce(sum(m.n), 0)::BIGINT AS media, min(created_at) AS oldest, max(created_at) AS newest FROM posts LEFT JOIN m ON m.post_id = posts.id"""))
def _(read):
    """What an import brought."""
    files = views.media(read).groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n"))
    return views.posts(read).join(files, "id", "left").agg(
        F.count("*").alias("posts"), F.count("n").alias("with_media"), F.coalesce(F.sum("n"), F.lit(0)).alias("media"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")
    )


# -- ranking -----------------------------------------------------------------------------------------


@query("newest_capture_per_id", sql("captures", "SELECT id, captured_at, kind, event_id FROM captures QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, event_id) = 1"))
def _(read):
    """The newest version, the first winning ties."""
    return merge.newest(views.captures(read).select("id", "captured_at", "kind", "event_id"), ["id"], [F.col("captured_at").desc(), F.col("event_id").asc()])


@query("roster_newest", "SELECT user_id, event_type AS list, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY ALL")
def _(read):
    """The newest row of a pair, the later source winning ties."""
    return read("events").groupBy("user_id", F.col("event_type").alias("list")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("first_deletion", sql("deletions", "SELECT id, min(deleted_at) AS deleted_at FROM deletions GROUP BY id"))
def _(read):
    """The first deletion of each id."""
    return merge.first_deletions(views.deletions(read))


@query("best_variant", sql("media", """d AS (SELECT DISTINCT post_id, media_id, part, size FROM media),
 r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY size DESC, media_id, part) AS n FROM d) SELECT post_id, media_id, part, size FROM r WHERE n = 1"""))
def _(read):
    """The largest variant, the first winning ties."""
    variants = views.media(read).select("post_id", "media_id", "part", "size").distinct()
    rank = F.struct(F.col("size").alias("s"), (-F.col("media_id")).alias("m"), (-F.col("part")).alias("p"))
    return variants.groupBy("post_id").agg(F.max_by(F.struct("media_id", "part", "size"), rank).alias("v")).select("post_id", "v.*")


@query("spill_dirs", sql("media", """d AS (SELECT DISTINCT post_id, media_id, strftime(cached_at, '%Y/%m') AS month FROM media)
 SELECT post_id, media_id, month, (row_number() OVER (PARTITION BY month ORDER BY post_id, media_id) - 1) // 100 AS spill FROM d"""))
def _(read):
    """Month directories of at most 100 files."""
    files = views.media(read).select("post_id", "media_id", F.date_format("cached_at", "yyyy/MM").alias("month")).distinct()
    return relate.spill_directories(files, ["month"], [F.col("post_id").asc(), F.col("media_id").asc()], 100)


@query("greedy_shards", """WITH RECURSIVE s AS (SELECT lang, doc_id, strlen(text) AS b, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
 w AS (SELECT lang, doc_id, n, b AS used, 0 AS shard FROM s WHERE n = 1
  UNION ALL SELECT s.lang, s.doc_id, s.n, CASE WHEN w.used + s.b <= 50000 THEN w.used + s.b ELSE s.b END, CASE WHEN w.used + s.b <= 50000 THEN w.shard ELSE w.shard + 1 END FROM w JOIN s ON s.lang = w.lang AND s.n = w.n + 1)
 SELECT lang, doc_id, shard FROM w""")
def _(read):
    """Greedy shards by bytes, streamed over each language's sorted rows."""
    sized = read("documents").select("lang", "doc_id", F.octet_length("text").alias("bytes"))
    return sinks.shard_numbers(sized, ["lang"], ["doc_id"], [], 50_000, size=F.col("bytes")).select("lang", "doc_id", "shard")


# -- filters and joins -------------------------------------------------------------------------------


def _tab(name: str, keep, where: str):
    @query(f"tab_{name}", sql("thread", f"SELECT id, parent FROM thread WHERE {where}"))
    def _(read):
        """F6, F7."""
        return views.thread(read).where(keep()).select("id", "parent")


_tab("posts", lambda: F.col("parent").isNull(), "parent IS NULL")
_tab("replies", lambda: F.col("parent").isNotNull(), "parent IS NOT NULL")
_tab("media", lambda: F.length("text") > 400, "length(text) > 400")


@query("own_author_semi", sql("posts authors", "SELECT id, author_id FROM posts WHERE author_id IN (SELECT author_id FROM authors ORDER BY followers DESC, author_id LIMIT 20)"))
def _(read):
    """posts by the 20 own authors."""
    own = views.authors(read).orderBy(F.desc("followers"), "author_id").limit(20).select("author_id")
    return views.posts(read).select("id", "author_id").join(F.broadcast(own), "author_id", "left_semi").select("id", "author_id")


@query("account_filter", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def _(read):
    """F11."""
    return read("documents").where(F.col("source").isin("src1", "src3")).select("doc_id", "source")


@query("size_validator", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) <= 4096 AND doc_id IS NOT NULL")
def _(read):
    """messages up to a size."""
    return read("documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).where("bytes <= 4096 and doc_id is not null")


@query("gap_fill_anti", sql("posts media", "SELECT DISTINCT post_id FROM media WHERE post_id NOT IN (SELECT id FROM posts WHERE status = 'O')"))
def _(read):
    """Listed ids that are not stored."""
    stored = views.posts(read).where("status = 'O'").select(F.col("id").alias("post_id"))
    return relate.missing(views.media(read).select("post_id").distinct(), stored, ["post_id"])


@query("verify_inner", sql("posts media", "SELECT id, count(*) AS copies FROM posts JOIN media ON post_id = id WHERE status = 'P' GROUP BY id"))
def _(read):
    """Listed ids that are stored."""
    files = views.media(read).groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("copies"))
    return views.posts(read).where("status = 'P'").select("id").join(files, "id")


@query("media_join_all", sql("posts media", """f AS (SELECT post_id, media_id, source, row_number() OVER (PARTITION BY post_id, media_id ORDER BY part, source, size) AS n FROM media)
 SELECT p.id, f.media_id, f.source FROM posts p LEFT JOIN f ON f.post_id = p.id AND f.n = 1"""))
def _(read):
    """All posts with the first file of each key."""
    first = views.media(read).groupBy(F.col("post_id").alias("id"), "media_id").agg(F.min(F.struct("part", "source", "size")).alias("f"))
    return views.posts(read).select("id").join(first, "id", "left").select("id", "media_id", F.col("f.source").alias("source"))


@query("missing_media", sql("posts media", "SELECT id FROM posts WHERE id NOT IN (SELECT post_id FROM media WHERE type = 'R')"))
def _(read):
    """Posts without a file."""
    return relate.missing(views.posts(read).select("id"), views.media(read).where("type = 'R'").select(F.col("post_id").alias("id")), ["id"])


@query("media_union", sql("media", "SELECT post_id, media_id, min(source) AS source FROM media GROUP BY ALL"))
def _(read):
    """The first source of each key."""
    return views.media(read).groupBy("post_id", "media_id").agg(F.min("source").alias("source"))


@query("avatar_join", sql("authors posts", "b AS (SELECT author_id, max(id) AS blob FROM posts GROUP BY author_id) SELECT a.author_id, b.blob FROM authors a LEFT JOIN b ON b.author_id = a.author_id"))
def _(read):
    """People with their newest blob."""
    blobs = views.posts(read).groupBy("author_id").agg(F.max("id").alias("blob"))
    return views.authors(read).select("author_id").join(blobs, "author_id", "left")


@query("queue_restore", sql("posts media", "SELECT DISTINCT id FROM posts JOIN media ON post_id = id WHERE status = 'P' AND type = 'N'"))
def _(read):
    """Pending ids that still have media."""
    has = views.media(read).where("type = 'N'").select(F.col("post_id").alias("id")).distinct()
    return views.posts(read).where("status = 'P'").select("id").join(has, "id", "left_semi")


@query("children_counts", sql("thread", "SELECT parent AS id, count(*) AS replies FROM thread WHERE parent IS NOT NULL GROUP BY parent"))
def _(read):
    """J13, G2."""
    return relate.children_counts(views.thread(read))


@query("ancestor_chain_all", sql("thread", """w AS (SELECT id AS start, parent AS ancestor, 1 AS hops FROM thread WHERE parent IS NOT NULL
 UNION ALL SELECT w.start, t.parent, w.hops + 1 FROM w JOIN thread t ON t.id = w.ancestor WHERE t.parent IS NOT NULL AND w.hops < 20) SELECT start, ancestor, hops FROM w""", recursive=True))
def _(read):
    """Ancestors of all posts, 20 hops at most."""
    thread = views.thread(read)
    return relate.ancestors(thread.select("id", "parent"), thread.select(F.col("id").alias("start")))


@query("missing_parents", sql("thread", "k AS (SELECT * FROM thread WHERE turn <> 2) SELECT id, parent FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM k)"))
def _(read):
    """Replies to posts that are not there."""
    return relate.missing_parents(views.thread(read).where("turn <> 2").select("id", "parent"))


@query("conversation_inference", sql("thread", "SELECT id, coalesce(CASE WHEN turn % 2 = 0 THEN conv_id END, parent, id) AS conversation FROM thread"))
def _(read):
    """A conversation by itself, its parent or its id."""
    return views.thread(read).select("id", F.coalesce(F.when(F.col("turn") % 2 == 0, F.col("conv_id")), "parent", "id").alias("conversation"))


# -- merges ------------------------------------------------------------------------------------------


@query("edit_superseded", sql("thread", "e AS (SELECT parent, arg_max(id, turn * 1000000 + id) AS by FROM thread WHERE parent IS NOT NULL GROUP BY parent) SELECT t.id, e.by AS superseded_by FROM thread t LEFT JOIN e ON e.parent = t.id"))
def _(read):
    """The edit that replaces a post."""
    posts = views.thread(read).select("id", F.col("parent").alias("edited_from"), "turn")
    return merge.mark_superseded(posts, "turn").select("id", "superseded_by")


@query("apply_deletions", sql("authors deletions", "f AS (SELECT id, min(deleted_at) AS deleted_at FROM deletions GROUP BY id) SELECT a.author_id AS id, f.deleted_at FROM authors a LEFT JOIN f ON f.id = a.author_id"))
def _(read):
    """Deletion marks."""
    return merge.mark_deleted(views.authors(read).select(F.col("author_id").alias("id")), views.deletions(read)).select("id", "deleted_at")


@query("purge_category", sql("authors deletions", "SELECT author_id AS id FROM authors WHERE author_id NOT IN (SELECT id FROM deletions)"))
def _(read):
    """Posts without the deleted ones."""
    marked = merge.mark_deleted(views.authors(read).select(F.col("author_id").alias("id")), views.deletions(read))
    return merge.purge(marked, "deleted").select("id")


@query("merge_newest_nonempty", sql("captures", "SELECT id, arg_max(value, captured_at) FILTER (value IS NOT NULL) AS value, arg_max(k, captured_at) FILTER (k IS NOT NULL) AS k, max(captured_at) AS captured_at FROM captures GROUP BY id"))
def _(read):
    """M1, M2: each field's newest answer."""
    return merge.newest_answers(views.captures(read), ["id"], "captured_at", ["value", "k"])


@query("merge_fold_parity", sql("captures", """s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM captures),
 w AS (SELECT id, n, captured_at, value, k FROM s WHERE n = 1 UNION ALL
  SELECT s.id, s.n, greatest(s.captured_at, w.captured_at), CASE WHEN s.captured_at < w.captured_at THEN coalesce(w.value, s.value) ELSE coalesce(s.value, w.value) END,
   CASE WHEN s.captured_at < w.captured_at THEN coalesce(w.k, s.k) ELSE coalesce(s.k, w.k) END FROM w JOIN s ON s.id = w.id AND s.n = w.n + 1)
 SELECT id, captured_at, value, k FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""", recursive=True))
def _(read):
    """M8: copies folded in scan order."""
    return merge.fold_copies(views.captures(read), ["id"], ["event_id"], "captured_at", ["value", "k"])


@query("upsert_people", sql("captures authors", """c AS (SELECT id, arg_max(k, captured_at) FILTER (k IS NOT NULL) AS k, max(captured_at) AS captured_at FROM captures GROUP BY id)
 SELECT coalesce(a.author_id, c.id) AS id, coalesce(c.k, a.nation)::BIGINT AS k, a.handle, coalesce(c.captured_at, TIMESTAMP '2000-01-01') AS seen FROM authors a FULL JOIN c ON c.id = a.author_id"""))
def _(read):
    """M2: fresh answers over stored ones."""
    stored = views.authors(read).select(F.col("author_id").alias("id"), F.col("nation").cast("bigint").alias("k"), "handle", F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz").alias("seen"))
    fresh = merge.newest_answers(views.captures(read), ["id"], "captured_at", ["k"]).select("id", "k", F.lit(None).cast("string").alias("handle"), F.col("captured_at").alias("seen"))
    return merge.upsert(stored, fresh, ["id"])


@query("insert_if_absent", sql("authors", "SELECT author_id AS id, handle FROM authors WHERE author_id % 2 = 0 UNION ALL SELECT author_id, 'backfill' FROM authors WHERE author_id % 2 <> 0 AND author_id % 3 = 0"))
def _(read):
    """Backfill adds, never changes."""
    people = views.authors(read).select(F.col("author_id").alias("id"), "handle")
    return merge.insert_if_absent(people.where("id % 2 = 0"), people.where("id % 3 = 0").withColumn("handle", F.lit("backfill")), ["id"])


@query("fill_gaps", sql("captures", """n AS (SELECT id, event_id, value, k, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, event_id) AS r FROM captures),
 s AS (SELECT * FROM n WHERE r = 1), f AS (SELECT id, max(k) AS k FROM captures GROUP BY id) SELECT s.id, coalesce(s.k, f.k) AS k FROM s LEFT JOIN f USING (id)"""))
def _(read):
    """M5: absent fields of stored rows are filled."""
    captures = views.captures(read)
    stored = merge.newest(captures, ["id"], [F.col("captured_at").desc(), F.col("event_id").asc()]).select("id", "k")
    return merge.fill_gaps(stored, captures.groupBy("id").agg(F.max("k").alias("k")), ["id"], ["k"])


@query("delete_cascade", sql("posts media", """SELECT 'posts' AS store, count(*) AS rows FROM posts WHERE status <> 'F' UNION ALL SELECT 'media', count(*) FROM media WHERE post_id NOT IN (SELECT id FROM posts WHERE status = 'F')"""))
def _(read):
    """Posts and what hangs on them."""
    posts, media = views.posts(read), views.media(read)
    left, files, _ = merge.delete_cascade(posts, media, posts.select("id"), posts.where("status = 'F'"))
    return left.agg(F.count("*").alias("rows")).select(F.lit("posts").alias("store"), "rows").union(files.agg(F.count("*").alias("rows")).select(F.lit("media").alias("store"), "rows"))


# -- sets --------------------------------------------------------------------------------------------


@query("union_sources", "SELECT 'orders' AS origin, o_orderkey AS id FROM orders UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem")
def _(read):
    """Sources one after another."""
    return read("orders").select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id")).unionByName(
        read("lineitem").select(F.lit("lineitem").alias("origin"), F.col("l_orderkey").alias("id")), allowMissingColumns=True
    )


@query("dedup_first", "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(read):
    """Copies by content, the first place kept."""
    return read("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("set_intersect", sql("posts media", "SELECT id FROM posts WHERE status = 'O' INTERSECT SELECT post_id FROM media WHERE type = 'N'"))
def _(read):
    """Hits that a tab shows."""
    return views.posts(read).where("status = 'O'").select("id").intersect(views.media(read).where("type = 'N'").select(F.col("post_id").alias("id")))


@query("distinct_rows", "SELECT DISTINCT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def _(read):
    """U4: distinct by the whole row."""
    return read("events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).distinct()


@query("owner_union_cap", """WITH r AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL)
 SELECT user_id, array_to_string(list(event_type ORDER BY f)[1:3], ',') AS owners FROM r GROUP BY user_id""")
def _(read):
    """A union in order of arrival, capped."""
    firsts = read("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    owners = F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return firsts.groupBy("user_id").agg(F.array_join(F.slice(owners, 1, 3), ",").alias("owners"))


# -- text --------------------------------------------------------------------------------------------


@query("host_allowlist", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|[.])example[.](com|org)$') AS allowed, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def _(read):
    """URL checks."""
    url = F.col("url")
    return read("pages").select("page_id", urls.host(url).alias("host"), urls.on_hosts(url, ["example.com", "example.org"]).alias("allowed"), urls.without_query(url).alias("bare"))


@query("strip_tags", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))::BIGINT AS chars, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM pages")
def _(read):
    """Text of markup, for names out of HTML."""
    plain = text.strip_tags(F.col("html"))
    return read("pages").select("page_id", F.length(plain).cast("bigint").alias("chars"), F.sha2(plain, 256).alias("digest"))


@query("hashtags_extract", r"SELECT page_id, array_to_string(regexp_extract_all(url, '#([\p{L}\p{N}_]+)', 1), ',') AS tags FROM pages")
def _(read):
    """Tags in a text, in order."""
    return read("pages").select("page_id", F.array_join(text.hashtags(F.col("url")), ",").alias("tags"))


@query("csv_cell", r"""WITH c AS (SELECT event_id, v FROM events, (SELECT unnest([1, 2, 3, 4]) AS part) CROSS JOIN LATERAL (SELECT CASE part WHEN 1 THEN props WHEN 2 THEN '=' || event_type WHEN 3 THEN event_type || ',' || user_id WHEN 4 THEN NULL END AS v) AS x),
 g AS (SELECT event_id, CASE WHEN substr(v, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || v ELSE v END AS v FROM c)
 SELECT event_id, CASE WHEN v IS NULL THEN '' WHEN contains(v, '"') OR contains(v, ',') OR contains(v, chr(10)) OR contains(v, chr(13)) THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM g""")
def _(read):
    """K7: cells quoted where they need it, formulas defused, null empty."""
    kinds = F.array(F.col("props"), F.concat(F.lit("="), F.col("event_type")), F.concat_ws(",", "event_type", F.col("user_id").cast("string")), F.lit(None))
    return read("events").select("event_id", F.explode(kinds).alias("v")).select("event_id", text.csv_cell(F.col("v")).alias("cell"))


@query("compact_counts", """SELECT doc_id, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 10000 THEN (((n / 1000.0::DOUBLE * 4503599627370496)::HUGEINT * 10 + 2251799813685248) // 4503599627370496 // 10)::VARCHAR || '.' || (((n / 1000.0::DOUBLE * 4503599627370496)::HUGEINT * 10 + 2251799813685248) // 4503599627370496 % 10)::VARCHAR || 'K' WHEN n < 1000000 THEN round(n / 1000.0)::BIGINT::VARCHAR || 'K' ELSE 'M' END AS label
 FROM (SELECT doc_id, n_chars AS n FROM documents)""")
def _(read):
    """fmtCount."""
    return read("documents").select("doc_id", text.compact_count(F.col("n_chars")).alias("label"))


@query("sanitised_ids_all", """SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN substr(source, 4) END AS id, length(t)::BIGINT AS chars, sha256(t) AS digest
 FROM (SELECT doc_id, source, nullif(substr(text, 1, 200000), '') AS t FROM documents)""")
def _(read):
    """checked ids and whole texts, within the reference's bound."""
    whole = coerce.non_empty(F.col("text"))
    return read("documents").select("doc_id", coerce.record_id(F.substring("source", 4, 30)).alias("id"), F.length(whole).cast("bigint").alias("chars"), F.sha2(whole, 256).alias("digest"))


@query("absent_answers", "SELECT event_type, count(*) FILTER (nullif(CASE WHEN event_type = 'error' THEN '' ELSE props END, '') IS NULL) AS absent, count(*) AS rows FROM events GROUP BY event_type")
def _(read):
    """Absence of answers."""
    value = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props"))
    rows = read("events").select("event_type", value.alias("v"))
    return rows.groupBy("event_type").agg(F.count_if(is_absent(F.col("v"), rows.schema["v"].dataType)).alias("absent"), F.count("*").alias("rows"))


@query("media_queue", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
 SELECT event_type, count(*) FILTER (n <= 500) AS queued, count(*) FILTER (n > 500) AS dropped FROM r GROUP BY event_type""")
def _(read):
    """T-4: bounded queues with counted overflow."""
    placed = timeline.numbered(read("events").select("event_type", "ts", "event_id"), ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], "n")
    return placed.groupBy("event_type").agg(F.count_if(F.col("n") < 500).alias("queued"), F.count_if(F.col("n") >= 500).alias("dropped"))
