"""Queries of what is kept and told beside the records: accounts, batches, chains, traffic and links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.operators import accounts, merge, relate, timeline
from quillspark.plans import views
from quillspark.plans.registry import query
from quillspark.plans.views import sql
from quillspark.streaming import traffic


def _quoted(text: Column) -> Column:
    """A text as JSON, null for null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


@query("own_authors_newest", """WITH s AS (SELECT o_orderpriority AS account, o_custkey AS author, min(o_orderkey) AS t, 0 AS side FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
 f AS (SELECT o_orderpriority AS account, o_custkey AS author, min(o_orderkey) AS t, 1 AS side FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
 u AS (SELECT * FROM s UNION ALL SELECT * FROM f ANTI JOIN s USING (account, author)),
 r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY side DESC, t DESC, author DESC) AS n FROM u)
 SELECT account, author, row_number() OVER (PARTITION BY account ORDER BY side, t, author) - 1 AS place FROM r WHERE n <= 20""")
def _(read):
    """The newest 20 own authors of each account, stored ones before new ones."""
    rows = read("orders").select(F.col("o_orderpriority").alias("account"), F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    return accounts.remember(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), "account", "author", "place")


@query("own_authors_forgotten", "SELECT DISTINCT o_orderpriority AS account, o_custkey AS author FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(read):
    """Own authors without those that are to be forgotten."""
    own = read("orders").select(F.col("o_orderpriority").alias("account"), F.col("o_custkey").alias("author")).distinct()
    return accounts.forget(own, read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("author")), ["author"])


@query("edit_chains", sql("thread", """c AS (SELECT id, coalesce(parent, id) AS top, CASE WHEN parent IS NULL THEN 1 ELSE 2 END AS n FROM thread
  UNION ALL SELECT c.id, t.parent, c.n + 1 FROM c JOIN thread t ON t.id = c.top AND t.parent IS NOT NULL AND c.top <> c.id),
 o AS (SELECT id, max(n)::BIGINT AS version, arg_max(top, n) AS initial_id FROM c GROUP BY id)
 SELECT id, initial_id, version, max(version) OVER (PARTITION BY initial_id) AS versions, id IN (SELECT parent FROM thread WHERE parent IS NOT NULL) AS is_superseded FROM o""", recursive=True))
def _(read):
    """Every post with the first of its chain of edits, its place in it, how long it is and whether another came after it."""
    return relate.edit_chains(views.thread(read).select("id", F.col("parent").alias("edited_from")))


@query("superseded_purged", sql("thread", "SELECT id FROM thread WHERE id NOT IN (SELECT parent FROM thread WHERE parent IS NOT NULL)"))
def _(read):
    """F8: posts without those that an edit has replaced."""
    posts = views.thread(read).select("id", F.col("parent").alias("edited_from"), "turn")
    return merge.purge(merge.mark_superseded(posts, "turn"), "superseded").select("id")


_LINKS = """WITH e AS (SELECT page_id, url, host, CASE WHEN url IS NULL THEN NULL WHEN contains(url, '?') THEN '{"urls":[' || to_json(url) || ']}' WHEN length(url) % 3 = 0 THEN 'null'
   WHEN length(url) % 3 = 1 THEN '[' || to_json(url) || ']' ELSE '{"urls":[],"mentions":[' || to_json(host) || ']}' END AS entities
  FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages))"""


@query("filled_links", _LINKS + """ SELECT page_id AS id, CASE WHEN NOT g THEN entities ELSE '{"hashtags":[],"mentions":' || CASE WHEN contains(entities, 'mentions') THEN '[' || to_json(host) || ']' ELSE '[]' END || ',"urls":[' || to_json(url) || ']}' END AS entities, g AS filled
 FROM (SELECT *, url IS NOT NULL AND (entities = 'null' OR starts_with(entities, '{"urls":[]')) AS g FROM e)""")
def _(read):
    """M5: links are filled where the container is an object, null or absent and has none; tags and mentions that are there stay."""
    url = F.col("url")
    pages = read("pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
    entities = (
        F.when(url.isNull(), None).when(url.contains("?"), F.concat(F.lit('{"urls":['), _quoted(url), F.lit("]}"))).when(F.length(url) % 3 == 0, "null")
        .when(F.length(url) % 3 == 1, F.concat(F.lit("["), _quoted(url), F.lit("]"))).otherwise(F.concat(F.lit('{"urls":[],"mentions":['), _quoted(F.col("host")), F.lit("]}")))
    )
    fresh = pages.where(url.isNotNull()).select(F.col("page_id").alias("id"), F.concat(F.lit("["), _quoted(url), F.lit("]")).alias("urls"))
    return merge.fill_links(pages.select(F.col("page_id").alias("id"), entities.alias("entities")), fresh)


@query("verify_failures", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, text IS NULL OR regexp_matches(text, '["\\\\\\x00-\\x1F]') AS bad FROM documents)
 SELECT doc_id, position, (SELECT count(*) FROM r WHERE bad) AS failures FROM r WHERE bad ORDER BY position LIMIT 20""")
def _(read):
    """Texts put between quotes as they are; those that this makes unreadable are listed, 20 at most, and counted."""
    docs = read("documents").select("doc_id", F.concat(F.lit('{"t":"'), F.col("text"), F.lit('"}')).alias("record"))
    return accounts.failures(docs, ["doc_id"], F.try_parse_json("record").isNull())


@query("import_summary", sql("posts media", """m AS (SELECT post_id, count(*) AS n, sum(size)::BIGINT AS b FROM media GROUP BY post_id)
 SELECT count(*) AS posts, count(n) AS with_media, coalesce(sum(n), 0)::BIGINT AS media, sum(b)::BIGINT AS bytes, count(*) FILTER (status = 'P') AS replies, count(*) FILTER (status = 'F') AS retweets,
  min(created_at) AS oldest, max(created_at) AS newest FROM posts LEFT JOIN m ON m.post_id = posts.id"""))
def _(read):
    """What an import brought, with replies, retweets and the bytes of all media."""
    posts = views.posts(read).select("id", "created_at", F.when(F.col("status") == "P", F.col("author_id")).alias("reply_to_id"), F.when(F.col("status") == "F", F.col("author_id")).alias("retweeted_id"))
    return accounts.summary(posts, views.media(read).select(F.col("post_id").alias("id"), F.col("size").alias("bytes")))


@query("chosen_sources", """WITH d AS (SELECT doc_id, nullif(regexp_extract(source, '[0-9]+$'), '')::BIGINT AS n FROM documents)
 SELECT 'two' AS choice, doc_id FROM d WHERE n IN (1, 3) UNION ALL SELECT 'void', doc_id FROM d UNION ALL SELECT 'all', doc_id FROM d UNION ALL SELECT 'none', doc_id FROM d WHERE n = 2.5""")
def _(read):
    """records of chosen sources; one that there is not makes the choice void."""
    docs = read("documents").select("doc_id", F.nullif(F.regexp_extract("source", "[0-9]+$", 0), F.lit("")).cast("bigint").alias("n"))
    out = None
    for name, chosen in (("two", [1, "3"]), ("void", [1, -1]), ("all", []), ("none", [2.5])):
        part = accounts.of_sources(docs, "n", chosen, 1000).select(F.lit(name).alias("choice"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("message_batches", """WITH r AS (SELECT lang, length(text) + 20 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, text IS NOT NULL AND length(text) <= 10000 AS sound FROM documents),
 b AS (SELECT lang, count(*) AS incoming, count(*) FILTER (sound AND place < 200) AS taken, count(*) FILTER (place >= 200) AS "over", coalesce(sum(n) FILTER (sound AND place < 200), 0)::BIGINT AS s FROM r GROUP BY lang)
 SELECT lang, incoming, taken, incoming - taken AS dropped, "over", 2 + s + greatest(taken - 1, 0) AS chars, CASE WHEN 2 + s + greatest(taken - 1, 0) > 524288 THEN 'size' WHEN taken = 0 THEN 'empty' END AS refusal FROM b""")
def _(read):
    """messages of up to 200 records; unsound ones go, and a message that is too long is refused."""
    size = F.length("text")
    return accounts.batches(read("documents"), ["lang"], [F.col("doc_id")], F.col("text").isNotNull() & (size <= 10000), size + 20, 200, 524288)


_URL = "'https://' || CASE WHEN value > 80 THEN 'evil-x.com' ELSE 'api.x.com' END || '/graphql/q' || event_id || '/' || CASE event_type WHEN 'signup' THEN 'CreateTweet' WHEN 'error' THEN 'DeleteTweet' WHEN 'view' THEN 'TweetResultByRestId' WHEN 'click' THEN 'Following' ELSE 'UserRepliesTimeline' END || '?variables=%7B%22userId%22%3A%22' || user_id || '%22%7D'"


@query("merged_timeline_times", """WITH p AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN NULL ELSE make_timestamp(n_chars * 60000000) END AS created, CASE WHEN n_chars > 500 THEN make_timestamp(doc_id * 1000000) END AS captured FROM documents)
 SELECT doc_id, row_number() OVER (ORDER BY coalesce(created, captured, TIMESTAMP '1970-01-01') DESC, source NULLS FIRST, doc_id) - 1 AS position FROM p""")
def _(read):
    """Places by creation, else by capture, else as if from 1970."""
    docs = read("documents").select(
        "doc_id", "source", F.when(F.col("lang") == "en", None).otherwise(F.timestamp_seconds(F.col("n_chars") * 60)).alias("created"), F.when(F.col("n_chars") > 500, F.timestamp_seconds("doc_id")).alias("captured"),
    )
    return timeline.with_positions(docs, timeline.merged_keys("created", "captured", "source", "doc_id")).select("doc_id", "position")


@query("folded_archives", """WITH c AS (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS id, event_id, epoch_us(ts) AS t, CASE WHEN event_type <> 'view' THEN value END AS value, event_type FROM events)
 SELECT id, arg_min(event_id, (t, event_id)) AS event_id, max(t) AS seen, arg_max(value, (t, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(event_type, (t, event_id)) AS event_type FROM c WHERE id IS NOT NULL GROUP BY id
 UNION ALL SELECT id, event_id, t AS seen, value, event_type FROM c WHERE id IS NULL""")
def _(read):
    """Each post once at its first place, copies folded; records without id stay, each by itself."""
    copies = read("events").select(
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "event_type"
    ).withColumn("scan", F.col("at"))
    return merge.fold_archives(copies, "id", ["scan", "event_id"], "at", ["value", "event_type"]).select("id", "event_id", F.col("at").alias("seen"), "value", "event_type")


@query("deletions_recorded", """WITH s AS (SELECT user_id AS id, min(ts) FILTER (event_type = 'error') AS at FROM events WHERE event_type <> 'view' GROUP BY user_id),
 f AS (SELECT user_id AS id, min(ts) AS at FROM events WHERE event_type = 'view' GROUP BY user_id)
 SELECT id, coalesce(s.at, f.at) AS deleted_at FROM s FULL JOIN f USING (id)""")
def _(read):
    """A deletion is kept unless the one that is stored has a time."""
    events = read("events").select(F.col("user_id").alias("id"), "ts", "event_type")
    stored = events.where("event_type <> 'view'").groupBy("id").agg(F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("deleted_at"))
    return merge.record_deletions(stored, events.where("event_type = 'view'").select("id", F.col("ts").alias("deleted_at")))


@query("media_put", "SELECT id, coalesce(s_name, c_name) AS name FROM (SELECT c_custkey AS id, c_name FROM customer) FULL JOIN (SELECT s_suppkey AS id, s_name FROM supplier) USING (id)")
def _(read):
    """Rows by key, a fresh one in place of the stored one."""
    stored = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.put(stored, read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("media_indexed", sql("posts media", """e AS (SELECT post_id AS id, part AS name, row_number() OVER (PARTITION BY post_id ORDER BY media_id, part) AS n FROM media WHERE part IN (SELECT p_partkey FROM part WHERE p_retailprice >= 1200)),
 k AS (SELECT count(*) AS entries, count(*) FILTER (part NOT IN (SELECT p_partkey FROM part WHERE p_retailprice >= 1200)) AS skipped FROM media)
 SELECT posts.id, e.name, k.entries, k.skipped FROM posts LEFT JOIN e ON e.id = posts.id AND e.n = 1 CROSS JOIN k"""))
def _(read):
    """Posts with the first listed file that is there; entries whose file is absent are counted."""
    entries = views.media(read).select(F.col("post_id").alias("id"), F.col("part").alias("name"), "media_id")
    files = read("part").where("p_retailprice >= 1200").select(F.col("p_partkey").alias("name"))
    joined, counts = relate.indexed_media(views.posts(read).select("id"), entries, files, ["id"], [F.col("media_id").asc(), F.col("name").asc()])
    return joined.select("id", "name").join(F.broadcast(counts.select("entries", "skipped")))


@query("media_grids", sql("posts media", "SELECT id, least(greatest(count(media_id), 1), 4)::BIGINT AS shape FROM posts LEFT JOIN media ON post_id = id GROUP BY id"))
def _(read):
    """The layout of each post's pictures."""
    files = views.media(read).groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n"))
    return views.posts(read).select("id").join(files, "id", "left").select("id", display.grid_shape(F.col("n")).cast("bigint").alias("shape"))


@query("traffic_selected", f"""WITH t AS (SELECT event_id, event_type, user_id, {_URL} AS url, CASE WHEN event_type IN ('signup', 'error') OR event_id % 7 = 0 THEN 'post' ELSE 'GET' END AS method, CASE WHEN value < 20 THEN 403 ELSE 200 END AS status FROM events)
 SELECT event_id, 'q' || event_id AS query_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'detail' ELSE 'connections' END AS kind,
  CASE WHEN event_type = 'click' THEN 'following' END AS list, CASE WHEN event_type = 'click' THEN user_id::VARCHAR END AS owner_id
 FROM t WHERE contains(url, '/api.x.com/') AND status = 200 AND event_type <> 'purchase' AND (method = 'post') = (event_type IN ('signup', 'error'))""")
def _(read):
    """Requests that are looked at, by host, operation, method and status; follow lists asked for, replies not."""
    kind = F.col("event_type")
    operation = F.when(kind == "signup", "CreateTweet").when(kind == "error", "DeleteTweet").when(kind == "view", "TweetResultByRestId").when(kind == "click", "Following").otherwise("UserRepliesTimeline")
    url = F.concat(
        F.lit("https://"), F.when(F.col("value") > 80, "evil-x.com").otherwise("api.x.com"), F.lit("/graphql/q"), F.col("event_id").cast("string"), F.lit("/"), operation,
        F.lit("?variables=%7B%22userId%22%3A%22"), F.col("user_id").cast("string"), F.lit("%22%7D"),
    )
    rows = read("events").select(
        "event_id", url.alias("url"), F.when(kind.isin("signup", "error") | (F.col("event_id") % 7 == 0), "post").otherwise("GET").alias("method"), F.when(F.col("value") < 20, 403).otherwise(200).alias("status")
    )
    return traffic.selected(rows, connections=True).select("event_id", "query_id", "kind", "list", "owner_id")


@query("traffic_refusals", """WITH d AS (SELECT doc_id, coalesce(nullif(text, ''), 'no message') AS said, lang, n_chars FROM documents)
 SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN 'no data node' WHEN lang IS NULL THEN 'no tweet result candidate (data keys: other,viewer)'
   ELSE 'graphql errors: ' || substr(said || ' [code ' || n_chars || '] (+1 more)', 1, 200) || CASE WHEN lang = 'es' THEN '; NOTE a valid tweet result was also present' ELSE '' END END AS refusal,
  CASE WHEN lang = 'en' THEN doc_id::VARCHAR END AS post_id FROM d""")
def _(read):
    """Answers to writes, with the texts of documents as what their errors say."""
    number, lang = F.col("doc_id").cast("string"), F.col("lang")
    made = F.concat(F.lit('"data":{"notetweet_create":{"tweet_results":{"result":{"tweet":{"rest_id":"'), number, F.lit('"}}}}}'))
    errors = F.concat(F.lit('"errors":[{"code":'), F.col("n_chars").cast("string"), F.lit(',"message":'), F.coalesce(_quoted(F.col("text")), F.lit("null")), F.lit("},1]"))
    body = (
        F.when(lang == "en", F.concat(F.lit("{"), made, F.lit(',"errors":[]}'))).when(lang == "de", '{"data":[1],"errors":null}').when(lang.isNull(), '{"data":{"other":1,"viewer":{}}}')
        .when(lang == "es", F.concat(F.lit("{"), errors, F.lit(","), made, F.lit("}"))).otherwise(F.concat(F.lit("{"), errors, F.lit(',"data":{}}')))
    )
    return traffic.answered(read("documents").select("doc_id", F.lit("create").alias("kind"), body.alias("body"))).select("doc_id", "refusal", "post_id")
