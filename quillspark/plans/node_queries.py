"""Queries over nested answers, which are built from the test tables; their SQL says what each must give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.plans import extract, nodes
from quillspark.plans.registry import query


def _json(*parts: Column | str) -> Column:
    """JSON out of literal pieces and columns; the latter are encoded."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(_encoded(p), F.lit("null")) for p in parts])


def _encoded(value: Column) -> Column:
    """A value as JSON: the only element of an array without its brackets."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("refused_nodes", "SELECT doc_id, doc_id % 6 IN (0, 1, 3) AS refused FROM documents")
def _(read):
    """Tombstones and errors instead of posts."""
    rest = F.col("doc_id") % 6
    body = (
        F.when(rest == 0, _json('{"__typename":"TweetTombstone","rest_id":', _text("doc_id"), "}")).when(rest == 1, _json('{"tombstone":{"text":', F.col("source"), "}}"))
        .when(rest == 2, _json('{"rest_id":', _text("doc_id"), ',"legacy":{"full_text":', F.col("source"), "}}")).when(rest == 3, F.lit('{"legacy":{"error":{"code":1}}}'))
        .when(rest == 4, _json('{"__typename":"Tweet","rest_id":', _text("doc_id"), "}")).otherwise(_json('{"rest_id":', _text("doc_id"), ',"legacy":{"error":{"code":1}}}'))
    )
    return read("documents").select("doc_id", nodes.is_refused(body).alias("refused"))


@query("shown_text", r"""WITH d AS (SELECT doc_id, substr(text, 1, 40) || ' é' || chr(119070) || source AS t FROM documents)
 SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN regexp_replace(t, '\s+$', '') WHEN 1 THEN t || ' https://t.co/' || doc_id WHEN 2 THEN 'note of ' || doc_id WHEN 4 THEN t || ' https://t.co/' || doc_id END AS shown FROM d""")
def _(read):
    """P5: long text first, nothing where nothing is displayed, short text without its media's links, by characters."""
    docs = read("documents").select("doc_id", F.concat(F.substring("text", 1, 40), F.lit(" é\U0001d11e"), F.col("source")).alias("t"), F.concat(F.lit("https://t.co/"), _text("doc_id")).alias("u"))
    full, start = F.concat_ws(" ", "t", "u"), F.length("t") + 1
    media = lambda shift: _json('"extended_entities":{"media":[{"url":', F.col("u"), ',"indices":[', start + shift, ",", start + shift + F.length("u"), "]}]}")
    rest = F.col("doc_id") % 5
    body = F.concat(_json('{"rest_id":', _text("doc_id"), ',"legacy":{"full_text":', full), F.when(rest == 0, F.concat(F.lit(","), media(0))).when(rest == 4, F.concat(F.lit(","), media(-2))).otherwise(""),
                    F.when(rest == 3, ',"display_text_range":[0,0]').otherwise(',"display_text_range":[0,5]'), F.lit("}"),
                    F.when(rest == 2, _json(',"note_tweet":{"note_tweet_results":{"result":{"text":', F.concat(F.lit("note of "), _text("doc_id")), "}}}")).otherwise(""), F.lit("}"))
    return docs.select("doc_id", nodes.shown_text(body).alias("shown"))


@query("live_media", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'k' || page_id ELSE page_id::VARCHAR END AS id, url, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'name=small' AS thumbnail,
 CASE WHEN page_id % 2 = 0 THEN 640.0 ELSE 320.0 END::DOUBLE AS width, 480.0::DOUBLE AS height, CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'a picture' END AS alt, CASE WHEN page_id % 3 = 1 THEN 2 ELSE 0 END::BIGINT AS variants FROM pages WHERE url <> ''""")
def _(read):
    """Media of the first path that has some, with fallbacks for size and id."""
    k = F.col("page_id")
    video = ',"video_info":{"duration_millis":1000,"aspect_ratio":[16,9],"variants":[{"url":"a","bitrate":1,"content_type":"video/mp4"},{"url":""},{"url":"b"}]}'
    item = F.concat(
        _json('{"media_url_https":', F.col("url"), ',"media_key":', F.concat(F.lit("k"), _text("page_id"))), F.when(k % 3 == 0, "").otherwise(_json(',"id_str":', _text("page_id"))),
        F.when(k % 2 == 0, ',"original_info":{"width":640,"height":480}').otherwise(',"sizes":{"large":{"w":320,"h":480}}'),
        F.when(k % 4 == 1, ',"ext_alt_text":""').otherwise(',"ext_alt_text":"a picture"'), F.when(k % 3 == 1, video).otherwise(""), F.lit("}"),
    )
    body = F.when(k % 2 == 0, F.concat(F.lit('{"legacy":{"extended_entities":{"media":[]},"entities":{"media":['), item, F.lit("]}}}"))).otherwise(F.concat(F.lit('{"extended_entities":{"media":['), item, F.lit("]}}")))
    found = read("pages").where("url <> ''").select("page_id", F.explode(nodes.media(body)).alias("m"))
    return found.select("page_id", "m.id", "m.url", F.col("m.thumbnail_url").alias("thumbnail"), "m.width", "m.height", F.col("m.alt_text").alias("alt"), F.size("m.variants").cast("bigint").alias("variants"))


@query("live_entities", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS urls, 'tag' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ',' || source ELSE '' END AS tags, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id::VARCHAR END AS mention_id, lang AS mention FROM documents WHERE lang <> ''""")
def _(read):
    """Links, tags and mentions of the first path that is an object; empty ones go."""
    k = F.col("doc_id")
    inner = F.concat(
        F.lit('{"urls":[{"url":"u","expanded_url":"e"},{"url":"","expanded_url":""}'), F.when(k % 3 == 0, ',{"expanded_url":"only"}').otherwise(""),
        _json('],"hashtags":[{"text":', F.concat(F.lit("tag"), _text("doc_id")), '},{"text":""}'), F.when(k % 2 == 0, _json(',{"text":', F.col("source"), "}")).otherwise(""),
        _json('],"user_mentions":[{"id_str":', F.when(k % 4 == 0, F.lit("no id")).otherwise(_text("doc_id")), ',"screen_name":', F.col("lang"), '},{"id_str":"5"}]}'),
    )
    body = F.when(k % 2 == 0, F.concat(F.lit('{"legacy":{"entities":'), inner, F.lit("}}"))).otherwise(F.concat(F.lit('{"legacy":{"entities":[]},"note_tweet":{"note_tweet_results":{"result":{"entity_set":'), inner, F.lit("}}}}")))
    found = read("documents").where("lang <> ''").select("doc_id", nodes.entities(body).alias("e"))
    return found.select("doc_id", F.size("e.urls").cast("bigint").alias("urls"), F.array_join("e.hashtags", ",").alias("tags"), F.get("e.mentions", F.lit(0))["id"].alias("mention_id"), F.get("e.mentions", F.lit(0))["screen_name"].alias("mention"))


@query("quoted_posts", """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN doc_id::VARCHAR END AS quoted_id, CASE doc_id % 4 WHEN 0 THEN length(substr(text, 1, 25000)) WHEN 1 THEN length('a note') WHEN 2 THEN 0 END::BIGINT AS chars,
 CASE doc_id % 4 WHEN 0 THEN sha256(substr(text, 1, 25000)) WHEN 1 THEN sha256('a note') WHEN 2 THEN sha256('') END AS digest, CASE WHEN doc_id % 4 <> 3 THEN TIMESTAMP '2018-10-10 20:19:24' END AS created_at, CASE WHEN doc_id % 4 <> 3 THEN source END AS handle FROM documents WHERE text <> ''""")
def _(read):
    """The quoted post's short text, else its long one, cut."""
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, _json(',"full_text":', F.col("text"))).otherwise("")
    body = F.concat(
        _json('{"rest_id":"1","quoted_status_result":{"result":{"rest_id":', F.when(k % 4 == 3, F.lit("x")).otherwise(_text("doc_id")), ',"legacy":{"created_at":"Wed Oct 10 20:19:24 +0000 2018"'), text, F.lit("}"),
        F.when(k % 4 == 1, ',"note_tweet":{"note_tweet_results":{"result":{"text":"a note"}}}').otherwise(""), _json(',"core":{"user_results":{"result":{"legacy":{"screen_name":', F.col("source"), "}}}}}}}"),
    )
    found = read("documents").where("text <> ''").select("doc_id", nodes.quoted_post(body).alias("q"))
    return found.select("doc_id", F.col("q.id").alias("quoted_id"), F.length("q.text").cast("bigint").alias("chars"), F.sha2("q.text", 256).alias("digest"), F.col("q.created_at").cast("timestamp_ntz").alias("created_at"), F.col("q.author.screen_name").alias("handle"))


@query("posted_via", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'App ' || page_id WHEN 1 THEN 'Plain ' || page_id WHEN 2 THEN 'App' END AS name, CASE WHEN page_id % 4 = 0 AND regexp_matches(lower(url), '^https?://') THEN url END AS url FROM pages WHERE url IS NOT NULL AND NOT contains(url, '"') AND NOT contains(url, chr(39))""")
def _(read):
    """The client out of an anchor."""
    k, number = F.col("page_id"), _text("page_id")
    source = (
        F.when(k % 4 == 0, F.concat(F.lit('<a rel="x" HREF = "'), "url", F.lit('" class="y">App <b>'), number, F.lit("</b></a>"))).when(k % 4 == 1, F.concat(F.lit("Plain "), number))
        .when(k % 4 == 2, F.lit("<A href='javascript:1'>App</A>")).otherwise("")
    )
    rows = read("pages").where(F.col("url").isNotNull() & ~F.col("url").contains('"') & ~F.col("url").contains("'"))
    return rows.select("page_id", nodes.posted_via(source).alias("v")).select("page_id", "v.name", "v.url")


@query("poll_cards", """SELECT doc_id, doc_id % 4 IN (0, 2) AS is_poll, CASE doc_id % 4 WHEN 0 THEN 'yes,' || source WHEN 2 THEN source END AS choices, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 2 THEN false END AS final FROM documents WHERE source <> ''""")
def _(read):
    """Cards that are polls by their name, with bindings as list or object; of a repeated key the last counts."""
    k = F.col("doc_id")
    card = (
        F.when(k % 4 == 0, _json('{"legacy":{"name":"poll2choice_text_only","binding_values":[{"key":"choice1_label","value":{"string_value":"old"}},{"key":"choice1_label","value":{"string_value":"yes"}},{"key":"choice2_label","value":{"string_value":', F.col("source"), '}},{"key":"counts_are_final","value":{"boolean_value":true}}]}}'))
        .when(k % 4 == 1, F.lit('{"legacy":{"name":"poll:x","binding_values":[{"key":"choice1_label","value":{"string_value":"no"}}]}}'))
        .when(k % 4 == 2, _json('{"legacy":{"name":"19068:poll_choice_images","binding_values":{"choice1_label":{"string_value":', F.col("source"), '},"counts_are_final":{"boolean_value":false}}}}'))
        .otherwise(F.lit('{"legacy":{"name":"a:b:poll","binding_values":[]}}'))
    )
    found = read("documents").where("source <> ''").select("doc_id", extract.poll_of(card).alias("p"))
    return found.select("doc_id", F.col("p").isNotNull().alias("is_poll"), F.array_join("p.choices", ",").alias("choices"), "p.final")


@query("edit_chains", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id + 7)::VARCHAR END AS edited_from, doc_id % 3 = 0 OR doc_id % 2 = 0 AS is_edit, CASE WHEN doc_id % 2 = 0 THEN '5,' || doc_id + 100000 WHEN doc_id % 5 = 0 THEN '' ELSE (doc_id + 100000)::VARCHAR END AS ids, CASE WHEN doc_id % 2 = 0 OR doc_id % 5 <> 0 THEN 3.0 END::DOUBLE AS remaining FROM documents WHERE doc_id IS NOT NULL""")
def _(read):
    """The chain of versions, and the one that a request names."""
    k = F.col("doc_id")
    own = (k + 100000).cast("string")
    long = _json('{"edit_control":{"edit_control_initial":{"edit_tweet_ids":["5",', own, ',"5","bad"],"edits_remaining":3}}}')
    nested = _json('{"edit_control":{"edit":{"edit_control_initial":{"edit_tweet_ids":[', own, '],"edits_remaining":"3"}}}}')
    body = F.when(k % 2 == 0, long).when(k % 5 == 0, F.lit("{}")).otherwise(nested)
    found = read("documents").where("doc_id is not null").select("doc_id", nodes.edit_info(body, F.when(k % 3 == 0, (k + 7).cast("string")).otherwise("none")).alias("e"))
    return found.select("doc_id", "e.edited_from", "e.is_edit", F.array_join("e.ids", ",").alias("ids"), "e.remaining")


def _user(read):
    """People as user nodes."""
    k = F.col("c_custkey")
    body = F.concat(
        _json('{"rest_id":', F.when(k % 7 == 0, F.lit("bad")).otherwise(_text("c_custkey")), ',"core":{"screen_name":', F.col("c_name"), ',"name":""},"profile_bio":{"description":', F.col("c_mktsegment"),
              ',"entities":{"description":{"urls":[{"url":"https://t.co/1"},{"display_url":"x"},{"expanded_url":', F.col("c_mktsegment"), '}],"mentions":[{"username":', F.col("c_name"), '},{"screen_name":""}]}}},"relationship_counts":{"followers":', k, ',"following":-1},'),
        _json('"tweet_counts":{"tweets":5,"media_tweets":', F.col("c_nationkey"), '},"is_blue_verified":', k % 2 == 0, ',"verification":{"verified":"true?"},"location":{"location":""},"website":{"url":', F.col("c_mktsegment"), '},'),
        F.when(k % 3 == 0, '"privacy":{"protected":true},').otherwise(""), _json('"pinned_items":{"tweet_ids_str":[', _text("c_nationkey"), ',"9"]},"banner":{"image_url":"b"},"action_counts":{"favorites_count":12}}'),
    )
    people = read("customer")
    # The file has few row groups for its rows, and a node takes far longer to read than to deal out.
    return people.repartition(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(k.alias("id"), body.alias("body"))


@query("user_nodes", """SELECT c_custkey AS id, c_name AS handle, lower(c_name) AS lower_handle, c_mktsegment AS bio, 2::BIGINT AS urls, '' AS location, c_mktsegment AS website, c_custkey::BIGINT AS followers, NULL::BIGINT AS following, c_custkey % 2 = 0 AS blue, false AS verified FROM customer WHERE c_custkey % 7 <> 0""")
def _(read):
    """users' flat fields; without a sound id there is none."""
    return nodes.users(_user(read)).select(
        "id", F.col("screen_name").alias("handle"), F.col("screen_name_lower").alias("lower_handle"), "bio", F.size("bio_urls").cast("bigint").alias("urls"), "location",
        F.col("website_url").alias("website"), "followers", "following", F.col("blue_verified").alias("blue"), "verified",
    )


@query("live_profiles", """SELECT c_custkey AS id, c_name AS mentions, CASE WHEN c_custkey % 3 = 0 THEN true END AS protected, c_nationkey::VARCHAR AS pinned, c_nationkey::BIGINT AS media, 12::BIGINT AS likes, NULL::BIGINT AS listed, 'b' AS banner FROM customer WHERE c_custkey % 7 <> 0""")
def _(read):
    """What a profile shows beside a user's fields."""
    return nodes.profiles(_user(read)).select(
        "id", F.array_join("bio_mentions", ",").alias("mentions"), "protected", F.col("pinned_id").alias("pinned"), F.col("media_count").alias("media"),
        F.col("like_count").alias("likes"), F.col("listed_count").alias("listed"), F.col("banner_url").alias("banner"),
    )


@query("detail_links", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '|e|only' ELSE url || '|only' END AS links FROM pages WHERE url <> ''""")
def _(read):
    """Links of all places, each once, the first spelling kept."""
    first = F.when(F.col("page_id") % 2 == 0, '{"url":"e"},').otherwise("")
    body = F.concat(_json('{"legacy":{"entities":{"urls":[{"url":', F.col("url"), ',"expanded_url":"1"},{"url":""},'), first, _json('{"url":', F.col("url"), ',"expanded_url":"2"}]}},"entities":{"urls":[{"url":"","expanded_url":"only"},{"expanded_url":"only"},{"url":', F.col("url"), "}]}}"))
    found = read("pages").where("url <> ''").select("page_id", nodes.links(body).alias("l"))
    return found.select("page_id", F.array_join(F.transform("l", lambda u: F.coalesce(u["url"], u["expanded_url"])), "|").alias("links"))


@query("post_badges", """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'reply' END, CASE WHEN o_orderstatus = 'F' THEN 'deleted' END, CASE WHEN o_totalprice > 150000 THEN 'popular' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'edited' END], lambda x: x IS NOT NULL), ',') AS badges FROM orders""")
def _(read):
    """Badges of a list item."""
    names = nodes.badges([("reply", F.col("o_orderstatus") == "O"), ("deleted", F.col("o_orderstatus") == "F"), ("popular", F.col("o_totalprice") > 150000), ("edited", F.col("o_orderpriority") == "1-URGENT")])
    return read("orders").select(F.col("o_orderkey").alias("id"), F.array_join(names, ",").alias("badges"))


@query("post_details", """SELECT doc_id, label, value FROM (SELECT doc_id, unnest(['id', 'language', 'source', 'head', 'characters']) AS label, unnest([doc_id::VARCHAR, lang, source, substr(text, 1, 1), n_chars::VARCHAR]) AS value FROM documents) WHERE value <> ''""")
def _(read):
    """Labelled rows of a post's fields, empty ones left out."""
    rows = nodes.detail_rows([("id", F.col("doc_id")), ("language", F.col("lang")), ("source", F.col("source")), ("head", F.substring("text", 1, 1)), ("characters", F.col("n_chars"))])
    return read("documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.label", "r.value")


@query("profile_counts", """SELECT c_custkey AS id, label, value FROM (SELECT c_custkey, unnest(['balance', 'nation', 'listed']) AS label, unnest([c_acctbal::DOUBLE, c_nationkey::DOUBLE, NULL]) AS value FROM customer) WHERE value >= 0""")
def _(read):
    """Counts that are numbers and not negative."""
    rows = nodes.shown_counts([("balance", F.col("c_acctbal")), ("nation", F.col("c_nationkey")), ("listed", F.lit(None).cast("double"))])
    return read("customer").select(F.col("c_custkey").alias("id"), F.explode(rows).alias("r")).select("id", "r.label", "r.value")


@query("live_records", """SELECT doc_id::VARCHAR AS id, source AS shown, doc_id % 3 = 0 AS is_reply, CASE WHEN doc_id % 2 = 0 THEN '77' WHEN doc_id % 3 = 0 THEN '99' ELSE doc_id::VARCHAR END AS conversation, doc_id % 2 <> 0 AS inferred, doc_id::BIGINT AS likes,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 12 END::BIGINT AS views, TIMESTAMP '2018-10-10 20:19:24' AS created_at, CASE WHEN doc_id % 4 = 0 THEN '55' WHEN doc_id % 4 = 1 THEN '66' END AS quote_id, doc_id % 6 = 0 AS liked, lang AS handle FROM documents WHERE source <> ''""")
def _(read):
    """Posts out of result nodes by ordered fallbacks."""
    k = F.col("doc_id")
    body = F.concat(
        F.when(k % 2 == 0, _json('{"rest_id":', _text("doc_id"))).otherwise(_json('{"rest_id":"","id_str":', _text("doc_id"))),
        _json(',"core":{"user_results":{"result":{"rest_id":"7","legacy":{"screen_name":', F.col("lang"), '}}}},"views":{"count":'), F.when(k % 5 == 0, '"-"').otherwise('"12"'),
        _json('},"legacy":{"full_text":', F.col("source"), ',"created_at":"Wed Oct 10 20:19:24 +0000 2018","favorite_count":', k, ',"favorited":', k % 6 == 0),
        F.when(k % 3 == 0, ',"in_reply_to_status_id_str":"99"').otherwise(""), F.when(k % 2 == 0, ',"conversation_id_str":"77"').otherwise(""), F.when(k % 4 == 0, ',"quoted_status_id_str":"55"').otherwise(""),
        F.lit("}"), F.when(k % 4 == 1, ',"attachment_url":"https://x.com/a/status/66?s=1"').otherwise(""), F.lit("}"),
    )
    found = nodes.live_posts(read("documents").where("source <> ''").select(body.alias("body")))
    return found.select(
        "id", F.col("text").alias("shown"), "is_reply", F.col("conversation_id").alias("conversation"), F.col("conversation_inferred").alias("inferred"), F.col("metrics.likes").alias("likes"), F.col("metrics.views").alias("views"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"), "quote_id", F.col("viewer_state.liked").alias("liked"), F.col("author.screen_name").alias("handle"),
    )


@query("archived_records", """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'shared ' || doc_id WHEN doc_id % 4 = 1 THEN 'long ' || doc_id ELSE source END AS shown, doc_id % 3 = 0 AS is_reply, CASE WHEN doc_id % 3 = 0 THEN 'you' END AS reply_to, doc_id % 4 = 0 AS is_retweet, lang AS author,
 CASE WHEN doc_id % 2 = 0 THEN 'last,v9' ELSE '' END AS media, CASE WHEN doc_id % 5 = 0 THEN '1,' || doc_id END AS edits, doc_id::BIGINT AS likes, TIMESTAMP '2020-01-02 03:04:05' AS created_at FROM documents WHERE source <> ''""")
def _(read):
    """Archived envelopes joined with what they include."""
    k, number = F.col("doc_id"), _text("doc_id")
    refs = F.array_join(F.array_compact(F.array(F.when(k % 3 == 0, '{"type":"replied_to","id":"4"}'), F.when(k % 4 == 0, '{"type":"retweeted","id":"8"}'))), ",")
    body = F.concat(
        _json('{"data":{"id":', number, ',"text":', F.col("source"), ',"author_id":"1","in_reply_to_user_id":"2","created_at":"2020-01-02T03:04:05.000Z","public_metrics":{"like_count":', k, '},"referenced_tweets":['), refs, F.lit("]"),
        F.when(k % 4 == 1, _json(',"note_tweet":{"text":', F.concat(F.lit("long "), number), "}")).otherwise(""), F.when(k % 2 == 0, ',"attachments":{"media_keys":["k1","gone","k2"]}').otherwise(""),
        F.when(k % 5 == 0, _json(',"edit_history_tweet_ids":["1",', number, "]")).when(k % 5 == 1, ',"edit_history_tweet_ids":["1","2"]').otherwise(""),
        _json('},"includes":{"users":[{"id":"1","username":', F.col("lang"), '},{"id":"1","username":"other"}'), F.when(k % 3 == 0, ',{"id":"2","username":"you"}').otherwise(""),
        _json('],"tweets":[{"id":"8","text":', F.concat(F.lit("shared "), number), '}],"media":[{"media_key":"k1","type":"photo","url":"first"},{"media_key":"k1","type":"photo","url":"last"},{"media_key":"k2","type":"video","variants":[{"url":"v1","bit_rate":1,"content_type":"video/mp4"},{"url":"v9","bit_rate":9,"content_type":"video/mp4"},{"url":"m","content_type":"application/x"}]}]}}'),
    )
    found = extract.archived_posts(read("documents").where("source <> ''").select(body.alias("body")))
    return found.select(
        "id", F.col("text").alias("shown"), "is_reply", F.col("reply_to_handle").alias("reply_to"), "is_retweet", F.col("author.screen_name").alias("author"), F.array_join(F.transform("media", lambda m: m["url"]), ",").alias("media"),
        F.array_join("edit_ids", ",").alias("edits"), F.col("metrics.likes").alias("likes"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query("archived_people", "SELECT c_custkey::VARCHAR AS user_id, c_name AS screen_name, c_mktsegment AS bio, c_custkey::BIGINT AS followers, c_custkey % 2 = 0 AS protected FROM customer WHERE c_custkey % 5 <> 0")
def _(read):
    """The included user whose handle is the requested one, whatever its case."""
    k = F.col("c_custkey")
    body = F.concat(
        _json('{"includes":{"users":[{"id":"0","username":"nobody"},{"id":', _text("c_custkey"), ',"username":', F.when(k % 5 == 0, "else").otherwise(F.col("c_name")), ',"description":', F.col("c_mktsegment"),
              ',"protected":', k % 2 == 0, ',"public_metrics":{"followers_count":', k, "}}]}}"),
    )
    found = extract.archived_profiles(read("customer").select(body.alias("body"), F.upper("c_name").alias("handle")))
    return found.select("user_id", "screen_name", "bio", "followers", "protected")


@query("roster_collected", "SELECT p.page_id, u.position::INTEGER AS position, (p.page_id * 10 + u.position)::VARCHAR AS user_id, 'u' || u.position AS screen_name FROM pages p, (SELECT unnest([0, 2]) AS position) u")
def _(read):
    """P20: users of a list's added entries; other instructions, items and users without an id go."""
    entry = lambda place, kind: _json('{"content":{"entryType":"TimelineTimelineItem","itemContent":{"itemType":', F.lit(kind), ',"user_results":{"result":{"rest_id":', place, ',"core":{"screen_name":')
    user = lambda i, kind="TimelineUser": F.concat(entry((F.col("page_id") * 10 + i).cast("string"), kind), F.lit(f'"u{i}"' + "}}}}}}"))
    bad = F.concat(entry(F.lit("none"), "TimelineUser"), F.lit('"u1"}}}}}}'))
    body = F.concat(F.lit('{"data":{"user":{"result":{"timeline":{"timeline":{"instructions":[{"type":"TimelineClearCache"},{"type":"TimelineAddEntries","entries":['), user(0), F.lit(","), bad, F.lit(","), user(9, "TimelineCursor"), F.lit(","), user(2), F.lit("]}]}}}}}}"))
    rows = read("pages").select("page_id", body.alias("body"))
    found = extract.roster_rows(rows)
    return found.select((F.floor(F.col("user_id").cast("bigint") / 10)).alias("page_id"), "position", "user_id", "screen_name")


@query("request_parts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'q' || doc_id END AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'UserTweets' END AS operation, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS asked FROM documents")
def _(read):
    """Query, operation and variables out of a request's address."""
    k, number = F.col("doc_id"), _text("doc_id")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://x.com/i/api/graphql/q"), number, F.lit("/UserTweets?variables=%7B%22userId%22%3A%22"), number, F.lit("%22%7D&features=1"))).otherwise("https://x.com/i/api/1.1/other.json")
    parts = extract.requests(read("documents").select("doc_id", url.alias("url")))
    return parts.select("doc_id", "query_id", "operation", F.get_json_object("variables", "$.userId").alias("asked"))


@query("collected_results", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS results, page_id::VARCHAR AS first FROM pages")
def _(read):
    """Result nodes anywhere in an answer, each id once, quoted ones left out."""
    k, number = F.col("page_id"), _text("page_id")
    one = _json('{"tweet_results":{"result":{"rest_id":', number, ',"quoted_status_result":{"tweet_results":{"result":{"rest_id":"q"}}}}}}')
    body = F.concat(F.lit('{"deep":[{"a":{"b":['), one, F.lit(","), one, F.when(k % 2 == 0, _json(',{"items":[{"tweet_results":{"result":{"rest_id":', F.concat(F.lit("1"), number), "}}}]}")).otherwise(""), F.lit("]}}]}"))
    found = extract.collect_results(read("pages").select(body.alias("body")), "body").select("position", F.get_json_object("body", "$.rest_id").alias("rest_id"))
    firsts = found.where("position = 0").select(F.col("rest_id").cast("bigint").alias("page_id"), F.col("rest_id").alias("first"))
    more = found.where("position = 1").select(F.substring("rest_id", 2, 20).cast("bigint").alias("page_id"), F.lit(1).alias("more"))
    return firsts.join(more, "page_id", "left").select("page_id", (1 + F.coalesce("more", F.lit(0))).cast("bigint").alias("results"), "first")


@query("visible_texts", r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'é' || chr(119070) || source WHEN 1 THEN 'long ' || doc_id WHEN 2 THEN substr('é' || chr(119070) || source, 1, 3) WHEN 3 THEN 'é' || chr(119070) || source || ' https://t.co/a' || doc_id ELSE 'é' || chr(119070) || source || ' https://t.co/a' || doc_id END AS shown FROM documents WHERE length(source) > 1""")
def _(read):
    """An archived post's text up to its display end, without a link to its own media at the end."""
    k, number = F.col("doc_id") % 5, _text("doc_id")
    link = F.concat(F.lit("https://t.co/a"), number)
    target = F.when(k == 3, F.concat(F.lit("https://x.com/a/status/9"), number, F.lit("/photo/1"))).when(k == 4, F.concat(F.lit("https://e.org/r?ref=x.com/status/"), number)).otherwise(F.concat(F.lit("https://x.com/a/status/"), number, F.lit("/photo/1")))
    data = F.concat(
        _json('{"text":', F.concat(F.lit("é\U0001d11e"), F.col("source"), F.lit(" "), link), ',"entities":{"urls":[{"url":', link, ',"expanded_url":', target, "}]}"),
        F.when(k == 1, _json(',"note_tweet":{"text":', F.concat(F.lit("long "), number), "}")).otherwise(""), F.when(k == 2, ',"display_text_range":[0,3]').otherwise(""), F.lit("}"),
    )
    return read("documents").where(F.length("source") > 1).select("doc_id", nodes.visible_text(data, F.array(number)).alias("shown"))


@query("archived_entities", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'u,v' ELSE 'v' END AS urls, 'Tag,' || source AS tags, lang AS mentions, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'who0-' || length(lang) || ',tag' || (length(lang) + 1) || '-' || (length(lang) + 4) END AS spans FROM documents WHERE lang <> '' AND lower(source) <> 'tag'""")
def _(read):
    """Entities each once, links to own media that the text does not show left out, spans that fit the text."""
    k, n = F.col("doc_id"), F.length("lang")
    measured = F.concat(F.col("lang"), F.lit(" Tag v"))
    body = F.when(k % 3 == 0, F.concat(F.lit("\U0001d11e\U0001d11e"), measured)).otherwise(measured)
    own = F.concat(F.lit("https://x.com/a/status/"), _text("doc_id"), F.lit("/photo/1"))
    raw = _json('{"urls":[{"url":"u","expanded_url":', F.when(k % 2 == 0, "https://x.com/a/status/1").otherwise(own), '},{"url":"v","expanded_url":', own, '},{"url":"v","expanded_url":', own,
                '},{"expanded_url":"z"}],"hashtags":[{"tag":"Tag","start":', n + 1, ',"end":', n + 4, '},{"tag":"tag","start":', n + 1, ',"end":', n + 4, '},{"tag":""},{"tag":', F.col("source"),
                ',"start":5,"end":5}],"mentions":[{"username":', F.col("lang"), ',"start":0,"end":', n, '},{"username":', F.upper("lang"), "}]}")
    found = read("documents").where("lang <> '' and lower(source) <> 'tag'").select("doc_id", nodes.archived_entities(raw, body, measured, F.array(_text("doc_id"))).alias("e"))
    return found.select(
        "doc_id", F.array_join(F.transform("e.urls", lambda u: u["url"]), ",").alias("urls"), F.array_join("e.hashtags", ",").alias("tags"), F.array_join("e.mentions", ",").alias("mentions"),
        F.array_join(F.transform("e.spans", lambda s: F.concat(s["kind"], s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("spans"),
    )
