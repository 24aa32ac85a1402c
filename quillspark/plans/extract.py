"""Nested API answers as flat records: first answers among ordered paths, built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.coerce import record_id


def first_of(body: Column, paths: Sequence[str]) -> Column:
    """The first path that gives a string that is not empty."""
    return first_answer(*[F.get_json_object(body, p) for p in paths])


def first_answer(*values: Column) -> Column:
    """The first string that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def count_at(body: Column, path: str) -> Column:
    return count_of(F.get_json_object(body, path))


def count_of(value: Column) -> Column:
    n = value.try_cast("bigint")
    return F.when(n >= 0, n)


#: Bindings of a card that are read.
BINDINGS = 256


def poll_of(card: Column) -> Column:
    """A poll out of a card's bindings (a list of key and value): up to four choices, end and finality; null if it is none."""
    values = F.get_json_object(card, "$.legacy.binding_values")
    kind = "struct<string_value:string,boolean_value:boolean>"
    listed = F.filter(F.from_json(values, f"array<struct<key:string,value:{kind}>>"), lambda b: b["key"].isNotNull())
    # An object of bindings serves as well; of a repeated key the last counts; at most BINDINGS are read.
    mapped = F.transform(F.map_entries(F.from_json(values, f"map<string,{kind}>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    read = F.slice(F.when(values.startswith("["), listed).otherwise(mapped), 1, BINDINGS)
    binding = lambda key: F.try_element_at(F.filter(read, lambda b: b["key"] == key), F.lit(-1))["value"]
    name = F.get_json_object(card, "$.legacy.name")
    parts = F.split(name, ":")
    # Once there is a colon, the second of exactly two parts tells, and the first does not.
    is_poll = F.when(F.contains(name, F.lit(":")), (F.size(parts) == 2) & F.get(parts, F.lit(1)).startswith("poll")).otherwise(name.startswith("poll"))
    choices = F.array_compact(F.array(*[binding(f"choice{i}_label")["string_value"] for i in range(1, 5)]))
    return F.when(is_poll, F.struct(
        name.alias("card_name"), choices.alias("choices"), binding("end_datetime_utc")["string_value"].alias("end_at"),
        binding("counts_are_final")["boolean_value"].alias("final"),
    ))


USERS = "array<struct<id:string,username:string,name:string,profile_image_url:string>>"
TWEETS = "array<struct<id:string,text:string,author_id:string>>"
FILES = "array<struct<media_key:string,type:string,url:string,width:int,height:int,alt_text:string,duration_ms:bigint,variants:array<struct<url:string,bit_rate:bigint,content_type:string>>>>"


def archived_posts(rows: DataFrame, body: str = "body") -> DataFrame:
    """Posts out of archived envelopes: data joined with what its includes hold, within the row.

    The first included user or post with an id counts; of media with one key, the last.
    """
    b = F.col(body)
    at = lambda path: F.get_json_object(b, path)
    users, tweets, files = (F.from_json(at(f"$.includes.{n}"), k) for n, k in (("users", USERS), ("tweets", TWEETS), ("media", FILES)))
    refs = F.from_json(at("$.data.referenced_tweets"), "array<struct<type:string,id:string>>")
    ref = lambda kind: F.get(F.filter(refs, lambda r: r["type"] == kind), F.lit(0))["id"]
    user = lambda key: F.get(F.filter(users, lambda u: u["id"] == key), F.lit(0))
    tweet = lambda key: F.get(F.filter(tweets, lambda t: t["id"] == key), F.lit(0))
    keys = F.from_json(at("$.data.attachments.media_keys"), "array<string>")

    def file(key: Column) -> Column:
        m = F.try_element_at(F.filter(files, lambda f: f["media_key"] == key), F.lit(-1))
        playable = F.filter(m["variants"], lambda v: v["content_type"] == "video/mp4")
        best = F.array_max(F.transform(playable, lambda v, i: F.struct(F.coalesce(v["bit_rate"], F.lit(0)).alias("rate"), (-i).alias("place"), v["url"].alias("url"))))
        return F.struct(key.alias("media_key"), m["type"].alias("type"), F.coalesce(best["url"], m["url"]).alias("url"), m["width"].alias("width"), m["height"].alias("height"), m["alt_text"].alias("alt_text"), m["duration_ms"].alias("duration_ms"))

    post, reply, shared = record_id(at("$.data.id")), ref("replied_to"), ref("retweeted")
    edits = F.coalesce(F.from_json(at("$.data.edit_history_tweet_ids"), "array<string>"), F.array().cast("array<string>"))
    chain = F.when((F.size(edits) > 0) & (F.try_element_at(edits, F.lit(-1)) == post), edits)
    author, answered = user(at("$.data.author_id")), user(at("$.data.in_reply_to_user_id"))
    media = F.filter(F.transform(F.coalesce(keys, F.array().cast("array<string>")), file), lambda m: m["type"].isNotNull())
    return rows.select(
        post.alias("id"), F.coalesce(tweet(shared)["text"], first_of(b, ["$.data.note_tweet.text", "$.data.text"])).alias("text"), at("$.data.lang").alias("lang"),
        F.try_to_timestamp(at("$.data.created_at")).alias("created_at"), reply.isNotNull().alias("is_reply"), reply.alias("reply_to_id"), answered["username"].alias("reply_to_handle"),
        shared.isNotNull().alias("is_retweet"), shared.alias("retweeted_id"), F.coalesce(at("$.data.conversation_id"), reply, post).alias("conversation_id"),
        ref("quoted").alias("quote_id"), tweet(ref("quoted"))["text"].alias("quoted_text"), chain.alias("edit_ids"),
        F.struct(at("$.data.author_id").alias("id"), author["username"].alias("screen_name"), author["name"].alias("name"), author["profile_image_url"].alias("avatar_url")).alias("author"),
        media.alias("media"), at("$.data.possibly_sensitive").try_cast("boolean").alias("sensitive"),
        F.struct(*[count_at(b, f"$.data.public_metrics.{n}").alias(a) for n, a in (("like_count", "likes"), ("retweet_count", "retweets"), ("reply_count", "replies"), ("quote_count", "quotes"), ("bookmark_count", "bookmarks"), ("impression_count", "views"))]).alias("metrics"),
    ).where("id is not null")


def archived_profiles(rows: DataFrame, body: str = "body") -> DataFrame:
    """The included user whose handle is the requested one, whatever its case."""
    kind = "array<struct<id:string,username:string,name:string,description:string,location:string,url:string,profile_image_url:string,protected:boolean,pinned_tweet_id:string,public_metrics:struct<followers_count:bigint,following_count:bigint,tweet_count:bigint,listed_count:bigint>>>"
    users = F.from_json(F.get_json_object(F.col(body), "$.includes.users"), kind)
    own = F.get(F.filter(users, lambda u: F.lower(u["username"]) == F.lower(F.col("handle"))), F.lit(0))
    return rows.select(own.alias("u")).where("u is not null").select(
        F.col("u.id").alias("user_id"), F.col("u.username").alias("screen_name"), F.col("u.name").alias("name"), F.col("u.description").alias("bio"), F.col("u.location").alias("location"),
        F.col("u.url").alias("website_url"), F.col("u.profile_image_url").alias("avatar_url"), F.col("u.protected").alias("protected"), F.col("u.pinned_tweet_id").alias("pinned_id"),
        F.col("u.public_metrics.followers_count").alias("followers"), F.col("u.public_metrics.following_count").alias("following"), F.col("u.public_metrics.tweet_count").alias("posts"), F.col("u.public_metrics.listed_count").alias("listed"),
    )


def roster_rows(rows: DataFrame, body: str = "body", most: int = 200) -> DataFrame:
    """(position, user_id, screen_name, name, bio) out of a follow list's entries."""
    kind = "array<struct<type:string,entries:array<struct<content:struct<entryType:string,itemContent:struct<itemType:string,user_results:struct<result:struct<rest_id:string,core:struct<screen_name:string,name:string>,legacy:struct<screen_name:string,name:string,description:string>>>>>>>>>"
    path = "$.data.user.result.timeline.timeline.instructions"
    entries = F.flatten(F.transform(F.filter(F.from_json(F.get_json_object(F.col(body), path), kind), lambda i: i["type"] == "TimelineAddEntries"), lambda i: i["entries"]))
    users = F.filter(F.transform(entries, lambda e: e["content"]["itemContent"]), lambda c: c["itemType"] == "TimelineUser")
    return rows.select(F.posexplode(F.slice(F.transform(users, lambda c: c["user_results"]["result"]), 1, most)).alias("position", "u")).select(
        "position", record_id(F.col("u.rest_id")).alias("user_id"), F.coalesce("u.core.screen_name", "u.legacy.screen_name").alias("screen_name"),
        F.coalesce("u.core.name", "u.legacy.name").alias("name"), F.col("u.legacy.description").alias("bio"),
    ).where("user_id is not null")


def requests(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows with query_id, operation and variables out of /graphql/<query>/<operation>?variables=…"""
    path = F.try_parse_url(F.col(url), F.lit("PATH"))
    return rows.withColumn("query_id", F.nullif(F.regexp_extract(path, "/graphql/([^/]+)/[^/]+$", 1), F.lit(""))).withColumn(
        "operation", F.nullif(F.regexp_extract(path, "/graphql/[^/]+/([^/]+)$", 1), F.lit(""))
    ).withColumn("variables", F.try_url_decode(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("variables"))))


#: Bounds of collect_results(): depth, nodes looked at and results taken.
DEPTH, NODES, RESULTS = 30, 200_000, 500


def results_within(body: str | None) -> list[str]:
    """Every tweet_results.result anywhere in an answer as JSON, once an id, in document order; quoted ones are left out."""
    import json

    try:
        stack = [(json.loads(body or "null"), 0)]
    except ValueError:
        return []
    out, ids, seen = [], set(), 0
    while stack and seen < NODES and len(out) < RESULTS:
        node, depth = stack.pop()
        seen += 1
        below = []
        if isinstance(node, dict):
            found = node.get("tweet_results")
            result = found.get("result") if isinstance(found, dict) else None
            if isinstance(result, dict) and result.get("rest_id") not in ids:
                ids.add(result.get("rest_id"))
                out.append(json.dumps(result, ensure_ascii=False))
            below = [v for k, v in node.items() if k != "quoted_status_result"]
        elif isinstance(node, list):
            below = node
        if depth < DEPTH:
            stack.extend((v, depth + 1) for v in reversed(below) if isinstance(v, (dict, list)))
    return out


def collect_results(rows: DataFrame, body: str = "body") -> DataFrame:
    """(position, body) of the result nodes in each timeline answer; depths are unknown, so an Arrow pass walks them."""
    import pyarrow as pa

    def each(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = results_within(text)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["position", "body"])

    return rows.select(F.col(body).alias("body")).mapInArrow(each, "position long, body string")
