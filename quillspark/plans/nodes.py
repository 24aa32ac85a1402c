"""Parts of nested answers that need more than a path: refused nodes, cut texts, users, profiles and links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.coerce import is_record_id, platform_timestamp, record_id, strictly_true
from quillspark.functions.urls import host, permalink_id
from quillspark.plans.extract import count_at, count_of, first_answer, first_of, poll_of

# Where an answer may hold its media, entities, long text and links, in the order in which they are tried.
MEDIA_PATHS = ("$.legacy.extended_entities.media", "$.legacy.entities.media", "$.extended_entities.media", "$.entities.media", "$.tweet.legacy.extended_entities.media")
NOTE = "note_tweet.note_tweet_results.result"
ENTITY_PATHS = ("$.legacy.entities", "$.entities", f"$.{NOTE}.entity_set", f"$.legacy.{NOTE}.entity_set", "$.note_tweet_results.result.entity_set", "$.tweet.legacy.entities")
LINK_PATHS = ("$.legacy.entities.urls", "$.entities.urls", f"$.{NOTE}.entity_set.urls", f"$.legacy.{NOTE}.entity_set.urls", "$.note_tweet_results.result.entity_set.urls")
#: Entries of a list that are read: media, variants, links, versions of a post, links and mentions of a bio.
MOST_MEDIA, MOST_VARIANTS, MOST_LINKS, MOST_VERSIONS, MOST_BIO = 64, 32, 64, 64, 8
#: Characters of a quoted post and of a bio.
MOST_QUOTED, MOST_BIO_CHARS = 25_000, 4_000

_ITEM = "struct<id_str:string,id:string,media_key:string,type:string,url:string,indices:array<double>,media_url_https:string,media_url:string,ext_alt_text:string," \
    "original_info:struct<width:double,height:double>,sizes:struct<large:struct<w:double,h:double>>," \
    "video_info:struct<duration_millis:double,aspect_ratio:array<double>,variants:array<struct<url:string,bitrate:double,content_type:string>>>>"
_LINK = "struct<url:string,expanded_url:string,display_url:string>"


def _some(value: Column) -> Column:
    """Text that is not empty."""
    return F.when(value != "", value)


def _is_object(body: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(body, path).startswith("{"), F.lit(False))


def _list(body: Column, path: str, item: str, most: int) -> Column:
    return F.slice(F.from_json(F.get_json_object(body, path), f"array<{item}>"), 1, most)


def is_refused(body: Column) -> Column:
    """Whether a node stands for a post that is not shown: by its type's name, a tombstone, or an error without an id."""
    named = F.coalesce(F.get_json_object(body, "$.__typename").rlike("(?i)tombstone|tweetunavailable"), F.lit(False))
    error = F.get_json_object(body, "$.rest_id").isNull() & _is_object(body, "$.legacy.error")
    return named | _is_object(body, "$.tombstone") | _is_object(body, "$.tweet_tombstone") | error


def media(body: Column) -> Column:
    """Media of the first path that has some: size from the original, else from the large form; null lists are empty."""
    lists = [F.from_json(F.get_json_object(body, p), f"array<{_ITEM}>") for p in MEDIA_PATHS]
    found = F.slice(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast(f"array<{_ITEM}>")), 1, MOST_MEDIA)

    def one(m: Column) -> Column:
        url = F.coalesce(_some(m["media_url_https"]), _some(m["media_url"]))
        variants = F.filter(F.slice(F.coalesce(m["video_info"]["variants"], F.array()), 1, MOST_VARIANTS), lambda v: F.coalesce(v["url"] != "", F.lit(False)))
        ratio = m["video_info"]["aspect_ratio"]
        return F.struct(
            F.coalesce(record_id(m["id_str"]), record_id(m["id"]), _some(m["media_key"])).alias("id"), _some(m["media_key"]).alias("media_key"), _some(m["type"]).alias("type"), url.alias("url"),
            F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("name=small")).alias("thumbnail_url"),
            F.coalesce(m["original_info"]["width"], m["sizes"]["large"]["w"]).alias("width"), F.coalesce(m["original_info"]["height"], m["sizes"]["large"]["h"]).alias("height"),
            _some(m["ext_alt_text"]).alias("alt_text"), m["video_info"]["duration_millis"].alias("duration_ms"),
            F.when((F.size(ratio) == 2) & F.forall(ratio, lambda x: x.isNotNull()), ratio).alias("aspect_ratio"), variants.alias("variants"),
        )

    return F.transform(F.filter(found, lambda m: m.isNotNull()), one)


def shown_text(body: Column) -> Column:
    """The long text if there is one; null if nothing is to be displayed; else the short text without its media's links.

    A link goes where an item's indices (in characters) point at its own url; blanks at the end go
    with it.
    """
    text = first_of(body, ["$.legacy.full_text", "$.full_text", "$.legacy.text"])
    lists = [_list(body, p, _ITEM, MOST_MEDIA) for p in MEDIA_PATHS]

    def ranges(items: Column) -> Column:
        sound = F.filter(items, lambda m: F.coalesce(
            (F.size(m["indices"]) == 2) & (m["indices"][0] >= 0) & (m["indices"][1] > m["indices"][0]) & (m["url"] != "")
            & F.forall(m["indices"], lambda x: x == F.floor(x))
            & F.startswith(F.substring(text, m["indices"][0].cast("int") + 1, (m["indices"][1] - m["indices"][0]).cast("int")), m["url"]), F.lit(False)))
        return F.transform(sound, lambda m: F.struct(m["indices"][0].cast("int").alias("start"), m["indices"][1].cast("int").alias("end")))

    cuts = F.coalesce(*[F.when(F.size(ranges(x)) > 0, ranges(x)) for x in lists], F.array().cast("array<struct<start:int,end:int>>"))
    ordered = F.reverse(F.array_sort(cuts))
    cut = F.aggregate(ordered, text, lambda acc, r: F.concat(F.substring(acc, F.lit(1), r["start"]), F.substring(acc, r["end"] + 1, F.length(acc))))
    short = F.when(F.size(cuts) > 0, F.regexp_replace(cut, r"\s+\z", "")).otherwise(text)
    none = F.coalesce(F.from_json(F.get_json_object(body, "$.legacy.display_text_range"), "array<double>") == F.array(F.lit(0.0), F.lit(0.0)), F.lit(False))
    return F.coalesce(first_of(body, [f"$.{NOTE}.text", f"$.legacy.{NOTE}.text", "$.note_tweet_results.result.text"]), F.when(~none, short))


def links(body: Column) -> Column:
    """Links of all paths one after another, the first of each url (or expanded url, without one)."""
    every = F.flatten(F.array(*[F.coalesce(_list(body, p, _LINK, MOST_LINKS), F.array().cast(f"array<{_LINK}>")) for p in LINK_PATHS]))
    some = F.transform(every, lambda u: F.struct(_some(u["url"]).alias("url"), _some(u["expanded_url"]).alias("expanded_url"), _some(u["display_url"]).alias("display_url")))
    known = F.filter(some, lambda u: F.coalesce(u["url"], u["expanded_url"]).isNotNull())
    keys = F.transform(known, lambda u: F.coalesce(u["url"], u["expanded_url"]))
    return F.slice(F.filter(known, lambda u, i: F.array_position(keys, F.coalesce(u["url"], u["expanded_url"])) == i + 1), 1, MOST_LINKS)


def entities(body: Column) -> Column:
    """(urls, hashtags, mentions) of the first path that is an object; empty answers go."""
    kind = f"struct<urls:array<{_LINK}>,hashtags:array<struct<text:string>>,user_mentions:array<struct<id_str:string,screen_name:string,name:string>>>"
    found = F.from_json(F.coalesce(*[F.when(_is_object(body, p), F.get_json_object(body, p)) for p in ENTITY_PATHS]), kind)
    urls = F.transform(F.slice(found["urls"], 1, MOST_LINKS), lambda u: F.struct(_some(u["url"]).alias("url"), _some(u["expanded_url"]).alias("expanded_url"), _some(u["display_url"]).alias("display_url")))
    tags = F.array_compact(F.transform(F.slice(found["hashtags"], 1, MOST_LINKS), lambda h: _some(h["text"])))
    people = F.transform(F.slice(found["user_mentions"], 1, MOST_LINKS), lambda m: F.struct(record_id(m["id_str"]).alias("id"), _some(m["screen_name"]).alias("screen_name"), _some(m["name"]).alias("name")))
    return F.struct(
        F.coalesce(F.filter(urls, lambda u: u["url"].isNotNull() | u["expanded_url"].isNotNull()), F.array()).alias("urls"), F.coalesce(tags, F.array()).alias("hashtags"),
        F.coalesce(F.filter(people, lambda m: m["screen_name"].isNotNull() | m["name"].isNotNull()), F.array()).alias("mentions"),
    )


def author(body: Column, at: str = "$") -> Column:
    user = f"{at}.core.user_results.result"
    return F.struct(
        record_id(F.get_json_object(body, f"{user}.rest_id")).alias("id"), first_of(body, [f"{user}.core.screen_name", f"{user}.legacy.screen_name"]).alias("screen_name"),
        first_of(body, [f"{user}.core.name", f"{user}.legacy.name"]).alias("name"),
    )


def quoted_post(body: Column) -> Column:
    """(id, text, created_at, author) of the quoted post: its short text, else the long one, cut; null without a sound id."""
    q = "$.quoted_status_result.result"
    post = F.coalesce(record_id(F.get_json_object(body, f"{q}.rest_id")), record_id(F.get_json_object(body, f"{q}.legacy.id_str")))
    text = F.coalesce(first_of(body, [f"{q}.legacy.full_text", f"{q}.legacy.text", f"{q}.{NOTE}.text"]), F.lit(""))
    created = F.get_json_object(body, f"{q}.legacy.created_at")
    return F.when(post.isNotNull(), F.struct(
        post.alias("id"), F.substring(text, 1, MOST_QUOTED).alias("text"), platform_timestamp(created).alias("created_at"), author(body, q).alias("author")
    ))


def posted_via(source: Column) -> Column:
    """(name, url) of the client out of an anchor: its text without tags, its target if that is http; plain text is a name."""
    anchor = r"(?is)<a[^>]*\shref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    inner = F.when(source.rlike(anchor), F.regexp_extract(source, anchor, 2)).otherwise(source)
    bare = lambda x: _some(F.regexp_replace(x, "<[^>]*>", ""))
    name, target = F.coalesce(bare(inner), bare(source)), F.regexp_extract(source, anchor, 1)
    url = F.when(target.rlike("(?i)^https?://"), target)
    return F.when((source != "") & (name.isNotNull() | url.isNotNull()), F.struct(name.alias("name"), url.alias("url")))


def edit_info(body: Column, previous: Column) -> Column:
    """(edited_from, is_edit, ids, initial_id, remaining): the chain of versions, and the one that a request names."""
    control = "$.edit_control.edit_control_initial"
    at = lambda leaf: F.when(_is_object(body, control), F.get_json_object(body, f"{control}.{leaf}")).otherwise(
        F.get_json_object(body, f"$.edit_control.edit.edit_control_initial.{leaf}"))
    ids = F.array_distinct(F.array_compact(F.transform(F.slice(F.from_json(at("edit_tweet_ids"), "array<string>"), 1, MOST_VERSIONS), record_id)))
    ids, before = F.coalesce(ids, F.array().cast("array<string>")), record_id(previous)
    return F.struct(
        before.alias("edited_from"), (before.isNotNull() | (F.size(ids) > 1)).alias("is_edit"), ids.alias("ids"),
        record_id(at("initial_tweet_id")).alias("initial_id"), at("edits_remaining").try_cast("double").alias("remaining"),
    )


def _bio_list(text: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _of_sound_nodes(rows: DataFrame, body: str, fields: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """The rows whose node has a sound id, with fields as columns; fields takes a function that gives what is at a path.

    Each path is read once, in a projection of its own, and one that no column in use needs is not read
    at all: reading a path parses the whole node.
    """
    read: dict[str, Column] = {}

    def at(path: str) -> Column:
        name = f"__at{path[1:].replace('.', '_')}"
        read[name] = F.get_json_object(F.col(body), path).alias(name)
        return F.col(name)

    sound, found = is_record_id(at("$.rest_id")), fields(at)
    others = [c for c in rows.columns if c != body]
    return rows.select(*others, *read.values()).where(sound).select(*others, *[value.alias(name) for name, value in found.items()])


def _user_fields(at: Callable[[str], Column], most_bio: int | None = None) -> dict[str, Column]:
    found = F.filter(_bio_list(at("$.profile_bio.entities.description.urls"), _LINK), lambda u: F.coalesce(_some(u["expanded_url"]), _some(u["url"])).isNotNull())
    urls = F.transform(F.slice(found, 1, MOST_BIO), lambda u: F.struct(
        F.coalesce(_some(u["url"]), u["expanded_url"]).alias("url"), F.coalesce(_some(u["expanded_url"]), u["url"]).alias("expanded_url"), _some(u["display_url"]).alias("display_url")))
    bio, number, true = at("$.profile_bio.description"), lambda path: count_of(at(path)), lambda path: F.coalesce(at(path) == "true", F.lit(False))
    handle = _some(at("$.core.screen_name"))
    return {
        "user_id": at("$.rest_id"), "screen_name": handle, "screen_name_lower": F.coalesce(F.lower(handle), F.lit("")), "name": _some(at("$.core.name")),
        "account_created_at": _some(at("$.core.created_at")), "bio": bio if most_bio is None else F.substring(bio, 1, most_bio), "bio_urls": urls,
        "location": at("$.location.location"), "website_url": first_answer(at("$.website.expanded_url"), at("$.website.url")), "lang": _some(at("$.profile_description_language")),
        "blue_verified": true("$.is_blue_verified"), "verified": true("$.verification.verified"), "followers": number("$.relationship_counts.followers"),
        "following": number("$.relationship_counts.following"), "posts": number("$.tweet_counts.tweets"), "avatar_url": _some(at("$.avatar.image_url")),
    }


def _profile_fields(at: Callable[[str], Column]) -> dict[str, Column]:
    mentions = _bio_list(at("$.profile_bio.entities.description.mentions"), "struct<screen_name:string,username:string>")
    named = F.transform(mentions, lambda m: F.coalesce(_some(m["screen_name"]), _some(m["username"])))
    pinned = F.get(F.from_json(at("$.pinned_items.tweet_ids_str"), "array<string>"), F.lit(0))
    return {
        "user": F.struct(*[value.alias(name) for name, value in _user_fields(at, MOST_BIO_CHARS).items()]), "banner_url": _some(at("$.banner.image_url")),
        "bio_mentions": F.slice(F.array_compact(named), 1, MOST_BIO), "protected": F.when(at("$.privacy.protected").isin("true", "false"), at("$.privacy.protected") == "true"),
        "pinned_id": record_id(pinned), "media_count": count_of(at("$.tweet_counts.media_tweets")), "like_count": count_of(at("$.action_counts.favorites_count")),
        "listed_count": F.lit(None).cast("bigint"),
    }


def users(rows: DataFrame, body: str = "body", most_bio: int | None = None) -> DataFrame:
    """Users' flat fields in place of their nodes; those without a sound id go. most_bio cuts the bio."""
    return _of_sound_nodes(rows, body, lambda at: _user_fields(at, most_bio))


def profiles(rows: DataFrame, body: str = "body") -> DataFrame:
    """A user's fields and what only a profile shows: banner, mentions of the bio, privacy, pinned post and more counts."""
    return _of_sound_nodes(rows, body, _profile_fields)


def badges(flags: Sequence[tuple[str, Column]]) -> Column:
    """The names of the flags that are true, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in flags]))


def detail_rows(fields: Sequence[tuple[str, Column]]) -> Column:
    """(label, value) of each field with an answer that is not empty, in order."""
    every = F.array(*[F.struct(F.lit(name).alias("label"), value.cast("string").alias("value")) for name, value in fields])
    return F.filter(every, lambda r: F.coalesce(r["value"] != "", F.lit(False)))


def shown_counts(fields: Sequence[tuple[str, Column]]) -> Column:
    """(label, value) of each count that is a number and not negative."""
    every = F.array(*[F.struct(F.lit(name).alias("label"), value.cast("double").alias("value")) for name, value in fields])
    return F.filter(every, lambda r: F.coalesce((r["value"] >= 0) & (r["value"] < float("inf")) & ~F.isnan(r["value"]), F.lit(False)))


# Hosts of a post's own address.
PERMALINK_HOSTS = ("x.com", "www.x.com", "mobile.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")


def own_media_link(expanded: Column, own_ids: Column) -> Column:
    """Whether an address is that of one of these posts, or of a picture or video of it."""
    parts = F.filter(F.split(F.try_parse_url(expanded, F.lit("PATH")), "/"), lambda p: p != "")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    tail = (n == 3) | ((n == 5) & at(3).isin("photo", "video") & at(4).rlike(r"\A[0-9]+\z"))
    sound = (F.try_parse_url(expanded, F.lit("PROTOCOL")) == "https") & host(expanded).isin(*PERMALINK_HOSTS)
    return F.coalesce(sound & (n >= 3) & (at(1) == "status") & F.array_contains(own_ids, at(2)) & tail, F.lit(False))


def visible_text(data: Column, own_ids: Column) -> Column:
    """An archived post's text as it is shown: the long one, else the short one up to its display end, without a link to its own media at the end."""
    text, end = F.coalesce(F.get_json_object(data, "$.text"), F.lit("")), F.get(F.from_json(F.get_json_object(data, "$.display_text_range"), "array<int>"), F.lit(1))
    cut = F.when((end > 0) & (end < F.length(text)), F.substring(text, F.lit(1), end)).otherwise(text)
    ends = r"(?U)\s*(https://t\.co/[A-Za-z0-9]+)\s*\z"
    entry = F.get(F.filter(_list(data, "$.entities.urls", _LINK, 10_000), lambda u: u["url"] == F.regexp_extract(cut, ends, 1)), F.lit(0))
    return F.coalesce(first_of(data, ["$.note_tweet.text"]), F.when(own_media_link(entry["expanded_url"], own_ids), F.regexp_replace(cut, ends, "")).otherwise(cut))


def _first_of_each(items: Column, key) -> Column:
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def archived_entities(raw: Column, body: Column, measured: Column, own_ids: Column) -> Column:
    """(urls, hashtags, mentions, spans) of an archived post's entities, each once; own media that the body does not show go.

    Spans (kind, start, end) are in characters of the text they were measured on, sorted by start; those
    that do not cut the same piece out of body go. Without a measured text there are none.
    """
    span = "start:int,end:int"
    kind = f"struct<urls:array<struct<url:string,expanded_url:string,display_url:string,{span}>>,hashtags:array<struct<tag:string,{span}>>,mentions:array<struct<username:string,{span}>>>"
    found = F.from_json(raw, kind)
    urls = F.filter(found["urls"], lambda u: u["url"].isNotNull() & ~(~F.contains(body, u["url"]) & own_media_link(u["expanded_url"], own_ids)))
    tags = F.filter(found["hashtags"], lambda h: F.coalesce(h["tag"] != "", F.lit(False)))
    people = F.filter(found["mentions"], lambda m: F.coalesce(m["username"] != "", F.lit(False)))
    placed = lambda items, name: F.coalesce(F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(name).alias("kind"))), F.array())
    every = F.array_distinct(F.concat(placed(urls, "url"), placed(tags, "tag"), placed(people, "who")))
    same = lambda s: F.substring(measured, s["start"] + 1, s["end"] - s["start"]) == F.substring(body, s["start"] + 1, s["end"] - s["start"])
    sound = F.filter(every, lambda s: F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["start"] < F.length(measured)) & same(s), F.lit(False)))
    links_ = F.transform(urls, lambda u: F.struct(u["url"].alias("url"), u["expanded_url"].alias("expanded_url"), u["display_url"].alias("display_url")))
    return F.struct(
        F.coalesce(F.array_distinct(links_), F.array()).alias("urls"), F.coalesce(F.transform(_first_of_each(tags, lambda h: F.lower(h["tag"])), lambda h: h["tag"]), F.array()).alias("hashtags"),
        F.coalesce(F.transform(_first_of_each(people, lambda m: F.lower(m["username"])), lambda m: m["username"]), F.array()).alias("mentions"),
        F.transform(F.array_sort(sound), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )


def live_posts(rows: DataFrame, body: str = "body", previous: Column | None = None) -> DataFrame:
    """Posts out of result nodes: one select of the parts above; refused nodes and those without a sound id go.

    previous is the version that the request of an edit names. Null and broken bodies give no post.
    """
    b, legacy = F.col(body), "$.legacy"
    at = lambda path: F.get_json_object(b, path)
    post, reply = record_id(first_of(b, ["$.rest_id", f"{legacy}.id_str", "$.id_str"])), record_id(at(f"{legacy}.in_reply_to_status_id_str"))
    shared = record_id(first_of(b, [f"{legacy}.retweeted_status_result.result.rest_id", f"{legacy}.retweeted_status_id_str"]))
    quoted = first_of(b, [f"{legacy}.quoted_status_id_str", "$.quoted_status_result.result.rest_id"])
    edit = edit_info(b, previous if previous is not None else F.lit(None).cast("string"))
    state = lambda leaf: strictly_true(at(f"{legacy}.{leaf}").try_cast("boolean"))
    user = "$.core.user_results.result"
    who = author(b)
    return rows.where(~is_refused(b)).select(
        post.alias("id"), F.coalesce(shown_text(b), F.lit("")).alias("text"), at(f"{legacy}.lang").alias("lang"),
        platform_timestamp(at(f"{legacy}.created_at")).alias("created_at"), at(f"{legacy}.created_at").alias("created_at_raw"),
        reply.isNotNull().alias("is_reply"), reply.alias("reply_to_id"), at(f"{legacy}.in_reply_to_screen_name").alias("reply_to_handle"),
        shared.isNotNull().alias("is_retweet"), shared.alias("retweeted_id"),
        F.coalesce(record_id(at(f"{legacy}.conversation_id_str")), reply, post).alias("conversation_id"), at(f"{legacy}.conversation_id_str").isNull().alias("conversation_inferred"),
        F.coalesce(record_id(quoted), permalink_id(first_of(b, ["$.attachment_url"]))).alias("quote_id"), quoted_post(b).alias("quoted"),
        edit["is_edit"].alias("is_edit"), edit["edited_from"].alias("edited_from"), edit["ids"].alias("edit_ids"), edit["initial_id"].alias("edit_initial_id"), edit["remaining"].alias("edits_remaining"),
        who.withField("avatar_url", first_of(b, [f"{user}.avatar.image_url", f"{user}.legacy.profile_image_url_https"])).alias("author"),
        F.struct(
            count_at(b, f"{legacy}.favorite_count").alias("likes"), count_at(b, f"{legacy}.retweet_count").alias("retweets"), count_at(b, f"{legacy}.reply_count").alias("replies"),
            count_at(b, f"{legacy}.quote_count").alias("quotes"), count_at(b, f"{legacy}.bookmark_count").alias("bookmarks"), count_at(b, "$.views.count").alias("views"),
        ).alias("metrics"),
        media(b).alias("media"), entities(b).alias("entities"), links(b).alias("links"), poll_of(at("$.card")).alias("poll"), posted_via(at("$.source")).alias("posted_via"),
        F.struct(state("favorited").alias("liked"), state("bookmarked").alias("bookmarked"), state("retweeted").alias("reposted")).alias("viewer_state"),
        at(f"{legacy}.possibly_sensitive").try_cast("boolean").alias("sensitive"),
    ).where("id is not null")
