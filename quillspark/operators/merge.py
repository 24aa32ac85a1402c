"""Keyed merges of captures, people, deletions and links.

All take a stored table and fresh rows with at most one row a key (dedupe first with newest()), and
return the stored table as it is afterwards. Both sides are shuffled by key once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.absence import is_absent, merge_structs, sticky
from quillspark.operators.timeline import running_max


def _sides(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(old, new): a full join of whole rows, either of which may be null."""
    old = stored.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.struct(*stored.columns).alias("old"))
    new = fresh.select(*[F.col(k).alias(f"__n_{k}") for k in keys], F.struct(*stored.columns).alias("new"))
    on = None
    for k in keys:
        test = F.col(f"__o_{k}") == F.col(f"__n_{k}")
        on = test if on is None else on & test
    return old.join(new, on, "full").select("old", "new")


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """Merge fresh rows: each field takes the fresh answer or keeps the stored one; keep never changes once known.

    rules gives fields of rows that both sides have by expressions over the structs old and new.
    """
    kind = stored.schema
    kept = {c: sticky(F.col(f"old.{c}"), F.col(f"new.{c}"), kind[c].dataType) for c in keep}
    merged = merge_structs(F.col("old"), F.col("new"), kind, kept | (rules or {}))
    return _sides(stored, fresh, keys).select(
        F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new")).otherwise(merged).alias("r")
    ).select("r.*")


def upsert_posts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Posts by id: a field merge, then what follows from it.

    captured_at keeps the stored time, first_captured_at falls back to it, updated_at takes the fresh
    capture's; an inferred conversation never replaces a known one. is_reply and is_poll follow the
    merged reply_to_id and poll (its is_poll, if it has one) alone; is_edit and is_retweet turn true
    where edited_from and retweeted_id are there and never turn back. Rows that only one side has
    stay as they are. Only columns that exist are touched. All of it is worked out from the two rows
    of one join.
    """
    has, kind = set(stored.columns), stored.schema
    old, new = F.col("old"), F.col("new")
    rules: dict[str, Column] = {}
    if {"first_captured_at", "captured_at"} <= has:
        rules["first_captured_at"] = F.coalesce("old.first_captured_at", "old.captured_at", "new.captured_at")
    if "captured_at" in has:
        rules["captured_at"] = sticky(old["captured_at"], new["captured_at"], kind["captured_at"].dataType)
    if {"updated_at", "captured_at"} <= has:
        rules["updated_at"] = F.coalesce("new.captured_at", "new.updated_at", "old.updated_at")
    if {"conversation_id", "conversation_inferred"} <= has:
        known = ~F.coalesce("old.conversation_inferred", F.lit(False)) & F.col("old.conversation_id").isNotNull() & F.coalesce("new.conversation_inferred", F.lit(False))
        taken = lambda c: F.when(is_absent(new[c], kind[c].dataType), old[c]).otherwise(new[c])
        rules["conversation_id"] = F.when(known, old["conversation_id"]).otherwise(taken("conversation_id"))
        rules["conversation_inferred"] = F.when(known, False).otherwise(taken("conversation_inferred"))
    merged = merge_structs(old, new, kind, rules)
    there = lambda field: ~is_absent(F.col(f"r.{field}"), kind[field].dataType)
    flags: dict[str, Column] = {}
    if {"is_reply", "reply_to_id"} <= has:
        flags["is_reply"] = there("reply_to_id")
    if {"is_poll", "poll"} <= has:
        of = kind["poll"].dataType
        own = F.coalesce(F.col("r.poll.is_poll"), F.lit(False)) if isinstance(of, T.StructType) and "is_poll" in of.names else there("poll")
        flags["is_poll"] = there("poll") & own
    for flag, field in (("is_retweet", "retweeted_id"), ("is_edit", "edited_from")):
        if {flag, field} <= has:
            flags[flag] = F.coalesce(F.col(f"r.{flag}"), F.lit(False)) | there(field)
    both = old.isNotNull() & new.isNotNull()
    met = _sides(stored, fresh, ["id"]).select("old", "new", F.when(both, merged).otherwise(F.coalesce(old, new)).alias("r"))
    # What a row was before it was merged with nothing stays as it came.
    return met.select(*[F.when(both, flags[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in flags else F.col(f"r.{c}") for c in stored.columns])


def insert_if_absent(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add fresh rows whose key is not stored; stored rows never change."""
    return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def fill_gaps(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set columns of stored rows where they are absent; rows are never added."""
    news = fresh.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = stored.join(news, list(keys), "left")
    for c in columns:
        out = out.withColumn(c, F.when(is_absent(F.col(c), stored.schema[c].dataType), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)))
    return out.select(*stored.columns)


def merge_people(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], first: str, last: str, owners: str | None = None, most: int = 20) -> DataFrame:
    """People by key: fresh answers win, 0 and false too; absent ones erase nothing.

    `first` keeps the stored time, `last` takes the fresh one, `owners` is the union with stored
    owners first, `most` at most.
    """
    kind = stored.schema
    old, new = F.col("old"), F.col("new")
    fields = {f.name: sticky(new[f.name], old[f.name], f.dataType) for f in kind.fields}
    fields[first] = F.coalesce(old[first], new[first])
    fields[last] = new[last]
    if owners:
        empty = F.array().cast(kind[owners].dataType)
        fields[owners] = F.slice(F.array_union(F.coalesce(old[owners], empty), F.coalesce(new[owners], empty)), 1, most)
    merged = F.struct(*[fields[f.name].alias(f.name) for f in kind.fields])
    return _sides(stored, fresh, keys).select(F.when(new.isNull(), old).when(old.isNull(), new).otherwise(merged).alias("r")).select("r.*")


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in an order; Spark limits each task to that row before the shuffle."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def newest_answers(rows: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Each column's newest answer by itself: max_by over rows that have one.

    ties order rows of equal times, the greatest last; among rows that are equal in these too the
    greatest value counts, so reruns agree. Equals folding copies pairwise where there are at most two or times are monotone in scan order.
    """
    kind = rows.schema
    last = lambda c: F.struct(time, *ties, *([c] if _ordered(kind[c].dataType) else []))
    return rows.groupBy(*keys).agg(*[
        F.max_by(F.when(~is_absent(F.col(c), kind[c].dataType), F.col(c)), F.when(~is_absent(F.col(c), kind[c].dataType), last(c))).alias(c)
        for c in columns
    ], F.max(time).alias(time))


def _ordered(kind: T.DataType) -> bool:
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


def fold_copies(rows: DataFrame, keys: Sequence[str], scan: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Copies of a record folded pairwise in scan order, the copy with the smaller time being the older.

    The result carries the larger time, so the outcome depends on the order, as it does for files
    that are read one after another. No copies of a key are collected: a copy whose time is not less
    than all before it replaces answers, any other fills gaps only. So a field's outcome is the last
    answer of the former copies or else the first answer of all, which are aggregates with partial
    sums once the running maximum of times is known. Null times count as not less.
    """
    kind = rows.schema
    marked = running_max(rows.select(*dict.fromkeys([*keys, *scan, time, *columns])), keys, [F.col(c).asc() for c in scan], time, "__before")
    leads = ~F.coalesce(F.col(time) < F.col("__before"), F.lit(False))
    place = F.struct(*scan)

    def folded(value: Column, of: T.DataType) -> Column:
        if isinstance(of, T.StructType):
            fields = F.struct(*[folded(value[f.name], f.dataType).alias(f.name) for f in of.fields])
            return F.when(F.count(value) > 0, fields)
        answer = ~is_absent(value, of)
        return F.coalesce(
            F.max_by(F.when(answer & leads, value), F.when(answer & leads, place)), F.min_by(F.when(answer, value), F.when(answer, place)), F.any_value(value, F.lit(True))
        )

    return marked.groupBy(*keys).agg(F.max(time).alias(time), *[folded(F.col(c), kind[c].dataType).alias(c) for c in columns if c != time])


def mark_superseded(posts: DataFrame, at: str = "updated_at", stamp: bool = True) -> DataFrame:
    """superseded_by on the posts that another post's edited_from names, the newest edit winning.

    Marks that are stored stay where no edit is at hand; a post that is marked anew takes the edit's
    time as its own, unless stamp is off.
    """
    edits = posts.where(F.col("edited_from").isNotNull()).groupBy(F.col("edited_from").alias("__of")).agg(
        F.max_by("id", F.struct(at, "id")).alias("__by"), F.max(at).alias("__when")
    )
    stored = F.col("superseded_by") if "superseded_by" in posts.columns else F.lit(None)
    out = posts.join(edits, F.col("id") == F.col("__of"), "left").withColumn("superseded_by", F.coalesce("__by", stored))
    return (out.withColumn(at, F.coalesce("__when", at)) if stamp else out).drop("__of", "__by", "__when")


def mark_deleted(posts: DataFrame, deletions: DataFrame) -> DataFrame:
    """deleted_at on posts, of the type that it has there, else in deletions; the first deletion known stays and no row is removed."""
    first = first_deletions(deletions).select(F.col("id").alias("__gone"), F.col("deleted_at").alias("__at"))
    stored = F.col("deleted_at") if "deleted_at" in posts.columns else F.lit(None).cast(deletions.schema["deleted_at"].dataType)
    return posts.join(first, F.col("id") == F.col("__gone"), "left").withColumn("deleted_at", F.coalesce(stored, F.col("__at"))).drop("__gone", "__at")


def first_deletions(deletions: DataFrame, arrival: str | None = None) -> DataFrame:
    """(id, deleted_at): the deletion of each id that arrived first, by a column that tells; without one, the earliest. Empty times are no answers."""
    known = deletions.where(~is_absent(F.col("deleted_at"), deletions.schema["deleted_at"].dataType))
    first = F.min("deleted_at") if arrival is None else F.min_by("deleted_at", F.struct(arrival, "deleted_at"))
    return known.groupBy("id").agg(first.alias("deleted_at"))


#: What an archived copy's source is said to be where a null one is filled in.
_SOURCE = {"captured_via": "fetch", "text_from_request": False, "backfilled": False, "tombstone": False}


def protected(stored: DataFrame, fresh: DataFrame, mode: str = "parity") -> DataFrame:
    """Merge archived copies of posts under stored ones: their metrics and source are no answers.

    In mode intended a copy has no source, so the stored one stays. In mode parity the missing
    source is filled in by defaults before the merge, as the archive does it, and these then replace
    the stored answers. All else follows upsert_posts().
    """
    if mode not in ("parity", "intended"):
        raise ValueError(f"mode {mode} is neither parity nor intended")
    copy, kind = fresh, stored.schema
    if "metrics" in kind.names:
        copy = copy.withColumn("metrics", F.lit(None).cast(kind["metrics"].dataType))
    if "source" in kind.names:
        of = kind["source"].dataType
        filled = F.struct(*[F.lit(_SOURCE.get(f.name)).cast(f.dataType).alias(f.name) for f in of.fields])
        copy = copy.withColumn("source", filled if mode == "parity" else F.lit(None).cast(of))
    return upsert_posts(stored, copy.select(*stored.columns))


def merge_archives(copies: DataFrame, deletions: DataFrame, scan: Sequence[str], columns: Sequence[str], mode: str = "reader") -> DataFrame:
    """(id, captured_at, columns..., deleted_at, superseded_by) of copies(id, captured_at, edited_from, ...) of several archives.

    Mode reader folds copies in scan order, the larger time staying, and leaves deletions and
    supersession as the copies carry them. Mode documented takes each field's newest answer, keeps
    the earliest capture, applies all deletions(id, deleted_at) and works superseded_by out again.
    """
    if mode not in ("reader", "documented"):
        raise ValueError(f"mode {mode} is neither reader nor documented")
    carried = [c for c in ("deleted_at", "superseded_by") if c in copies.columns]
    if mode == "reader":
        return fold_copies(copies, ["id"], scan, "captured_at", [*columns, *carried])
    newest_ = newest_answers(copies, ["id"], "captured_at", [*columns, *carried], ties=scan)
    first = copies.groupBy("id").agg(F.min("captured_at").alias("__first"))
    merged = newest_.join(first, "id").withColumn("captured_at", F.col("__first")).drop("__first")
    return mark_deleted(mark_superseded(merged.drop("superseded_by"), "captured_at", stamp=False), deletions)


def delete_cascade(posts: DataFrame, media: DataFrame, deletions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts, media and deletions without the ids of `gone`."""
    ids = gone.select("id").distinct()
    return (
        posts.join(ids, "id", "left_anti"),
        media.join(ids.withColumnRenamed("id", "post_id"), "post_id", "left_anti"),
        deletions.join(ids, "id", "left_anti"),
    )


def purge(posts: DataFrame, category: str) -> DataFrame:
    """Posts without those of a category: superseded or deleted; another name removes nothing."""
    column = {"superseded": "superseded_by", "deleted": "deleted_at"}.get(category)
    return posts if column is None else posts.where(is_absent(F.col(column), posts.schema[column].dataType))


def fold_archives(copies: DataFrame, key: str, scan: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """(key, place..., time, columns...): copies of several archives, each post once at its first place.

    Copies of a key are folded as fold_copies() has it; place is scan's columns of the first. Rows
    without a key, null or empty, cannot be matched and stay as they are, each by itself.
    """
    known = ~is_absent(F.col(key), copies.schema[key].dataType)
    narrow = list(dict.fromkeys([key, *scan, time, *columns]))
    kept = copies.where(~F.coalesce(known, F.lit(False))).select(*narrow)
    rest = copies.where(known).select(*narrow)
    folded = fold_copies(rest, [key], scan, time, columns)
    first = rest.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*scan)).alias("__first"))
    met = folded.join(first, F.col(key) == F.col("__key")).select(key, *[F.col(f"__first.{s}").alias(s) for s in scan if s not in columns and s != time and s != key], *[c for c in (time, *columns) if c != key])
    return met.unionByName(kept.select(*met.columns))


def record_deletions(stored: DataFrame, fresh: DataFrame, arrival: str | None = None) -> DataFrame:
    """Deletions (id, deleted_at, ...) after fresh ones came: an id whose stored time is an answer stays, any other is replaced.

    Of several fresh ones of an id the first counts, as first_deletions() has it. Other columns of
    stored that fresh rows cannot tell are null in new rows.
    """
    kind = stored.schema["deleted_at"].dataType
    answered = stored.where(~is_absent(F.col("deleted_at"), kind))
    first = first_deletions(fresh, arrival).where("id is not null")
    new = first.join(answered.select("id"), "id", "left_anti")
    silent = stored.where(is_absent(F.col("deleted_at"), kind)).join(new.select("id"), "id", "left_anti")
    return answered.unionByName(silent).unionByName(new, allowMissingColumns=True)


def put(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], skip_known: bool = False) -> DataFrame:
    """Rows by key after fresh ones (one a key) came: a whole row replaces the stored one, or is skipped if its key is known."""
    if skip_known:
        return insert_if_absent(stored, fresh, keys)
    return stored.join(fresh.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def fill_links(stored: DataFrame, fresh: DataFrame, entities: str = "entities") -> DataFrame:
    """stored(id, entities as JSON text, ...) with filled: links of fresh(id, urls as a JSON array) set where there are none.

    Only a container that is an object, null or absent is filled, and only if its urls are no array
    with elements. Tags and mentions that are missing become empty lists; those that are there stay,
    whatever they are. An empty or unsound list of fresh links fills nothing. Rows are never added;
    text that is not filled stays as it is, filled containers come with sorted keys. Of several fresh
    rows of an id the one with the greatest text counts. A container that is no JSON is malformed and stays.
    """
    news = fresh.groupBy(F.col("id").alias("__id")).agg(F.max("urls").alias("__urls"))
    whole, urls = F.try_parse_json(F.col(entities)), F.try_parse_json("__urls")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    holds = lambda v: kind(v).startswith("ARRAY") & (F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
    gap = F.col(entities).isNull() | (kind(whole) == "VOID") | (kind(whole).startswith("OBJECT") & ~holds(F.try_variant_get(whole, "$.urls", "variant")))
    fills = F.coalesce(gap & holds(urls), F.lit(False))
    none = F.expr("map_from_arrays(array('hashtags', 'mentions'), array(parse_json('[]'), parse_json('[]')))")
    fields = F.coalesce(F.try_variant_get(whole, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    missing_ = F.map_filter(none, lambda k, v: ~F.map_contains_key(fields, k))
    filled = F.map_concat(F.map_filter(fields, lambda k, v: k != "urls"), missing_, F.create_map(F.lit("urls"), urls))
    pairs = F.transform(F.array_sort(F.map_keys(filled)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.element_at(filled, k))))
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    met = stored.join(news, F.col("id") == F.col("__id"), "left").withColumn("filled", fills)
    return met.withColumn(entities, F.when(F.col("filled"), text).otherwise(F.col(entities))).select(*stored.columns, "filled")
