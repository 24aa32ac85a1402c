"""Joins, groups and graph walks over posts, media and people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.timeline import numbered, placed_parts, running_sum
from quillspark.scratch import Tables, materialize, release


def media_files(wanted: DataFrame, files: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """wanted left-joined with the first file of each key."""
    first = files.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return wanted.join(first, list(keys), "left")


def media_name_key(name: Column) -> Column:
    """(post_id, media_id) out of media/<digits>_<id>.<ext>, cut at the first underscore; null if it is another name."""
    found = name.rlike(r"^media/[0-9]+_[^/]+$")
    return F.when(found, F.struct(
        F.regexp_extract(name, r"^media/([0-9]+)_", 1).alias("post_id"),
        F.regexp_replace(F.regexp_extract(name, r"^media/[0-9]+_(.+)$", 1), r"\.[^.]*$", "").alias("media_id"),
    ))


def missing(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of wanted without a partner."""
    return wanted.join(present.select(*keys), list(keys), "left_anti")


def account_key(profile_id: Column, handle: Column, source: Column) -> Column:
    """The account a file belongs to: by id, else by handle, else by itself."""
    return (
        F.when(F.coalesce(profile_id, F.lit("")) != "", F.concat(F.lit("id:"), profile_id))
        .when(F.coalesce(handle, F.lit("")) != "", F.concat(F.lit("name:"), F.lower(handle)))
        .otherwise(F.concat(F.lit("file:"), source.cast("string")))
    )


def account_groups(files: DataFrame, key: Column, fresh: str, order: str) -> DataFrame:
    """(account, files, newest): files by account and the freshest file of each, later ones winning ties."""
    return files.withColumn("account", key).groupBy("account").agg(
        F.count("*").alias("files"), F.max_by(order, F.struct(fresh, order)).alias("newest")
    )


def top_author(posts: DataFrame, author: str, order: Sequence[Column], most: int = 2000) -> DataFrame:
    """The author with most of the `most` newest posts; the one seen first wins ties."""
    head = posts.orderBy(*order).limit(most)
    ranked = head.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.groupBy(author).agg(F.count("*").alias("posts"), F.min("__rank").alias("first_rank")).orderBy(F.desc("posts"), "first_rank").limit(1)


def best_variant(variants: DataFrame, keys: Sequence[str], bitrate: str, order: str) -> DataFrame:
    """The variant of the highest bitrate, null counting as 0; the first wins ties."""
    rank = F.struct(F.coalesce(bitrate, F.lit(0)).alias("b"), (-F.col(order)).alias("o"))
    return variants.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in variants.columns if c not in keys]), rank).alias("v")).select(*keys, "v.*")


def spill_directories(files: DataFrame, partition: Sequence[str], order: Sequence[Column], budget: int) -> DataFrame:
    """spill, the directory number (from 0) of each file, `budget` files a directory."""
    placed = numbered(files.drop("spill"), partition, order, "__place")
    return placed.withColumn("spill", F.floor(F.col("__place") / budget)).drop("__place")


def greedy_shards(sizes: Column, budget: int) -> Column:
    """Shard numbers for sizes in order: a shard is closed when the next record would exceed the budget.

    An oversize record has a shard of its own. The state is sequential, so this folds an array.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("shard"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + size <= budget)
        shard = F.when(fits, acc["shard"]).otherwise(acc["shard"] + 1)
        return F.struct(
            F.when(fits, acc["used"] + size).otherwise(size).cast("bigint").alias("used"), shard.alias("shard"),
            F.concat(acc["out"], F.array(shard)).alias("out"),
        )

    return F.aggregate(sizes, zero, step)["out"]


def within_budget(files: DataFrame, groups: Sequence[str], order: Sequence[Column], size: str, budget: int, each: int) -> DataFrame:
    """files with taken: those over `each` are passed over, the first that breaks the budget ends its group.

    Since sizes are not negative, what is taken is what a running sum of the others keeps within the
    budget, so no group passes through one task. Null sizes are 0. A column named taken is replaced.
    """
    held = Tables()
    fits = F.coalesce(F.col(size), F.lit(0)) <= each
    sized = files.drop("taken").withColumn("__size", F.when(fits, F.coalesce(F.col(size), F.lit(0))).otherwise(0).cast("bigint"))
    placed = held.keep(placed_parts(sized, groups, order))
    used = held.keep(running_sum(placed, groups, "__size", "__used", held))
    held.close(used)
    return used.withColumn("taken", fits & (F.col("__used") + F.col("__size") <= budget)).drop("__size", "__used", "__at")


def ancestors(edges: DataFrame, starts: DataFrame, most: int = 20, order: str | None = None) -> DataFrame:
    """(start, ancestor, hops): parents of parents of each start, at most `most` hops, cycles cut.

    edges is (id, parent) and may have more columns; of rows with one id the last in the order
    column counts, without one that with the largest parent, so no id multiplies rows. starts is (start), each counted once. Each id has the
    list of its next ancestors, and a round appends to it the list of its last one, so lists
    double: five joins for 20 hops, each written to the shared folder. Rounds end when no list is
    full. Null ids and parents are no edges.
    """
    last = F.max("parent") if order is None else F.max_by("parent", F.struct(order, "parent"))
    edges = edges.where("id is not null").groupBy("id").agg(last.alias("parent")).where("parent is not null")
    chains, length = materialize(edges.select("id", F.array("parent").alias("chain"))), 1
    while length < most:
        more = min(length, most - length)
        rest = chains.select(F.col("id").alias("__at"), F.slice("chain", 1, more).alias("__rest"))
        longer = materialize(chains.join(rest, F.element_at("chain", -1) == F.col("__at"), "left").select(
            "id", F.when(F.col("__rest").isNull(), F.col("chain")).otherwise(F.concat("chain", "__rest")).alias("chain")
        ))
        release(chains)
        chains, length = longer, length + more
        if chains.where(F.size("chain") == length).isEmpty():
            break
    # In a cycle a list goes on with what it has: only the first of each counts, and the start not at all.
    own = F.array_except("chain", F.array("id"))
    return starts.select("start").distinct().join(chains, F.col("start") == F.col("id")).select("start", F.posexplode(own).alias("__n", "ancestor")).select(
        "start", "ancestor", (F.col("__n") + 1).alias("hops")
    )


def children_counts(posts: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key, replies) of each post that has some."""
    return posts.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.count("*").alias("replies"))


def missing_parents(posts: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Posts whose parent is not there."""
    there = posts.select(F.col(key).alias("__there")).distinct()
    return posts.where(F.col(parent).isNotNull()).join(there, F.col(parent) == F.col("__there"), "left_anti")


def edit_chains(posts: DataFrame, key: str = "id", previous: str = "edited_from", order: str | None = None) -> DataFrame:
    """(id, initial_id, version, versions, is_superseded) of each post: its chain of edits over stored rows.

    initial_id is where its chain of earlier posts ends, stored or not; version counts from 1 there,
    versions is the highest in all that begins at the same post. A post is superseded if a stored one names
    it as the one before. Of rows with one id the last in the order column counts, without one that
    with the greatest earlier id. Posts in a circle, or behind one, have no initial id and no
    version, and come with nulls. Null ids go.

    Pointers double: a round replaces each row's pointer by that of the post it points to, so a
    chain of n edits takes log n joins, each written to the shared folder. While a chain is open
    each round closes some row; a round that closes none leaves circles only.
    """
    last = F.max(previous) if order is None else F.max_by(previous, F.struct(order, previous))
    edges = materialize(posts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(last.alias("at")))
    # at: the farthest earlier post known; hops: how far it is; a pointer is open while its post has one itself.
    now = materialize(edges.select("id", F.coalesce("at", "id").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.col("at").isNotNull().alias("open")))
    left = None
    while True:
        count = now.where("open").count()
        if count == 0 or count == left:
            break
        left = count
        ahead = now.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.col("hops").alias("__hops"), F.col("open").alias("__open"))
        met = now.where("open").join(ahead, F.col("at") == F.col("__id"), "left").select(
            "id", F.coalesce("__at", "at").alias("at"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.coalesce("__open", F.lit(False)).alias("open")
        )
        further = materialize(met.unionByName(now.where("not open")))
        release(now)
        now = further
    named = edges.where("at is not null").select(F.col("at").alias("id")).distinct().withColumn("__named", F.lit(True))
    whole = now.where("not open").groupBy(F.col("at").alias("initial_id")).agg((F.max("hops") + 1).alias("versions"))
    own = now.select("id", F.when(~F.col("open"), F.col("at")).alias("initial_id"), F.when(~F.col("open"), F.col("hops") + 1).alias("version"))
    out = own.join(whole, "initial_id", "left").join(named, "id", "left").select(
        "id", "initial_id", "version", "versions", F.coalesce("__named", F.lit(False)).alias("is_superseded")
    )
    done = materialize(out)
    release(edges, now)
    return done


def indexed_media(wanted: DataFrame, entries: DataFrame, files: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(wanted with the file of the first entry of each key whose file is there, (entries, used, skipped) in one row).

    entries is (keys..., name, ...), files (name); entries of files that are not there are skipped
    before the first of a key is taken. used counts entries whose file is there. Names without case
    folding; null names are no files.
    """
    there = files.select(F.col(name).alias("__there")).where("__there is not null").distinct()
    met = entries.join(there, F.col(name) == F.col("__there"), "left")
    found = met.where("__there is not null").drop("__there")
    counts = met.agg(F.count("*").alias("entries"), F.count("__there").alias("used")).withColumn("skipped", F.col("entries") - F.col("used"))
    return media_files(wanted, found, keys, order), counts
