"""Exact n-gram Jaccard self join by adaptive multi-match prefixes.

A document is its set of word shingles in some order. Two sets that reach the threshold share at
least l tokens within their l-prefixes (the first n - t + l tokens, t the least overlap for size n),
for every l. So a document may pass over its l - m most frequent prefix tokens if it then asks for
m matches among the rest. Each document picks (l, m) by the estimated cost of its candidates: the
lengths of the token lists it still has to read, and the verifications they bound.

1. One pass over the texts hashes shingles; documents with equal sets are one node from here on.
2. Tokens of hash-ordered prefixes are counted; those that one node alone holds go. Nodes whose
   cheapest plan reads lists of at most SHORT nodes are joined through them, m matches a pair.
3. The other nodes are joined among themselves (a pair with one of the former is found from that
   one's side). All their tokens are counted: what no other holds cannot be shared, which bounds
   every overlap of a node and drops the nodes that can link with none. The rest order their
   tokens by these counts, rarest first, so a prefix holds frequent tokens only if most of the set
   is frequent, and plan again, with l up to LONGEST_COUNTED. Lists of at most MIDDLE nodes are
   joined as before, m matches a pair.
4. What still reads longer lists are mostly large groups of near copies. Those nodes are linked to
   one leader a list, the most typical node. Links are verified on the full sets and give
   components. Lists in which several components are left are led again. What is left after that
   is compared across components in blocks: the smaller component's nodes with the larger one's,
   of a list, of sizes and bounds that admit a link, and bitmaps that bound their overlaps; a task
   holds two blocks and returns the few pairs that can link, which are verified. That is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables, connected_components, materialize, shingles, sliced, small, word_hashes

#: Words of a shingle; the least similarity, as a fraction.
SIZE, THRESHOLD = 5, (4, 5)
#: Tokens by which a prefix is lengthened, at most: in the order of hashes, and in that of counts.
LONGEST, LONGEST_COUNTED = 16, 64
#: Beyond that, a text's share of tokens that its prefix may be lengthened by: one in so many.
LENGTHEN = 32
#: Nodes of a list that is joined directly, at most: in the order of hashes, and in that of counts.
SHORT, MIDDLE = 8, 32
#: Cost of a verification against reading a list entry.
VERIFY = 8
#: Nodes of a block on either side where lists are compared across components; bits of a bitmap, as a power of 2.
LEFT, RIGHT, WIDEST = 256, 512, 16
_BYTES = 5


def _least(n, threshold):
    """The least overlap of a set of n tokens with any set it links with."""
    return (threshold[0] * n + threshold[1] - 1) // threshold[1]


def _longest(n: int, most: int, threshold) -> int:
    """The largest l of a set of n tokens."""
    return min(max(most, n // LENGTHEN), _least(n, threshold))


def _prefix_col(n: Column, threshold) -> Column:
    return (n - F.floor((n * threshold[0] + (threshold[1] - 1)) / threshold[1]) + 1).cast("int")


def _fits(a: Column, b: Column, threshold) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * threshold[1] >= F.greatest(a, b) * threshold[0]


def _signatures(docs: DataFrame, size: int, threshold) -> DataFrame:
    """(key, doc_id, n, node, tokens): node is a hash of the set, null if empty; tokens its longest prefix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, node, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(word_hashes(text), size)
                n.append(len(s))
                if not len(s):
                    node.append(None)
                    tokens.append(None)
                    continue
                node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                t = _least(len(s), threshold)
                tokens.append(s[:len(s) - t + _longest(len(s), LONGEST, threshold)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["key", "doc_id", "n", "node", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(
        each, f"key long, doc_id {kind}, n long, node long, tokens array<long>"
    )


def choose(n: int, pos: np.ndarray, df: np.ndarray, threshold, longest: int) -> tuple[int, int, np.ndarray]:
    """(l, m, places in pos and df of the tokens to read), the cheapest plan of a set of n tokens.

    pos are the places of its shared tokens in its order, from 1; df are the lengths of their lists.
    """
    t = _least(n, threshold)
    prefix, best = n - t + 1, None
    by_df = np.argsort(df, kind="stable")
    pos_by, df_by = pos[by_df], df[by_df]
    for l in range(1, _longest(n, longest, threshold) + 1):
        inside = pos_by <= prefix + l - 1
        if best is not None and not best[0]:
            break
        lists = np.concatenate(([0], np.cumsum(df_by[inside] - 1)))
        for m in sorted({1, min(l, 2), min(l, 4), l}):
            kept = max(0, len(lists) - 1 - (l - m))
            cost = float(lists[kept]) * (1 + VERIFY / m)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, l, m, by_df[inside][:kept])
    return best[1:]


def _plans(threshold, longest: int, longest_list: int):
    """For nodes with rows of (pos, df, token): the tokens each reads, with its l and m.

    A node whose plan reads a list of more than longest_list nodes has l negative. Its lists are
    led and compared in blocks, which meets every pair that shares one of them: of m shared tokens
    one at least is not among the m - 1 longest lists, so these are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [[np.zeros(0, dtype=np.int64)] for _ in range(6)]
            for node, n, rows in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("rows"), strict=True):
                rows = rows.values
                pos, df, token = (rows.field(i).to_numpy() for i in range(3))
                l, m, read = choose(n, pos, df, threshold, longest)
                if len(read) and df[read].max() > longest_list:
                    l, read = -l, read[:len(read) - m + 1]
                for column, values in zip(out, (token[read], df[read]), strict=False):
                    column.append(values)
                for column, value in zip(out[2:], (node, n, l, m), strict=True):
                    column.append(np.full(len(read), value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["token", "df", "node", "n", "l", "m"]
            )

    return each


_PLAN = "token long, df long, node long, n long, l long, m long"


def _matched(plans: DataFrame, listed: DataFrame, longest_list: int, threshold) -> DataFrame:
    """Pairs (a, b) of nodes that share m tokens of a's plan within b's l-prefix, over lists of bounded length."""
    other = listed.where(F.col("df") <= longest_list).select("token", F.col("node").alias("b"), F.col("n").alias("nb"), "pos")
    return (
        plans.where("l > 0").select("token", F.col("node").alias("a"), F.col("n").alias("na"), "l", "m").join(other, "token")
        .where((F.col("a") != F.col("b")) & (F.col("pos") <= _prefix_col(F.col("nb"), threshold) + F.col("l") - 1) & _fits(F.col("na"), F.col("nb"), threshold))
        .groupBy("a", "b", "m").agg(F.count("*").alias("matches")).where("matches >= m").select("a", "b")
    )


def _verified(pairs: DataFrame, sets: DataFrame, threshold) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = _unpack(x.as_buffer()), _unpack(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * threshold[1] >= (len(x) + len(y) - both) * threshold[0])
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(sets.select(F.col("node").alias("src"), F.col("set").alias("x")), "src")
        .join(sets.select(F.col("node").alias("dst"), F.col("set").alias("y")), "dst")
        .select("src", "dst", "x", "y").mapInArrow(each, "src long, dst long")
    )


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set) for nodes(node, key, times): each set's hashes, of which _BYTES bytes suffice for two sets.

    times is how many rows have the key; only rows that are repeated are made distinct.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(word_hashes(text), size)
                out.append(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "set"])

    met = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(small(nodes), "key").select("node", "text", "times")
    texts = met.where("times = 1").select("node", "text")
    if not nodes.where("times > 1").isEmpty():
        texts = texts.union(met.where("times > 1").dropDuplicates(["node"]).select("node", "text"))
    return texts.mapInArrow(each, "node long, set binary")


def _counted(sets: DataFrame, nodes: DataFrame, threshold, held: Tables) -> tuple[DataFrame, DataFrame]:
    """What nodes(node, n) share: (token, node, n, pos, df, shared) of prefixes in the order of counts, and (node, n, rows) to plan by.

    shared counts a node's tokens that another node holds too; tokens of one node come first, then
    the others by their counts. Nodes whose shared tokens are fewer than their least overlap can
    link with none: they go, and the rest are counted again, once.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            raw = [_unpack(x.as_buffer()) for x in part.column("set")]
            n = [len(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(raw).view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), n))], names=["token", "node"]
            )

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [[np.zeros(0, dtype=np.int64)] for _ in range(6)]
            for node, n, rows in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("rows"), strict=True):
                df, token = (rows.values.field(i).to_numpy() for i in range(2))
                t, shared = _least(n, threshold), len(df)
                order = np.lexsort((token, df))[:max(0, shared - t + _longest(n, LONGEST_COUNTED, threshold))]
                for column, values in zip(out, (token[order], np.full(len(order), node), np.full(len(order), n), n - shared + 1 + np.arange(len(order)), df[order], np.full(len(order), shared)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["token", "node", "n", "pos", "df", "shared"])

    left = nodes
    for last in (False, True):
        entries = held.keep(sets.join(small(left.select("node"), left), "node").select("node", "set").mapInArrow(tokens, "token long, node long"))
        counts = held.keep(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
        met = entries.join(counts, "token")
        if last:
            met = met.groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("rows")).join(small(left), "node")
            met = met.where(F.size("rows") * threshold[1] >= F.col("n") * threshold[0]).select("node", "n", "rows")
            listed = held.keep(met.mapInArrow(ordered, "token long, node long, n long, pos long, df long, shared long"))
        else:
            shared = held.keep(met.groupBy("node").agg(F.count("*").alias("shared")))
            left = held.keep(nodes.join(small(shared), "node").where(F.col("shared") * threshold[1] >= F.col("n") * threshold[0]).select("node", "n"))
        held.drop(entries)
    return listed, listed.groupBy("node", "n").agg(F.collect_list(F.struct("pos", "df", "token")).alias("rows"))


def _possible(na: Column, sa: Column, nb: Column, sb: Column, threshold) -> Column:
    """Whether nodes with these sizes and shared tokens can link: the overlap needs t / (1 + t) of both sizes."""
    return _fits(na, nb, threshold) & ((threshold[0] + threshold[1]) * F.least(sa, sb) >= threshold[0] * (na + nb))


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, bits): each set as a bitmap of 4 to 8 bits a token, 2^WIDEST at most; halves of a wide one fold onto a narrow one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for x in batch.column("set"):
                tokens = _unpack(x.as_buffer())
                bits = np.zeros(1 << min(WIDEST, max(6, (4 * len(tokens) - 1).bit_length())), dtype=np.uint8)
                bits[tokens & np.uint64(len(bits) - 1)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "bits"])

    return sets.select("node", "set").mapInArrow(each, "node long, bits binary")


def _folded(packed: bytes, words: int) -> np.ndarray:
    """A bitmap as so many 64-bit words, wider ones folded by or."""
    return np.bitwise_or.reduce(np.frombuffer(packed, dtype="<u8").reshape(-1, words), axis=0)


def _across(reads: DataFrame, named: DataFrame, sketches: DataFrame, threshold, held: Tables) -> DataFrame:
    """Pairs (src, dst) that can link, of nodes of a list that are in different components.

    reads(token, node, n, shared, l, rank) and named(token, node, n, shared, pos, rank), rank being
    (size, name) of a component. The node whose component has the lower rank reads, so each pair is
    compared from one side, with all the lists of that side. Bitmaps bound each overlap from above.
    """
    own, name = threshold
    most = lambda least: (own + name) * F.col("shared") >= own * (F.col("n") + F.col(least))
    bounds = named.groupBy("token").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("n").alias("least")).where("low < high")
    left = held.keep(reads.join(small(held.keep(bounds)), "token").where((F.col("rank") < F.col("high")) & most("least")).select(*reads.columns))
    asked = held.keep(left.groupBy("token").agg(F.count("*").alias("left"), F.min("rank").alias("low"), F.min("n").alias("least")))
    right = named.join(small(asked), "token").where((F.col("rank") > F.col("low")) & most("least"))
    right = held.keep(right.select(*named.columns))
    met = right.groupBy("token").agg(F.count("*").alias("right")).join(asked, "token")
    count = held.keep(met.select("token", F.ceil(F.col("left") / LEFT).alias("lefts"), F.ceil(F.col("right") / RIGHT).alias("rights")))
    flat = lambda df, extra: df.join(small(sketches), "node").select(*(
        F.col(c).alias(c.removeprefix("rank.")) for c in ("token", "x", "y", "node", "n", "shared", "rank.size", "rank.component", extra, "bits")
    ))
    blocks = lambda df, mine, other, x, y: df.join(small(count), "token").withColumn(
        x, F.pmod(F.xxhash64("node"), F.col(mine))).withColumn(y, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    lefts = flat(blocks(left, "lefts", "rights", "x", "y"), "l")
    rights = flat(blocks(right, "rights", "lefts", "y", "x"), "pos")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"src": pd.Series([], dtype="int64"), "dst": pd.Series([], dtype="int64")})
        if not len(a) or not len(b):
            return none
        na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        sa, sb = a["shared"].to_numpy()[:, None], b["shared"].to_numpy()[None, :]
        za, zb = a["size"].to_numpy()[:, None], b["size"].to_numpy()[None, :]
        ca, cb = a["component"].to_numpy()[:, None], b["component"].to_numpy()[None, :]
        ok = ((za < zb) | (za == zb) & (ca < cb)) & (np.minimum(na, nb) * name >= np.maximum(na, nb) * own)
        ok &= (own + name) * np.minimum(sa, sb) >= own * (na + nb)
        ok &= b["pos"].to_numpy()[None, :] <= nb - (own * nb + name - 1) // name + a["l"].to_numpy()[:, None]
        ra, rb = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(ra):
            return none
        most = np.full((len(ra), len(rb)), np.inf)
        xs, ys = [a["bits"].iloc[i] for i in ra], [b["bits"].iloc[i] for i in rb]
        lx, ly = np.array([len(v) // 8 for v in xs]), np.array([len(v) // 8 for v in ys])
        for wide_y in np.unique(ly):
            j = np.flatnonzero(ly == wide_y)
            for wide in np.unique(np.minimum(lx, wide_y)):
                y = np.stack([_folded(ys[k], wide) for k in j])
                y_bits = np.bitwise_count(y).sum(axis=1, dtype=np.int64)
                for i in np.flatnonzero(np.minimum(lx, wide_y) == wide):
                    x = _folded(xs[i], wide)
                    both = np.bitwise_count(y & x).sum(axis=1, dtype=np.int64)
                    # A token whose bit the other lacks is no common one.
                    most[i, j] = np.minimum(na[ra[i], 0] - (np.bitwise_count(x).sum(dtype=np.int64) - both), nb[0, rb[j]] - (y_bits - both))
        sub = np.ix_(ra, rb)
        link = ok[sub] & ((own + name) * most >= own * (na[ra] + nb[:, rb]))
        i, j = np.nonzero(link)
        return pd.DataFrame({"src": a["node"].to_numpy()[ra[i]], "dst": b["node"].to_numpy()[rb[j]]})

    found = lefts.groupBy("token", "x", "y").cogroup(rights.groupBy("token", "x", "y")).applyInPandas(compare, "src long, dst long")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _unpack(x: bytes) -> np.ndarray:
    part = np.frombuffer(x, dtype=np.uint8).reshape(-1, _BYTES)
    out = np.zeros((len(part), 8), dtype=np.uint8)
    out[:, :_BYTES] = part
    return out.view("<u8").ravel()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def components(docs: DataFrame, size: int = SIZE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Words are runs of other than blanks, A-Z lower-cased; the set holds a text's distinct shingles
    of `size` words, all words as one if there are fewer. Texts without words (null ones too) have
    an empty set, link with nothing and are components of their own. Other rows link if threshold[1]
    times the intersection reaches threshold[0] times the union; component_id is the smallest
    doc_id that links reach. A null doc_id counts as larger than all others. Repeated rows are
    repeated. Other columns are ignored. Sets are compared by 64-bit hashes of shingles (40 bits of
    them within a pair).
    """
    docs, held = docs.select("doc_id", "text"), Tables()
    signed = held.keep(_signatures(docs, size, threshold))
    # Tables of nodes and pairs are written by a task for this many documents; what verifies pairs has as many tasks as they need.
    parts = max(8, signed.count() // 20_000)
    of_key = signed.where("node is not null").groupBy("node", "key").agg(F.count("*").alias("times"))
    nodes = held.keep(of_key.groupBy("node").agg(F.min(F.struct("key", "times")).alias("r")).select("node", "r.key", "r.times"), parts)
    copies = held.keep(
        signed.where("node is not null").select("node", "key").join(small(nodes.select("node", F.col("key").alias("first")), nodes), "node")
        .where("key <> first").select("key").distinct(), parts
    )
    # Repeated rows of one key stay here; equal (token, node) entries are made one below.
    reps = signed.where("node is not null").join(small(copies), "key", "left_anti")
    repeated = not nodes.where("times > 1").isEmpty()

    # Lists of tokens in the order of hashes; those of one node are of no use.
    entries = reps.select("node", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "node", F.col("n").cast("int").alias("n"), (F.col("pos") + 1).alias("pos"))
    entries = entries.distinct() if repeated else entries
    counts = held.keep(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    # Neither side is ever broadcast: both grow with the corpus. Adaptive execution splits frequent tokens.
    listed = held.keep(entries.join(counts, "token"))
    planned = lambda rows, longest, most: held.keep(rows.mapInArrow(_plans(threshold, longest, most), _PLAN))
    plans = planned(listed.groupBy("node", "n").agg(F.collect_list(F.struct("pos", "df", "token")).alias("rows")), LONGEST, SHORT)
    direct = held.keep(_ordered(_matched(plans, listed, SHORT, threshold)), parts)

    as_pairs = lambda t: t.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs, open_ = as_pairs(direct), False
    # The nodes that would read longer lists, among themselves, in the order of counts.
    readers = held.keep(plans.where("l < 0").select("node", "n").distinct(), parts)
    key_of = lambda wanted: held.keep(nodes.join(small(held.keep(wanted.distinct(), parts)), "node"), parts)
    long_sets = held.keep(_sets(docs, key_of(readers.select("node")), size))
    if not readers.isEmpty():
        counted, rows = _counted(long_sets, readers, threshold, held)
        plans = planned(rows, LONGEST_COUNTED, MIDDLE)
        pairs = pairs.union(as_pairs(held.keep(_ordered(_matched(plans, counted, MIDDLE, threshold)), parts)))
        still = held.keep(plans.where("l < 0").select("node").distinct(), parts)
        open_ = not still.isEmpty()
    odd = (F.col("n") - F.col("shared")).alias("odd")

    def led(reads: DataFrame, leaders: DataFrame, *more: Column) -> DataFrame:
        """Pairs of nodes and the leaders of their lists, the nodes with the fewest tokens of their own."""
        test = (F.col("node") != F.col("lead.node")) & _possible(F.col("n"), F.col("shared"), F.col("lead.n"), F.col("lead.shared"), threshold)
        for m in more:
            test = test & m
        return reads.join(small(held.keep(leaders, parts)), "token").where(test).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))

    if open_:
        # Lists that are still longer: (token, node, n, shared, l) that is read, (token, node, n, shared, pos) that is met.
        # Only pairs of two such nodes are open; the others are found from the side that reads short lists.
        shared = held.keep(counted.select("node", "n", "shared").distinct(), parts)
        long_reads = plans.where("l < 0").select("token", "node", (-F.col("l")).alias("l")).join(small(shared), "node")
        long_reads = held.keep(long_reads.select("token", "node", "n", "shared", "l"), parts)
        read = held.keep(long_reads.select("token").distinct(), parts)
        lists = counted.select("token", "node", "pos", "n", "shared").join(small(still), "node", "left_semi").join(small(read), "token", "left_semi")
        lists = held.keep(lists.select("token", "node", "n", "shared", "pos"), parts)
        pairs = pairs.union(led(long_reads, lists.groupBy("token").agg(F.min(F.struct(odd, "node", "n", "shared")).alias("lead"))))
    tested = held.keep(_ordered(pairs), parts)
    # Sets of the long readers are there; those of the other nodes of a pair are made now.
    wanted = tested.select(F.col("src").alias("node")).union(tested.select("dst"))
    sets = held.keep(_sets(docs, key_of(wanted.join(small(readers.select("node"), readers), "node", "left_anti")), size)).union(long_sets)
    links = held.keep(_verified(tested, sets, threshold))
    labels = held.keep(connected_components(links, parts, held), parts)

    def ranked(table: DataFrame, *more: str) -> DataFrame:
        """table with rank, (size, component) of each node's component."""
        sizes = held.keep(labels.groupBy("component").agg(F.count("*").alias("size")), parts)
        known = labels.join(small(still), "node", "left_semi").join(small(sizes), "component").select("node", F.struct("size", "component").alias("known"))
        alone = F.struct(F.lit(1).cast("bigint").alias("size"), F.col("node").alias("component"))
        ranks = table.join(small(held.keep(known, parts)), "node", "left")
        return held.keep(ranks.select("token", "node", "n", "shared", *more, F.coalesce("known", alone).alias("rank")), parts)

    if open_:
        named = ranked(lists, "pos")
        mixed = named.groupBy("token").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min(F.struct(odd, "node", "rank")).alias("lead")).where("low < high")
        mixed = held.keep(mixed.select("token", F.col("lead.rank").alias("led")), parts)
        # Where several components are left, the most typical node outside the leader's own leads the others.
        others = named.join(small(mixed), "token").where("rank <> led")
        leaders = others.groupBy("token").agg(F.min(F.struct(odd, "node", "n", "shared", "rank")).alias("lead"))
        found = _ordered(led(ranked(long_reads, "l"), leaders, F.col("rank") != F.col("lead.rank")))
        fresh = held.keep(found.join(tested, ["src", "dst"], "left_anti"), parts)
        again = held.keep(_verified(fresh, long_sets, threshold))
        if not again.isEmpty():
            links = held.keep(links.union(again), parts)
            labels = held.keep(connected_components(links, parts, held), parts)
        sketches = held.keep(_sketches(long_sets.join(small(still), "node", "left_semi")), parts)
        across = held.keep(_across(ranked(long_reads, "l"), ranked(lists, "pos"), sketches, threshold, held), parts)
        again = held.keep(_verified(across, long_sets, threshold))
        if not again.isEmpty():
            labels = held.keep(connected_components(links.union(again), parts, held), parts)

    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(small(labels), "node", "left")
    group = F.coalesce("component", "node")
    rows = materialize(rows.select("doc_id", "n_shingles", group.alias("group")), parts)
    least = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    least = materialize(least.where("members > 1").select("group", "component_id"), parts)
    held.close()
    return rows.join(small(least), "group", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = SIZE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs less all but one document of each component, the one with the smallest doc_id.

    Documents without words stay. Of rows with equal doc_ids all stay if one does; rows with a null
    doc_id stay only if they are alone in their component. Other columns stay as they are, whatever
    their names.
    """
    found = components(docs, size, threshold)
    gone = materialize(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    return docs.join(small(gone), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


#: DuckDB SQL for query op3_jaccard.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS node, any_value(s) AS s, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT node, n, unnest(s) AS t FROM n),
l AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.t = b.t AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
m AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS node, min(doc_id) AS least FROM s WHERE len(s) > 0 GROUP BY 1),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS node, min(least) AS component_id FROM reach JOIN m ON m.node = reach.b GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.node = md5(array_to_string(list_sort(s.s), chr(10)))
"""
