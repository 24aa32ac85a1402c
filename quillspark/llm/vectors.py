"""Embedding near-duplicates by a pruned graph, and exact top-k inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Tables, connected_components, materialize, sliced, small

# -- near-duplicates -------------------------------------------------------------------------------

#: Cosine from which vectors link.
COSINE = 0.98
#: Members of a cluster that is not split again, about; clusters that one is split into, at most; members and queries of one task.
CLUSTER, FAN, TASK = 1024, 64, 4096
#: Distance that centres keep from each other, so that near copies are not split among several.
APART = 0.45
#: Overlap of clusters, as a share of the one that loses no link at all; the second try takes all of it.
OVERLAP = 0.35, 1.0
#: Out-degree before reverse edges, candidates for it, slack of the pruning, width of the search.
DEGREE, POOL, SLACK, BEAM = 20, 48, 1.2, 12
#: Queries of a task that are compared with all its rows; share of such pairs in range from which a task compares all its rows.
AUDIT, DENSE = 48, 1 / 32
#: Queries that are compared with all rows of their label, about; below LEAST_RECALL of their links the search is not accepted.
SAMPLE, LEAST_RECALL = 256, 0.99


def _finite(x: Column) -> Column:
    """True for vectors that are not null or empty and hold finite components only."""
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _pruned(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row of unit vectors x, padded by -1: of the POOL nearest and some random rows, those that no chosen one covers.

    A candidate is covered when a chosen one is SLACK times nearer to it than the row is; so edges
    point in different directions and near copies do not use up the degree. Reverse edges are added.
    """
    n = len(x)
    k, rng = min(POOL, n - 1), np.random.default_rng(n)
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start in range(0, n if n > 1 else 0, 256):
        own = np.arange(start, min(n, start + 256))
        dot = x[own] @ x.T
        pool = np.concatenate([np.argpartition(-dot, k, axis=1)[:, :k + 1], rng.integers(0, n, (len(own), 8))], axis=1)
        near = x[pool]
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(dot, pool, axis=1)))
        gap[pool == own[:, None]] = np.inf
        rows = np.arange(len(own))
        for _ in range(DEGREE):
            at = gap.argmin(axis=1)
            open_ = np.isfinite(gap[rows, at])
            if not open_.any():
                break
            pick = pool[rows, at]
            src.append(own[open_])
            dst.append(pick[open_])
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rd,rpd->rp", x[pick], near)))
            gap[(SLACK * between <= gap) | (pool == pick[:, None])] = np.inf
    a, b = np.concatenate(src), np.concatenate(dst)
    # Own edges come first, then the reverse ones, twice the degree at most.
    edges = np.concatenate([np.stack([a, b, np.zeros_like(a)]), np.stack([b, a, np.ones_like(a)])], axis=1)
    edges = edges[:, np.lexsort((edges[2], edges[1], edges[0]))]
    if edges.shape[1]:
        edges = edges[:, np.concatenate(([True], (edges[:2, 1:] != edges[:2, :-1]).any(axis=0)))]
    edges = edges[:, np.lexsort((edges[1], edges[2], edges[0]))]
    place = np.arange(edges.shape[1]) - np.searchsorted(edges[0], edges[0])
    kept = place < 2 * DEGREE
    table = np.full((n, int(place[kept].max()) + 1 if kept.any() else 1), -1)
    table[edges[0, kept], place[kept]] = edges[1, kept]
    return table


def _range_search(x: np.ndarray, table: np.ndarray, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with a dot product of at least `least`, as a greedy search finds them.

    All queries start at the medoid and expand the best of their `beam` best rows until all of
    these are expanded; then rows in range go on being expanded until none is left.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n), dtype=bool)
    start = int((x @ x.mean(axis=0)).argmax())
    seen[:, start] = True
    ids, score, open_ = np.full((m, beam), -1), np.full((m, beam), -np.inf), np.zeros((m, beam), dtype=bool)
    ids[:, 0], score[:, 0], open_[:, 0] = start, q @ x[start], True
    hit = np.flatnonzero(score[:, 0] >= least)
    found_q, found_x, live = [hit], [np.full(len(hit), start)], np.arange(m)
    while len(live):
        best = np.where(open_[live], score[live], -np.inf).argmax(axis=1)
        open_[live, best] = False
        next_ = table[ids[live, best]]
        fresh = (next_ >= 0) & ~seen[live[:, None], next_]
        row, col = np.nonzero(fresh)
        node = next_[row, col]
        seen[live[row], node] = True
        value = np.full(next_.shape, -np.inf)
        value[row, col] = np.einsum("ij,ij->i", q[live[row]], x[node])
        row, col = np.nonzero(value >= least)
        found_q.append(live[row])
        found_x.append(next_[row, col])
        both = np.concatenate([score[live], value], axis=1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        score[live] = np.take_along_axis(both, top, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], next_], axis=1), top, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, axis=1)
        live = live[open_[live].any(axis=1)]
    at_q, at_x = np.concatenate(found_q), np.concatenate(found_x)
    while len(at_q):  # the range expands
        next_ = table[at_x]
        row, col = np.nonzero(next_ >= 0)
        pair = at_q[row] * n + next_[row, col]
        pair = np.unique(pair[~seen[pair // n, pair % n]])
        at_q, at_x = pair // n, pair % n
        seen[at_q, at_x] = True
        near = np.einsum("ij,ij->i", q[at_q], x[at_x]) >= least
        at_q, at_x = at_q[near], at_x[near]
        found_q.append(at_q)
        found_x.append(at_x)
    return np.concatenate(found_q), np.concatenate(found_x)


def _within(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All such pairs, by comparing everything."""
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(q), 256):
        row, col = np.nonzero(q[start:start + 256] @ x.T >= least)
        a.append(row + start)
        b.append(col)
    return np.concatenate(a), np.concatenate(b)


def _links(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, rows, graph) of the pairs in range: by the graph, unless an audit speaks against it.

    AUDIT queries are compared with all rows first. Where much is in range a graph saves nothing,
    and where it then misses one of their links it is not good enough: both compare everything.
    """
    audited = np.arange(0, len(q), max(1, len(q) // AUDIT))
    a, b = _within(x, q[audited], least)
    table = _pruned(x)
    if len(a) > DENSE * len(audited) * len(x):
        return *_within(x, q, least), table
    found_q, found_x = _range_search(x, table, q, least)
    got = np.isin(audited[a] * len(x) + b, found_q * len(x) + found_x)
    return (found_q, found_x, table) if got.all() else (*_within(x, q, least), table)


def _forest(query: np.ndarray, found: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the pairs connect, at most one a node."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    src, dst = [], []
    for a, b in zip(query.tolist(), found.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            src.append(a)
            dst.append(b)
    return src, dst


def _unit(raw) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype="<f8") for b in raw])


_MEMBER = "cell long, node long, unit binary, copies long, home boolean, was long"


def _clustered(nodes: DataFrame, cosine: float, overlap: float, held: Tables) -> DataFrame:
    """nodes(node, grp, unit, copies) as members (cell, node, unit, copies, home, was) of overlapping clusters.

    A cell of more than two CLUSTERs is split by centres, a hashed sample of its members in
    proportion to its size, at most FAN and at least APART from each other; its children are split
    again until none is left that is too large and gets smaller. So the centres grow with the data,
    and no table of all of them is ever in one place. A member goes to its nearest centre, where it
    is at home, and to each that can be nearest for a vector in range, which the distance to the
    bisecting plane tells; overlap is the share of that distance that is kept.
    """
    reach = overlap * 2 * (float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9)
    members = held.keep(nodes.select(F.col("grp").alias("cell"), "node", "unit", "copies", F.lit(True).alias("home"), F.lit(None).cast("long").alias("was")))
    done, draw = [], F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) / float(1 << 20)

    def centres(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, kept = frame.sort_values("draw"), []
        for u in map(lambda b: np.frombuffer(b, dtype="<f8"), frame["unit"]):
            if len(kept) < frame["fan"].iloc[0] and all(u @ k <= 1 - APART**2 / 2 for k in kept):
                kept.append(u)
        return pd.DataFrame({"cell": [key[0]], "centres": [np.concatenate(kept).tobytes()], "size": [frame["size"].iloc[0]]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            take, to, home = [], [], []
            units = _unit(batch.column("unit").to_pylist())
            cells, ranges = batch.column("cell").to_pylist(), batch.column("centres")
            fixed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, cell in enumerate(cells):
                if cell not in fixed:
                    c = np.frombuffer(ranges[i].as_buffer(), dtype="<f8").reshape(-1, units.shape[1])
                    fixed[cell] = c, np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                c, apart = fixed[cell]
                gap = 2 - 2 * (c @ units[i])
                at = int(gap.argmin())
                near = np.flatnonzero((gap - gap[at] <= reach * apart[at] + 1e-9) | (np.arange(len(c)) == at)).tolist()
                take += [i] * len(near)
                to += near
                home += [k == at for k in near]
            part = batch.take(pa.array(take, pa.int64()))
            home = np.array(home, dtype=bool) & np.array(part.column("home").to_pylist(), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [part.column("cell"), pa.array(to, pa.int64()), *(part.column(c) for c in ("node", "unit", "copies")), pa.array(home, pa.bool_()), part.column("size")],
                names=["parent", "k", "node", "unit", "copies", "home", "was"],
            )

    while True:
        sizes = held.keep(members.groupBy("cell").agg(F.count("*").alias("size"), F.first("was").alias("was")))
        wide = sizes.where((F.col("size") > 2 * CLUSTER) & (F.coalesce("was", 2 * F.col("size")) > 1.1 * F.col("size")))
        wide = held.keep(wide.select("cell", "size", F.least(F.lit(FAN), F.ceil(F.col("size") / CLUSTER)).alias("fan")))
        drawn = members.where("home").join(small(wide), "cell").withColumn("draw", draw).where(F.col("draw") * F.col("size") < 3 * F.col("fan"))
        found = drawn.select("cell", "size", "fan", "draw", "unit").groupBy("cell").applyInPandas(centres, "cell long, centres binary, size long")
        split = held.keep(found.where(F.length("centres") > F.lit(8)))
        if split.isEmpty():
            done.append(members)
            break
        done.append(held.keep(members.join(small(split.select("cell"), split), "cell", "left_anti")))
        dealt = members.join(small(split), "cell").mapInArrow(deal, "parent long, k long, node long, unit binary, copies long, home boolean, was long")
        members = held.keep(dealt.select(F.xxhash64("parent", "k").alias("cell"), "node", "unit", "copies", "home", "was"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return held.keep(out)


_LINK = "kind int, a long, b long, n long, m long"
_NODE, _EDGE, _FOREIGN = 0, 1, 2


def _searched(members: DataFrame, cosine: float, held: Tables) -> DataFrame:
    """What searches in all clusters find: rows (kind, a, b, n, m).

    _NODE: n rows and m nodes that link with node a, in its home cluster. _EDGE: a and b are
    connected. _FOREIGN: a links with b by the graph of a cluster where neither list was asked.
    """
    sizes = held.keep(members.groupBy("cell").agg(F.ceil(F.count("*") / TASK).alias("subs"), F.ceil(F.count_if("home") / TASK).alias("batches")))
    met = members.join(small(sizes), "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "node"), F.col(n))
    rows = met.withColumn("sub", deal("sub", "subs")).withColumn("batch", each("batches")).where("batches > 0").withColumn("asks", F.lit(False))
    asking = met.where("home and subs * batches > 1").withColumn("sub", each("subs")).withColumn("batch", deal("batch", "batches")).withColumn("asks", F.lit(True))
    columns = ["cell", "sub", "batch", "asks", "home", "node", "unit", "copies", (F.col("subs") * F.col("batches")).alias("tasks")]

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["asks", "node"])
        own, ask = frame[~frame["asks"]], frame[frame["asks"]]
        if len(frame) and frame["tasks"].iloc[0] == 1:
            ask = own[own["home"]]
        if not len(own) or not len(ask):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": [], "m": []}).astype("int64")
        ids, weight, who = own["node"].to_numpy(), own["copies"].to_numpy(), ask["node"].to_numpy()
        x, q = _unit(own["unit"]), _unit(ask["unit"])
        at, to, table = _links(x, q, cosine)
        other = who[at] != ids[to]
        at, to = at[other], to[other]
        src, dst = _forest(who[at], ids[to])
        # Lists are united over clusters: what a vector's list holds where it is not at home is looked up in its home.
        row, col = np.nonzero((table >= 0) & ~own["home"].to_numpy()[:, None])
        far = table[row, col]
        near = np.einsum("ij,ij->i", x[row], x[far]) >= cosine
        a = np.concatenate([who, src, ids[row[near]]]).astype(np.int64)
        b = np.concatenate([np.full(len(who), -1), dst, ids[far[near]]]).astype(np.int64)
        n, m = np.bincount(at, weight[to], len(who)).astype(np.int64), np.bincount(at, minlength=len(who))
        pad = np.zeros(len(a) - len(who), dtype=np.int64)
        kind = np.repeat([_NODE, _EDGE, _FOREIGN], [len(who), len(src), int(near.sum())])
        return pd.DataFrame({"kind": kind, "a": a, "b": b, "n": np.concatenate([n, pad]), "m": np.concatenate([m, pad])})

    return held.keep(rows.select(*columns).unionByName(asking.select(*columns)).groupBy("cell", "sub", "batch").applyInPandas(search, _LINK))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row of rows(vec_id, embedding, label).

    Vectors with equal labels link from the given cosine on, in double precision. n_links counts
    other rows linked directly, copies included; component_id is the smallest vec_id that links
    reach; kept marks it. Null labels, null, empty and zero vectors and those with null or
    non-finite components link with nothing; so do vectors of different lengths. Repeated rows
    count as rows. Other columns are ignored.

    Copies are one node. Nodes of a label are dealt to overlapping clusters, each of which builds a
    pruned graph; every node is searched for in the graph of the cluster where it is at home, and
    counts links and returns spanning edges only. Lists of nodes are united over clusters: links in
    lists of clusters where a node is not at home are counted unless its home holds the other one.
    A cluster beyond TASK members is cut by hash into tasks of so many rows and so many queries, so
    a place with a third of all rows is many tasks; where most rows are in range, tasks compare them
    outright.

    recall is the share of links found for about SAMPLE nodes, which are compared with all rows of
    their label. Below LEAST_RECALL clusters are dealt again with the overlap that loses none; if
    that does not suffice it is an error.
    """
    held, kind = Tables(), rows.schema["vec_id"].dataType.simpleString()
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("label"))
    usable = F.col("label").isNotNull() & _finite(F.col("x")) & F.exists("x", lambda v: v != 0)
    known = rows.select("vec_id", F.when(usable, F.xxhash64("label", "x")).alias("node"), "label", "x")
    placed = held.keep(known.select("vec_id", "node"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            out = []
            for v in batch.column("x").to_pylist():
                a = np.array(v, dtype=float)
                a = a / np.abs(a).max()
                out.append((a / np.sqrt(a @ a)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("grp"), pa.array(out, pa.binary())], names=["node", "grp", "unit"]
            )

    group = F.xxhash64("label", F.size("x"))
    copies = held.keep(placed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")))
    nodes = known.where("node is not null").select("node", group.alias("grp"), "x").mapInArrow(units, "node long, grp long, unit binary").dropDuplicates(["node"])
    nodes = held.keep(nodes.join(small(copies), "node"))
    n = nodes.count()
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)) + 1)
    asked = {}
    for r in drawn.select("grp", "node", "unit").limit(4 * SAMPLE).collect():
        asked.setdefault(r["grp"], []).append((r["node"], np.frombuffer(r["unit"], dtype="<f8")))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true: dict[int, int] = {}
        for batch in sliced(batches, 4096):
            grp, ids, x = batch.column("grp").to_numpy(), batch.column("node").to_numpy(), batch.column("unit").to_pylist()
            for g in np.unique(grp):
                if int(g) in asked:
                    at = np.flatnonzero(grp == g)
                    part = _unit([x[i] for i in at])
                    for node, u in asked[int(g)]:
                        true[node] = true.get(node, 0) + int(np.count_nonzero((part @ u >= cosine) & (ids[at] != node)))
        yield pa.RecordBatch.from_arrays([pa.array(list(true), pa.int64()), pa.array(list(true.values()), pa.int64())], names=["node", "true"])

    true = held.keep(nodes.select("grp", "node", "unit").mapInArrow(audit, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")), 1)
    for overlap in OVERLAP:
        members = _clustered(nodes, cosine, overlap, held)
        out = _searched(members, cosine, held)
        homes = members.where("home").select(F.col("node").alias("a"), "cell")
        there = members.select(F.col("node").alias("b"), "cell")
        foreign = held.keep(out.where(F.col("kind") == _FOREIGN).select("a", "b").distinct())
        foreign = held.keep(foreign.join(homes, "a").join(there, ["b", "cell"], "left_anti").select("a", "b"))
        weighed = foreign.join(small(copies), F.col("b") == F.col("node")).groupBy("a").agg(F.sum("copies").alias("n"), F.count("*").alias("m"))
        links = out.where((F.col("kind") == _NODE) & (F.col("m") > 0)).select("a", "n", "m").union(weighed)
        links = held.keep(links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"), F.sum("m").alias("found")))
        both = true.join(links, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("found", F.lit(0))))).first()
        recall = both[1] / both[0] if both[0] else 1.0
        if recall >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"the search found {recall:.4f} of the audited links, less than {LEAST_RECALL}")
    edges = out.where(F.col("kind") == _EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst")).union(foreign.select("a", "b"))
    labels = held.keep(connected_components(edges, held=held))
    rows = placed.join(small(copies), "node", "left").join(small(links), "node", "left").join(small(labels), "node", "left")
    rows = materialize(rows.select("vec_id", F.coalesce(F.col("links"), F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("component", "node").alias("group")))
    least = materialize(rows.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("component_id")))
    held.close()
    component = F.coalesce("component_id", "vec_id")
    return rows.join(small(least), "group", "left").select(
        F.col("vec_id").cast(kind).alias("vec_id"), (F.col("links") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"),
    )


# -- exact top-k -------------------------------------------------------------------------------------

#: Vectors and queries of a block; dimensions of the first partial sum; blocks of the first norm band.
BLOCK, ASK_BLOCK, HEAD, BAND = 4096, 1024, 16, 4
#: Join keys of a band, about, its blocks times their copies.
SALTED = 256


def _blocks(size: int):
    """Rows (id, norm, q), which come by descending norm, as blocks (block, norm, low, n, ids, q)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, number, held = pyspark.TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            ids, norms, qs = zip(*held, strict=True)
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([max(norms)], pa.float64()), pa.array([len(ids)], pa.int64()),
                 pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([b"".join(qs)], pa.binary())],
                names=["block", "norm", "n", "ids", "q"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "norm", "q")), strict=True):
                held.append(row)
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    return each


_BLOCK_TYPE = "block long, norm double, n long, ids binary, q binary"


def _ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype="<i8")


def _matrix(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, dtype="<f8").reshape(n, -1)


class _Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[row], score]), np.concatenate([self.id[row], ids])
        order = np.lexsort((i, -s))[:self.k]
        self.score[row], self.id[row] = s[order], i[order]


def _score_block(ids: np.ndarray, x: np.ndarray, ask_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> _Best:
    """Each query's k best rows of a block that reach its floor.

    Rows come by descending norm. In slices, the first HEAD rotated dimensions are summed and the
    rest is bounded by Cauchy-Schwarz; only rows whose bound reaches the query's k-th score are
    summed in full, in whole numbers, which doubles hold exactly up to 2^53.
    """
    best = _Best(len(q), k)
    xr, qr = x @ turn, q @ turn
    head = min(HEAD, x.shape[1])
    x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    x_rest, q_rest = np.sqrt((xr[:, head:] ** 2).sum(axis=1)), np.sqrt((qr[:, head:] ** 2).sum(axis=1))
    for start in range(0, len(x), 1024):
        end = start + 1024
        low = np.maximum(floor, best.score[:, -1])
        live = np.flatnonzero(q_norm * x_norm[start] * (1 + 1e-9) + 1e-3 >= low)
        if not len(live):
            break
        bound = qr[live, :head] @ xr[start:end, :head].T + np.outer(q_rest[live], x_rest[start:end])
        reach = bound + 1e-9 * np.outer(q_norm[live], x_norm[start:end]) + 1e-3 >= low[live, None]
        full = q[live] @ x[start:end].T if reach.mean() > 0.1 else None
        for j, row in enumerate(live):
            at = np.flatnonzero(reach[j])
            score = full[j, at] if full is not None else x[start + at] @ q[row]
            own = ids[start + at]
            keep = (score >= low[row]) & (own != ask_ids[row])
            if keep.any():
                score, own = score[keep], own[keep]
                if len(score) > 4 * k:
                    cut = -np.partition(-score, k - 1)[k - 1]
                    score, own = score[score >= cut], own[score >= cut]
                best.add(row, score, own)
    return best


def top_inner_products(rows: DataFrame, asks: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows(vec_id, embedding) where asks holds, the k largest inner products.

    Components are floor(scale * x), x as double; scores are whole numbers. Rows with the query's
    vec_id are its own and no candidates. Ties go to the smaller vec_id; fewer than k candidates
    give fewer rows. Null vectors, empty ones and those with null or non-finite components take no
    part; vectors are as long as the longest, missing components being 0. Repeated candidate rows
    are candidates each; null vec_ids take no part. Other columns are ignored.

    Rows are sorted by norm into blocks, and blocks taken in bands of descending norm, each band
    twice as wide as the one before. In a band, blocks of queries (with their floors, the k-th
    scores so far) are sent to the blocks of vectors; vectors stay, but for one shuffle a band. What
    reaches a floor is merged into the k best of each query, which raises floors for the next band.
    Blocks of queries that no later vector can reach are done, and bands end when all are. The k
    best are kept by query row, so repeated queries have a result each.
    """
    held = Tables()
    valid = rows.where(F.col("vec_id").isNotNull() & _finite(F.col("embedding").cast("array<double>")))
    width = valid.agg(F.max(F.size("embedding"))).first()[0] or 1

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            q, norm = [], []
            for v in batch.column("embedding").to_pylist():
                a = np.zeros(width)
                a[:len(v)] = np.floor(scale * np.array(v, dtype=np.float64))
                q.append(a.astype("<f8").tobytes())
                norm.append(float(np.sqrt(a @ a)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("asks"), pa.array(norm, pa.float64()), pa.array(q, pa.binary())], names=["vec_id", "asks", "norm", "q"]
            )

    whole_rows = held.keep(
        valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(whole, "vec_id long, asks boolean, norm double, q binary")
    )

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(b"".join(batch.column("q").to_pylist()), batch.num_rows)
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    # One number for each pair of dimensions, however many vectors there are.
    turn = np.zeros((width, width))
    for i, j, v in whole_rows.select("q").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        turn[i, j] = v
    turn = np.linalg.svd((turn + turn.T) / 2)[0]

    ordered = lambda df: df.repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), F.asc("vec_id"))
    cut = held.keep(ordered(whole_rows.select("vec_id", "norm", "q")).mapInArrow(_blocks(BLOCK), _BLOCK_TYPE))
    # Partitions are ranges of norm and blocks are numbered within them, so this is the rank of each block; one row a partition is summed up.
    part = F.shiftright("block", 32).alias("part")
    before = F.sum("n_blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = held.keep(cut.groupBy(part).agg(F.count("*").alias("n_blocks")).select("part", F.coalesce(before, F.lit(0)).alias("shift")))
    rank = F.col("shift") + F.col("block").bitwiseAND((1 << 32) - 1) - 1
    blocks = held.keep(cut.withColumn("part", part).join(small(shifts), "part").select(rank.alias("rank"), "norm", "n", "ids", "q"))
    ask_blocks = held.keep(ordered(whole_rows.where("asks").select("vec_id", "norm", "q")).mapInArrow(_blocks(ASK_BLOCK), _BLOCK_TYPE))
    ask_blocks = ask_blocks.select(F.col("block").alias("ask"), F.col("n").alias("ask_n"), F.col("ids").alias("ask_ids"), F.col("q").alias("ask_q"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            r = batch.to_pylist()[0]
            q, asked, low = _matrix(r["ask_q"], r["ask_n"]), _ids(r["ask_ids"]), np.full(r["ask_n"], -np.inf)
            for x in r["floors"] or ():
                low[x["row"]] = x["low"]
            best = _score_block(_ids(r["ids"]), _matrix(r["q"], r["n"]), asked, q, low, turn, k)
            row, col = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), r["ask"]), pa.int64()), pa.array(row, pa.int64()), pa.array(asked[row], pa.int64()),
                 pa.array(best.id[row, col], pa.int64()), pa.array(best.score[row, col].astype(np.int64), pa.int64())],
                names=["ask", "row", "query_id", "vec_id", "score"],
            )

    kind = "ask long, row long, query_id long, vec_id long, score long"
    best, at, step, n_blocks = held.keep(rows.sparkSession.createDataFrame([], kind)), 0, BAND, blocks.count()
    by_query = Window.partitionBy("ask", "row").orderBy(F.desc("score"), "vec_id")
    norms = held.keep(whole_rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("norm").alias("norm")))
    while at < n_blocks:
        most = blocks.where(F.col("rank") == at).select("norm").first()[0]
        # A floor stands where k are known; a block goes on while one of its rows has none, or has one that this band can reach.
        floors = best.groupBy("ask", "row", "query_id").agg(F.count("*").alias("known"), F.min("score").cast("double").alias("low")).where(F.col("known") >= k)
        reached = (F.col("norm") * F.lit(most * (1 + 1e-9)) + 1e-3 >= F.col("low")).cast("int")
        floors = floors.join(small(norms), "query_id").groupBy("ask").agg(
            F.collect_list(F.struct("row", "low")).alias("floors"), F.sum(1 - reached).alias("over")
        )
        live = ask_blocks.join(small(held.keep(floors)), "ask", "left").where(F.coalesce("over", F.lit(0)) < F.col("ask_n")).drop("over")
        # A band of few blocks is met by all queries: its blocks are repeated, so that queries spread over as many tasks as in a wide one.
        salts = max(1, SALTED // step)
        sent = live.withColumn("rank", F.explode(F.sequence(F.lit(at), F.lit(min(n_blocks, at + step) - 1)))).withColumn("salt", F.pmod(F.xxhash64("ask"), F.lit(salts)))
        band = blocks.where((F.col("rank") >= at) & (F.col("rank") < at + step)).select("rank", "n", "ids", "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = sent.withColumn("rank", F.col("rank").cast("long")).join(band, ["rank", "salt"]).mapInArrow(met, kind)
        merged = best.union(found).withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k).drop("place")
        done, best = best, held.keep(merged)
        held.drop(done)
        at, step = at + step, 2 * step
        if live.isEmpty():
            break
    out = materialize(best.withColumn("rank", F.row_number().over(by_query).cast("int")).select("query_id", "rank", "vec_id", "score"))
    held.close()
    return out


#: DuckDB SQL for the two queries.
ORACLE_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
ORACLE_NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.q, b.q) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, min(reach.b) AS component_id, vec_id = min(reach.b) AS kept, 1.0::DOUBLE AS recall
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN reach ON reach.a = vec_id GROUP BY vec_id, n_links
"""
