"""Repair of damaged conversations: the cheapest edits that make turns alternate, found by A*.

A conversation's turns are codes of a few bytes: the role's initial and the turn's first fault. They
are sorted by range of conversation and turn, cut into segments of at most SEGMENT turns, and each
segment is searched by itself, from each state that it can be entered in to each that it can be left
in. What the segments of a conversation cost is then put together in order, so a conversation of
many turns is many searches, and only its audit, one letter an edit, meets in one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Tables, small, tidy

#: Turns of a conversation that are searched together, as a power of two.
SEGMENT_BITS = 10
#: Costs of edits; keeping a turn costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial, where it may follow.
_KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after a turn that is inserted or given another role, which has to be a user's or an assistant's.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (START, ASSISTANT)
_WHITE = " \t\n\x0b\x0c\r"


def cheapest(roles: str, faults: str, entry: int = START, last: bool = True, first: bool = False) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest edits of some turns, among equals the least audit.

    roles has each turn's initial, faults b (blank), d (duplicate), t (truncated) or another letter.
    A* over (turns done, state): what is still to come costs at least its mandatory deletions and one
    for each truncated turn, kept or not, as suffix sums have it. The bound never falls by more than
    an edit costs, so a node's first way out of the queue, which is keyed (cost plus bound, audit), is
    its cheapest and among those its least. Turns are inserted before others, and at the end only of
    the last segment. first: stop at the first state that may end a conversation.
    """
    n = len(roles)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in "bd" else TRUNCATED if faults[i] == "t" else 0)
    queue, done, out = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        bound, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            out[state] = bound, audit
            if first and state in _ENDS:
                return {state: out[state]}
            if not last:
                continue
        heapq.heappush(queue, (bound + INSERT, audit + "I", i, _NEXT[state]))
        if i == n:
            continue
        after = bound - rest[i] + rest[i + 1]
        heapq.heappush(queue, (after + DELETE, audit + "D", i + 1, state))
        if faults[i] not in "bd":
            charge = TRUNCATED if faults[i] == "t" else 0
            if roles[i] in _KEEP[state]:
                heapq.heappush(queue, (after + charge, audit + "K", i + 1, _KEEP[state][roles[i]]))
            heapq.heappush(queue, (after + charge + REROLE, audit + "R", i + 1, _NEXT[state]))
    return out


class _Joined:
    """Segments of a conversation put together in order: for each state the cheapest way there, ties by audit.

    Two ways to different states never have audits of which one begins with the other, since both
    hold one letter for each turn and end with a turn's; so ranks of audits decide ties, and no audit
    is compared again.
    """

    def __init__(self) -> None:
        self.front: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: (cost, rank)
        self.ways: list[dict[int, tuple[int, str]]] = []  # of each segment, state: (state before, piece)

    def add(self, paths: dict[int, dict[int, tuple[int, str]]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for entry, (cost, rank) in self.front.items():
            for state, (more, piece) in paths.get(entry, {}).items():
                way = cost + more, rank, piece, entry
                if state not in best or way < best[state]:
                    best[state] = way
        order = sorted(best, key=lambda s: best[s][1:3])
        self.front = {s: (best[s][0], order.index(s)) for s in best}
        self.ways.append({s: (best[s][3], best[s][2]) for s in best})

    def end(self) -> tuple[int, str]:
        state = min((s for s in self.front if s in _ENDS), key=lambda s: self.front[s])
        cost, pieces = self.front[state][0], []
        for way in reversed(self.ways):
            state, piece = way[state]
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_PATHS = T.ArrayType(T.StructType([
    T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())
]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (conv_id, segment, rows, from, to) as counts, ends and the paths from each state that they may be entered in."""
    try:
        for batch in batches:
            out: list[dict] = []
            for rows, segment, low, high in zip(*(batch.column(c).to_pylist() for c in ("rows", "segment", "from", "to")), strict=True):
                roles, faults = "".join(r["initial"] for r in rows), "".join(r["fault"] for r in rows)
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                entries = (START,) if low is None or segment == low else (START, SYSTEM, USER, ASSISTANT)
                last = high is None or segment == high
                paths = [
                    {"entry": e, "exit": s, "cost": cost, "audit": audit}
                    for e in entries for s, (cost, audit) in cheapest(roles, faults, e, last, first=last).items()
                ]
                out.append({
                    "n": len(rows), "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
                    "illegal": sum(not _legal(a, b) for a, b in zip(roles, roles[1:], strict=False)), "turns": sum(a != b for a, b in zip([None, *turns], turns, strict=False)),
                    "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "ends": roles[0] + roles[-1], "paths": paths,
                })
            columns = [pa.array([o[c] for o in out], pa.int64()) for c in _COUNTS]
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("segment"), *columns, pa.array([o["ends"] for o in out], pa.string()), pa.array([o["paths"] for o in out], kind)],
                names=["conv_id", "segment", *_COUNTS, "ends", "paths"],
            )
    finally:
        tidy()


class _Sum(NamedTuple):
    """What is known of a conversation's segments so far."""

    conv_id: object
    joined: _Joined
    counts: dict


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations out of their segments, which come in order."""
    names = ["conv_id", "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    now: _Sum | None = None
    kind: pa.DataType = pa.null()

    def closed(x: _Sum) -> tuple:
        cost, audit = x.joined.end()
        c = x.counts
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
        return x.conv_id, c["n"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 7, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    done.append(closed(now))
                now = _Sum(row["conv_id"], _Joined(), dict.fromkeys(_COUNTS[:6], 0) | {"low": None, "high": None, "end": ""})
            c = now.counts
            for k in _COUNTS[:6]:
                c[k] += row[k]
            if c["end"] and not _legal(c["end"], row["ends"][0]):
                c["illegal"] += 1
            if row["low"] is not None:
                c["turns"] -= c["high"] == row["low"]  # a turn number on both sides of a cut
                c["low"], c["high"] = row["low"] if c["low"] is None else c["low"], row["high"]
            c["end"] = row["ends"][1]
            paths: dict[int, dict[int, tuple[int, str]]] = {}
            for p in row["paths"]:
                paths.setdefault(p["entry"], {})[p["exit"]] = p["cost"], p["audit"]
            now.joined.add(paths)
        yield packed(done)
    if now is not None:
        yield packed([closed(now)])


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, mark): mark orders turns of one number and role."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("mark"))


def plan(turns: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit): the cheapest repair of each conversation.

    turns is (conv_id, turn, role, text); other columns are ignored. Turns are taken by number, nulls
    first, those of one number by role and the MD5 of the text; rows that are equal in all are equal.
    Null roles and texts count as empty, a null conv_id is a conversation. A turn's first fault
    counts: blank, a role and text that came before, a last character that ends no sentence. Audit
    has one letter an edit: Keep, Rerole, Delete, Insert. An empty table gives no rows.
    """
    held = Tables()
    whole = _ordered(turns)
    body = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(body == "", "b").when(F.substring(body, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.substring("role", 1, 1)
    coded = whole.select(
        "conv_id", "turn", "role", "mark", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault")
    )
    order = ["conv_id", "turn", "role", "mark"]
    table = held.keep(coded.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at")))
    seen = held.keep(
        table.where("fault <> 'b'").groupBy("conv_id", "role", "mark").agg(F.min("at").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("mark").alias("__m"), "first")
    )
    again = table.join(small(seen), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("mark") == F.col("__m")), "left").select(
        "conv_id", F.shiftright("at", segment_bits).alias("segment"), "at", "turn", "initial", F.when(F.col("at") > F.col("first"), "d").otherwise(F.col("fault")).alias("fault")
    )
    # Most conversations lie in one segment; only of the others is it known here where they begin and end.
    cut = held.keep(
        table.groupBy("conv_id").agg(F.shiftright(F.min("at"), segment_bits).alias("from"), F.shiftright(F.max("at"), segment_bits).alias("to"))
        .where(F.col("from") < F.col("to")).select(F.col("conv_id").alias("__c"), "from", "to")
    )
    rows = again.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "initial", "fault"))).alias("rows"))
    placed = rows.join(small(cut), F.col("conv_id").eqNullSafe(F.col("__c")), "left").select("conv_id", "segment", "rows", "from", "to")
    conv = T.StructField("conv_id", turns.schema["conv_id"].dataType)
    longs = lambda names: [T.StructField(c, T.LongType()) for c in names]
    searched = placed.mapInArrow(_searched, T.StructType([conv, *longs(["segment", *_COUNTS]), T.StructField("ends", T.StringType()), T.StructField("paths", _PATHS)]))
    out = searched.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_composed, T.StructType([
        conv, *longs(["n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), T.StructField("audit", T.StringType())
    ]))
    result = held.keep(out)
    held.close(result)
    return result


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (conv_id, place, role, text, edit) out of rows of which each conversation's first is its audit."""
    conv, known, audit, at, state, place = None, False, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield conv, place, _NAMES[state], "", "I"
            place += 1

    for batch in batches:
        out: list[tuple] = []
        for own, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                if known:
                    out += inserted()
                conv, known, audit, at, state, place = own, True, text, 0, START, 0
                continue
            out += inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = _KEEP[state][role[:1]] if edit == "K" else _NEXT[state]
            out.append((conv, place, role if edit == "K" else _NAMES[state], text, edit))
            place += 1
        yield out
    yield list(inserted()) if known else []
    tidy()


def _with_plans(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns behind their conversation's audit, in order; a conversation's texts stream through one task."""
    audits = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("mark"))
    rows = _ordered(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "mark")
    return audits.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that plan()'s edits leave and add, place from 0; inserted texts are empty."""
    kind = turns.schema["conv_id"].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string()]

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[0] = batch.column("conv_id").type
                yield batch

        for rows in _edited(told()):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "place", "role", "text", "edit"])

    return _with_plans(turns, plans).mapInArrow(each, T.StructType([
        T.StructField("conv_id", kind), T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]
    ]))


def digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each conversation that plan()'s edits leave turns of: role:text, joined by line feeds."""
    kind = turns.schema["conv_id"].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.string()]

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[0] = batch.column("conv_id").type
                yield batch

        packed = lambda done: pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=["conv_id", "repaired_sha256"])
        conv, state = None, None
        for rows in _edited(told()):
            done = []
            for own, place, role, text, _ in rows:
                if place == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield packed(done)
        if state is not None:
            yield packed([(conv, state.hexdigest())])

    return _with_plans(turns, plans).mapInArrow(each, T.StructType([T.StructField("conv_id", kind), T.StructField("repaired_sha256", T.StringType())]))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversation rows after damage by a checksum of conv_id:turn, modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence marks, 3 repeats it and 4 makes it a
    user's. Null roles and texts are one blank, and so are nulls in what is summed.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("way"))

    def hurt(way: Column, role: Column, text: Column) -> list[Column]:
        return [
            F.when(way == 4, "user").otherwise(role).alias("role"),
            F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        ]

    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", *hurt(F.col("way"), F.col("role"), F.col("text")), copies.alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conv_id of rows with what plan() says of its turns after damage, and the digest of the repaired ones.

    A conversation that has lost all its rows has zeros, an empty audit and the digest of nothing.
    """
    turns = damaged(rows)
    plans = plan(turns)
    texts = digests(turns, plans).withColumnRenamed("conv_id", "__d")
    ids = rows.select(F.col("conv_id").alias("__id")).distinct()
    met = ids.join(plans, F.col("__id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(texts, F.col("__id").eqNullSafe(F.col("__d")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return met.select(
        F.col("__id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """The repair in SQL: four states a turn, each the least of cost and audit as one string, walked turn by turn."""
    add = lambda v, cost, letters: f"(lpad((substr({v}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({v}, 11) || '{letters}')"
    opened = (
        f"SELECT conv_id, i, z, s, least(u, {add('z', 2, 'I')}, {add('s', 2, 'I')}, {add('a', 2, 'I')}) AS u, "
        f"least(a, {add('u', 2, 'I')}, {add('z', 4, 'II')}, {add('s', 4, 'II')}) AS a FROM walk"
    )
    every = lambda cost, letter: ", ".join(add(f"w.{v}", cost, letter) for v in "zsa")
    return rf"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (SELECT keyed.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda p: ascii(substr(k, p, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS way FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, range(2) c(copy) WHERE way <> 0 AND (copy = 0 OR way = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
told AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '-' ELSE 't' END AS f FROM placed),
turns AS (SELECT *, f IN ('b', 'd') AS must, (f = 't')::INT AS t FROM told),
walk AS (SELECT conv_id, 0::BIGINT AS i, '0000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL SELECT w.conv_id, x.i, {add('w.z', 3, 'D')}, least({add('w.s', 3, 'D')}, CASE WHEN NOT must AND r = 's' THEN {add('w.z', 't', 'K')} END),
  least({add('w.u', 3, 'D')}, CASE WHEN NOT must AND r = 'u' THEN least({every('t', 'K')}) END, CASE WHEN NOT must THEN least({every('t + 2', 'R')}) END),
  least({add('w.a', 3, 'D')}, CASE WHEN NOT must AND r = 'a' THEN {add('w.u', 't', 'K')} END, CASE WHEN NOT must THEN {add('w.u', 't + 2', 'R')} END)
  FROM ({opened}) w JOIN turns x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1),
best AS (SELECT conv_id, arg_max(least(z, a), i) AS v FROM ({opened}) GROUP BY conv_id),
audits AS (SELECT conv_id, substr(v, 1, 10)::BIGINT AS cost, substr(v, 11) AS audit FROM best),
letters AS (SELECT conv_id, p, l, sum((l <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM (SELECT conv_id, p, substr(audit, p, 1) AS l FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits))),
left_ AS (SELECT e.conv_id, l, x.role, CASE WHEN l = 'I' THEN '' ELSE x.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) - 1 AS k
  FROM letters e LEFT JOIN turns x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.i WHERE l <> 'D'),
lead_ AS (SELECT *, first_value(l = 'K' AND substr(role, 1, 1) = 's') OVER (PARTITION BY conv_id ORDER BY k)::INT AS off FROM left_),
mended AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (k - off) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS digest FROM lead_ GROUP BY conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(f = 'b')::BIGINT AS blank, count_if(f = 'd')::BIGINT AS duplicate, count_if(f = 't')::BIGINT AS truncated,
  count_if(p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM turns) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
