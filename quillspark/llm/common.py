"""What several operators share: scratch tables, connected components, hashing of word shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import BROADCAST_ROWS, Tables, materialize, release, scratch_dir, small

__all__ = ["BROADCAST_ROWS", "Tables", "materialize", "release", "scratch_dir", "small"]

#: One word of a text, for all operators that count or shingle words.
WORD = r"[^\x20\x09-\x0D]+"


def tidy() -> None:
    """Give memory that a task no longer uses back to the system: workers live on, and hold what their largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that Python objects are made of few rows at once."""
    try:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
    finally:
        tidy()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars around the smallest node of what they connect, batch by batch."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(a: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        leaves = [x for x in parent if parent[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array([root(x) for x in leaves], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, parts: int | None = None, held: Tables | None = None) -> DataFrame:
    """(node, component) for undirected edges (src, dst) of longs: component is the smallest node reachable.

    Edges are first contracted to stars within each batch, then large-star and small-star steps
    alternate. Each step groups by node with partial aggregation, writes the minima and joins them
    back: by broadcast if they are few, else by a join whose two shuffles adaptive execution splits
    at a node that holds a third of the edges. Self loops and nulls are dropped; nodes without an
    edge do not appear. No edge reaches the driver, only counts and one checksum a round. parts is
    the number of tasks that write the edges, if the caller knows that they are few. What the result
    reads is among the tables of held, to be deleted with them.
    """
    held = Tables() if held is None else held
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v")
    pairs = pairs if parts is None else pairs.coalesce(parts)
    state = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    table = held.keep(pairs.mapInArrow(_contracted, "u long, v long").distinct(), parts)
    before = state(table)
    while before[0]:
        both = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = held.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), parts)
        # Of both directions only v > u goes on: each edge once, at its smaller end.
        ends = table.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = held.keep(ends.join(small(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), parts)
        least = held.keep(large.groupBy("u").agg(F.min("v").alias("m")), parts)
        next_ = held.keep(
            large.join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), parts
        )
        held.drop(table, low, large, least)
        table = next_
        old, before = before, state(table)
        if old == before:
            break
    stars = table.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.union(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# -- shingles -----------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_BLOCK = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _POWERS:
        _POWERS[base] = _powers(base)
    if n <= _BLOCK:
        return _POWERS[base][:n]
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased; empty for null."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    running = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=running[1:])
    hashes = (running[end] - running[start]) * _power(_BASE_INV, len(raw))[start]
    return _mix(hashes + (end - start).astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct shingles of consecutive words; all words as one if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _STEP + words[k:k + n])
    return np.unique(out)
