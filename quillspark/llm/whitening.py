"""Whitening of embeddings by their leading components, found by block Lanczos without a matrix.

Vectors become integers, so sums are exact. The covariance is never built: each step sends a block
of directions to all tasks, which centre their rows, multiply and return one block of sums. Only
blocks of the dimension by a few columns reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Tables, tidy

#: Components that are kept, steps of a unit, and columns of a block.
COMPONENTS, SCALE, BLOCK = 4, 256, 8
#: Columns that the basis may have before it is shrunk to its best directions, and passes over the data at most.
BASIS, PASSES = 192, 400
#: What a component may miss of its equation, in units of the largest eigenvalue; eigenvalues below SMALLEST of the trace are none.
TOLERANCE, SMALLEST = 1e-14, 1e-12


def integral(vector: Column) -> Column:
    """Each entry, as double, as floor(SCALE * entry); null for vectors that are null or hold null or non-finite entries.

    What no long can hold becomes the largest or smallest one.
    """
    entry = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) != float("inf")), F.lit(False)))
    return F.when(good, F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * entry(c)).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs; shorter vectors are filled up with 0."""
    starts = column.offsets.to_numpy()
    sizes, flat = np.diff(starts), column.values.to_numpy(zero_copy_only=False)[starts[0]:starts[-1]]
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """The sum over all rows of part(matrix of x), width x columns; tasks add up their batches, and sums meet by place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * columns)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x"), width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])
        tidy()

    out = np.zeros(width * columns)
    for place, value in rows.select("x").mapInArrow(each, "place int, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out.reshape(width, columns)


def _exact_sums(rows: DataFrame, width: int) -> list[int]:
    """Per-dimension sums of x as whole numbers of any size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), width)
                safe = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < (1 << 62) // batch.num_rows
                total = [a + int(b) for a, b in zip(total, (x if safe else x.astype(object)).sum(axis=0), strict=True)]
        # Two parts, so that sums of sums fit: a whole number is high * 2^40 + low.
        high, low = [t >> 40 for t in total], [t & ((1 << 40) - 1) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["place", "high", "low"])
        tidy()

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = [0] * width
    for place, high, low in rows.select("x").mapInArrow(each, "place int, high long, low long").groupBy("place").agg(wide("high"), wide("low")).collect():
        out[place] = (int(high) << 40) + int(low)
    return out


def _centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, with the whole part of S / n taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], dtype=object)
    rest = np.array([(s % n) / n for s in sums])
    small_ = max(map(abs, [*whole, 0])) < 1 << 61 and max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 61
    off = x - whole.astype(np.int64) if small_ else (x.astype(object) - whole).astype(float)
    return off - rest


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, basis: int = BASIS, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, dict]:
    """(values, vectors, report): the leading eigenpairs of a symmetric operator that product(block of columns) applies.

    Each block is what the operator makes of the last one, orthogonalised twice against all before
    it. Columns that vanish by that, since a subspace is complete, start again at random. Pairs are
    those of the operator within the basis, and end when none misses its equation by more than
    tolerance of the largest value, or the basis is the whole space. A basis of more than `basis`
    columns is shrunk to its best directions, with the block that comes next.
    """
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, width), min(max(block, wanted), width)
    basis = max(basis, 4 * block)
    q, aq = np.zeros((width, 0)), np.zeros((width, 0))
    report = {"passes": 0, "breakdowns": 0, "shrunk": 0, "residual": 0.0}

    def orthogonal(columns: np.ndarray, most: int) -> np.ndarray:
        """Unit columns orthogonal to q and each other, at most `most`; columns that vanish start again."""
        kept = np.zeros((width, 0))
        for k in range(min(most, width - q.shape[1])):
            v = columns[:, k] if k < columns.shape[1] else np.zeros(width)
            while True:
                size = np.linalg.norm(v)
                for _ in range(3):
                    v = v - q @ (q.T @ v)
                    v = v - kept @ (kept.T @ v)
                left = np.linalg.norm(v)
                if left > 1e-10 * max(size, 1e-300) and left > 1e-12 * scale:
                    break
                report["breakdowns"] += report["passes"] > 0
                v = rng.standard_normal(width) * max(scale, 1.0)
            kept = np.concatenate([kept, (v / left)[:, None]], axis=1)
        return kept

    scale = 0.0
    fresh = orthogonal(rng.standard_normal((width, block)), block)
    while True:
        if fresh.shape[1]:
            q, aq = np.concatenate([q, fresh], axis=1), np.concatenate([aq, product(fresh)], axis=1)
            report["passes"] += 1
        inner = q.T @ aq
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = values[::-1], inside[:, ::-1]
        scale = max(float(np.abs(values[0])), 1e-300)
        vectors = q @ inside[:, :wanted]
        missed = np.linalg.norm(aq @ inside[:, :wanted] - vectors * values[:wanted], axis=0)
        report["residual"] = float(missed.max() / scale)
        if q.shape[1] >= width or report["residual"] <= tolerance:
            break
        if report["passes"] >= passes:
            raise RuntimeError(f"components miss their equation by {report['residual']:.1e} after {passes} passes")
        following = aq[:, -fresh.shape[1]:]
        if q.shape[1] + block > basis:
            best = inside[:, : 2 * wanted + block]
            following = aq @ inside[:, :block] - (q @ inside[:, :block]) * values[:block]
            q, aq = q @ best, aq @ best
            report["shrunk"] += 1
        fresh = orthogonal(following, block)
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0), report


@dataclass(frozen=True)
class Whitening:
    """The fit: n distinct vectors, their sums, the leading components and what they explain."""

    n: int
    width: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    report: dict


def fit(vectors: DataFrame, components: int = COMPONENTS, **options) -> Whitening:
    """The leading components of x(array of longs), each distinct vector once, null ones left out.

    Shorter vectors count as filled up with 0. Components without variance (below SMALLEST of the
    trace) are left out, so equal vectors have none. The sign is such that a component's entry of
    the largest size is positive. identity_error comes from another pass, over what whitening makes
    of the fitted vectors.
    """
    held = Tables()
    known = vectors.where("x is not null").select("x")
    width = known.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return Whitening(known.distinct().count(), 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, {})
    # Filled up first, so that vectors that differ by closing zeros alone are one.
    filled = F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))))
    rows = held.keep(known.select(filled.alias("x")).distinct())
    n = rows.count()
    sums = _exact_sums(rows, width)
    trace = float(_summed(rows, width, lambda x: (_centre(x, n, sums) ** 2).sum(axis=0)[:, None], 1).sum()) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centre(x, n, sums)
            return c.T @ (c @ block)

        return _summed(rows, width, part, block.shape[1]) / n

    if trace <= 0:
        values, found, report = np.zeros(0), np.zeros((width, 0)), {}
    else:
        values, found, report = block_lanczos(product, width, components, **options)
        real = values > SMALLEST * trace
        values, found = values[real], found[:, real]
        found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    error = 0.0
    if len(values):
        k = len(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = _centre(x, n, sums) @ found / np.sqrt(values)
            out = np.zeros((width, k + 1))
            out[:k, :k], out[:k, k] = w.T @ w, w.sum(axis=0)
            return out

        m = _summed(rows, width, moments, k + 1) / n
        error = float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())
    held.close()
    return Whitening(n, width, sums, values, found, trace, error, report)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S)^2 as whole numbers; null beyond a long."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 63:
        off = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * n - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained) of each row(key, x) with an x and each component, numbered from 1.

    Narrow. deviation, over all dimensions and in units of 1 / n, is exact, and null where no long
    holds it. Null and repeated keys are rows like any others; without components there are no rows.
    """
    kind = rows.schema[key].dataType
    k = len(model.values)
    explained = model.values / model.trace if k else np.zeros(0)
    turned = model.vectors / np.sqrt(model.values) if k else np.zeros((model.width, 0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not (m and k):
                continue
            x = _matrix(batch.column("x"), model.width)
            w = _centre(x, model.n, model.sums) @ turned
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(again), pa.array(w.ravel()), pa.array(np.tile(explained, m)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained"])
        tidy()

    return rows.where("x is not null").select(key, "x").mapInArrow(each, T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    ]))


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """whiten() of a table of vectors by the fit to all of them, with identity_error; other columns are ignored."""
    rows = embeddings.select(F.col(key), integral(F.col(vector)).alias("x"))
    model = fit(rows, components)
    return whiten(rows, model, key).withColumn("identity_error", F.lit(model.identity_error))
