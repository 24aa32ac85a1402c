"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document's vector is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, none
across a word boundary); a linear softmax over it gives the languages. Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(TRAIN_ROWS). A temperature is then fitted on rows kept aside, and the calibrated probability below
which a prediction should be rejected is the one that keeps 99 % of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import sliced
from quillspark.llm.sampling import bounded_sample, held_out

#: Labelled rows that are learned from, at most. All languages among them are learned.
TRAIN_ROWS = 4_000
#: Hash buckets and size of an embedding.
BUCKETS, SIZE = 1 << 13, 16
#: What is predicted for texts without letters.
UNDETERMINED = "und"
_ORDERS = (2, 3, 4)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
#: Letters of ASCII in lower case, bytes of other characters as they are, all else a space.
_CODES = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint8)
_SLICE = 1 << 18


def bucket_counts(text: str | None) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    if text:
        raw = _CODES[np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        for at in range(0, len(raw), _SLICE):  # long texts in slices that overlap by an n-gram
            codes = raw[at:at + _SLICE + 3].astype(np.uint32)
            space = codes == 32
            for order in _ORDERS:
                n = min(_SLICE, len(codes) - order + 1)
                if n <= 0:
                    continue
                h = np.full(n, np.uint32(order))
                for k in range(order):
                    h = (h ^ codes[k:k + n]) * _FACTORS[k]
                    h ^= h >> np.uint32(15)
                inner = space[1:1 + n].copy() if order > 2 else space[:n] & space[1:1 + n]
                for k in range(2, order - 1):
                    inner |= space[k:k + n]
                h = (h & np.uint32(BUCKETS - 1)).astype(np.int64)
                h[inner] = BUCKETS
                out += np.bincount(h, minlength=BUCKETS + 1)
    return out[:BUCKETS]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Languages, the scores of each bucket under each, and the calibration."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float, reject: float):
        self.languages, self.table, self.bias, self.heat, self.reject = languages, table, bias, heat, reject

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        """The likeliest language of each row of counts, and its calibrated probability."""
        if not self.languages or not len(counts):
            return [(UNDETERMINED, 0.0)] * len(counts)
        p = _softmax((counts @ self.table / np.maximum(1, counts.sum(axis=1, keepdims=True)) + self.bias) / self.heat)
        best = p.argmax(axis=1)
        return [(self.languages[b], float(p[i, b])) for i, b in enumerate(best)]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 12, rate: float = 20.0, seed: int = 1) -> Model:
    """Gradient descent over shuffled batches of 32 documents on embeddings and softmax."""
    rng = np.random.default_rng(seed)
    kept = rng.permutation(len(y))
    check, kept = kept[: len(y) // 5], kept[len(y) // 5:]
    totals = np.maximum(1, counts.sum(axis=1, keepdims=True)).astype(np.float32)
    embed = rng.normal(0, 0.1, (counts.shape[1], SIZE)).astype(np.float32)
    weight = rng.normal(0, 0.1, (SIZE, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    one = np.eye(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for start in range(0, len(kept), 32):
            rows = rng.choice(kept, min(32, len(kept)), replace=False) if epoch == 0 else kept[start:start + 32]
            x = counts[rows] / totals[rows]
            doc = x @ embed
            error = (_softmax(doc @ weight + bias) - one[y[rows]]) / len(rows)
            seen = np.flatnonzero(x.any(axis=0))
            embed[seen] -= step * (x[:, seen].T @ (error @ weight.T))
            weight -= step * 0.05 * (doc.T @ error)
            bias -= step * 0.005 * error.sum(axis=0)
        kept = rng.permutation(kept)
    table = embed @ weight
    heat, reject = 1.0, 0.0
    if len(check):
        z = counts[check] / totals[check] @ table + bias
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
        heat = float(min(np.geomspace(0.05, 10, 60), key=loss))
        reject = float(np.quantile(_softmax(z / heat).max(axis=1), 0.01))
    return Model(languages, table.astype(np.float64), bias.astype(np.float64), heat, reject)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of at most train_rows documents that held_out() leaves.

    Null languages, texts and ids are left out. Without any row, all is undetermined.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sample = bounded_sample(known.where(~held_out(F.col("doc_id"))), F.col("doc_id"), train_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, n = [], []
            for text in batch.column("text").to_pylist():
                c = bucket_counts(text)
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
                names=["doc_id", "lang", "at", "n"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(each, f"doc_id {id_type}, lang string, at array<int>, n array<int>").toArrow()
    order = np.argsort(np.array([str(x) for x in rows.column("doc_id").to_pylist()]), kind="stable")
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    number = {lang: k for k, lang in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    counts, at, n = np.zeros((len(order), BUCKETS), dtype=np.float32), rows.column("at"), rows.column("n")
    for k, i in enumerate(order):
        counts[k, at[i].values.to_numpy()] = n[i].values.to_numpy()
    return train(counts, np.array([number[langs[i]] for i in order]), languages)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (calibrated, 0 to 1) and rejected for each whole text.

    lang_pred is UNDETERMINED, with score 0 and rejected, where text is null or has no letter;
    otherwise a learned language, rejected if its score is under the model's bound. Narrow: all
    rows and other columns stay. Columns of those three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            out = [(UNDETERMINED, 0.0)] * len(texts)
            for i, found in zip(known, model.predict(np.stack([bucket_counts(texts[i]) for i in known]) if known else np.zeros((0, BUCKETS))), strict=True):
                out[i] = found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[0] == UNDETERMINED or x[1] < model.reject for x in out], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(each, T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]))
