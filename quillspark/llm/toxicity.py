"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The trees, the calibration and the lexicon are fitted on a bounded sample of labelled rows
(TRAIN_ROWS); scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, release, sliced
from quillspark.llm.sampling import bounded_sample, held_out

#: Labelled rows of each label that are learned from, at most.
TRAIN_ROWS = 6_000
#: Lexicon entries, at most, and stems that are looked at for it.
LEXICON_SIZE, CANDIDATES = 400, 20_000
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Distinct tokens that a worker remembers, of two generations each: what is looked up again outlives the older one.
CACHE_TOKENS = 1 << 17

# Second-person words of the corpus languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros".split()
)
# Characters that stand for letters.
LEET = str.maketrans("01345789@$!|€", "oieastbgasile")
_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[^\W_][^\w\s]+[^\W_]")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_STEMS = (4, 5, 6, 7, 8)
_LEX, _HIDDEN, _YOU, _CAPS, _SYMBOL, _DIGIT, _STRESS, _LONG, _PUNCT, _SINGLE, _WEAK = (1 << i for i in range(11))
#: How much oftener toxic rows hold an entry of the lexicon than others do, and one of the weaker list.
STRONG, WEAK = 25, 6
FEATURES = (
    "log_tokens", "lexicon", "lexicon_rate", "weak", "weak_rate", "hidden", "hidden_rate", "second_person_rate", "second_person_near",
    "capitals_rate", "symbol_rate", "digit_rate", "stress_rate", "lengthened_rate", "punctuation_rate", "single_rate",
)


def _stems(word: str) -> set[str]:
    """The word itself and its beginnings; an entry ending in * stands for a beginning."""
    return {word, *(word[:n] + "*" for n in _STEMS if len(word) > n)}


class Tokens(dict):
    """Flags of each token, worked out at its first lookup.

    Once CACHE_TOKENS are known they become the older generation, which serves lookups until the
    next one is full, so tokens that come again and again are never worked out anew.
    """

    def __init__(self, lexicon: list[str], weak: list[str] = ()):
        super().__init__()
        self.older: dict[str, int] = {}
        self.weak = tuple(x.rstrip("*") for x in weak)
        self.whole = frozenset(x for x in lexicon if not x.endswith("*"))
        self.begin = frozenset(x[:-1] for x in lexicon if x.endswith("*"))
        self.lengths = sorted({len(x) for x in self.begin})

    def listed(self, word: str) -> bool:
        return word in self.whole or any(word[:n] in self.begin for n in self.lengths if len(word) >= n)

    def __missing__(self, token: str) -> int:
        flags = self.older.get(token)
        if flags is None:
            flags = self.flags(token)
        self[token] = flags
        return flags

    def flags(self, token: str) -> int:
        lower = token.lower()
        core = lower.strip(".,;:!?\"'()[]{}<>*_-#%&$/\\|+=~`“”‘’«»…")
        flags, letters, again = 0, core.isalpha(), _REPEAT.search(lower)
        if self.listed(core):
            flags |= _LEX
        elif self.weak and core.startswith(self.weak):
            flags |= _WEAK
        elif letters:
            # Nothing but letters stands for nothing else; only repeated ones can hide a word.
            if again and (short := _REPEAT.sub(r"\1", core)) != core and self.listed(short):
                flags |= _HIDDEN
        elif any(c.isalpha() for c in core):
            plain = "".join(_LETTERS.findall(core.translate(LEET)))
            joined = "".join(_LETTERS.findall(core))
            short = _REPEAT.sub(r"\1", joined)
            if any(x != core and self.listed(x) for x in (plain, joined, short)):
                flags |= _HIDDEN
            elif "*" in core and len(core) > 3 and core[0].isalpha():
                shape = re.compile("".join("." if c == "*" else re.escape(c) for c in core))
                if any(len(x) == len(core) and shape.fullmatch(x) for x in self.whole):
                    flags |= _HIDDEN
        if core in SECOND_PERSON:
            flags |= _YOU
        if len(core) > 2 and token.isupper():
            flags |= _CAPS
        if not token.isalpha() and _INNER.search(token):
            flags |= _SYMBOL
        if not letters and any(c.isdigit() for c in core) and any(c.isalpha() for c in core):
            flags |= _DIGIT
        if "!" in token or "?" in token:
            flags |= _STRESS
        if again:
            flags |= _LONG
        if core != lower:
            flags |= _PUNCT
        if len(core) == 1 and letters:
            flags |= _SINGLE
        return flags

    def features(self, text: str | None) -> list[float]:
        """FEATURES of a whole text; all 0 for null and for texts without tokens."""
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > CACHE_TOKENS:
            self.older = dict(self)
            self.clear()
        flags = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=n)
        count = [int(np.count_nonzero(flags & (1 << i))) for i in range(11)]
        lexicon, hidden = count[0], count[1]
        if count[9] >= 4:  # letters set apart
            run = []
            for token, flag in zip([*tokens, ""], [*flags.tolist(), 0], strict=True):
                if flag & _SINGLE:
                    run.append(token.strip(".,;:!?*_-").lower())
                else:
                    if len(run) >= 4 and any(self.listed("".join(run)[i:]) for i in range(len(run) - 3)):
                        hidden += 1
                    run = []
        near = 0.0
        if lexicon + hidden and count[2]:
            you, bad = np.flatnonzero(flags & _YOU), np.flatnonzero(flags & (_LEX | _HIDDEN))
            if len(bad):
                at = np.searchsorted(you, bad)
                gap = np.minimum(np.abs(bad - you[np.minimum(at, len(you) - 1)]), np.abs(bad - you[np.maximum(at - 1, 0)]))
                near = 1.0 / (1.0 + float(gap.min()))
        return [
            math.log1p(n), float(lexicon), lexicon / n, float(count[10]), count[10] / n, float(hidden), hidden / n, count[2] / n, near,
            count[3] / n, count[4] / n, count[5] / n, count[6] / n, count[7] / n, count[8] / n, count[9] / n,
        ]


# -- trees ---------------------------------------------------------------------------------------


class Boosted:
    """Trees of depth `depth` for the logistic loss, grown level by level over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -5.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        margin, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            feature = np.zeros(2**self.depth - 1, dtype=np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.zeros(n)
                at = np.full((n, 2), -1)
                for f in range(x.shape[1]):
                    slot = node * width + binned[:, f]
                    gs = np.bincount(slot, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(slot, h, n * width).reshape(n, width).cumsum(axis=1)
                    cs = np.bincount(slot, minlength=n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(cs < self.least) | (ct - cs < self.least)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(n), k] > best + 1e-9
                    best[better] = gain[np.arange(n), k][better]
                    at[better] = np.stack([np.full(n, f), k], axis=1)[better]
                right = np.zeros(len(y), dtype=np.int64)
                for i in range(n):
                    if at[i, 0] >= 0 and at[i, 1] < len(cuts[at[i, 0]]):
                        feature[first + i], cut[first + i] = at[i, 0], cuts[at[i, 0]][at[i, 1]]
                        own = node == i
                        right[own] = binned[own, at[i, 0]] > at[i, 1]
                node = 2 * node + right
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge) * self.rate
            margin = margin + leaf[node]
            self.grown.append((feature, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        each = np.arange(len(x))
        for feature, cut, leaf in self.grown:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[each, feature[at]] >= cut[at])
            out += leaf[node]
        return out


class Isotonic:
    """The nondecreasing function of a margin that is nearest to the labels (pool adjacent violators)."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        self.x, self.y = np.array([0.0]), np.array([0.0])
        if not len(y):
            return self
        values, place = np.unique(margin, return_inverse=True)
        blocks: list[list[float]] = []
        for v, total, weight in zip(values, np.bincount(place, y), np.bincount(place), strict=True):
            blocks.append([total, weight, v, v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
        # Half a case to either side keeps scores off 0 and 1 by how much was seen.
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks for _ in (0, 1)])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # Margins among the calibration rows' own interpolate; ties between blocks order the score.
        return np.clip(np.interp(margin, self.x, self.y) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


class Model:
    """A lexicon, trees and their calibration."""

    def __init__(self, lexicon: list[str], weak: list[str], trees: Boosted, scale: Isotonic):
        self.lexicon, self.weak, self.trees, self.scale = lexicon, weak, trees, scale

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.scale(self.trees.margin(features))


def _feature_rows(lexicon: list[str], weak: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(lexicon, weak)
        for batch in sliced(batches):
            rows = [tokens.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("fold"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "fold", "x"]
            )

    return each


def _stem_rows(wanted: frozenset[str] | None):
    """Counts of stems a partition: documents of either label that hold them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                stems: set[str] = set()
                for word in set(_LETTERS.findall((text or "").lower())):
                    if len(word) > 2:
                        stems |= _stems(word)
                found.update(stems if wanted is None else stems & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["stem", "n"]
        )

    return each


def _entries(clean: dict[str, int]) -> list[str]:
    """Stems as beginnings: of nested ones that hold nearly the same rows the longest, of others the shorter."""
    kept: set[str] = set()
    # What begins with a stem follows it in order; only beginnings that do not count themselves look there.
    listed = sorted(clean)
    for stem in sorted(clean, key=lambda s: (len(s.rstrip("*")), not s.endswith("*"), s)):
        root = stem.rstrip("*")
        if any(root[:n] in kept for n in range(1, len(root) + 1)):
            continue
        if stem.endswith("*"):
            after = itertools.takewhile(lambda s, root=root: s.startswith(root), (listed[i] for i in range(bisect.bisect_left(listed, root), len(listed))))
            if any(s != stem and clean[s] >= 0.95 * clean[stem] for s in after):
                continue
        kept.add(root)
    return [k + "*" for k in sorted(kept, key=lambda k: (-max(clean.get(k, 0), clean.get(k + "*", 0)), k))[:LEXICON_SIZE]]


def learn_lexicon(sample: DataFrame, toxic_rows: int, plain_rows: int) -> tuple[list[str], list[str]]:
    """(strong, weak) beginnings of words that at least 4 % (and 3) of the toxic rows hold.

    Toxic rows hold strong ones STRONG times as often as other rows, weak ones WEAK times. Weak ones
    that a strong one covers are left out.
    """
    support = max(3, math.ceil(0.04 * toxic_rows))
    held = (
        sample.where("toxic = 1").select("text").mapInArrow(_stem_rows(None), "stem string, n long")
        .groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
        .orderBy(F.desc("n"), "stem").limit(CANDIDATES)
    )
    toxic = dict(map(tuple, held.collect()))
    plain = dict(map(tuple, (
        sample.where("toxic = 0").select("text").mapInArrow(_stem_rows(frozenset(toxic)), "stem string, n long")
        .groupBy("stem").agg(F.sum("n").alias("n")).collect()
    )))
    lift = {s: n / max(1, toxic_rows) / ((plain.get(s, 0) + 0.25) / max(1, plain_rows)) for s, n in toxic.items()}
    strong = _entries({s: n for s, n in toxic.items() if lift[s] >= STRONG})
    covered = tuple(x.rstrip("*") for x in strong)
    weak = _entries({s: n for s, n in toxic.items() if WEAK <= lift[s] < STRONG and not (covered and s.startswith(covered))})
    # The beginning of a strong entry says nothing that the entry itself does not say better.
    return strong, [w for w in weak if not any(c.startswith(w.rstrip("*")) and toxic.get(c + "*", toxic.get(c, 0)) >= 0.8 * toxic[w] for c in covered if w in toxic)]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from documents that labels(doc_id, toxic) mark and held_out() leaves.

    At most train_rows documents of either label are read, drawn by a hash of doc_id; a document
    with several labels counts as toxic if one says so. A quarter of the sample, by another hash,
    calibrates only (if it holds 100 toxic rows; else all rows do both). Null labels and ids are left out. Without labelled rows every score is near 0.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    drawn = bounded_sample(known.where("toxic = 1"), F.col("doc_id"), train_rows).union(
        bounded_sample(known.where("toxic = 0"), F.col("doc_id"), train_rows)
    )
    total = dict(map(tuple, known.groupBy("toxic").count().collect()))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(4)).cast("int")
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", fold.alias("fold")))
    rows = dict(map(tuple, sample.groupBy("toxic").count().collect()))
    lexicon, weak = learn_lexicon(sample, rows.get(1, 0), rows.get(0, 0)) if rows.get(1) else ([], [])
    data = sample.mapInArrow(_feature_rows(lexicon, weak), "toxic int, fold int, x array<double>").collect()
    release(sample)
    data.sort(key=lambda r: (r["x"], r["toxic"], r["fold"]))
    x = np.array([r["x"] for r in data], dtype=float).reshape(-1, len(FEATURES))
    y, held = np.array([r["toxic"] for r in data], dtype=float), np.array([r["fold"] == 0 for r in data], dtype=bool)
    if y[held].sum() < 100 or held.all():
        held = np.ones(len(y), dtype=bool)
        trees = Boosted().fit(x, y)
    else:
        trees = Boosted().fit(x[~held], y[~held])
    # Labels are drawn evenly; the calibration counts each label as often as it is among all rows.
    weight = {k: total.get(k, 0) / max(1, rows.get(k, 0)) for k in (0, 1)}
    copies = np.maximum(1, np.round(4 * np.array([weight[int(v)] for v in y]))).astype(int)
    margin = trees.margin(x)
    return Model(lexicon, weak, trees, Isotonic().fit(np.repeat(margin[held], copies[held]), np.repeat(y[held], copies[held])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (double, 0 to 1) of each whole text; a null or empty text has one too.

    Narrow: all columns and rows stay, in place. A column named toxicity is replaced.
    """
    docs = docs.drop("toxicity")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon, model.weak)
        for batch in sliced(batches, 512):
            x = np.array([tokens.features(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, "toxicity"]
            )

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))
