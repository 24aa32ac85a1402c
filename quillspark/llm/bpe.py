"""Byte-level BPE encoding and decoding by a rank file.

Encoding: each Arrow batch is split by the tokenizer's pattern; its distinct new words are folded by
ranked merges over their bytes, words of a length together, and texts are put together from the
words' ids. There is no shuffle: the vocabulary (at most 65,536 ranks, checked) goes to the tasks
with the function, and words already folded stay in a cache of bounded size in each worker. Decoding
concatenates the ids' binary pieces out of a literal array, in built-in functions.

encode_by_functions() is the same fold in higher-order functions, over a literal rank map.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import sliced

#: Words a worker remembers; beyond that it starts anew.
CACHE_WORDS = 1 << 17
#: Longer words are folded one by one with a heap.
LONG = 48
#: Texts that are put together at once.
CHUNK = 128
_NONE = np.int32(2**31 - 1)
#: Texts of these characters alone split alike under the standard library's faster expressions.
_SIMPLE = re.compile("[\x00-\x1b\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
_SIMPLE_OF = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
}


def read_ranks(path: str) -> bytes:
    """The rank file's content; it must not hold more ranks than fit in 16 bits."""
    with open(path, "rb") as f:
        content = f.read()
    if content.count(b"\n") > 65_536:
        raise ValueError(f"{path} has more than 65,536 ranks")
    return content


class _Index(dict):
    """Numbers words in the order of their first lookup."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Bpe:
    """Merges and byte strings of a rank file, and the words folded so far."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.simple = _SIMPLE_OF.get(pattern, self.pattern)
        self.ranks = _ranks(content)
        size = max(self.ranks.values()) + 1
        self.words = [b""] * size
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        keys = np.fromiter(pairs, dtype=np.uint32, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order]
        self.piece_len = np.array([len(w) for w in self.words], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_len)))[:-1]
        self.pieces = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.ids, self.ids_end = np.zeros(1 << 16, dtype=np.int32), 0
        self.at, self.len = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it is no merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def fold_equal(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fold words of one length, a row of bytes each; yields (rows, their ids) as they end."""
        rows, ids = np.arange(len(words)), self.byte_id[words]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        while True:
            if not ranks.shape[1]:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            open_ = low != _NONE
            if not open_.all():
                yield rows[~open_], ids[~open_]
                rows, ids, ranks, at, low = rows[open_], ids[open_], ranks[open_], at[open_], low[open_]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            ids[each, at] = low
            keep = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            if ids.shape[1] == 1:
                yield rows, ids
                return
            # The merged pair's rank goes; the ranks to its left and right change.
            keep = keep[:, :-1]
            ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank_of(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < ids.shape[1] - 1)
            ranks[has, at[has]] = self.rank_of(ids[has, at[has]], ids[has, at[has] + 1])

    def fold_long(self, word: bytes) -> list[int]:
        """Fold one word with a heap of (rank, position) over a linked list."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = lambda i: self.ranks.get(self.words[ids[i]] + self.words[ids[after[i]]]) if after[i] < len(ids) else None
        first = self.rank_of(np.array(ids[:-1]), np.array(ids[1:])) if len(ids) > 1 else np.zeros(0, dtype=np.int32)
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(heap, (r, j))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str], first: int) -> None:
        """Fold words and remember their ids under the numbers from first on."""
        self.at, self.len = _grown(self.at, first + len(words)), _grown(self.len, first + len(words))
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for number, word in enumerate(words, first):
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self._put(np.array([number]), np.array([[whole]], dtype=np.int32))
            elif len(raw) > LONG:
                self._put(np.array([number]), np.array([self.fold_long(raw)], dtype=np.int32))
            else:
                numbers, raws = by_length.setdefault(len(raw), ([], []))
                numbers.append(number)
                raws.append(raw)
        for length, (numbers, raws) in by_length.items():
            rows = np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(len(raws), length)
            own = np.array(numbers)
            for done, ids in self.fold_equal(rows):
                self._put(own[done], ids)

    def _put(self, numbers: np.ndarray, ids: np.ndarray) -> None:
        n, width = ids.shape
        self.ids = _grown(self.ids, self.ids_end + n * width)
        self.ids[self.ids_end:self.ids_end + n * width] = ids.ravel()
        self.at[numbers] = self.ids_end + width * np.arange(n)
        self.len[numbers] = width
        self.ids_end += n * width

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        if len(self.index) > CACHE_WORDS:
            self._forget()  # a chunk's own words come on top, CHUNK texts at most
        index, first, texts_words = self.index, len(self.index), []
        for text in texts:
            text = text or ""
            words = (self.simple if _SIMPLE.fullmatch(text) else self.pattern).findall(text)
            texts_words.append(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)))
        self.learn(list(index)[first:] if len(index) > first else [], first)
        for words in texts_words:
            yield self.ids[_gather(self.at[words], self.len[words])]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pieces[_gather(self.piece_at[ids], self.piece_len[ids])].tobytes()


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate((x, np.zeros(max(size - len(x), len(x)), dtype=x.dtype)))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, for all i in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_BUILT: dict[tuple[int, str], Bpe] = {}


def _bpe(content: bytes, pattern: str) -> Bpe:
    key = (hash(content), pattern)
    if key not in _BUILT:
        _BUILT[key] = Bpe(content, pattern)
    return _BUILT[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) and tokens (array of the same ids).

    Every whole text is split by pattern and each match folded by the ranks in the file at path,
    which the driver reads. No special tokens. A null or empty text has no ids. Columns of docs
    named n_tokens, ids or tokens are replaced; all others stay, rows repeat as in docs.
    """
    docs = docs.drop("n_tokens", "ids", "tokens")
    content = read_ranks(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(content, pattern)
        for batch in sliced(batches, CHUNK):
            found = list(bpe.encode(batch.column(text).to_pylist()))
            n = [len(x) for x in found]
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *found]), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), tokens],
                names=[*batch.schema.names, "n_tokens", "ids", "tokens"],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(each, schema)


def decode(encoded: DataFrame, path: str, ids: str = "tokens") -> DataFrame:
    """encoded with decoded (binary), the tokens' byte strings in turn; null tokens give null.

    The column holds arrays of ids; their byte strings come from a literal array, as hex digits, and
    are concatenated: no Python. An id that the rank file lacks is an error. A column named decoded
    is replaced.
    """
    ranks = _ranks(read_ranks(path))
    words = [""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word.hex()
    pieces = _literal(words, "string")
    found = F.transform(F.col(ids), lambda i: F.get(pieces, i))
    # An id beyond the table has no piece, one that the file leaves out an empty one; neither may pass in silence.
    known = F.assert_true(F.col(ids).isNull() | F.forall(found, lambda p: F.coalesce(p != "", F.lit(False))), F.lit("an id is not in the rank file"))
    return encoded.drop("decoded").withColumn("decoded", F.when(known.isNull(), F.unhex(F.array_join(found, ""))))


# -- the fold in built-in functions --------------------------------------------------------------------


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}


def _literal(values, kind: str) -> Column:
    """A literal array, out of one literal text that the optimizer takes apart once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_map(content: bytes) -> tuple[Column, Column, Column]:
    """(ids of bytes, places, shifts): the rank file's merges as literal arrays that are looked up in constant time.

    A map's literal would be searched from its start. A pair (a, b) has the key a * 65536 + b; its
    place is key + shifts[key % d], modulo the number of places, where the key and its rank are
    packed into one number. Shifts are chosen so that no two keys share a place.
    """
    ranks = _ranks(content)
    merges = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
            if a is not None and b is not None:
                merges[a << 16 | b] = rank
    n = _PLACES
    while n < 2 * len(merges):
        n = 2 * n + 1
    dealt: dict[int, list[int]] = {}
    for key in merges:
        dealt.setdefault(key % _SHIFTS, []).append(key)
    places, shifts, rng = np.full(n, -1, dtype=np.int64), np.zeros(_SHIFTS, dtype=np.int64), np.random.default_rng(3)
    for group, keys in sorted(dealt.items(), key=lambda x: -len(x[1])):
        own = np.array(keys) % n
        while True:
            shift = int(rng.integers(n))
            at = (own + shift) % n
            if (places[at] < 0).all() and len(np.unique(at)) == len(at):
                break
        shifts[group] = shift
        places[at] = [key << 16 | merges[key] for key in keys]
    return _literal([ranks[bytes([b])] for b in range(256)], "bigint"), _literal(places, "bigint"), _literal(shifts, "bigint")


_PLACES, _SHIFTS = 262_147, 65_537


def folded(word: Column, table: tuple[Column, Column, Column]) -> Column:
    """The ids of a word (a string) by ranked merges over its bytes: each step merges the leftmost pair of the lowest rank."""
    byte_ids, places, shifts = table
    size = F.size(places).cast("bigint")

    def rank_of(a: Column, b: Column) -> Column:
        return _let(a * 65536 + b, lambda key: _let(
            F.get(places, ((key + F.get(shifts, (key % _SHIFTS).cast("int"))) % size).cast("int")), lambda at: F.when(F.shiftright(at, 16) == key, at.bitwiseAND(65535))))

    raw, n = word.cast("binary"), F.octet_length(word)
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(byte_ids, F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")))
    state = F.struct(ids.alias("ids"), F.lit(True).alias("open"))

    def step(acc: Column, _: Column) -> Column:
        merged = lambda x, ranks: _let(F.array_min(ranks), lambda low: F.when(low.isNull(), F.struct(x.alias("ids"), F.lit(False).alias("open"))).otherwise(
            _let(F.array_position(ranks, low).cast("int"), lambda at: F.struct(
                F.concat(F.slice(x, F.lit(1), at - 1), F.array(low), F.slice(x, at + 2, F.size(x))).alias("ids"), F.lit(True).alias("open")))))
        return F.when(~acc["open"], acc).otherwise(_let(acc["ids"], lambda x: _let(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), rank_of), lambda ranks: merged(x, ranks))))

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.sequence(F.lit(1), n), state, step)["ids"])


def encode_by_functions(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and tokens (array of ids), by higher-order functions alone.

    A text's matches are made distinct and sorted, each distinct word is folded once, and every match
    finds its word's ids by a binary search in its row. Equal to encode(), and slower: the README has
    the figures of a timing by hand, for which encode() is the one that queries use.
    """
    table = rank_map(read_ranks(path))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    rows = docs.drop("n_tokens", "tokens").withColumn("__words", words)
    rows = rows.withColumn("__distinct", F.array_sort(F.array_distinct("__words")))
    rows = rows.withColumn("__folded", F.transform("__distinct", lambda w: folded(w, table)))

    def place(word: Column) -> Column:
        """The 0-based place of a word among the distinct ones: the last that is not greater."""
        halve = lambda acc, bit: F.when((acc + bit < F.size("__distinct")) & (F.get("__distinct", acc + bit) <= word), acc + bit).otherwise(acc)
        bits = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size("__distinct") + 1)).cast("int")), lambda i: F.pow(F.lit(2), F.ceil(F.log2(F.size("__distinct") + 1)) - i).cast("int"))
        return F.aggregate(bits, F.lit(0), halve)

    tokens = F.flatten(F.transform("__words", lambda w: F.get("__folded", place(w))))
    out = rows.withColumn("tokens", F.transform(tokens, lambda x: x.cast("int"))).drop("__words", "__distinct", "__folded")
    return out.withColumn("n_tokens", F.size("tokens").cast("bigint"))
