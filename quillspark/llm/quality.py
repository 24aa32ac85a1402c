"""Quality rules: measures of each text, and verdicts on hosts by their shrunken rates of failure.

Texts are measured in one narrow pass. A host's rate of documents that fail a rule is drawn towards
the rate of all by a beta prior that is fitted to the hosts themselves, so a host of few documents
is not judged by them alone; hosts whose rate stays high lose all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Tables, sliced, small

#: A document of fewer words fails; so does one of whose words more than this share, in percent, lies in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: More symbols than this in 100 words, or more repeated lines than this in 100, are failures too, and so are words of such mean lengths.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTHS = 25, 50, (2, 20)
#: Words of a window that is looked for again.
WINDOW = 5
#: A host is rejected where at least this share of its documents fails a rule, once shrunk.
HOST_RATE = 0.5
#: Weight of the prior, in documents: where hosts differ as much as can be, and where they differ by no more than chance.
WEAKEST, STRONGEST = 1.0, 1e9

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _repeated(words: list[bytes]) -> int:
    """How many words lie in windows of WINDOW words that the text holds twice or more; words are compared, not hashes."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0  # no word comes twice
    window = word
    for k in range(1, WINDOW):
        # Windows of k words have numbers below n, so a pair with the next word has one of its own.
        pairs = window[: n - k] * np.int64(n) + word[k:]
        window = np.unique(pairs, return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measured(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of a whole text in UTF-8; all 0 for null.

    Words are what blanks and the characters 9 to 13 leave; n_lines and n_dup_lines count lines with
    a word, the latter those that are equal to an earlier one.
    """
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()  # of bytes: at ASCII white space alone
    raw = np.frombuffer(text, dtype=np.uint8)
    chars = int(np.count_nonzero(~_SPACE[raw] & ((raw & 0xC0) != 0x80)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, int(np.count_nonzero(_SYMBOLS[raw])), len(lines), len(lines) - len(set(lines)), _repeated(words)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text and with MEASURES of it; a column named like one is replaced. Narrow."""
    rest = [f for f in docs.schema.fields if f.name not in (text, *MEASURES)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            rows = [measured(t) for t in batch.column("__text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *columns], names=[*(f.name for f in rest), *MEASURES])

    given = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text}`").cast("binary").alias("__text"))
    return given.mapInArrow(each, T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in MEASURES]]))


def base_failed() -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def failed() -> Column:
    """A document fails the base rules or those on symbols, repeated lines and lengths of words."""
    return (
        base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
        | ~(F.col("word_chars") / F.greatest("n_words", F.lit(1))).between(*WORD_LENGTHS)
    )


def prior(hosts: DataFrame) -> tuple[float, float]:
    """(rate, weight) of the beta prior of hosts(documents, failures), by moments.

    rate is that of all documents; weight says how many documents it counts for: few where hosts
    differ, WEAKEST at least, STRONGEST where they differ by chance alone. Without documents the rate is 0.
    """
    n, f = F.col("documents").cast("double"), F.col("failures").cast("double")
    row = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("h"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    if not row["n"]:
        return 0.0, STRONGEST
    rate = row["f"] / row["n"]
    spread, noise = row["ff"] - row["n"] * rate * rate, (row["h"] - 1) * rate * (1 - rate)
    room = row["n"] - row["nn"] / row["n"]
    between = (spread - noise) / room if room > 0 else 0.0
    if between <= 0 or not 0 < rate < 1:
        return rate, STRONGEST
    return rate, min(max(rate * (1 - rate) / between - 1, WEAKEST), STRONGEST)


def host_verdicts(documents: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """(host, documents, failures, rate, host_kept) of documents(host, failed); rows without a host have no verdict."""
    held = Tables()
    hosts = held.keep(documents.where("host is not null").groupBy("host").agg(F.count("*").alias("documents"), F.count_if("failed").alias("failures")))
    rate, weight = prior(hosts)
    shrunk = (F.col("failures") + F.lit(rate * weight)) / (F.col("documents") + F.lit(weight))
    out = hosts.select("*", shrunk.alias("rate")).withColumn("host_kept", F.col("rate") < most)
    out._scratch_path = hosts._scratch_path
    return out


def judge(docs: DataFrame, host: Column, carried: Sequence[str] = ("doc_id",), text: str = "text", most: float = HOST_RATE) -> DataFrame:
    """(carried..., host, MEASURES..., base_failed, failed, host_rate, kept) of each document.

    A document is kept if it does not fail the base rules and its host is not rejected; what fails
    only the other rules counts against its host and stays. A null host has no verdict, and its
    documents stand for themselves. Null and empty texts have no words and fail. Repeated rows and
    null ids are rows like any others, an empty table gives no rows, other columns are ignored.
    """
    held = Tables()
    rows = held.keep(measure(docs.select(*carried, host.cast("string").alias("host"), F.col(text).alias(text)), text).withColumn("base_failed", base_failed()).withColumn("failed", failed()))
    hosts = host_verdicts(rows, most)
    verdicts = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "host_kept")
    met = rows.join(small(verdicts, hosts), F.col("host") == F.col("__host"), "left")
    return met.select(*carried, "host", *MEASURES, "base_failed", "failed", "host_rate", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


#: The words of a text in SQL.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, row_number() OVER () AS row FROM documents),
win AS (SELECT row, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY row),
line AS (SELECT row, l FROM (SELECT row, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM line GROUP BY row),
m AS (SELECT d.row, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.row = d.row LEFT JOIN lines ON lines.row = d.row),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 100 * n_symbols > {MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {MOST_DUP_LINES} * n_lines
  OR NOT word_chars::DOUBLE / greatest(n_words, 1) BETWEEN {WORD_LENGTHS[0]} AND {WORD_LENGTHS[1]} AS failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(failed)::DOUBLE AS f FROM g WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS p, sum(f * f / n) - sum(n) * (sum(f) / sum(n)) ** 2 AS spread, count(*) - 1 AS k, sum(n) - sum(n * n) / sum(n) AS room FROM h),
b AS (SELECT p, CASE WHEN room > 0 THEN (spread - k * p * (1 - p)) / room ELSE 0 END AS between_ FROM s),
q AS (SELECT p, CASE WHEN between_ <= 0 OR p <= 0 OR p >= 1 THEN {STRONGEST} ELSE least(greatest(p * (1 - p) / between_ - 1, {WEAKEST}), {STRONGEST}) END AS weight FROM b),
v AS (SELECT source, (f + p * weight) / (n + weight) < {HOST_RATE} AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept FROM g LEFT JOIN v USING (source)"""
