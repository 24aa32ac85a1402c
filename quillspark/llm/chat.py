r"""Chat formatting at the level of tokens.

Each turn becomes the ids of

    <|im_start|> role \n text <|im_end|> \n

where the two control tokens are reserved ids behind the vocabulary's and every other segment is
encoded by itself, so that no merge crosses a boundary. Control strings inside roles and texts are
escaped: each <| gets a backslash between its characters, <\| another one, and so on, which is
undone without loss. The loss mask marks the tokens of assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.bpe import _bpe, read_ranks

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts are learned.
LEARNED = "assistant"
#: Tokens of a row of assemble(); longer conversations go on in further rows.
ROW_TOKENS = 1 << 20
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(role: str) -> str:
    """As escape(); besides, a role keeps to its line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _mask(lengths: list[int], learned: list[bool]) -> np.ndarray:
    """1 for the tokens of learned segments: running sums of steps at the segments' edges."""
    ends = np.cumsum(lengths)
    steps = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
    np.add.at(steps, (ends - lengths)[learned], 1)
    np.add.at(steps, ends[learned], -1)
    return np.cumsum(steps)[:-1].astype(np.uint8)


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, mask) for rows (conv_id, turn, role, text); narrow.

    ids is binary, little-endian unsigned 32-bit; mask is binary, a byte for each id. A null role
    or text counts as empty; other columns are dropped.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    content = read_ranks(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(content, pattern)
        first = len(bpe.words)
        start, end = np.array([first]), np.array([first + 1])
        line = next(iter(bpe.encode(["\n"])))
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            coded = list(bpe.encode([*map(escape_role, roles), *map(escape, texts)]))
            ids, masks = [], []
            for role, head, body in zip(roles, coded, coded[len(roles):], strict=False):
                segments = [start, head, line, body, end, line]
                ids.append(np.concatenate(segments).astype("<u4").tobytes())
                masks.append(_mask([len(s) for s in segments], [i == 3 and role == LEARNED for i in range(6)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=[*batch.schema.names, "ids", "mask"]
            )

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("mask", T.BinaryType())]))


def assemble(formatted: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """(conv_id, chunk, ids, mask): a conversation's turns in order (by turn, role, text) as one row.

    Conversations of more than row_tokens ids go on in further chunks, cut between turns, which
    follow each other in the partition; so memory is bounded however long a conversation is. One
    shuffle by conv_id; null conv_ids are one conversation.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    kind = dealt.schema["conv_id"].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, chunk, held, ids, mask, out = None, 0, 0, [], [], []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])
            for conv, i, m in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                new = not ids and chunk == 0 or conv != now
                if ids and (new or held + len(m) > row_tokens):
                    out.append((now, chunk, b"".join(ids), b"".join(mask)))
                    chunk, held, ids, mask = chunk + 1, 0, [], []
                if new:
                    now, chunk = conv, 0
                ids.append(i)
                mask.append(m)
                held += len(m)
                if len(out) >= 1000 or out and sum(len(x[2]) for x in out[-1:]) > row_tokens:
                    yield batch_of()
                    out = []
        if ids:
            out.append((now, chunk, b"".join(ids), b"".join(mask)))
        if out:
            yield batch_of()

    return dealt.mapInArrow(each, T.StructType([
        T.StructField("conv_id", kind), T.StructField("chunk", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("mask", T.BinaryType()),
    ]))


def read_back(assembled: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of what assemble()'s rows say, which must still be in their order (else it is an error); one row a conversation.

    n_turns, turns_sha256 (role, line feed, text, line feed for each turn), loss_chars and
    loss_sha256 (the text under the mask, unescaped), formatted_chars (of the template's text).
    """
    content = read_ranks(path)
    kind = assembled.schema["conv_id"].dataType

    def turns(ids: np.ndarray, mask: np.ndarray, bpe) -> Iterator[tuple[str, str, str, int]]:
        first = len(bpe.words)
        starts, ends = np.flatnonzero(ids == first), np.flatnonzero(ids == first + 1)
        for a, b in zip(starts, ends, strict=True):
            inside = bpe.decode(ids[a + 1:b]).decode("utf-8", "surrogatepass")
            role, _, text = inside.partition("\n")
            learned = bpe.decode(ids[a + 1:b][mask[a + 1:b] == 1]).decode("utf-8", "surrogatepass")
            yield unescape_role(role), unescape(text), unescape(learned), len(START) + len(inside) + len(END) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema, state, last, out = _bpe(content, pattern), None, None, None, []

        def done() -> tuple:
            conv, n, said, chars, loss, total = state
            return conv, n, said.hexdigest(), chars, loss.hexdigest(), total

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
            ])
            for conv, chunk, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "ids", "mask")), strict=True):
                if chunk != (0 if last is None or chunk == 0 else last[1] + 1) or chunk and conv != last[0]:
                    raise ValueError(f"chunk {chunk} of conversation {conv} does not follow {last}: rows are not in the order of assemble()")
                last = conv, chunk
                if chunk == 0:
                    if state:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learned, chars in turns(np.frombuffer(ids, dtype="<u4"), np.frombuffer(mask, dtype=np.uint8), bpe):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
                    state[5] += chars
            if len(out) >= 1000:
                yield batch_of()
                out = []
        if state:
            out.append(done())
        if out:
            yield batch_of()

    return assembled.mapInArrow(each, T.StructType([
        T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ]))


#: DuckDB SQL for query op8_chat.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS er,
             regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
