"""Sanitising, line dedup, encoding and chat formats against brute force on awkward texts."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, linededup, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c_d@e.f", "x@a..b y@a.b. z@a.b..c", "1.2.3.4.5 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111 4111-1111-1111-1111-", "41" * 16, "é😇 a@b.co +1 (375) 555-4393",
    "+12345678 +1234567890123456", "4111  1111 1111 1111", "", None, "@@a@b@c.d", "a" * 50 + "@" + "b." * 3000 + "c", "4 " * 3000, "%@x.y -@-.- a+1 (555) 555-5555@b.c", "1..2.3.4 0.0.0.0 " + "9" * 400 + ".1.1.1",
]


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = dict(map(tuple, docs.select("doc_id", pii.render(pii.base_spans(F.col("text")))).collect()))
    assert got == {i: brute_spans(t) for i, t in enumerate(ODD)}


def test_disclosing_terms(spark):
    """A name that always stands by one address tells it; it is found where the address is not, common words are not."""
    docs = [(i, f"note {i} from Quibblewick mail q.w@mail.example.com about things") for i in range(6)]
    docs += [(100 + i, f"about things and note number {i} from others mail") for i in range(300)]
    docs += [(900, "nobody saw Quibblewick today"), (901, None), (None, ""), (900, "nobody saw Quibblewick today")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit(1))
    found = pii.find(frame)
    terms = {(r["doc_id"], r["terms"][0]["start"], r["terms"][0]["value"]) for r in found.collect() if r["terms"]}
    assert terms == {(i, len(f"note {i} from "), "Quibblewick") for i in range(6)} | {(900, 11, "Quibblewick")}
    assert found.count() == len(docs)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame, found).collect()}
    assert clean[900] == "nobody saw  today" and clean[0] == "note 0 from  mail [email] about things"
    assert pii.find(frame.limit(0)).count() == 0


def test_terms_at_the_edges_of_texts_and_windows(spark):
    """Words that open or end a text are whole; those that a window's edge cuts are not."""
    import re

    address = "q.w@mail.example.com"
    texts = [f"Quibblewick mail {address} end", f"saw {address} or Quibblewick", f"{address} Quibblewick", f"Quibblewick {address}"]
    texts += [f"{'x' * a} Quibblewick {'. ' * b}{address}{' .' * c} Quibblewick{'y' * d}" for a in (0, 3) for b in (12, 13, 14, 15, 20) for c in (13, 14, 15, 16, 20) for d in (0, 3)]
    texts += [f"{a}Quibblewick{'!' * 29}{address}{'!' * 29}Quibblewick{b}" for a in ("", "Z", "\n", " ") for b in ("", "Z", "\n", " ")]

    def near(t):
        at, end = t.index(address), t.index(address) + len(address)
        places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z]{3,}", t)]
        return {w for a, b, w in places if at - pii.NEAR <= a and b <= at or end <= a and b <= end + pii.NEAR}

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("base", pii.base_spans(F.col("text")))
    got = {r["i"]: set(r["near"]) for r in rows.select("i", pii._near_terms(F.col("text"), F.col("base")[0]).alias("near")).collect()}
    assert got == {i: near(t) for i, t in enumerate(texts)}
    docs = [(i, f"Quibblewick mail {address} about things, number {i}") for i in range(6)] + [(100 + i, f"about things and number {i} from mail") for i in range(300)]
    terms = {(r["doc_id"], r["terms"][0]["value"]) for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["terms"]}
    assert terms == {(i, "Quibblewick") for i in range(6)}


def brute_lines(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        lines = (text or "").split("\n")
        solid = [(i, x.strip(" \t\r\v\f")) for i, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        covered = set()
        for j in range(len(solid) - 2):
            key = tuple(x for _, x in solid[j:j + 3])
            if key in seen:
                covered |= {i for i, _ in solid[j:j + 3]}
            seen.add(key)
        out[(doc_id, text)] = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in covered)
    return out


def test_line_dedup(spark):
    docs = [
        (1, "a\nb\nc\nd\n\ne"), (2, "x\na\n  b\nc\t\nd\nz"), (3, "q\nq\nq\nq\nq"), (4, None), (5, ""), (6, "a\nb"), (7, "x\na\nb\n\nc\nd"), (7, "x\na\nb\n\nc\nd"), (None, "a\nb\nc"),
        (9, "\n".join(f"line {i % 700}" for i in range(3000))),
    ]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_lines int")
    got = linededup.dedup(frame).collect()
    expected = brute_lines(docs)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(d[0]), str(expected[d])) for d in docs)
    assert linededup.dedup(frame.limit(0)).count() == 0


TEXTS = [
    "Hello  world\n\n  x don't 123 don’t", "", None, "a" * 700, "日本語のテキスト😇😇", "\x00\x01 a\x1cb\x85c\xa0d", "½ ²x ǅ ʰ_a __ 1_2", "é" * 300 + " ÿſ", "abcdefgh" * 40, "​  a",
]


def brute_bpe(text, ranks, pattern):
    """Ranked merges as they are defined: the leftmost pair of the lowest rank, again and again."""
    import regex

    out = []
    for word in regex.findall(pattern, text):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_bpe_equals_brute_force(spark, tokenizer):
    import numpy as np

    path, pattern = tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, tokens int")
    for r in bpe.decode(bpe.encode(docs, *tokenizer), path).collect():
        assert r["tokens"] == brute_bpe(r["text"] or "", ranks, pattern) and r["n_tokens"] == len(r["tokens"])
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == r["tokens"]
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(docs.limit(0), *tokenizer).count() == 0
    bad = spark.createDataFrame([([70000],)], "tokens array<int>")
    with pytest.raises(Exception, match="rank file"):
        bpe.decode(bad, path).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "tokens array<int>"), path).first()["decoded"] is None


def test_bpe_by_functions_equals_brute_force(spark, tokenizer):
    path, pattern = tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    texts = [t for t in TEXTS if t is None or len(t) < 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode_by_functions(docs, *tokenizer).collect():
        assert r["tokens"] == brute_bpe(r["text"] or "", ranks, pattern) and r["n_tokens"] == len(r["tokens"])


def test_bpe_equals_tiktoken(spark, tokenizer):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in bpe.encode(docs, *tokenizer).collect():
        assert r["tokens"] == reference.encode_ordinary(r["text"] or "")


def test_pii_in_long_runs(spark):
    """Runs of a megabyte and 100,000 matches take linear time; each text in a job of its own."""
    import time

    many = " ".join(f"u{i}@x{i}.co_" for i in range(100_000))
    for text, n in (("a" * 1_000_000 + " @", 0), ("1" * 1_000_000 + " 1.2", 0), (many, 100_000)):
        frame = spark.createDataFrame([(text,)], "text string")
        start = time.perf_counter()
        spans = frame.select(pii.base_spans(F.col("text")).alias("s")).first()["s"]
        assert len(spans) == n and time.perf_counter() - start < 60
        if n:
            assert all(text[s["start"]:s["end"]] == s["value"] for s in spans[::9973])


def test_chat_round_trip(spark, tokenizer):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\||>", "", None, "line\nline", "😇 ünï"]
    turns = [(c, t, ("user", "assistant", "sys\\tem\n<|x|>")[t % 3], text) for c in range(3) for t, text in enumerate(odd)]
    turns += [(None, 0, None, "alone"), (9, None, "assistant", "x"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y")]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, ids string")
    for row_tokens in (1 << 20, 5):
        got = {r["conv_id"]: r for r in chat.read_back(chat.assemble(chat.format_turns(frame, *tokenizer), row_tokens), *tokenizer).collect()}
        assert set(got) == {0, 1, 2, 9, None}
        for conv, row in got.items():
            own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
            said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
            loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
            assert row["n_turns"] == len(own) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.assemble(chat.format_turns(frame.limit(0), *tokenizer)).count() == 0
