"""Personal data by information-theoretic sanitisation; DataFrame functions only.

Protected entities are what four expressions find (email, ip, card, phone). A term standing near an
entity discloses it when its pointwise mutual information with the entity, over the distinct texts
of the whole corpus, reaches the entity's own information divided by ALPHA: with documents counted,

    log2(n(t, e) n / (n(t) n(e)))  >=  log2(n / n(e)) / ALPHA.

Such terms get spans of their own wherever they occur, beside the entities' spans. Sanitising
generalises an entity to its kind's label and removes a disclosing term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, release, small

#: Strictness: 1 asks that a term is never seen without the entity; higher finds more terms.
ALPHA = 1.05
#: Distinct texts in which a term must stand near an entity, and how many characters near is.
SUPPORT, NEAR = 3, 40

KINDS = ("email", "ip", "card", "phone")
# The expressions match what the nested forms of their definitions match, written without repeated
# groups, since those recurse in java.util.regex: a card is extended while a digit follows at once or
# after one separator, a domain while a letter follows at once or after one dot.
# A run of a kind's first characters is tried from its start only (or where the match before it ended):
# what follows the run decides, so no later start in it can match, and long runs cost linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?!\.?[A-Za-z0-9-])"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x20-]*?(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True))
#: A text without this holds no valid match.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_TERM = r"\p{L}{3,}"


def _matches(text: Column, pattern: Column, kind: Column) -> Column:
    """All leftmost matches as struct(kind, start, end, value), in code points, end exclusive.

    The text's gaps between matches have known lengths, so starts are running sums. These are taken
    over blocks of the square root of their number, so 100,000 matches of a text do not copy a
    growing array each.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, v: acc + v)
    counted = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1),
        lambda m, g: F.struct(F.length(g).alias("gap"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("step"), m.alias("value")),
    )
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def spans(found: Column) -> Column:
        steps = F.transform(found, lambda x: x["step"])
        width = F.ceil(F.sqrt(F.size(found))).cast("int")
        return let(F.struct(steps.alias("steps"), width.alias("width")), lambda s: let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(s["steps"]) - 1) / s["width"]).cast("int")), lambda b: total(F.slice(s["steps"], b * s["width"] + 1, s["width"]))),
            lambda blocks: let(
                F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))),
                lambda before: F.transform(found, lambda x, i: let(
                    F.get(before, F.floor(i / s["width"]).cast("int"))
                    + total(F.slice(s["steps"], F.floor(i / s["width"]).cast("int") * s["width"] + 1, i % s["width"])) + x["gap"],
                    lambda start: F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")),
                )),
            ),
        ))

    # The last part of the split has no match after it.
    return let(F.filter(counted, lambda x: x["value"].isNotNull()), lambda found: F.when(F.size(found) == 0, empty).otherwise(spans(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["value"])


def _by_start(spans: Column) -> Column:
    """By start, then kind as listed (terms last), then end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"])
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s.alias("span")))),
        lambda x: x["span"],
    )


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end, value) of the four kinds in a text, sorted; null counts as empty.

    Each kind by itself: leftmost matches that do not overlap, those that fail the kind's test dropped.
    """
    text = F.coalesce(text, F.lit(""))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    each = []
    for kind in KINDS:
        hinted = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINTS[kind])
        found = F.filter(_matches(text, F.lit(_PATTERNS[kind]), F.lit(kind)), _test(kind))
        each.append(F.when(hinted, found).otherwise(empty))
    return _by_start(F.concat(*each))


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _entity(span: Column) -> Column:
    """An entity's identity: its digits, or its text in lower case."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _near_terms(text: Column, span: Column) -> Column:
    """The words that stand whole within NEAR characters before or after a span, in lower case."""
    # One character more on each side tells whether a word goes on outside; a text's own edge cuts none.
    start = F.greatest(F.lit(0), span["start"] - NEAR - 1)
    before = F.substring(text, start + 1, span["start"] - start)
    before = F.when(span["start"] > NEAR, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.substring(text, span["end"] + 1, F.lit(NEAR + 1))
    after = F.when(F.length(after) > NEAR, F.regexp_replace(after, r"\p{L}+\z", "")).otherwise(after)
    words = F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), after)), F.lit(_TERM), F.lit(0))
    return F.array_distinct(words)


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text_md5, base, terms) for each row of docs(doc_id, text).

    base and terms are arrays of spans (kind, start, end, value), sorted by start; kind is term for
    the method's own. A null text counts as empty and has none; repeated rows give repeated rows;
    null doc_ids stay; other columns are ignored. Counts are over all distinct texts, so copies
    count once. Contexts are aggregated by (entity, term) with partial sums; the corpus is read once
    more for the candidate terms only and texts with disclosing terms once more for their places.
    """
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_md5", F.md5("text"))
    spanned = known.withColumn("base", base_spans(F.col("text")))
    near = F.flatten(F.transform("base", lambda s: F.transform(_near_terms(F.col("text"), s), lambda t: F.struct(_entity(s).alias("entity"), t.alias("term")))))
    based = materialize(spanned.select("doc_id", "text_md5", "base", F.array_distinct(near).alias("near")))
    contexts = materialize(
        based.where(F.size("near") > 0).select("text_md5", F.explode("near").alias("p")).select("text_md5", "p.entity", "p.term").distinct()
    )
    total = based.agg(F.count_distinct("text_md5")).first()[0]
    # A term that discloses e stands in at most (n / n(e)) ** (1 - 1 / alpha) times n(t, e) texts; the
    # texts in which it stands near any entity are some of them, which rules out common words early.
    seen = contexts.select("term", "text_md5").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = materialize(
        contexts.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= support).join(seen, "term")
        .where(F.col("n_near") <= F.col("together") * F.pow(F.lit(float(max(total, 1))) / F.col("together"), F.lit(1 - 1 / alpha)) + 1e-9)
    )
    release(contexts)
    no_terms = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    if pairs.isEmpty():
        release(pairs)
        return based.select("doc_id", "text_md5", "base", no_terms.alias("terms"))

    entities = (
        based.where(F.size("base") > 0).select("text_md5", F.explode(F.transform("base", _entity)).alias("entity")).distinct()
        .groupBy("entity").agg(F.count("*").alias("n_entity"))
    )
    held = materialize(
        known.select("text_md5", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))
        .join(small(pairs.select("term").distinct(), pairs), "term").distinct()
    )
    terms = held.groupBy("term").agg(F.count("*").alias("n_term"))
    telling = F.log2(F.col("together") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    disclosing = materialize(
        pairs.join(entities, "entity").join(terms, "term").where((own > 0) & (telling >= own / alpha - 1e-9)).select("term").distinct()
    )
    where = materialize(held.join(small(disclosing), "term").groupBy("text_md5").agg(F.sort_array(F.collect_set("term")).alias("words")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}])"))
    placed = (
        known.select("text_md5", "text").join(small(where), "text_md5")
        .select("text_md5", _matches(F.col("text"), pattern, F.lit("term")).alias("terms")).dropDuplicates(["text_md5"])
    )
    placed = materialize(placed)
    for table in (pairs, held, disclosing, where):
        release(table)
    return based.join(small(placed), "text_md5", "left").select(
        "doc_id", "text_md5", "base", F.coalesce("terms", no_terms).alias("terms")
    )


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with entities generalised to [kind] and disclosing terms removed.

    found is find(docs). Of overlapping spans the first counts, the longer if they start together.
    """
    spans = found.select("text_md5", _by_start(F.concat("base", "terms")).alias("spans")).dropDuplicates(["text_md5"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_md5", F.md5("text")).join(spans, "text_md5", "left")
    cut = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                     F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"),
            s["end"].alias("at"),
        )),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return rows.select("doc_id", cut.alias("text"))
