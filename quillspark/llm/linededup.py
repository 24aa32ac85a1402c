"""Line dedup over windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables, materialize, small

#: Consecutive lines of a window.
WINDOW = 3
_BLANK = " \t\r\x0b\x0c"


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text less its repeated passages, and n_lines and n_removed (long).

    Lines are the parts of a text between line feeds. Windows are WINDOW consecutive lines that are
    not blank, compared without blanks at their ends. The first occurrence of a window, by doc_id
    and then by place, stays; the lines of all later ones, merged where they overlap, are removed.
    Blank lines and lines of texts with fewer lines stay. Rows equal in doc_id and text are one
    document and keep the same lines. Null and empty texts are unchanged (null: 0 lines); null
    doc_ids come first. Other columns stay; columns named n_lines or n_removed are replaced.

    Each text is split and hashed once; windows (hashes and places, no lines) are written. Hashes
    that occur again are found by a grouping with partial sums, and joined back to the windows: by
    broadcast if they are few, else by a join of two written tables, which adaptive execution
    splits where one window is in a third of all documents. Texts meet the lines they lose by
    broadcast if few lines go, else by one shuffle.
    """
    held, docs = Tables(), docs.drop("n_lines", "n_removed")
    at = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("at")
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_BLANK)).alias("line"))),
        lambda x: x["line"] != "",
    )
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
        lambda j: F.struct(
            F.xxhash64(*[F.element_at("lines", j + k)["line"] for k in range(WINDOW)]).alias("h"),
            F.hash(*[F.element_at("lines", j + k)["line"] for k in range(WINDOW)]).alias("g"),
            F.transform(F.array(*[F.lit(k) for k in range(WINDOW)]), lambda k: F.element_at("lines", j + k)["i"]).alias("covers"),
        ),
    )
    windows = held.keep(
        docs.select(at, lines.alias("lines")).where(F.size("lines") >= WINDOW)
        .select("at", F.explode(hashes).alias("w")).select("at", "w.*")
    )
    place = F.struct("at", F.element_at("covers", 1).alias("i"))
    firsts = held.keep(windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"))
    covered = materialize(
        windows.join(small(firsts), ["h", "g"]).where(place > F.col("first")).select("at", F.explode("covers").alias("i"))
        .groupBy("at").agg(F.collect_set("i").alias("lines"))
    )
    held.close()
    # Whatever columns docs has, these two are structs of this join alone.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), at)
    rows = rows.alias("r").join(small(covered).alias("c"), F.col("r.at").eqNullSafe(F.col("c.at")), "left").select("row", F.col("c.lines").alias("gone"))
    parts = F.split("row.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    return rows.select(
        *[
            F.when(F.col("gone").isNull(), F.col("row.text"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")).alias("text")
            if c == "text" else F.col(f"row.`{c}`") for c in docs.columns
        ],
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
    )


#: DuckDB SQL for query op9_lines.
ORACLE = r"""
WITH docs AS (SELECT doc_id, text, hash(text) AS key FROM documents),
d AS (SELECT DISTINCT doc_id, key, text FROM docs),
parts AS (SELECT doc_id, key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
solid AS (SELECT doc_id, key, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM parts
          WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT doc_id, key, i AS i0, line AS l0,
             lead(i, 1) OVER o AS i1, lead(line, 1) OVER o AS l1, lead(i, 2) OVER o AS i2, lead(line, 2) OVER o AS l2
      FROM solid WINDOW o AS (PARTITION BY doc_id, key ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, key, i0) AS n FROM w WHERE i2 IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, key, unnest([i0, i1, i2]) AS i FROM ranked WHERE n > 1),
kept AS (SELECT p.doc_id, p.key, string_agg(p.line, chr(10) ORDER BY p.i) AS text, count(*) AS n
         FROM parts p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.key = c.key AND p.i = c.i GROUP BY ALL)
SELECT docs.doc_id, len(string_split(docs.text, chr(10)))::BIGINT AS n_lines,
       (len(string_split(docs.text, chr(10))) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS text_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id AND kept.key = docs.key
"""
