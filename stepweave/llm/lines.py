"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Every run of ``SPAN`` consecutive lines is hashed (128 bits). A window found more than once anywhere in the corpus is
repeated; its first occurrence, by doc_id and position, stays. Every later occurrence covers its lines, covered positions
are merged into intervals and removed. Lines are compared as they are and windows of blank lines only are left out.

Window counts are added up before the shuffle, and only repeated windows, with their first place, are kept in a written
table; looking all windows up in it is a plain join, which adaptive execution splits where one window is very common.

Defined results: null stays null with no lines; a text of fewer than three lines has no window and stays; an empty text
is one empty line; rows without an id come last in the order; rows that repeat an id and text are one document and are
treated alike; a window that repeats in its own document is cut there too; other columns are kept by ``dedup_text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import id_text, whole_row, written

SPAN = 3
_DOC = ("line_id", "line_key", "line_key2")


def _keyed(docs: DataFrame) -> DataFrame:
    """The document's key beside its whole ``row`` and its ``own_text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(whole_row(docs), F.col("text").cast("string").alias("own_text"), id_text().alias(_DOC[0]),
                       F.xxhash64(text).alias(_DOC[1]), F.xxhash64(F.lit(SPAN), text).alias(_DOC[2]))


def _windows(docs: DataFrame) -> DataFrame:
    """(document, pos, hash of the lines pos, pos + 1, pos + 2) of every window that is not blank."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = keyed.select("row.doc_id", *_DOC, F.split("own_text", "\n", -1).alias("lines")).where(F.size("lines") >= SPAN)

    def window(at: "F.Column") -> "F.Column":
        part = [F.col("lines")[at + i] for i in range(SPAN)]
        return F.struct(at.alias("pos"), F.xxhash64(*part).alias("w1"), F.xxhash64(F.lit(SPAN), *part).alias("w2"),
                        F.concat(*part).rlike(r"\S").alias("full"))
    at = F.sequence(F.lit(0), F.size("lines") - SPAN)
    return rows.select("doc_id", *_DOC, F.explode(F.transform(at, window)).alias("w")).select(
        "doc_id", *_DOC, "w.*").where("full").drop("full")


def covered_lines(docs: DataFrame) -> DataFrame:
    """The distinct line positions that later occurrences cover, one row per document that has any."""
    windows = _windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_key", "line_key2", "pos")
    repeated = written(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                       .where("n > 1").drop("n"), "windows")
    later = windows.join(repeated, ["w1", "w2"]).where(place != F.col("first"))
    return (later.groupBy(*_DOC).agg(F.collect_set("pos").alias("found"))
            .select(*_DOC, F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda p: F.sequence(
                p, p + SPAN - 1))))).alias("covered")))


def _cut(docs: DataFrame) -> DataFrame:
    """Every ``row`` with ``kept_text``, ``n_lines``, ``n_removed`` and the ``removed`` intervals."""
    joined = _keyed(docs).join(covered_lines(docs), list(_DOC), "left")
    rows = joined.select("row", "own_text", F.coalesce("covered", F.array().cast("array<int>")).alias("covered"),
                         F.split("own_text", "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    first = F.array_except("covered", F.transform("covered", lambda x: x + 1))
    last = F.array_except("covered", F.transform("covered", lambda x: x - 1))
    text = F.when(F.size("covered") == 0, F.col("own_text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    return rows.select(
        "row", text.alias("kept_text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.size("covered").cast("bigint").alias("n_removed"),
        F.transform(F.arrays_zip(first.alias("first"), last.alias("last")),
                    lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` and the ``removed`` intervals, which
    take the place of columns of these names."""
    found = _cut(docs)
    new = [c for c in found.columns if c != "row"]
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *new)


def dedup_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; ``n_chars`` follows where there is such a column of numbers or
    strings. All other columns stay as they are, whatever their names."""
    found, kinds = _cut(docs), {f.name: f.dataType for f in docs.schema}

    def column(name: str) -> "F.Column":
        own = F.col(f"row.`{name}`")
        if name == "text":
            return F.col("kept_text").alias(name)
        if name == "n_chars" and isinstance(kinds[name], (T.NumericType, T.StringType)):
            return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kinds[name])).otherwise(own).alias(name)
        return own
    return found.select(*[column(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: F.concat_ws(
        "-", x["first"], x["last"])), ",").alias("removed"), F.col("kept_text").alias("text"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_at, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT row_at, doc_id, i, lines[i + 1:i + {SPAN}] AS part
  FROM (SELECT *, unnest(range(greatest(len(lines) - {SPAN - 1}, 0))) AS i FROM d)),
ranked AS (SELECT row_at, i, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS LAST, i) AS n FROM w
  WHERE regexp_matches(array_to_string(part, ''), '\\S')),
hit AS (SELECT DISTINCT row_at, i + s AS pos FROM ranked, range({SPAN}) r(s) WHERE n > 1),
runs AS (SELECT row_at, min(pos) AS a, max(pos) AS b FROM
  (SELECT *, pos - row_number() OVER (PARTITION BY row_at ORDER BY pos) AS run FROM hit) GROUP BY row_at, run),
said AS (SELECT row_at, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1)::BIGINT AS n FROM runs
  GROUP BY row_at),
kept AS (SELECT l.row_at, string_agg(line, chr(10) ORDER BY pos) AS text FROM
  (SELECT row_at, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d SEMI JOIN said USING (row_at)) l
  ANTI JOIN hit h ON h.row_at = l.row_at AND h.pos = l.pos GROUP BY l.row_at)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
  coalesce(removed, '') AS removed, CASE WHEN n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN said USING (row_at) LEFT JOIN kept USING (row_at)"""
