"""Mixing sources to target weights, in DataFrame functions only.

A document's size is its number of words. Sources, by code point and null last, weigh 1, 2, 3 and so on in turn, and share
the words of the whole corpus by weight; no target exceeds ``MOST`` times its source's words. The sources that reach that
limit are the first ones by words per weight, so running sums over the sources in that order decide which they are, and the
others share what is left by weight: the fixed point of sharing the excess again and again.

Within a source documents are dealt in the order of a hash of their id, then of their text. The corpus is range-sorted by
(source, hash) and summed up range by range, so a source of any share of the rows is spread over many tasks and every
document knows the words before it. A source's budget is its target rounded to words: whole epochs of the source, then the
documents at the front until exactly the budget is reached; the one at the cut gives its first words only.

Defined results: null and empty texts have size 0 and give nothing; rows without an id are hashed by their text; rows that
repeat an id and text are documents of their own; the empty source is a source; a source without words has target 0; an
empty table gives no rows; other columns are not read. All amounts are exact integers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import id_text, numbered, running, written

#: A target is at most so many times the words of its source: the largest number of epochs.
MOST = 3
WEIGHTS = 3
WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,0)"


def _draw(text: "F.Column") -> "F.Column":
    """60 bits of a hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, none, name, size, draw, tie, row): the source as a flag for null and a name, and the random keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    return written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source.isNull().alias("none"),
        F.coalesce(source, F.lit("")).alias("name"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        _draw(id_text()).alias("draw"), _draw(text).alias("tie"), F.monotonically_increasing_id().alias("row")), "sizes")


def budgets(sized: DataFrame) -> DataFrame:
    """(none, name, source_size, target, budget) of every source."""
    sources = sized.groupBy("none", "name").agg(F.sum("size").alias("source_size"))
    weight = F.pmod("position", F.lit(WEIGHTS)) + 1
    # words per weight as whole numbers: times a common multiple of the weights
    multiple = math.lcm(*range(1, WEIGHTS + 1))
    weighed = written(numbered(sources, "sources", "none", "name").select(
        "none", "name", "source_size", weight.alias("weight"), "position",
        (F.col("source_size").cast(EXACT) * F.expr(f"{multiple} div (pmod(position, {WEIGHTS}) + 1)")).alias("ratio")),
        "weights")
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = F.lit(total or 0).cast(EXACT), F.lit(weights or 0).cast(EXACT)
    order = ("ratio", "position")
    words = running(weighed, "source-words", "source_size", *order).withColumnRenamed("before", "words_before")
    both = running(words, "source-weights", "weight", *order).withColumnRenamed("before", "weight_before")
    size = F.col("source_size").cast(EXACT)
    full = size * MOST * (weights - F.col("weight_before")) <= (total - F.col("words_before") * MOST) * F.col("weight")
    marked = written(both.select("none", "name", "source_size", "weight", full.alias("full")), "shares")
    rest, open_weight = marked.agg(F.sum(F.when(F.col("full"), F.col("source_size"))),
                                   F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    left = (total - F.lit(rest or 0).cast(EXACT) * MOST).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * MOST).cast("double")).otherwise(
        left * F.col("weight") / F.lit(open_weight or 1).cast("double"))
    return marked.withColumn("target", target).select(
        "none", "name", "source_size", "target", F.floor(F.col("target") + 0.5).alias("budget"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, its source's source_size and target, and ``taken``, the words of the document that the mix takes."""
    sized = sizes(docs)
    placed = written(running(sized, "order", "size", "none", "name", "draw", "tie", "row"), "running")
    first = placed.groupBy("none", "name").agg(F.min("before").alias("first"))
    sources = written(budgets(sized).join(first, ["none", "name"]), "budgets")
    rows = placed.join(sources, ["none", "name"])
    whole = F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0 END")
    rest = F.col("budget") - whole * F.col("source_size")
    cut = F.least(F.greatest(rest - (F.col("before") - F.col("first")), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).alias("taken"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_at, doc_id, source IS NULL AS none, coalesce(source, '') AS name,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS draw, ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS tie
  FROM documents),
s AS (SELECT none, name, sum(size)::HUGEINT AS words, (row_number() OVER (ORDER BY none, name) - 1) AS n
  FROM d GROUP BY none, name),
w AS (SELECT *, (n % {WEIGHTS} + 1)::HUGEINT AS weight FROM s),
o AS (SELECT *, sum(words) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum(words) OVER up, 0) AS words_before, coalesce(sum(weight) OVER up, 0) AS weight_before FROM w
  WINDOW up AS (ORDER BY words * (6 // weight), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, {MOST} * words * (weights - weight_before) <= (total - {MOST} * words_before) * weight AS is_full FROM o),
t AS (SELECT none, name, words, CASE WHEN is_full THEN ({MOST} * words)::DOUBLE
  ELSE (total - {MOST} * coalesce(sum(words) FILTER (is_full) OVER (), 0))::DOUBLE * weight::DOUBLE
    / (sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT d.*, words, target, floor(target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY none, name
  ORDER BY draw, tie, row_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (none, name))
SELECT doc_id, size, words::BIGINT AS source_size, target, (CASE WHEN words > 0 THEN budget // words ELSE 0 END * size
  + least(greatest(CASE WHEN words > 0 THEN budget % words ELSE 0 END - before, 0), size))::BIGINT AS taken FROM p"""
