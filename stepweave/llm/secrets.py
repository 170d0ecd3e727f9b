"""Secret scans: base patterns and multipart credentials, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they pass. The multipart method looks for weak parts,
which mean little alone: identifiers of capitals and digits, long mixed words, and endpoints. Parts are joined by
interval: a weak part is reported (``weak_access``, ``weak_secret``, ``endpoint``) only when complementary parts lie in
its scope, at most ``SCOPE`` code points away: an identifier needs a secret, a secret needs an identifier, an endpoint
needs both. Base ``access`` spans count as identifiers and ``assign`` spans as secrets; what overlaps a base span is no
weak part. The join emits no pairs: windows over the parts of one document look up the nearest part on either side.

Positions are running sums of the lengths of the pieces between matches. Parts are counted per document and place
before the first shuffle by document; documents are told apart by id and a 128-bit hash of the text.

Defined results: null reads as the empty text; a text without matches has counts 0, no spans, and the hash of the empty
text; repeated rows give one result each; rows without an id are documents too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")

#: Fixed patterns of the base kinds. Runs below the least length are left out of the pattern itself where that cannot
#: move another match: a run of one class is either long enough or not.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
LEAST_ASSIGN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: one pattern for words, told apart by what they hold, and one for hosts behind a scheme.
WORD = r"[A-Za-z0-9+/]{16,}"
ENDPOINT = r"://[A-Za-z0-9._~-]+(:[0-9]{1,5})?"


def _parts(text: "F.Column", number: int, pattern: str, kind: Callable) -> "F.Column":
    """The matches as structs (pattern, place in order, kind, length of the gap before, length)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(found.alias("match"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))

    def part(x: "F.Column", at: "F.Column") -> "F.Column":
        return F.struct(F.lit(number).alias("pattern"), at.alias("at"), kind(x["match"]).alias("kind"),
                        F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"))
    empty = F.array().cast("array<struct<pattern:int,at:int,kind:int,gap:int,size:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(both, part)).otherwise(empty)


def _kind(name: str) -> "F.Column":
    return F.lit(KINDS.index(name))


#: A match that fails keeps its place for the running sums, as kind -1; each pattern counts for itself.
PATTERNS = (
    (ASSIGN, lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN, _kind("assign")).otherwise(-1)),
    (ACCESS, lambda m: _kind("access")),
    (HEX, lambda m: _kind("hex")),
    (WORD, lambda m: F.when((F.length(m) <= 32) & ~m.rlike("[^A-Z0-9]") & m.rlike("[A-Z]") & m.rlike("[0-9]"),
                            _kind("weak_access"))
     .when((F.length(m) >= 32) & m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"), _kind("weak_secret"))
     .otherwise(-1)),
    (ENDPOINT, lambda m: _kind("endpoint")),
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, the spans (start, kind, end) in order of start and kind, of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = F.concat(*[_parts(F.col("text"), n, pattern, kind) for n, (pattern, kind) in enumerate(PATTERNS)])
    doc = ["doc_id", "text_key"]
    rows = (texts.select("doc_id", F.md5("text").alias("text_key"), F.explode_outer(parts).alias("p"))
            .select(*doc, "p.*").groupBy(*doc, "pattern", "at")
            .agg(F.first("kind").alias("kind"), F.first("gap").alias("gap"), F.first("size").alias("size"),
                 F.count(F.lit(1)).alias("copies"))
            .repartition(*doc))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*doc, "pattern").orderBy("at"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    passed = F.col("kind") >= 0
    base = passed & (F.col("kind") < 3)
    ahead = Window.partitionBy(*doc).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*doc).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)

    def nearest(rows: DataFrame, **wanted: "F.Column") -> DataFrame:
        """For each condition the greatest end at or before each start, and the least start at or behind it."""
        rows = rows.select("*", *[F.max(F.when(c, F.col("end"))).over(ahead).alias(f"{n}_before")
                                  for n, c in wanted.items()])
        return rows.select("*", *[F.min(F.when(c, F.col("start"))).over(back).alias(f"{n}_behind")
                                  for n, c in wanted.items()])

    def in_scope(name: str) -> "F.Column":
        return F.coalesce((F.col(f"{name}_before") >= F.col("start") - SCOPE)
                          | (F.col(f"{name}_behind") <= F.col("end") + SCOPE), F.lit(False))

    rows = nearest(rows, base=base)
    covered = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("base_behind") < F.col("end"), F.lit(False))
    rows = rows.withColumn("part", F.when(base, F.col("kind")).when(passed & ~covered, F.col("kind")))
    rows = nearest(rows, access=F.col("part").isin(1, 3), secret=F.col("part").isin(0, 4))
    linked = (F.when(F.col("part") == 3, in_scope("secret")).when(F.col("part") == 4, in_scope("access"))
              .when(F.col("part") == 5, in_scope("access") & in_scope("secret")).otherwise(F.col("part") >= 0))
    span = F.when(linked, F.struct(F.col("start").cast("int").alias("start"), F.col("part").alias("kind"),
                                   F.col("end").cast("int").alias("end")))
    return (rows.groupBy(*doc).agg(F.array_sort(F.collect_list(span)).alias("found"), F.max("copies").alias("copies"))
            .select("doc_id", "found", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .drop("copy"))


def _joined(found: "F.Column") -> "F.Column":
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> "F.Column":
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"))


def _sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"
    kinds = (
        f"CASE WHEN length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {LEAST_ASSIGN} THEN 0 ELSE -1 END", "1", "2",
        "CASE WHEN length(m) <= 32 AND NOT regexp_matches(m, '[^A-Z0-9]') AND regexp_matches(m, '[A-Z]') "
        "AND regexp_matches(m, '[0-9]') THEN 3 WHEN length(m) >= 32 AND regexp_matches(m, '[a-z]') "
        "AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 4 ELSE -1 END", "5")
    each = " UNION ALL ".join(
        f"SELECT row_at, {n} AS pattern, nth, {kind} AS kind, length(m) AS size, length(gap) AS gap FROM ("
        f"SELECT row_at, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, unnest(range(len(found))) AS nth FROM ("
        f"SELECT row_at, regexp_extract_all(text, {quoted(p)}) AS found, "
        f"string_split_regex(text, {quoted(p)}) AS gaps FROM d))"
        for n, ((p, _), kind) in enumerate(zip(PATTERNS, kinds)))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

    def scope(name: str) -> str:
        return f"coalesce({name}_before >= start - {SCOPE} OR {name}_behind <= stop + {SCOPE}, false)"

    def near(name: str, where: str) -> str:
        return (f"max(CASE WHEN {where} THEN stop END) OVER ahead AS {name}_before, "
                f"min(CASE WHEN {where} THEN start END) OVER back AS {name}_behind")
    windows = ("WINDOW ahead AS (PARTITION BY row_at ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
               "back AS (PARTITION BY row_at ORDER BY start DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    said = f"string_agg({names}[part + 1] || ':' || start || ':' || stop, ',' ORDER BY start, part"
    counts = ", ".join(f"count(*) FILTER (part = {n})::BIGINT AS n_{k}" for n, k in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_at, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({each}),
ended AS (SELECT *, sum(gap + size) OVER (PARTITION BY row_at, pattern ORDER BY nth) AS stop FROM parts),
placed AS (SELECT *, stop - size AS start FROM ended),
based AS (SELECT *, {near("base", "kind BETWEEN 0 AND 2")} FROM placed {windows}),
part AS (SELECT row_at, start, stop, CASE WHEN kind BETWEEN 0 AND 2 THEN kind WHEN kind > 2
    AND NOT coalesce(base_before > start, false) AND NOT coalesce(base_behind < stop, false) THEN kind END AS part
  FROM based),
near AS (SELECT *, {near("access", "part IN (1, 3)")}, {near("secret", "part IN (0, 4)")} FROM part {windows}),
kept AS (SELECT * FROM near WHERE CASE part WHEN 3 THEN {scope("secret")} WHEN 4 THEN {scope("access")}
    WHEN 5 THEN {scope("access")} AND {scope("secret")} ELSE part >= 0 END),
said AS (SELECT row_at, {counts}, coalesce({said}) FILTER (part < 3), '') AS base,
    coalesce({said}), '') AS spans FROM kept GROUP BY row_at)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (row_at)"""


SQL = _sql()
