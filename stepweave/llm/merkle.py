"""A Merkle manifest of the dataset by butterfly exchange.

Every row is a leaf. Within a language leaves ascend by doc_id and every ``FANOUT`` consecutive nodes become their parent,
until one remains, the subroot; subroots, by language, become the root in the same way. Leaves are numbered by a range sort,
so a language of any size is cut into partitions aligned to ``FANOUT ** LEVELS`` leaves. A partition hashes its own subtree.
Then all partitions go up together, round by round: those whose numbers differ in one digit to the base ``FANOUT`` swap the
roots they hold, and each hashes the common ancestor for itself. After the last round every partition holds the root and all
siblings on its path, so proofs need no pass downward. Where the last node of a level covers fewer partitions than its
neighbours, its partitions answer for the missing ones in turn. Languages are exchanged likewise behind their own rounds.

A round is a join and a grouping of at most ``FANOUT`` small rows per partition, and its table is written; the number of
rounds is the logarithm of the number of partitions.

Defined results: a leaf hashes its fields with lengths, a null as ``-``, so null and empty differ; missing ids come first;
rows of equal id follow the order of their leaves, so repeated rows give the same result wherever they lie; a row without
an id is never tampered with; a lone leaf is its own subroot and a lone subroot the root; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import numbered, written

FANOUT = 8
#: Levels hashed inside a partition.
LEVELS = 3
BLOCK = FANOUT ** LEVELS
TAMPERED = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(*parts: "F.Column") -> "F.Column":
    return F.sha2(F.concat(*parts), 256)


def _field(value: "F.Column") -> "F.Column":
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered, row): the leaf, and that of the tampered text where the row is tampered with."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("bigint")
    ahead = [_field(x) for x in (doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint"))]
    picked = F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0
    return written(docs.select(
        doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), _hash(*ahead, _field(text)).alias("leaf"),
        F.when(picked, _hash(*ahead, _field(F.translate(text, UPPER, LOWER)))).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "leaves", compression="zstd")


def _depth(count: "F.Column") -> "F.Column":
    """Levels above ``count`` nodes."""
    return sum((F.lit(FANOUT ** k) < count).cast("int") for k in range(21))


def _parents(nodes: "F.Column") -> "F.Column":
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(nodes) / FANOUT) - 1, F.lit(0)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def partitions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The languages (lang_at, n, blocks, depth) and the partitions with their leaves, inner levels and root."""
    placed = numbered(rows, "placed", "lang", "doc_id", "leaf", "row")
    langs = placed.groupBy("lang").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    langs = written(numbered(langs, "langs", "lang").select(
        F.col("lang").alias("of_lang"), F.col("position").alias("lang_at"), "first", "n",
        F.ceil(F.col("n") / BLOCK).alias("blocks"), _depth(F.col("n")).alias("depth")), "lang-sizes")
    at = F.col("position") - F.col("first")
    rows = placed.join(langs, F.col("lang").eqNullSafe(F.col("of_lang")))
    found = rows.groupBy("lang_at", F.expr(f"(position - first) div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "doc_id", "leaf", "tampered"))).alias("docs"),
        F.first("blocks").alias("blocks"), F.first("depth").alias("depth"))
    found = found.withColumn("level0", F.col("docs.leaf"))
    none = F.array().cast("array<string>")
    for k in range(1, LEVELS):
        found = found.withColumn(f"level{k}", F.when(F.col("depth") >= k, _parents(F.col(f"level{k - 1}"))).otherwise(none))
    node = _parents(F.col(f"level{LEVELS - 1}"))[0]
    for k in reversed(range(LEVELS)):
        node = F.when(F.col("depth") <= k, F.col(f"level{k}")[0]).otherwise(node)
    return langs, written(found.withColumn("node", node), "subtrees", compression="zstd")


def _partners(at: "F.Column", count: "F.Column", step: int) -> "F.Column":
    """The nodes of the run that holds the node of ``at``, each with the one of its ``step`` members to ask for it."""
    node = F.floor(at / step)
    first = node - node % FANOUT
    last = F.least(first + FANOUT, F.ceil(count / step)) - 1
    return F.transform(F.sequence(first, last), lambda q: F.struct(
        q.alias("slot"), (q == node).alias("own"),
        (q * step + (at % step) % F.least(F.lit(step), count - q * step)).alias("ask")))


def _swap(state: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """One round: every partition gets the nodes it asks for, hashes their parent and adds its siblings to its path."""
    roots = state.select(F.col("lang_at").alias("from_lang"), F.col("block").alias("from_block"), F.col("node").alias("got"))
    kept = [c for c in state.columns if c not in ("lang_at", "block", "node", "path")]
    run = F.array_sort(F.collect_list(F.struct("p.slot", "p.own", "got"))).alias("run")
    found = (asked.join(roots, ["from_lang", "from_block"]).groupBy("lang_at", "block")
             .agg(run, F.first(F.when(F.col("p.own"), F.col("path")), ignorenulls=True).alias("path"),
                  *[F.first(c).alias(c) for c in kept]))
    own = F.array_position("run.own", True).cast("int")
    around = F.struct(F.array_join(F.slice("run.got", 1, own - 1), "").alias("before"),
                      F.array_join(F.slice("run.got", own + 1, FANOUT), "").alias("after"))
    return written(found.select("lang_at", "block", _hash(F.array_join("run.got", "")).alias("node"),
                                F.concat("path", F.array(around)).alias("path"), *kept), name)


def exchange(langs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang_at, block, subroot, root, path) of every partition; path holds the siblings of each level above it."""
    path = F.array().cast("array<struct<before:string,after:string>>")
    state = blocks.select("lang_at", "block", "blocks", "depth", "node", path.alias("path"))
    n_langs, deepest = langs.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    for k in range(LEVELS, deepest):
        growing = state.where(F.col("depth") > k)
        partners = _partners(F.col("block"), F.col("blocks"), FANOUT ** (k - LEVELS))
        asked = growing.select("*", F.explode(partners).alias("p")).withColumns(
            {"from_lang": F.col("lang_at"), "from_block": F.col("p.ask")})
        state = _swap(growing, asked, f"round-{k}").unionByName(state.where(F.col("depth") <= k))
    state = state.withColumn("subroot", F.col("node"))
    sizes = langs.select(F.col("lang_at").alias("from_lang"), F.col("blocks").alias("from_blocks"))
    step = 1
    while step < n_langs:
        asked = state.select("*", F.explode(_partners(F.col("lang_at"), F.lit(n_langs), step)).alias("p")).withColumn(
            "from_lang", F.col("p.ask")).join(sizes, "from_lang").withColumn("from_block", F.col("block") % F.col("from_blocks"))
        state = _swap(state, asked.drop("from_blocks"), f"round-langs-{step}")
        step *= FANOUT
    return state.select("lang_at", "block", "subroot", F.col("node").alias("root"), "path")


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, leaf, subroot, root, proof_sha256, and the root folded from its (tampered) leaf and its proof."""
    langs, blocks = partitions(leaves(docs))
    rows = blocks.join(exchange(langs, blocks), ["lang_at", "block"])
    above = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")

    def proven(doc: "F.Column", i: "F.Column") -> "F.Column":
        folded, siblings = F.coalesce(doc["tampered"], doc["leaf"]), []
        for k in range(LEVELS):
            node = F.floor(i / FANOUT ** k).cast("int")
            slot = node % FANOUT
            before = F.array_join(F.slice(f"level{k}", node - slot + 1, slot), "")
            after = F.array_join(F.slice(f"level{k}", node + 2, FANOUT - 1 - slot), "")
            there = F.col("depth") > k
            siblings += [F.when(there, x).otherwise("") for x in (before, after)]
            folded = F.when(there, _hash(before, folded, after)).otherwise(folded)
        folded = F.aggregate("path", folded, lambda acc, x: _hash(x["before"], acc, x["after"]))
        return F.struct(doc["doc_id"].alias("doc_id"), doc["leaf"].alias("leaf"),
                        _hash(*siblings, F.col("above")).alias("proof_sha256"), folded.alias("folded_root"))
    rows = rows.withColumn("above", above).select("subroot", "root", F.explode(F.transform("docs", proven)).alias("d"))
    return rows.select("d.doc_id", "d.leaf", "subroot", "root", "d.proof_sha256", "d.folded_root",
                       (F.col("d.folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(({x})::VARCHAR))::VARCHAR || ':' || ({x})::VARCHAR, '-')"
    ahead = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: "
           "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_at, doc_id, lang, sha256({ahead} || {field("text")}) AS leaf,
  CASE WHEN {crc} % {TAMPERED} = 0 THEN
    sha256({ahead} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS tampered FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_at) - 1 AS i FROM d),
tree AS (SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM l
  UNION ALL SELECT g, level + 1, p, node, (n + {FANOUT - 1}) // {FANOUT} FROM (
    SELECT g, level, i // {FANOUT} AS p, n, sha256(string_agg(node, '' ORDER BY i)) AS node FROM tree WHERE n > 1
    GROUP BY g, level, i // {FANOUT}, n)),
subs AS (SELECT g, node FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, node, count(*) OVER () AS n FROM subs
  UNION ALL SELECT level + 1, p, node, (n + {FANOUT - 1}) // {FANOUT} FROM (
    SELECT level, i // {FANOUT} AS p, n, sha256(string_agg(node, '' ORDER BY i)) AS node FROM top WHERE n > 1
    GROUP BY level, i // {FANOUT}, n)),
depth AS (SELECT g, max(level) AS depth FROM tree GROUP BY g),
nodes AS (SELECT g, level, i, node FROM tree WHERE n > 1
  UNION ALL SELECT d.g, d.depth + t.level, t.i, t.node FROM top t, depth d WHERE t.n > 1),
own AS (SELECT row_at, l.g, level, CASE WHEN level < depth THEN l.i // ({FANOUT} ** level)::BIGINT
  ELSE l.g // ({FANOUT} ** (level - depth))::BIGINT END AS i
  FROM l JOIN depth USING (g) JOIN (SELECT DISTINCT g, level FROM nodes) USING (g)),
sides AS (SELECT row_at, o.level, coalesce(string_agg(node, '' ORDER BY n.i) FILTER (n.i < o.i), '') AS before,
  coalesce(string_agg(node, '' ORDER BY n.i) FILTER (n.i > o.i), '') AS after
  FROM own o JOIN nodes n ON n.g = o.g AND n.level = o.level AND n.i // {FANOUT} = o.i // {FANOUT} GROUP BY row_at, o.level),
proof AS (SELECT row_at, string_agg(before || after, '' ORDER BY level) AS said, count(*) AS levels,
  list({{'a': before, 'z': after}} ORDER BY level) AS path FROM sides GROUP BY row_at),
fold AS (SELECT row_at, 0 AS level, coalesce(tampered, leaf) AS node FROM l
  UNION ALL SELECT f.row_at, f.level + 1, sha256(path[f.level + 1].a || node || path[f.level + 1].z)
  FROM fold f JOIN proof p USING (row_at) WHERE f.level < p.levels),
folded AS (SELECT row_at, arg_max(node, level) AS folded_root FROM fold GROUP BY row_at)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(coalesce(said, '')) AS proof_sha256, folded_root,
  folded_root = t.node AS verified
FROM l JOIN subs s USING (g) JOIN folded USING (row_at) LEFT JOIN proof USING (row_at), (SELECT node FROM top WHERE n = 1) t"""


SQL = _sql()
