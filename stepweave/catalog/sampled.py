"""Shuffles, batches, shards, set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.registry import STEPS, query
from stepweave.catalog.windowing import joined
from stepweave.functions import indices
from stepweave.operators import joins, sampling
from stepweave.plans import jobs
from stepweave.sources import readers, views

RANKED = """r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS rank,
             count(*) OVER () AS n FROM orders)"""


def shuffled(spark, sf):
    return sampling.shuffle(views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 42, "o_orderkey")


@query("srt01_seeded_shuffle", f"WITH {RANKED} SELECT o_orderkey, rank FROM r")
def srt01(spark, sf):
    return shuffled(spark, sf).select("o_orderkey", "rank")


@query("srt02_batches", f"""WITH {RANKED}
SELECT rank // 128 AS batch, count(*)::INT AS size, list(o_orderkey ORDER BY rank)[1] AS first, list(o_orderkey ORDER BY rank)[128] AS last
FROM r WHERE rank // 128 < n // 128 GROUP BY rank // 128""")
def srt02(spark, sf):
    out = sampling.stack(sampling.batches(shuffled(spark, sf), 128), ["o_orderkey"])
    return out.select("batch", F.size("o_orderkey").alias("size"), F.element_at("o_orderkey", 1).alias("first"),
                      F.element_at("o_orderkey", -1).alias("last"))


@query("srt03_wrapped_batches", f"""WITH {RANKED}, d AS (SELECT i AS draw, i % (SELECT max(n) // 512 FROM r) AS batch FROM range(40) x(i))
SELECT draw, count(*) AS size, sum(o_orderkey)::BIGINT AS keys FROM d JOIN r ON rank // 512 = batch GROUP BY draw""")
def srt03(spark, sf):
    out = sampling.take_batches(shuffled(spark, sf), 512, 40)
    return out.groupBy("draw").agg(F.count(F.lit(1)).alias("size"), F.sum("o_orderkey").alias("keys"))


@query("srt04_worker_shard", f"WITH {RANKED} SELECT o_orderkey, rank FROM r WHERE rank % 7 = 3 AND rank < (n // 7) * 7")
def srt04(spark, sf):
    return sampling.shard(shuffled(spark, sf), 7, 3).select("o_orderkey", "rank")


@query("srt05_map_batched", f"""WITH {RANKED}
SELECT rank // 128 AS batch, count(*)::INT AS size, (sum(o_orderkey) * 2)::BIGINT AS doubled FROM r WHERE rank // 128 < n // 128 GROUP BY rank // 128""")
def srt05(spark, sf):
    packed = sampling.stack(sampling.batches(shuffled(spark, sf), 128), ["o_orderkey"])
    out = sampling.map_batched(packed, lambda rows: rows.withColumn("o_orderkey", F.col("o_orderkey") * 2), ["o_orderkey"])
    return out.select("batch", F.size("o_orderkey").alias("size"),
                      F.aggregate("o_orderkey", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("doubled"))


def turned_sql(n: str, key: str, x: str) -> str:
    """One pass of the keyed Feistel rounds over the number ``x``, in the rectangle (a, b) of ``sides``."""
    at = f"SELECT id, {x} // b AS l, {x} % b AS r, a, b, n FROM {n}"
    for k in range(sampling.ROUNDS):
        own, other, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        drawn = f"('0x' || substr(md5('{key}:{k}:' || {other}), 1, 15))::BIGINT"
        at = f"SELECT id, ({own} + {drawn} % {side}) % {side} AS {own}, {other}, a, b, n FROM ({at})"
    return f"SELECT id, l * b + r AS x, a, b, n FROM ({at})"


def permuted_sql(name: str, rows: str, key: str) -> str:
    """(id, rank) of numbers ``id`` in 0..n-1; the rectangle is the smallest of 4096 with n numbers or more."""
    return f"""{name}_n AS (SELECT *, count(*) OVER () AS n FROM ({rows})),
{name}_side AS (SELECT ceil(n / b::DOUBLE)::BIGINT AS a, b::BIGINT AS b FROM (SELECT max(n)::BIGINT AS n FROM {name}_n) x,
  range(4096) y(j), LATERAL (SELECT floor(sqrt(n - 1))::BIGINT + 1 + j AS b) z ORDER BY a * b, b LIMIT 1),
{name}_0 AS (SELECT id, id AS x, a, b, n FROM {name}_n, {name}_side),
{name}_walk AS ({turned_sql(f"{name}_0", key, "x")} UNION ALL {turned_sql(f"(SELECT * FROM {name}_walk WHERE x >= n)", key, "x")}),
{name} AS (SELECT id, x::BIGINT AS rank, n FROM {name}_walk WHERE x < n)"""


SAMPLE_IDS = "SELECT row_number() OVER (ORDER BY epis_idx, step_idx) - 1 AS id FROM v_steps WHERE NOT is_demo"


def sample_ids(spark, sf):
    rows = jobs.number_samples(views.steps(spark, sf)).where("sample_id IS NOT NULL").select("sample_id", "epis_idx", "step_idx")
    return rows, rows.count()


@query("srt01_keyed_permutation", f"""WITH RECURSIVE {STEPS}, {permuted_sql("p", SAMPLE_IDS, "42.1")}
SELECT id AS sample_id, rank, id AS back FROM p""")
def srt01_keyed(spark, sf):
    rows, n = sample_ids(spark, sf)
    ranked = rows.select("sample_id", sampling.permuted(F.col("sample_id"), n, 42, 1).alias("rank"))
    return ranked.withColumn("back", sampling.unpermuted(F.col("rank"), n, 42, 1))


@query("srt02_epoch_batches", f"""WITH RECURSIVE {STEPS}, {permuted_sql("p", SAMPLE_IDS, "42.0")}
SELECT (rank // 3) // 64 AS batch, count(*)::INT AS size, max(id) FILTER (WHERE (rank // 3) % 64 = 0) AS first,
       max(id) FILTER (WHERE (rank // 3) % 64 = 63) AS last
FROM p WHERE rank % 3 = 1 AND rank < (n // 3) * 3 AND rank // 3 < ((n // 3) // 64) * 64 GROUP BY ALL""")
def srt02_epoch(spark, sf):
    rows, n = sample_ids(spark, sf)
    out = sampling.stack(sampling.epoch_batches(rows, "sample_id", n, 64, 42, workers=3, worker=1), ["sample_id"])
    return out.select("batch", F.size("sample_id").alias("size"), F.element_at("sample_id", 1).alias("first"),
                      F.element_at("sample_id", -1).alias("last"))


@query("srt03_resumed_batches", f"""WITH RECURSIVE {STEPS}, {permuted_sql("p", SAMPLE_IDS, "42.0")}, {permuted_sql("q", SAMPLE_IDS, "42.1")},
ids AS (SELECT row_number() OVER (ORDER BY epis_idx, step_idx) - 1 AS id, epis_idx, step_idx FROM v_steps WHERE NOT is_demo),
d AS (SELECT rank // 64 AS draw, 0 AS epoch, rank, id FROM p WHERE rank < n // 64 * 64
      UNION ALL SELECT n // 64 + rank // 64, 1, rank, id FROM q WHERE rank < n // 64 * 64)
SELECT draw, epoch, (rank % 64)::INT AS slot, epis_idx, step_idx FROM d JOIN ids USING (id)
WHERE draw >= (SELECT max(n) // 64 - 5 FROM p) AND draw < (SELECT max(n) // 64 + 7 FROM p)""")
def srt03_resumed(spark, sf):
    rows, n = sample_ids(spark, sf)
    drawn = sampling.resumed(spark, n, 64, 42, cursor=n // 64 - 5, count=12, index="sample_id")
    return drawn.join(rows, "sample_id").select("draw", "epoch", "slot", "epis_idx", "step_idx")


@query("set01_file_union", "SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events")
def set01(spark, sf):
    events = views.table(spark, sf, "events")
    even = events.where(F.col("event_id") % 2 == 0).select("event_id", "user_id")
    odd = events.where(F.col("event_id") % 2 == 1).select("event_id", "user_id", "value")
    return readers.union_files(even, odd)


@query("set02_index_union", f"""WITH {STEPS}
SELECT epis_idx, step_idx, list_aggregate(list_sort(list_distinct(list_filter([step_idx, k, exec_start, n, step_idx + 1], lambda x: x >= 10))), 'string_agg', ',') AS merged
FROM v_steps""")
def set02(spark, sf):
    merged = indices.merge_indices(F.array("step_idx", "k", "exec_start"), F.array(F.col("n"), F.col("step_idx") + 1), F.lit(10))
    return views.steps(spark, sf).select("epis_idx", "step_idx", joined(merged).alias("merged"))


@query("set03_difference", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set03(spark, sf):
    rich = views.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return joins.except_values(views.table(spark, sf, "nation"), rich, "n_nationkey")
