"""Array and math operators, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.joining import QUANTILES, VEC
from stepweave.catalog.registry import CHUNK_ROWS, STEPS, query, rnd
from stepweave.catalog.windowing import dim_sum, joined
from stepweave.functions import images, text
from stepweave.functions import vectors as v
from stepweave.operators import memory, sampling, shape, stats, windows
from stepweave.sources import views

LINE_Q = f"""WITH v AS ({VEC}){QUANTILES}"""


@query("arr01_normalized", f"""WITH q AS ({LINE_Q}), w AS (SELECT max(q01) FILTER (WHERE dim = 1) AS a, max(q99) FILTER (WHERE dim = 1) AS b FROM q),
m AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sum(abs((l_tax - m) / (s + 1e-6))), 2) AS z,
       round(sum((l_extendedprice - a) / (b - a + 1e-6) * 2 - 1), 2) AS q FROM lineitem, w, m GROUP BY l_returnflag""")
def arr01(spark, sf):
    rows = views.vectors(spark, sf)
    found = {"x": stats.collect_norm_stats(rows, "x")}
    both = stats.normalize(rows.withColumn("y", F.col("x")), {"x": found["x"]})
    both = stats.normalize(both.withColumnsRenamed({"x": "z", "y": "x"}), found, use_quantiles=True)
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.get("z", F.lit(3)))), 2).alias("z"),
                                            F.round(F.sum(F.get("x", F.lit(1))), 2).alias("q"))


@query("arr02_unnormalized", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS z, round(sum(l_extendedprice), 1) AS q,
       round(sum(l_tax), 4) AS past_stats FROM lineitem GROUP BY l_returnflag""")
def arr02(spark, sf):
    rows = views.vectors(spark, sf)
    full = stats.collect_norm_stats(rows, "x")
    z = stats.unnormalize(stats.normalize(rows, {"x": full}), {"x": full}).withColumnRenamed("x", "z")
    short = stats.NormStats(full.mean[:2], full.std[:2], full.q01[:2], full.q99[:2])
    q = z.withColumn("x", F.concat(v.quantile_scale(F.slice("z", 1, 2), v.literal(short.q01), v.literal(short.q99)),
                                   F.slice("z", 3, 2)))
    q = stats.unnormalize(q, {"x": short}, use_quantiles=True)
    return q.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("z", F.lit(0))), 2).alias("z"),
        F.round(F.sum(F.get("x", F.lit(1))), 1).alias("q"), F.round(F.sum(F.get("x", F.lit(3))), 4).alias("past_stats"))


@query("arr03_delta_actions", f"""WITH {CHUNK_ROWS}
SELECT epis_idx, step_idx, round(sum(a0 - s0), 4) AS d0, sum(a1) AS d1, round(sum(a0), 4) AS back0
FROM v_chunk GROUP BY epis_idx, step_idx""")
def arr03(spark, sf):
    mask = v.bool_mask(1, -1)
    chunks = windows.action_chunks(views.steps(spark, sf), 20)
    delta = chunks.withColumn("delta", v.shift_actions(F.col("actions"), F.col("state"), mask, -1))
    back = v.shift_actions(F.col("delta"), F.col("state"), mask, 1)
    return delta.select("epis_idx", "step_idx", F.round(dim_sum("delta", 0), 4).alias("d0"), dim_sum("delta", 1).alias("d1"),
                        F.round(dim_sum(back, 0), 4).alias("back0"))


@query("arr04_padding", f"""WITH {STEPS},
f AS (SELECT epis_idx, step_idx, list_reverse(list_filter(list_transform(range(8), lambda i: step_idx - 2 * i), lambda x: x >= 0)) AS x FROM v_steps)
SELECT epis_idx, step_idx,
       list_aggregate(list_concat(x, list_transform(range(8), lambda i: 0))[1:6], 'string_agg', ',') AS right_padded,
       list_aggregate(list_concat(list_transform(range(greatest(0, 6 - len(x))), lambda i: 0), x[greatest(1, len(x) - 5):]), 'string_agg', ',') AS left_padded,
       least(len(x), 6)::INT AS used FROM f""")
def arr04(spark, sf):
    steps = views.steps(spark, sf).withColumn("frame", F.col("step_idx"))
    rows = windows.recent_frames(steps, "frame")
    mask = v.mask_left(F.size("recent"), 6)
    return rows.select("epis_idx", "step_idx", joined(v.pad_right(F.col("recent"), 6, F.lit(0))).alias("right_padded"),
                       joined(v.pad_left(F.col("recent"), 6, F.lit(0))).alias("left_padded"),
                       F.size(F.filter(mask, lambda x: x)).alias("used"))


@query("arr05_packed_state", f"WITH {STEPS} SELECT epis_idx, step_idx, 3 AS size, k::DOUBLE AS joint, n::DOUBLE AS gripper FROM v_steps")
def arr05(spark, sf):
    packed = v.pack_state(F.col("state"), F.array(F.col("n"), F.col("k")))
    out = views.steps(spark, sf).withColumn("packed", packed)
    return out.select("epis_idx", "step_idx", F.size("packed").alias("size"), F.get("packed", F.lit(1)).cast("double").alias("joint"),
                      F.get("packed", F.lit(2)).cast("double").alias("gripper"))


@query("arr06_motion_norm", f"""WITH {STEPS}
SELECT epis_idx, step_idx, round(sqrt((a0 - value) ** 2 + (a1 - k) ** 2), 5) AS norm FROM v_steps""")
def arr06(spark, sf):
    return views.steps(spark, sf).select("epis_idx", "step_idx", F.round(v.delta_norm(F.col("action"), F.col("state")), 5).alias("norm"))


@query("arr07_discretized", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 8) AS x FROM embeddings)
SELECT vec_id, list_aggregate(list_transform(x, lambda t: greatest(-1, least(255, floor((t + 1) * 128)))::INT), 'string_agg', ' ') AS raw,
       list_aggregate(list_transform(x, lambda t: greatest(-1, least(255, floor((greatest(-1, least(1, t)) + 1) * 128)))::INT), 'string_agg', ' ') AS clipped
FROM e""")
def arr07(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 8)
    return views.table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(v.discretize(scaled).cast("array<string>"), " ").alias("raw"),
        text.state_text(scaled, True).alias("clipped"))


@query("arr08_token_values", """
SELECT l_orderkey, l_linenumber, l_partkey, 257152 - 1 - 128 - l_partkey AS token,
       CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE round(l_quantity / 256 * 2 - 1 + l_linenumber / 256.0 * 2 - 1 + 0.5, 6) END AS total
FROM lineitem""")
def arr08(spark, sf):
    tokens = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.col("l_quantity"))).otherwise(
        F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(192.0), F.lit(128.0)))
    rows = views.table(spark, sf, "lineitem").withColumn("a", v.bins_to_actions(tokens, 2, 2))
    total = F.aggregate(F.flatten("a"), F.lit(0.0), lambda x, y: x + y)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", v.map_action_token(F.col("l_partkey"), 257152).alias("token"),
                       F.round(total, 6).alias("total"))


@query("arr09_scalar_quantization", """
WITH d AS (SELECT vec_id, round_even((tanh(embedding[1]::DOUBLE * 4) + 1) * 7 / 2, 0)::INT AS a,
           round_even((tanh(embedding[2]::DOUBLE * 4) + 1) * 5 / 2, 0)::INT AS b,
           round_even((tanh(embedding[3]::DOUBLE * 4) + 1) * 4 / 2, 0)::INT AS c FROM embeddings)
SELECT vec_id, (a + 8 * b + 48 * c)::INT AS token, round(a / 7.0 * 2 - 1 + b / 5.0 * 2 - 1 + c / 4.0 * 2 - 1, 6) AS total FROM d""")
def arr09(spark, sf):
    bins = v.fsq_bins(256)
    scaled = F.transform("embedding", lambda x: x.cast("double") * 4)
    rows = views.table(spark, sf, "embeddings").withColumn("token", v.fsq_encode(scaled, bins))
    total = F.aggregate(v.fsq_decode(F.col("token"), bins), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "token", F.round(total, 6).alias("total"))


def angular_sql(x: str) -> str:
    p = f"({x} * (0.05800 - 0.01844) + 0.01844)"
    r = f"(0.022 ** 2 + {p} * {p} - 0.036 ** 2) / (2 * 0.022 * {p})"
    return f"((asin(greatest(-1.0, least(1.0, {r}))) - 0.5476) / (1.6296 - 0.5476))"


@query("arr10_two_arm_conversion", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_tax AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, x, t, round(2 * x + 2 * t, 6) AS joints,
       round({angular_sql('x')} + {angular_sql('t')}, 6) AS grippers,
       round((x + 0.5476 + 0.6213) / (1.4910 + 0.6213), 6) AS encoded, round(x, 6) AS back FROM l""")
def arr10(spark, sf):
    x, t = F.col("l_quantity") / 50, F.col("l_tax")
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), t.alias("t"))
    rows = rows.withColumn("state", F.concat(F.array_repeat("x", 7), F.array_repeat("t", 7)))
    decoded, encoded = v.decode_state(F.col("state")), v.encode_actions(F.array("state"))

    def plus(c, keep):
        return F.aggregate(F.filter(c, keep), F.lit(0.0), lambda a, b: a + b)
    joints = plus(decoded, lambda _, i: ~i.isin(6, 13))
    grips = plus(decoded, lambda _, i: i.isin(6, 13))
    back = v.encode_actions_inv(encoded)
    # Two of six joints flip on each arm, so two of them remain in the sum.
    return rows.select("l_orderkey", "l_linenumber", "x", "t", F.round(joints, 6).alias("joints"), F.round(grips, 6).alias("grippers"),
                       F.round(F.get(F.get(encoded, F.lit(0)), F.lit(6)), 6).alias("encoded"),
                       F.round(F.get(F.get(back, F.lit(0)), F.lit(6)), 6).alias("back"))


@query("arr11_letterbox_geometry", """
WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity * 8)::INT AS w, (l_partkey % 300 + 20)::INT AS h FROM lineitem),
r AS (SELECT *, greatest(w / 224.0::DOUBLE, h / 160.0::DOUBLE) AS ratio FROM s),
g AS (SELECT *, trunc(h / ratio)::INT AS rh, trunc(w / ratio)::INT AS rw FROM r)
SELECT l_orderkey, l_linenumber, w, h, rh, rw, ((160 - rh) // 2)::INT AS top, (160 - rh - (160 - rh) // 2)::INT AS bottom,
       ((224 - rw) // 2)::INT AS lft, (224 - rw - (224 - rw) // 2)::INT AS rgt FROM g""")
def arr11(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 8).cast("int").alias("w"),
        (F.col("l_partkey") % 300 + 20).cast("int").alias("h"))
    out = rows.withColumn("g", v.letterbox_geometry(F.col("w"), F.col("h"), 224, 160))
    return out.select("l_orderkey", "l_linenumber", "w", "h", F.col("g.height").alias("rh"), F.col("g.width").alias("rw"),
                      F.col("g.top").alias("top"), F.col("g.bottom").alias("bottom"), F.col("g.left").alias("lft"),
                      F.col("g.right").alias("rgt"))


def resized_sql(size: int, target: int, name: str) -> str:
    """Interpolation weights of ``target`` points out of ``size``: (o, i, w)."""
    scale = target / size
    reach = max(1.0, 1.0 / scale)
    return (f"{name} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, "
            f"1.0::DOUBLE - abs((o + 0.5::DOUBLE) / {scale}::DOUBLE - 0.5::DOUBLE - i) / {reach}::DOUBLE AS w "
            f"FROM range({target}) a(o), range({size}) b(i)) WHERE w > 0)")


def letterbox_sql(height: int, width: int) -> str:
    """Embeddings as 8 x 8 images in a frame: (vec_id, pos, value)."""
    h, w = images.fitted(8, 8, height, width)
    top, left = (height - h) // 2, (width - w) // 2
    return f"""{resized_sql(8, h, 'wy')}, {resized_sql(8, w, 'wx')},
inside AS (SELECT vec_id, (y.o + {top}) * {width} + x.o + {left} AS pos,
    greatest(-1.0, least(1.0, sum(y.w * x.w * embedding[y.i * 8 + x.i + 1]::DOUBLE))) AS value
  FROM embeddings, wy y, wx x GROUP BY vec_id, y.o, x.o),
framed AS (SELECT e.vec_id, p.pos::INT AS pos, coalesce(value, -1.0) AS value
  FROM embeddings e CROSS JOIN range({height * width}) p(pos) LEFT JOIN inside i ON i.vec_id = e.vec_id AND i.pos = p.pos)"""


def letterboxed(spark, sf, height, width):
    rows = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pixels"))
    out = images.letterbox(rows, "pixels", (8, 8, 1), height, width)
    return out.select("vec_id", F.posexplode("pixels").alias("pos", "value")).select("vec_id", "pos", F.round("value", 6).alias("value"))


@query("arr11_letterbox_pixels", f"WITH {letterbox_sql(5, 12)} SELECT vec_id, pos, round(value, 6) AS value FROM framed")
def arr11_pixels(spark, sf):
    return letterboxed(spark, sf, 5, 12)


@query("arr11_enlarged_pixels", f"WITH {letterbox_sql(14, 11)} SELECT vec_id, pos, round(value, 6) AS value FROM framed")
def arr11_enlarged(spark, sf):
    return letterboxed(spark, sf, 14, 11)


@query("arr12_jittered_boxes", f"""WITH {STEPS},
j AS (SELECT epis_idx, step_idx, k, {rnd(3, 'epis_idx', 'step_idx', '0', '0')} % 4 - 2 AS d0, {rnd(3, 'epis_idx', 'step_idx', '0', '1')} % 4 - 2 AS d1 FROM v_steps)
SELECT epis_idx, step_idx, least(greatest(k + d0, 0), 255)::INT AS y, least(greatest(255 - k // 50 + d1, 0), 255)::INT AS x FROM j""")
def arr12(spark, sf):
    boxes = F.array(F.array(F.col("k"), (255 - F.floor(F.col("k") / 50)).cast("int")))
    moved = text.jitter_boxes(boxes, 3, F.concat_ws(":", "epis_idx", "step_idx"))
    first = F.get(moved, F.lit(0))
    return views.steps(spark, sf).select("epis_idx", "step_idx", F.get(first, F.lit(0)).alias("y"), F.get(first, F.lit(1)).alias("x"))


@query("arr13_random_pick", f"""
SELECT conv_id, turn, (['a', 'b', 'c'])[{rnd(11, 'conv_id')} % 3 + 1] || conv_id AS instruction FROM conversations""")
def arr13(spark, sf):
    rows = views.table(spark, sf, "conversations").withColumn(
        "texts", F.array(*[F.concat(F.lit(c), F.col("conv_id").cast("string")) for c in "abc"]))
    return sampling.pick(rows, "texts", 3, 11, "conv_id", name="instruction").select("conv_id", "turn", "instruction")


@query("arr14_swapped_texts", f"""WITH {STEPS}
SELECT epis_idx, step_idx, CASE WHEN {rnd(5, 'epis_idx', 'step_idx')} / 4294967296.0 < 0.5 THEN upper(subgoal) ELSE subgoal END AS simple_subgoal
FROM v_steps""")
def arr14(spark, sf):
    rows = views.steps(spark, sf).select("epis_idx", "step_idx", F.col("subgoal").alias("simple_subgoal"),
                                         F.upper("subgoal").alias("simple_subgoal_online"))
    out = sampling.swap_online(rows, 5, "epis_idx", "step_idx", columns=["simple_subgoal"])
    return out.select("epis_idx", "step_idx", "simple_subgoal")


@query("udf01_row_transforms", f"WITH {STEPS} SELECT epis_idx, step_idx, (2 * k + 1)::INT AS k, upper(subgoal) AS subgoal FROM v_steps")
def udf01(spark, sf):
    group = shape.Group(inputs=[lambda d: d.withColumn("k", F.col("k") * 2)]).push(
        inputs=[shape.python_rows(lambda r: {**r, "subgoal": r["subgoal"].upper()}, "epis_idx int, step_idx int, k int, subgoal string")],
        outputs=[lambda d: d.withColumn("k", F.col("k") + 1)])
    rows = views.steps(spark, sf).select("epis_idx", "step_idx", "k", "subgoal")
    return group.apply_outputs(group.apply_inputs(rows)).withColumn("k", F.col("k").cast("int"))


@query("udf02_encoder", """
SELECT vec_id, 64 AS patches, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings""")
def udf02(spark, sf):
    rows = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("pixels"))
    out = memory.with_encoder(rows, memory.identity_encoder)
    return out.select("vec_id", F.size("emb").alias("patches"),
                      F.round(F.get(F.get("emb", F.lit(0)), F.lit(0)).cast("double"), 6).alias("first"))
