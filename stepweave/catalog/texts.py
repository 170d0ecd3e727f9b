"""String and JSON operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.registry import STEPS, query, rnd
from stepweave.constants import DEMO_QUERY, DEMO_TASKS, IMAGE_QUERY, VIDEO_QUERY
from stepweave.functions import text, tokens
from stepweave.operators import ordered as o
from stepweave.operators import windows
from stepweave.sources import views

CLEAN = "replace(replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '_', ' '), chr(10), ' ')"
CLEAN_LOWER = "replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '_', ' ')"


@query("str01_clean_prompts", f"""
SELECT doc_id, md5({CLEAN.format("'_ ' || text || '__ '")}) AS plain, md5({CLEAN_LOWER.format("'_ ' || text || '__ '")}) AS lowered
FROM documents""")
def str01(spark, sf):
    raw = F.concat(F.lit("_ "), "text", F.lit("__ "))
    return views.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.clean_prompt(raw)).alias("plain"), F.md5(text.clean_prompt(raw, "lower")).alias("lowered"))


BINS = """list_aggregate(list_transform(embedding[1:8], lambda x: greatest(-1, least(255, floor((greatest(-1, least(1, x::DOUBLE * 8)) + 1) * 128)))::INT), 'string_agg', ' ')"""
RAW_BINS = """list_aggregate(list_transform(embedding[1:8], lambda x: greatest(-1, least(255, floor((x::DOUBLE * 8 + 1) * 128)))::INT), 'string_agg', ' ')"""
FORMATS = {
    "state": "'Task: ' || c || '; State: ' || s || chr(59) || chr(10) || 'Action: '",
    "state_comma": "'Task: ' || c || ', State: ' || s || chr(59) || chr(10) || 'Action: '",
    "prefix": "'Task: ' || l || ', State: ' || r || chr(59) || chr(10)",
    "subgoal": "'Task: ' || c || chr(59) || chr(10) || 'Current Subgoal: ' || lang || chr(59) || chr(10) || 'Action: '",
    "subgoal_state": "'Task: ' || c || chr(10) || 'Current Subgoal: ' || lang || '.' || chr(10) || 'Action: '",
    "plain": "c",
}


@query("str02_prompt_formats", f"""
WITH d AS (SELECT doc_id, lang, {CLEAN.format('text')} AS c, {CLEAN_LOWER.format('text')} AS l, {BINS} AS s, {RAW_BINS} AS r
           FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))
SELECT doc_id, {', '.join(f'md5({sql}) AS {name}' for name, sql in FORMATS.items())} FROM d""")
def str02(spark, sf):
    vectors = views.table(spark, sf, "embeddings")
    state = vectors.select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 8).alias("state"))
    docs = views.table(spark, sf, "documents").withColumn("vec_id", F.col("doc_id") % vectors.count())
    rows = docs.join(state, "vec_id")
    return rows.select("doc_id", *[F.md5(text.build_prompt(F.col("text"), f, F.col("state"), F.col("lang"))).alias(f) for f in FORMATS])


@query("str03_token_masks", """
SELECT doc_id, 256 AS length, least(strlen(text), 256)::INT AS used, least(strlen(lang) + strlen(text), 256)::INT AS both_used,
       greatest(0, least(strlen(lang) + strlen(text), 256) - strlen(lang))::INT AS loss_on, ascii(lang)::INT AS first_token FROM documents""")
def str03(spark, sf):
    rows = tokens.with_tokens(views.table(spark, sf, "documents"), "text", tokens.byte_tokenizer, 256, "ids")
    rows = tokens.with_prefix_postfix(rows, "lang", "text", tokens.byte_tokenizer, 256)

    def on(c):
        return F.size(F.filter(c, lambda x: x))
    return rows.select("doc_id", F.size("ids").alias("length"), on("ids_mask").alias("used"), on("token_mask").alias("both_used"),
                       on("loss_mask").alias("loss_on"), F.get("tokens", F.lit(0)).alias("first_token"))


@query("udf03_tokenizer", "SELECT conv_id, turn, strlen(text)::INT AS n_tokens FROM conversations")
def udf03(spark, sf):
    rows = views.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.size(tokens.token_ids(F.col("text"), tokens.byte_tokenizer)).alias("n_tokens"))


@query("str04_numbered_history", """
SELECT conv_id, turn, md5(coalesce(array_to_string(list(rn || '. ' || r) OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '; '), '')) AS history FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, role || turn AS r FROM conversations)""")
def str04(spark, sf):
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("r"))
    out = o.prefix_list(rows, ["conv_id"], "turn", F.col("r"), "before")
    return out.select("conv_id", "turn", F.md5(text.number_list(F.col("before"))).alias("history"))


GROUNDED = "'pick at <' || l_quantity::INT || ', ' || l_linenumber || '> then ' || CASE WHEN l_linenumber % 2 = 0 THEN 'at <' || l_suppkey || ', 6>' ELSE 'stop' END"


def grounded():
    second = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("at <"), F.col("l_suppkey").cast("string"), F.lit(", 6>"))).otherwise(F.lit("stop"))
    return F.concat(F.lit("pick at <"), F.col("l_quantity").cast("int").cast("string"), F.lit(", "),
                    F.col("l_linenumber").cast("string"), F.lit("> then "), second)


@query("str05_points", f"""
SELECT l_orderkey, l_linenumber, l_partkey, 1 + (l_linenumber % 2 = 0)::INT AS found, (l_quantity::INT + l_linenumber
         + CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey + 6 ELSE 0 END)::INT AS total,
       regexp_replace({GROUNDED}, 'at <(\\d+), (\\d+)>', 'at <bbox>', 'g') AS masked FROM lineitem""")
def str05(spark, sf):
    rows = views.table(spark, sf, "lineitem").withColumn("t", grounded())
    pts = text.points(F.col("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size(pts).alias("found"),
                       F.aggregate(F.flatten(pts), F.lit(0), lambda a, x: a + x).alias("total"), text.mask_points(F.col("t")).alias("masked"))


@query("str06_rescaled_points", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 1001)::INT AS y, (l_suppkey * 9 % 1001)::INT AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, 'go <' || (y * 256 // 1000) || ', ' || (x * 256 // 1000) || '> now' AS scaled, 'go <bbox> now' AS boxed,
       (y * 256 // 1000 + x * 256 // 1000)::INT AS total,
       'at <' || least(256, y * 256 // 1000) || ', ' || least(256, x * 256 // 1000) || '>' AS angled FROM p""")
def str06(spark, sf):
    y, x = (F.col("l_partkey") % 1001).cast("string"), (F.col("l_suppkey") * 9 % 1001).cast("string")
    rows = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("go <|box_start|>("), y, F.lit(","), x, F.lit(")<|box_end|> now")).alias("t"),
        F.concat(F.lit("at <"), y, F.lit(", "), x, F.lit(">")).alias("a"))
    total = F.aggregate(F.flatten(text.box_points(F.col("t"))), F.lit(0), lambda a, v: a + v)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", text.rescale_boxes(F.col("t")).alias("scaled"),
                       text.rescale_boxes(F.col("t"), "bbox").alias("boxed"), total.alias("total"),
                       text.rescale_angles(F.col("a")).alias("angled"))


def noise_sql(axis: str) -> str:
    u1 = f"({rnd(f'9{axis}a', 'l_orderkey', 'l_linenumber')} + 1) / 4294967297.0::DOUBLE"
    u2 = f"{rnd(f'9{axis}b', 'l_orderkey', 'l_linenumber')} / 4294967296.0::DOUBLE"
    return f"round_even(greatest(-8.0, least(8.0, sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}) * 3.2)), 0)::INT"


@query("str07_augmented_points", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN {GROUNDED}
       ELSE 'pick at <' || (l_quantity::INT + {noise_sql('y')}) || ', ' || (l_linenumber + {noise_sql('x')}) || '> then stop' END AS t FROM lineitem""")
def str07(spark, sf):
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.augment_points(grounded(), 9, key).alias("t"))


@query("str08_fenced_json", """
SELECT event_id, event_id % 10 <> 0 AS ok, CASE WHEN event_id % 10 <> 0 THEN regexp_extract(props, '"k": (\\d+)', 1)::INT END AS k FROM events""")
def str08(spark, sf):
    body = F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(F.col("props"))
    wrapped = F.when(F.col("event_id") % 3 == 0, body).otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone")))
    rows = views.table(spark, sf, "events").withColumn("j", text.fenced_json(wrapped))
    return rows.select("event_id", text.is_json(F.col("j")).alias("ok"), F.from_json("j", "k int")["k"].alias("k"))


@query("str09_structured_answers", f"""WITH {STEPS},
f AS (SELECT *, list_reverse(list_filter(list_transform(range(8), lambda i: step_idx - 2 * i), lambda x: x >= 0)) AS fr, k % 8 + 1 AS p FROM v_steps),
a AS (SELECT epis_idx, step_idx, step_idx % 7 <> 3 AND p <= len(fr) AS ok, subgoal, fr[p] AS frame FROM f)
SELECT epis_idx, step_idx, last_value(CASE WHEN ok THEN subgoal END IGNORE NULLS) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS subtask,
       CASE WHEN ok THEN frame::VARCHAR END AS frames FROM a""")
def str09(spark, sf):
    steps = views.steps(spark, sf).withColumn("frame", F.col("step_idx"))
    rows = windows.recent_frames(steps, "frame", "frames")
    good = F.concat(F.lit('{"current_subtask": "'), "subgoal", F.lit('", "keyframe_positions": ['),
                    (F.col("k") % 8 + 1).cast("string"), F.lit("]}"))
    reply = F.when(F.col("step_idx") % 7 == 3, F.lit("I am not sure")).otherwise(good)
    parsed = rows.withColumn("answer", text.parse_answer(reply, F.col("frames")))
    out = o.scan(parsed, ["epis_idx"], "step_idx", {"subtask": o.last(F.col("answer.subtask"))})
    return out.select("epis_idx", "step_idx", "subtask", F.array_join(F.col("answer.frame_ids").cast("array<string>"), ",").alias("frames"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DEMO = "(" + ", ".join(quoted(t) for t in DEMO_TASKS) + ")"


@query("str12_query_texts", f"""WITH {STEPS}
SELECT epis_idx, step_idx, CASE WHEN step_idx = 0 THEN replace(CASE WHEN env_id IN {DEMO} THEN {quoted(DEMO_QUERY)} ELSE {quoted(IMAGE_QUERY)} END,
         '{{task_goal}}', lower(env_id)) ELSE {quoted(VIDEO_QUERY)} END AS text FROM v_steps""")
def str12(spark, sf):
    return views.steps(spark, sf).select("epis_idx", "step_idx", text.query_text(F.col("step_idx"), F.col("env_id"), F.lower("env_id")).alias("text"))


@query("str13_artifact_names", f"""WITH {STEPS}
SELECT epis_idx, step_idx, env_id || '_ep' || epis_idx || '_step' || step_idx || '.png' AS image,
       env_id || '_ep' || epis_idx || '_success_' || subgoal || '_easy.mp4' AS video,
       'folder--file' || epis_idx || '--' || step_idx AS frame_key, step_idx AS parsed FROM v_steps""")
def str13(spark, sf):
    e, s = F.col("epis_idx"), F.col("step_idx")
    path = F.concat(F.lit("/tmp/x/step_"), s.cast("string"), F.lit("_image.png"))
    return views.steps(spark, sf).select(
        "epis_idx", "step_idx", text.image_name(F.col("env_id"), e, s).alias("image"),
        text.rollout_name(F.col("env_id"), e, F.lit("success"), F.col("subgoal"), F.lit("easy")).alias("video"),
        text.frame_key(F.lit("folder"), F.concat(F.lit("file"), e.cast("string")), s).alias("frame_key"), text.step_of(path).alias("parsed"))
