"""License scans: a trained paragraph classifier, in DataFrame functions and Spark's own logistic regression.

Paragraphs are runs of lines that hold a letter or digit, so a notice wrapped over lines is one. What is classified are
their passages: every sentence, and where a sentence runs over lines each line, too. The features of a passage are the
distinct hashes of its words and word pairs, each counted as its share of all of them. A softmax regression over the families
of ``TEMPLATES`` and an unknown class is fitted on the templates, parts of them, the templates amid other words
(``AROUND``), and every distinct passage of the corpus as unknown; passages that hold a template, or are mostly made of
template words, are notices and not used. It is sparse: only features of templates that few unknown passages hold get a
weight. Passages of the same such features and size are one weighted row. The threshold is calibrated on all unknown
passages, too, each half scored by a model fitted without it: a family needs at least the probability that none but
``FALSE_SHARE`` of them reach.

Texts are split and hashed once. What is kept of a passage, in a written table, is its number of features, their hash and
the features that templates hold. Scoring explodes these and keeps those with a weight, a broadcast join with a table
bounded by the templates; only these few rows are shuffled. A predicted passage is confirmed when its words and pairs
agree with a template of its family (Dice coefficient of ``CONFIRM`` or more) or hold ``HELD`` of the template.

Defined results: null reads as the empty text; a text without paragraphs or matches has empty lists; repeated rows give
one result each; rows without an id are documents too; other columns are not read. Without corpus paragraphs the unknown
class is learned from an empty paragraph alone. A passage that occurs again is one passage in training.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import written
from stepweave.llm.templates import TEMPLATES

FALSE_SHARE, COMMON, CONFIRM, HELD = 0.001, 0.01, 0.7, 0.9
#: Fixed words that stand before and behind a template in training.
AROUND = [("copyright 2020 the project authors", ""), ("", "see the file for details"), ("this file and its parts", "and others")]
#: Between sentences and between paragraphs.
BETWEEN = r"(?<=[.!?])\s+|\n(?:[^\p{L}\p{N}\n]*+\n)++"
PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
STEPS, DECAY, SCALE, BUCKETS, PART = 60, 1e-4, 10.0, 4096, 1 << 16
FAMILIES = sorted(TEMPLATES)
_DOC = ["doc_id", "text_key"]


def _features(paragraph: "F.Column") -> "F.Column":
    """The distinct hashes of a paragraph's words and pairs of neighbours."""
    def hashed(words: "F.Column") -> "F.Column":
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                           F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
        return F.array_distinct(F.concat(F.transform(words, lambda w: F.xxhash64(w)), pairs))
    # the words go through a lambda so that they are split once
    return F.transform(F.array(F.array_remove(F.split(F.lower(paragraph), "[^a-z0-9]+", -1), "")), hashed)[0]


def _passages(text: str) -> "F.Column":
    """Sentences, and the lines of those that run over lines."""
    return F.flatten(F.transform(F.split(text, BETWEEN, -1), lambda s: F.when(
        F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, F.lit("\n"), -1))).otherwise(F.array(s))))


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _among(features: "F.Column", some: list[int]) -> "F.Column":
    """The features that are some of a list bounded by the templates."""
    return F.filter(features, lambda x: x.isin(some))


def _kept(docs: DataFrame, known: list[int]) -> DataFrame:
    """(doc_id, text_key, n_paragraphs, passages) of every row; passages: (at, n, key, features) of those that hold a word,
    with the number of all features, their hash, and the known features."""
    found = F.filter(F.transform(_passages("text"), lambda p, at: F.transform(F.array(_features(p)), lambda f: F.struct(
        at.alias("at"), F.size(f).alias("n"), F.xxhash64(f).alias("key"), _among(f, known).alias("features")))[0]),
        lambda x: x["n"] > 0)
    return written(_documents(docs).select(
        "doc_id", F.md5("text").alias("text_key"), F.size(F.split("text", PARAGRAPHS, -1)).cast("bigint").alias("n_paragraphs"),
        found.alias("passages")), "licence-passages")


def _template_rows(spark: SparkSession) -> DataFrame:
    """(family, template, around, features): the templates, alone (around 0) and amid other words, through the same
    functions as the corpus."""
    rows = [(f, f"{f}/{i}", k, f"{a} {text} {z}") for f in FAMILIES for i, text in enumerate(TEMPLATES[f])
            for k, (a, z) in enumerate([("", ""), *AROUND])]
    one = spark.createDataFrame(rows, "family string, template string, around int, text string")
    return one.select("family", "template", "around", _features(F.col("text")).alias("features"))


class Model:
    """Weights of the features (feature, class), of all others, biases, and the features left out as common; the last
    class is unknown."""

    def __init__(self, features: list[int], weights: np.ndarray, bias: np.ndarray, common: list[int], cut: float) -> None:
        self.features, self.weights, self.rest = features, weights[:-1], weights[-1]
        self.bias, self.common, self.cut = bias, common, cut


def _halves(features: list[int]) -> list[list[int]]:
    """The features of a template, and those of its first and last parts."""
    n = len(features)
    return [features] if n < 20 else [features, features[:n * 7 // 10], features[n * 3 // 10:]]


def _unknown(kept: DataFrame, alone: list[set[int]]) -> DataFrame:
    """(fold, n, features, amount): the distinct passages of the corpus that are no notices, counted by what they hold;
    ``fold`` is the half of the corpus that a passage's hash puts it in."""
    passages = kept.select(F.explode("passages").alias("x")).select("x.key", "x.n", "x.features").distinct()
    inside = _among(F.col("features"), sorted(set().union(*alone)))
    # the number of features is looked at first; few passages hold enough of them for a long template
    notice = F.size(inside) >= 0.5 * F.col("n")
    for t in sorted(alone, key=len):
        least = 0.7 * len(t)
        notice = notice | ((F.size("features") >= least) & (F.size(_among(F.col("features"), sorted(t))) >= least))
    rows = passages.where(~notice).groupBy(F.pmod("key", F.lit(2)).alias("fold"), "n", "features")
    return written(rows.agg(F.count(F.lit(1)).alias("amount")), "licence-unknown")


def _vectors(rows: DataFrame, names: list[int]) -> DataFrame:
    """The rows with ``x``, the share of each name among the ``n`` features of a row, and of all others."""
    tokens = F.concat(F.transform("features", lambda f: f.cast("string")),
                      F.array_repeat(F.lit("other"), (F.col("n") - F.size("features")).cast("int")))
    counts = CountVectorizerModel.from_vocabulary([*map(str, names), "other"], "tokens", "counts")
    return Normalizer(p=1.0, inputCol="counts", outputCol="x").transform(
        counts.transform(rows.withColumn("tokens", tokens))).drop("tokens", "counts")


def fit(templates: DataFrame, unknown: DataFrame) -> LogisticRegressionModel:
    """Softmax regression on rows of (label, weight, x) and (amount, x), which weigh as much as all templates together."""
    n, amount = unknown.agg(F.count(F.lit(1)), F.sum("amount")).first()
    scale = templates.agg(F.sum("weight")).first()[0] / amount
    rows = templates.select("label", "weight", "x").unionByName(unknown.select(
        F.lit(float(len(FAMILIES))).alias("label"), (F.col("amount") * scale).alias("weight"), "x"))
    rows = rows.coalesce(1 + n // PART)  # each step is a job, so few rows are not dealt out
    return LogisticRegression(featuresCol="x", weightCol="weight", family="multinomial", standardization=False,
                              regParam=DECAY / SCALE ** 2, maxIter=STEPS).fit(rows)


def ranked(scores: DataFrame, above: int, low: float) -> float:
    """The ``score`` that ``above`` others precede in descending order, or ``low`` if it is less; a row stands for
    ``amount`` scores. They are counted in buckets, then those of one bucket in smaller ones."""
    high = 1.0
    while True:
        place = F.floor((F.col("score") - low) / (high - low) * BUCKETS)
        held = scores.where(F.col("score").between(low, high)).groupBy(place.alias("place")).agg(
            F.sum("amount").alias("amount"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in held.orderBy(F.desc("place")).collect():
            if above < r.amount:
                break
            above -= r.amount
        else:
            return low
        if r.low == r.high:
            return r.low
        low, high = r.low, r.high


def _threshold(vectors: DataFrame, templates: DataFrame, empty: DataFrame) -> float:
    """The probability of a family that ``FALSE_SHARE`` of the unknown passages exceed, under models fitted without them."""
    halves, total = [vectors.where(F.col("fold") == i) for i in (0, 1)], 0
    scores = None
    for aside, learned in (halves, halves[::-1]):
        amount = aside.agg(F.sum("amount")).first()[0] or 0
        if not amount:
            continue
        model = fit(templates, learned if learned.take(1) else empty)
        best = F.array_max(F.slice(vector_to_array("probability"), 1, len(FAMILIES)))
        found = model.transform(aside.select("x", "amount")).select(best.alias("score"), "amount").where("score > 0.5")
        scores, total = found if scores is None else scores.unionByName(found), total + amount
    if not total:
        return 0.5
    return ranked(written(scores, "licence-scores"), total - 1 - int((1 - FALSE_SHARE) * (total - 1)), 0.5)


def _learned(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, (family, template, features) of the templates, and the kept passages."""
    spark, templates = docs.sparkSession, _template_rows(docs.sparkSession)
    rows = templates.orderBy("template", "around").collect()
    every = sorted({f for r in rows for f in r.features})
    kept = _kept(docs, every)
    unknown = _unknown(kept, [set(r.features) for r in rows if not r.around])
    total = unknown.agg(F.sum("amount")).first()[0] or 0
    most = max(COMMON * total, 2)
    common = sorted(r.feature for r in unknown.select("amount", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("amount").alias("amount")).where(F.col("amount") > most).collect())  # bounded by the templates
    names = sorted(set(every) - set(common))

    held = unknown.select("fold", "amount", "n", _among(F.col("features"), names).alias("features"))
    held = held.withColumn("n", F.when(F.size("features") > 0, F.col("n")).otherwise(1))  # the rest alone, whatever the size
    held = held.groupBy("fold", "n", "features").agg(F.sum("amount").alias("amount"))
    vectors = written(_vectors(held, names).select("fold", "amount", "x"), "licence-rows")
    empty = _vectors(spark.createDataFrame([(0, [], 1)], "n int, features array<bigint>, amount bigint"), names)
    parts = [(float(FAMILIES.index(r.family)), 1 / len(_halves(r.features)), len(fs), [f for f in fs if f in place])
             for place in [set(names)] for r in rows for fs in _halves(r.features)]
    examples = spark.createDataFrame(parts, "label double, weight double, n int, features array<bigint>")
    examples = written(_vectors(examples, names).select("label", "weight", "x"), "licence-examples")

    fitted = fit(examples, vectors if total else empty)
    model = Model(names, fitted.coefficientMatrix.toArray().T / SCALE, np.array(fitted.interceptVector.toArray()), common,
                  _threshold(vectors, examples, empty))
    return model, templates.where("around = 0").drop("around"), kept


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (family, template, features) of the templates."""
    return _learned(docs)[:2]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and found of every document; found: (at, family, probability, agreement, confirmed)."""
    model, templates, kept = _learned(docs)
    spark, k = docs.sparkSession, len(FAMILIES)
    table = spark.createDataFrame([(f, [float(v) for v in row]) for f, row in zip(model.features, model.weights)],
                                  "feature bigint, w array<double>")
    common = F.array(*[F.lit(f) for f in model.common]).cast("array<bigint>")
    passages = kept.select(*_DOC, F.explode("passages").alias("x")).select(*_DOC, "x.at", "x.n", "x.features")
    each = passages.select(*_DOC, "at", "n", (F.col("n") - F.size(_among(F.col("features"), model.common))).alias("p"),
                           F.explode(_among(F.col("features"), model.features)).alias("feature"))
    # the table is bounded by the templates; distinct, because a repeated row is one document here
    hits = each.join(F.broadcast(table), "feature").distinct()
    sums = hits.groupBy(*_DOC, "at", "n", "p").agg(
        F.count(F.lit(1)).alias("m"), F.collect_list("feature").alias("features"),
        *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k + 1)])
    logits = [F.lit(float(model.bias[i])) + SCALE / F.col("n") * (
        F.col(f"s{i}") + float(model.rest[i]) * (F.col("n") - F.col("m"))) for i in range(k + 1)]
    scored = sums.select(*_DOC, "at", "p", "features", F.array(*logits).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top))
    best = F.array_max(F.slice("z", 1, k))
    predicted = scored.select(
        *_DOC, "at", "p", "features", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position(
            "z", best).cast("int")).alias("family"), (F.exp(best - top) / total).alias("probability")
    ).where((F.col("probability") > model.cut) & (best > F.element_at("z", -1)))

    own = templates.select("family", "template", F.array_except("features", common).alias("f"))
    own = own.select("family", "template", F.size("f").alias("t"), F.explode("f").alias("feature"))
    place = [*_DOC, "at", "family", "probability"]
    agreed = (predicted.select(*place, "p", F.explode("features").alias("feature"))
              .join(F.broadcast(own), ["family", "feature"])
              .groupBy(*place, "p", "template", "t").agg(F.count(F.lit(1)).alias("both"))
              .withColumn("held", F.col("both") / F.col("t"))
              .groupBy(*place).agg(F.max(F.greatest(2 * F.col("both") / (F.col("p") + F.col("t")), F.when(
                  F.col("held") >= HELD, F.col("held")))).alias("agreement")))
    found = agreed.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct(
        "at", "family", "probability", "agreement", (F.col("agreement") >= CONFIRM).alias("confirmed")))).alias("found"))
    return _all(kept, found)


def _all(kept: DataFrame, found: DataFrame) -> DataFrame:
    rows = kept.select(*_DOC, "n_paragraphs")
    joined = rows.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                                  & (F.col("d.text_key") == F.col("f.text_key")), "left")
    return joined.select("d.doc_id", "n_paragraphs", F.coalesce("found", F.array().cast(
        found.schema["found"].dataType)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, licences (confirmed families) and places (at:family)."""
    good = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_predicted"),
        F.size(good).cast("bigint").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))), ",").alias("licences"),
        F.array_join(F.transform(good, lambda x: F.concat_ws(":", x["at"], x["family"])), ",").alias("places"))
