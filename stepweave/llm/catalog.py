"""The registered corpus queries, each over its whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import (decontamination, jaccard, licences, lines, markov, merkle, mixing, neighbours, pieces, quality,
                           ranked, secrets, toxicity)
from stepweave.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup(table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scans": op1,
    "op2_sentencepiece_sampling": op2,
    "op3_line_dedup": op3,
    "op4_quality_classifier": op4,
    "op5_hidden_markov_lm": op5,
    "op6_license_scans": op6,
    "op7_approximate_neighbours": op7,
    "op8_toxicity": op8,
    "op9_ngram_jaccard_join": op9,
    "op10_benchmark_decontamination": op10,
    "op11_source_mixing": op11,
    "op12_merkle_manifest": op12,
    "op13_ranked_search": op13,
}
ORACLES = {
    "op1_secret_scans": secrets.SQL,
    "op3_line_dedup": lines.SQL,
    "op9_ngram_jaccard_join": jaccard.SQL,
    "op10_benchmark_decontamination": decontamination.SQL,
    "op11_source_mixing": mixing.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_ranked_search": ranked.SQL,
}
