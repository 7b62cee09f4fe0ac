"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import decontaminate, hpylm, importance, lines, mixing, neardup, pii, prefixes, quality, repeats, rules, toxicity, vectors
from plotweave.llm.bytekit import documents, labels


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.digest(found)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.judged(documents(spark, sf_dir), rules.trusted_ids(labels(spark, sf_dir))))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.deduplicated(documents(spark, sf_dir)))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scored(documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(documents(spark, sf_dir), keep_bytes=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(vectors.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def queries() -> dict:
    made = [op1_toxicity, op2_near_duplicates, op3_decontaminate, op4_quality, op5_quality_rules, op6_lines, op7_language_model, op8_repeats, op9_pii, op10_mixture, op11_vector_links, op12_prefix_trie, op13_importance]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.ORACLE, "op11_vector_links": vectors.ORACLE, "op12_prefix_trie": prefixes.ORACLE, "op13_importance": importance.ORACLE}
