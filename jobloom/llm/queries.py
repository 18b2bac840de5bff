"""Queries of the operators in this subpackage over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import boilerplate, canonical, encoding, leakage, mixing, names, neighbours, residue
from jobloom.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_values(table(spark, d, "jobs"), table(spark, d, "skill_list"), table(spark, d, "place_list"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_values(table(spark, d, "jobs"), table(spark, d, "skill_list"), table(spark, d, "place_list"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = names.name_pairs(table(spark, d, "jobs").select(F.col("company").alias("name")))
    return pairs.select(F.col("name_a").alias("company_a"), F.col("name_b").alias("company_b"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "jobs").select(F.col("company").alias("name")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.page_furniture(table(spark, d, "jobs"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "job_vectors").select(F.col("job_id").alias("key"), F.col("embedding").alias("vec"))
    return jobs.unionByName(table(spark, d, "profiles").select(F.col("id").alias("key"), F.col("resume_embedding").alias("vec")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(vectors(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "jobs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.verbatim_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "documents")).select("doc_id", "restored_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, p2_unmatched, p3_found, p3_entities, p4_found, p5_found, p7_found, p8_found, p8_reparameterised, p9_mixture, p9_shares, p10_found)
    return {f.__name__: f for f in found}
