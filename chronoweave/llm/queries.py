"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import collocations, context_tree, line_dedup, merkle, mixing, nn_descent, packing, quality, quality_rules, rank_aggregation, simhash, token_counts, token_files
from chronoweave.llm.common import table, written


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_rank_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_aggregation.top_k(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(written(token_counts.histogram(table(spark, sf_dir, "documents")), "histogram"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return context_tree.scores(docs, ~held_out).withColumn("held_out", held_out)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = quality_rules.with_statistics(docs, "stats").drop("text")
    out = quality_rules.verdicts(rows, table(spark, sf_dir, "labels"), "lang", "stats", "v")
    return out.select("doc_id", *[F.col("v")[c].alias(c) for c in (*quality_rules.COUNTS, "base_failed", "kept")])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(docs, merkle.tampered(F.col("doc_id"), F.col("text"))).drop("proof")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_rank_aggregation, op3_mixing, op4_token_files, op5_token_counts,
        op6_context_tree, op7_simhash, op8_packing, op9_quality, op10_nn_descent,
        op11_quality_rules, op12_collocations, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op2_rank_aggregation": rank_aggregation.SQL, "op11_quality_rules": quality_rules.SQL, "op12_collocations": collocations.SQL, "op13_merkle_manifest": merkle.SQL}
