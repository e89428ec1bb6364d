"""Queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfold.llm import bpe, jaccard, lattice, mtree, nndescent, packing, pii, quality, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, pii.key_of(spark), count="n_entities")


def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op8_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.neighbours(table(spark, sf_dir, "embeddings"))


def op9_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_mtree_top_k, op3_warc_records, op4_quality_votes, op5_shingle_components, op6_packed_windows, op7_subword_lattice, op8_graph_neighbours, op9_bpe_digests, op10_toxicity_grades)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree_top_k": mtree.ORACLE_SQL, "op3_warc_records": warc.ORACLE_SQL, "op5_shingle_components": jaccard.ORACLE_SQL}
