"""The registered queries of this package and their DuckDB SQL.

Every query reads its whole table and returns the digest columns of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import block_search, html_extraction, imatch, language_id, license_scan, merkle_manifest, minhash_dedup, nbest_pieces, packing
from wakeline.llm import secret_scan, suffix_dedup, toxicity, vector_codes
from wakeline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nbest_pieces.segment(table(spark, sf_dir, "documents"))
    ranked = [F.get("scores", F.lit(k)).alias(f"score_{k + 1}") for k in range(nbest_pieces.N_BEST)]
    return found.select("doc_id", "n_pieces", "ids_crc32", F.size("scores").alias("n_best"), *ranked, "round_trip")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_license_scan": op1_license_scan, "op2_main_text": op2_main_text, "op3_near_duplicates": op3_near_duplicates, "op4_nbest_segmentation": op4_nbest_segmentation, "op5_packing": op5_packing, "op6_nearest_vectors": op6_nearest_vectors, "op7_language_id": op7_language_id, "op8_repeated_spans": op8_repeated_spans, "op9_toxicity": op9_toxicity, "op10_imatch": op10_imatch, "op11_vector_codes": op11_vector_codes, "op12_merkle_manifest": op12_merkle_manifest, "op13_secret_scan": op13_secret_scan}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op6_nearest_vectors": block_search.oracle(), "op11_vector_codes": vector_codes.oracle(), "op12_merkle_manifest": merkle_manifest.oracle(), "op13_secret_scan": secret_scan.oracle()}
