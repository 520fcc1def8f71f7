"""The registered queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import benchmark_suffixes, crf_language, exact_combining, fm_index, nb_svm_quality, packing, radix_suffixes, repair, sanitise, sorted_projections, sql, superminhash, turn_alignment, zone_maps
from .common import table
from .tokens import public_file


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.identify(table(spark, sf_dir, "documents"))


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_information_theoretic_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


def op4_radix_sorted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op5_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


def op6_superminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sorted_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeats(table(spark, sf_dir, "documents"))


def op9_benchmark_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_suffixes.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json")))


def op11_hilbert_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_maps.report(table(spark, sf_dir, "embeddings"))


def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_alignment.report(table(spark, sf_dir, "conversations"))


def op13_skew_safe_combining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_combining.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_language,
        op2_nb_svm_quality,
        op3_information_theoretic_sanitisation,
        op4_radix_sorted_suffixes,
        op5_minimum_slack_packing,
        op6_superminhash_near_duplicates,
        op7_sorted_projection_passes,
        op8_fm_index_repeats,
        op9_benchmark_suffix_arrays,
        op10_repair_token_files,
        op11_hilbert_zone_maps,
        op12_turn_alignment,
        op13_skew_safe_combining,
    )
}
#: For small tables, where SQL can express the whole result.
ORACLE_SQL = {
    "op4_radix_sorted_suffixes": sql.REPEATED_BYTES,
    "op6_superminhash_near_duplicates": sql.NEAR_DUPLICATES,
    "op7_sorted_projection_passes": sql.VECTORS,
    "op8_fm_index_repeats": sql.REPEATED_WORDS,
    "op9_benchmark_suffix_arrays": sql.BENCHMARK,
    "op11_hilbert_zone_maps": sql.CLUSTERS,
    "op12_turn_alignment": sql.CONVERSATIONS,
    "op13_skew_safe_combining": sql.EXACT,
}
