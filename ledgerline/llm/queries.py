"""The queries opN_* over whole tables, and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, language, lines, minhash, mixing, packing, pii, quality, suffixes, toxicity, vectors, warc, whitening
from ..sources.telemetry import dealt
from .common import table


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op2_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(dealt(table(spark, sf_dir, "pages")))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup(dealt(table(spark, sf_dir, "documents"))))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(dealt(table(spark, sf_dir, "documents"))))


def op5_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(dealt(table(spark, sf_dir, "documents"))))


def op7_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(dealt(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(dealt(table(spark, sf_dir, "documents")))


def op11_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_forest": op1_quality_forest,
    "op2_warc_source": op2_warc_source,
    "op3_line_spread": op3_line_spread,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_lattice_hashing": op5_lattice_hashing,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_nb_ngrams": op7_nb_ngrams,
    "op8_cost_packing": op8_cost_packing,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_cross_parsing": op10_cross_parsing,
    "op11_interval_expansion": op11_interval_expansion,
    "op12_tiled_whitening": op12_tiled_whitening,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op2_warc_source": warc.ORACLE,
    "op3_line_spread": lines.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
