"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, decontaminate, delta_lloyd, exact_dedup, html_text, langid, license_scan, minhash, mpeg, packing, periodic, pii, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))[0].drop("row")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("keep_chars")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.digests(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_loops(_table(spark, sf_dir, "documents")))


# The columns that plain SQL can give of queries whose other columns are learned or encoded, from the same operators.


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).drop("spans")


def mpeg_payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def url_rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licenses, op2_pii, op3_main_text, op4_mix, op5_language, op6_pack, op7_mpeg, op8_urls, op9_near_dedup, op10_exact_dedup)
    + (op11_decontaminate, op12_delta_lloyd, op13_periodic_runs)
    + (license_base_columns, pii_base_columns, mpeg_payload_columns, url_rule_columns)
}

ORACLES: dict[str, str] = {"op4_mix": curriculum.ORACLE, "op6_pack": packing.oracle(), "op9_near_dedup": minhash.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE} | {
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_delta_lloyd": delta_lloyd.oracle(),
    "op13_periodic_runs": periodic.ORACLE,
    "license_base_columns": license_scan.ORACLE,
    "pii_base_columns": pii.ORACLE,
    "mpeg_payload_columns": mpeg.ORACLE,
    "url_rule_columns": url_filter.ORACLE,
}
