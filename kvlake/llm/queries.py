"""Queries of the corpus operators, registered by the top-level entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import exactdedup, langid, media, mixing, packing, pii, simhash, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.temperature_mix(_table(spark, sf_dir, "documents"), repetition_limit=4.0)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_tokens", "mix_weight", "mix_exponent", "mix_position")


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_buckets(_table(spark, sf_dir, "documents"))


def op4_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.RULES)


def op5_exact_dedup_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labelled = langid.identify_languages(docs, learn=~held_out)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_media(_table(spark, sf_dir, "documents"))
    return stored.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_warc_normaliser,
    op2_temperature_mix,
    op3_length_buckets,
    op4_url_bloom_cascade,
    op5_exact_dedup_lsm,
    op6_language_centroids,
    op7_media_tiles,
    op8_simhash_bktree,
    op9_toxicity_subwords,
    op10_pii_bootstrap,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normaliser": warc.ORACLE_SQL,
        "op4_url_bloom_cascade": urlfilter.ORACLE_SQL,
        "op5_exact_dedup_lsm": exactdedup.ORACLE_SQL,
    }
