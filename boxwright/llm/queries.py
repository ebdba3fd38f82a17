"""One thin query per operator, with production parameters, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import scratch_path
    from .tokenstore import read_shards, write_shards

    manifest = write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=24)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key="check-key")


def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch_path
    from .warc import merge_runs, read_records, write_archives

    folder = scratch_path(spark, "warc")
    captures = merge_runs(write_archives(table(spark, sf_dir, "pages"), folder), folder)
    return read_records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licences

    return licences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_decontamination, op3_jaccard_join, op4_token_store, op5_kd_shards, op6_language, op7_pseudonyms, op8_warc_captures, op9_quality_rules, op10_licences)}
