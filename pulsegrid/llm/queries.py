"""Queries of this subpackage's operators: one for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.sharding import shard_by_bytes

    return shard_by_bytes(_documents(spark, sf_dir), 24)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.suffix_dedup import repeated_passages

    return repeated_passages(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.pii import find_pii

    out = find_pii(_documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.quality import quality_rules, train

    docs = _documents(spark, sf_dir)
    out = quality_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.drop("probability")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), percent=85)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.byte_bpe import encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_balanced_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.secrets import BASE_RULES, find_secrets, span_text

    out = find_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    digest = F.sha2(span_text(F.col("secrets"), base_only=True), 256)
    return out.select("doc_id", *counts, digest.alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


MIX_LEVELS = {"domain": "CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END", "lang": "lang", "source": "source"}
MIX_WEIGHTS = {"domain": {"english": 0.7, "other": 0.3}, "lang": {"de": 2.0, "fr": 2.0}}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.mixing import mix

    levels = {name: F.expr(e) for name, e in MIX_LEVELS.items()}
    out = mix(_documents(spark, sf_dir), levels, MIX_WEIGHTS, F.col("all_tokens"), epochs=2, seed=17)
    return out.select("doc_id", "lang", "source", "epoch", "n_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from pulsegrid.llm.oracles import ORACLES

    return dict(ORACLES)
