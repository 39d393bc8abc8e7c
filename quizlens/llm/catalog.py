"""The ``opN_<name>`` queries: each applies its operator to its whole table.

The operators keep their own interfaces; the columns that the result format
asks for are derived from their outputs here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.llm import conversation_repair, divergence, exact_dedup, fingerprint, language_id, mixing, oracle_sql, packing, secret_scan, sharding, simhash, substring_dedup, token_ids, toxicity
from quizlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op2_sharding", oracle_sql.SHARDING)
def op2_sharding(spark, sf_dir):
    return sharding.stratified_shards(_docs(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op3_mixing", oracle_sql.MIXING)
def op3_mixing(spark, sf_dir):
    return mixing.mix_plan(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register("op6_exact_dedup", oracle_sql.EXACT_DEDUP)
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(_docs(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


@register("op4_token_ids")
def op4_token_ids(spark, sf_dir):
    path = scratch_path(spark, "token-ids")
    token_ids.write_token_ids(_docs(spark, sf_dir), path)
    return token_ids.read_documents(spark, path)


@register("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.packed(_docs(spark, sf_dir))


@register("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(_docs(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op1_secrets")
def op1_secrets(spark, sf_dir):
    return secret_scan.scan(_docs(spark, sf_dir))


@register("op5_fingerprint")
def op5_fingerprint(spark, sf_dir):
    return fingerprint.compared(_docs(spark, sf_dir))


@register("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.deduplicated(_docs(spark, sf_dir))


@register("op13_language_id")
def op13_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return language_id.predicted(docs, language_id.fit(docs))


@register("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repaired(conversation_repair.damaged(conversations), conversations)


@register("op11_divergence", oracle_sql.DIVERGENCE)
def op11_divergence(spark, sf_dir):
    return divergence.audit(_docs(spark, sf_dir))
