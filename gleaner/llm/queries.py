"""The queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import conversation_repair, fill_in_middle, fingerprints, licenses, line_dedup, mixing, near_duplicates, packing, passages, quality_rules, secrets, sharding, sql, token_counts
from gleaner.llm.common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    shards = F.array_join(F.transform("takes", lambda t: t["shard"].cast("string")), ",")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", mixing.taken_words().alias("taken"), shards.alias("shards"), F.get("takes.shuffle_key", F.lit(0)).alias("shuffle_key"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules.judged(documents(spark, sf_dir), labels, ["doc_id"], "q")
    return out.select("doc_id", *[f"q.{c}" for c in quality_rules.BASE], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_rule").alias("rule"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir), span=4)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    of_kind = lambda name: F.size(F.filter("spans.kind", lambda k: k == name)).cast("long").alias(f"n_{name}")
    examples = F.size(F.filter(base, lambda s: s["verdict"] == "example")).cast("long").alias("n_example")
    return out.select("doc_id", *map(of_kind, [*secrets.BASE, "live"]), examples, F.sha2(secrets.written_spans(base), 256).alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (op1_packing, op2_mixing, op3_quality_rules, op4_license_scan, op5_token_counts, op6_sharding, op7_near_duplicates, op8_repeated_passages, op9_line_dedup, op10_fingerprints, op11_conversation_repair, op12_secrets, op13_fill_in_middle)}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": sql.MIXING, "op4_license_scan": sql.licences(), "op9_line_dedup": sql.LINES, "op11_conversation_repair": sql.CONVERSATIONS, "op12_secrets": sql.secret_spans(), "op13_fill_in_middle": sql.MIDDLES}
