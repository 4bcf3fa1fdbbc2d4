"""From documents to packed training windows: quality rules, line dedup, near-dedup, mixing, packing.

Each stage reads the table that the one before wrote, works on all of it and
returns the columns of documents; the last returns the pieces of packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import line_dedup, mixing, near_duplicates, packing, quality_rules
from gleaner.llm.common import WORD, documents, free_name, small, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    name = free_name(docs.columns, "rules")
    judged = quality_rules.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns, name)
    return judged.where(f"`{name}_kept`").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the earliest; so do documents that lose every line with a word."""
    return line_dedup.without_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    found = near_duplicates.near_duplicates(docs)
    gone = written(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("gone_id")), "gone")
    return docs.join(small(gone), docs["doc_id"] == gone["gone_id"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each time that a document is taken it is a row, in shuffled order; one that is taken in part has that many of its words."""
    size, take = free_name(docs.columns, "mix_size"), free_name(docs.columns, "mix_take")
    out = mixing.mix(docs, docs.columns).select("carry.*", F.col("size").alias(size), F.explode("takes").alias(take))
    words, taken = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col(f"{take}.taken")
    part = taken < F.col(size)
    text = F.when(part, F.array_join(F.slice(words, 1, taken.cast("int")), " ")).otherwise(F.col("text"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    order = [F.col(f"{take}.shard"), F.col(f"{take}.shuffle_key")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[v.alias(k) for k, v in columns.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mixed), ("packing", packed)]

#: The learned rules, the similarity join and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
