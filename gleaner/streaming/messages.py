"""Streams: messages judged as tables are, running counts, rate windows, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import firewall, policy

REQUEST = "id string, method string, params struct<name:string,arguments:map<string,string>>"


def json_lines(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def requests(raw: DataFrame) -> DataFrame:
    return raw.select("id", "method", F.col("params.name").alias("tool"), F.coalesce("params.arguments", F.create_map().cast("map<string,string>")).alias("args"))


def guard(messages: DataFrame, direction: str, **options: object) -> DataFrame:
    return firewall.judge(messages, direction, **options)


def decide(calls: DataFrame, policies: tuple[policy.Policy, ...] = policy.DEFAULT) -> DataFrame:
    return policy.evaluate(calls, policies)


def audit_log(judged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events other than allow, appended as JSON lines."""
    return firewall.events(judged).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def tumbling(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    # the window itself is the key: its start alone carries no watermark
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "10 minutes", size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counts(judged: DataFrame) -> DataFrame:
    """Messages and points by direction and action so far; for output mode update or complete."""
    return firewall.stats(judged)


def fresh_targets(found: DataFrame, target: str = "target", ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Of a stream of addresses those to be looked up: an address that was seen within the time to live is known already."""
    return found.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([target])
