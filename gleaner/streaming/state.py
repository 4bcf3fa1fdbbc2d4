"""State that streams keep for each key: known addresses with a time to live, and rate windows that begin with a request.

Both run on event time with a watermark and `transformWithStateInPandas`, so
state is in the state store (RocksDB) and goes when its time is over.  Each has
a twin for tables with the same results where no row is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.operators import matcher

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The session keeps streams' state in RocksDB, which state with timers needs; set before streams start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Windows(StatefulProcessor):
    """A key's window begins with its first request and ends `every` microseconds later; the first `most` requests in it are allowed."""

    def __init__(self, every: int, most: int) -> None:
        self.every, self.most = every, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", StructType([StructField("start", LongType()), StructField("used", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, used = self.window.get() if self.window.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        allowed = []
        for at in batch["at"].tolist():
            if start is None or at >= start + self.every:
                start, used = at, 0
            used += 1
            allowed.append(used <= self.most)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.window.update((start, used))
        self.handle.registerTimer((start + self.every) // 1000)
        yield pd.DataFrame({"key": batch["key"].to_numpy(), "at": batch["at"].to_numpy(), "tie": batch["tie"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def _slim(rows: DataFrame, key: str, ts: str, tie: Column) -> DataFrame:
    matcher.workers_find_the_package(rows.sparkSession)
    return rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), tie.cast("long").alias("tie"))


_KIND = "key string, at long, tie long, allowed boolean"


def rate_windows(requests: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", every_seconds: int = 60, most: int = 4, late: str = "1 minute") -> DataFrame:
    """A stream of requests as key, ts, tie and allowed; a window that is over leaves no state, and a request behind the watermark is left out."""
    slim = _slim(requests, key, ts, F.col(tie)).withWatermark("ts", late)
    return slim.groupBy("key").transformWithStateInPandas(_Windows(every_seconds * 1_000_000, most), _KIND, "append", "eventtime").select("key", _back(requests, ts), "tie", "allowed")


def rate_windows_of(requests: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", every_seconds: int = 60, most: int = 4) -> DataFrame:
    """The same of a table.  Where a window begins depends on the one before, so each key's requests are gone through in order, a batch at a time."""
    slim = _slim(requests, key, ts, F.col(tie)).drop("ts").repartition("key").sortWithinPartitions("key", "at", "tie")
    every = every_seconds * 1_000_000

    def gone_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, start, used = None, None, 0
        for batch in batches:
            allowed = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist(), strict=True):
                if start is None or k != held or at >= start + every:
                    held, start, used = k, at, 0
                used += 1
                allowed.append(used <= most)
            yield batch.assign(allowed=allowed)

    return slim.mapInPandas(gone_through, _KIND).select("key", _back(requests, ts), "tie", "allowed")


def _back(rows: DataFrame, ts: str) -> Column:
    """The time as the input had it, with a zone or without."""
    return F.timestamp_micros("at").cast(dict(rows.dtypes)[ts]).alias("ts")


def known_targets(found: DataFrame, target: str = "target", ts: str = "ts", ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """A stream of addresses as target, ts and fresh: whether one is to be looked up, or an answer within its time to live still holds.  A window that lets one pass."""
    slim = _slim(found, target, ts, F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark("ts", late)
    out = slim.groupBy("key").transformWithStateInPandas(_Windows(ttl_seconds * 1_000_000, 1), _KIND, "append", "eventtime")
    return out.select(F.col("key").alias("target"), _back(found, ts), F.col("allowed").alias("fresh"))


def known_targets_of(found: DataFrame, target: str = "target", ts: str = "ts", ttl_seconds: int = 3600) -> DataFrame:
    """The same of a table."""
    out = rate_windows_of(found.withColumn("_tie", F.unix_micros(F.col(ts).cast("timestamp"))), target, ts, "_tie", ttl_seconds, 1)
    return out.select(F.col("key").alias("target"), "ts", F.col("allowed").alias("fresh"))


#: Codes of answers, by who gives them: a request that is blocked, a response that is blocked, no response.
CODES = {"proxy": (-32600, -32600, -32603), "firewall": (-32001, -32002, -32000)}


def answered(asked: DataFrame, responses: DataFrame, kind: str = "proxy", within: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Requests joined with their responses: id, ts, action, code and answer (JSON), in batch and in streams.

    asked(id, ts, params, action, reason) are requests that a policy (or the
    firewall) judged; responses(id, ts, raw, action) are those that the injection
    check judged.  A request that is blocked is answered at once and its response
    isn't waited for; one whose response doesn't come within the time is answered
    with an error when the watermark has passed; a response that comes later is
    nobody's.
    """
    blocked_request, blocked_response, unreached = CODES[kind]

    def error(code: int, message: Column, id: Column) -> Column:
        return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), id.alias("id"), F.struct(F.lit(code).alias("code"), message.alias("message")).alias("error")))

    stopped = asked.where("action = 'block'").select("id", "ts", F.lit("block").alias("action"), F.lit(blocked_request).alias("code"), error(blocked_request, F.coalesce("reason", F.lit("")), F.col("id")).alias("answer"))
    q = asked.where("action <> 'block'").select("id", "ts", F.col("action").alias("asked")).withWatermark("ts", late).alias("q")
    r = responses.select(F.col("id").alias("rid"), F.col("ts").alias("rts"), "raw", F.col("action").alias("told")).withWatermark("rts", late).alias("r")
    met = q.join(r, F.expr(f"id = rid AND rts >= ts AND rts <= ts + interval {within}"), "left")
    lost, bad = F.col("rid").isNull(), F.col("told") == "block"
    action = F.when(lost, "unreached").when(bad, "block").when((F.col("asked") == "warn") | (F.col("told") == "warn"), "warn").otherwise("allow")
    answer = F.when(lost, error(unreached, F.lit("no response"), F.col("id"))).when(bad, error(blocked_response, F.lit("response held back"), F.col("id"))).otherwise(F.col("raw"))
    passed = met.select("id", "ts", action.alias("action"), F.when(lost, unreached).when(bad, blocked_response).alias("code"), answer.alias("answer"))
    return stopped.unionByName(passed)

