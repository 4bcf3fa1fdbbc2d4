"""Addresses in text, looked up in a reputation table, within a budget of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import dialect

#: An address, what ends it by mistake, a number between word ends, and numbers that are private.
URL = r"(?i)https?://[^\s\"'<>]+"
TRAILING = r"[.,;:!?)]+$"
IP = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
PRIVATE = r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(dialect.java(URL)), F.lit(0)), lambda u: F.regexp_replace(u, TRAILING, "")))


def public_ip(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.forall(parts, lambda p: p.cast("int") <= 255) & ~ip.rlike(PRIVATE)


def ips(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(dialect.java(IP)), F.lit(0)), public_ip))


def targets(docs: DataFrame, key: str = "doc_id", text: str = "content", budget: int = 10) -> DataFrame:
    """(key, kind, target, seq, checked): addresses first, then numbers, in order of place; the first `budget` are to be checked."""

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    rows = F.concat(named("url", urls(F.col(text))), named("ip", ips(F.col(text))))
    out = docs.select(key, F.posexplode(rows).alias("seq", "t")).select(key, "t.*", (F.col("seq") + 1).cast("long").alias("seq"))
    return out.withColumn("checked", F.col("seq") <= budget)


def verdicts(found: DataFrame, table: DataFrame) -> DataFrame:
    """found with score and verdict from table(target, malicious, total): over 50 malicious, over 25 suspicious."""
    share = F.round(100.0 * F.col("malicious") / F.col("total"), 2)
    return found.join(table, "target", "left").withColumn("score", share).withColumn("verdict", F.when(share > 50, "malicious").when(share > 25, "suspicious").when(share.isNotNull(), "clean").otherwise("unknown"))


def within_rate(requests: DataFrame, key: str, ts: str = "ts", every: str = "1 minute", most: int = 4, tie: str = "event_id") -> DataFrame:
    """requests with `allowed`: the first `most` of each key and window."""
    window = F.window(ts, every)["start"]
    place = F.row_number().over(W.partitionBy(key, window).orderBy(ts, tie))
    return requests.withColumn("allowed", place <= most)


def status(requests: DataFrame, table: DataFrame, most: int = 4) -> DataFrame:
    """One row: requests in all, how many the rate allowed, the rate, and addresses in the table."""
    rows = requests.select(F.lit(1).alias("requests"), F.col("allowed").cast("int").alias("allowed"), F.lit(0).alias("known"))
    rows = rows.unionByName(table.select(F.lit(0).alias("requests"), F.lit(0).alias("allowed"), F.lit(1).alias("known")))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.agg(n("requests"), n("allowed"), F.lit(most).alias("rate"), n("known"))
