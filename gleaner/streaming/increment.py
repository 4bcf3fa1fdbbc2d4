"""Scans that read only what has changed: a snapshot of path and content hash, and findings that follow it.

A run compares documents with the snapshot of the last one, scans those that are
new or differ, drops findings of those that differ or are gone, and writes the
new snapshot; its findings equal a full scan's.  `follow` does so for each batch
of a stream of changes.

Cases: null content is empty; of a path that stands twice every row is scanned
if any of its contents is new; an empty snapshot means a full scan; removed paths
leave no findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot(docs: DataFrame) -> DataFrame:
    """(path, digest): the hash of a path's content, of all its contents in order where it has several."""
    each = docs.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"))
    return each.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots: added, changed or removed."""
    old, new = before.withColumnRenamed("digest", "old"), after.withColumnRenamed("digest", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def rescanned(docs: DataFrame, before: DataFrame, findings: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of docs(path, content): those of paths that are as they were in the snapshot `before`, and a scan of the others."""
    told = changes(before, snapshot(docs))
    fresh = scan(docs.join(told.where("change <> 'removed'"), "path", "left_semi"))
    return findings.join(told, "path", "left_anti").select(*fresh.columns).unionByName(fresh)


def follow(changed: DataFrame, scan: Callable[[DataFrame], DataFrame], findings_path: str, checkpoint: str) -> StreamingQuery:
    """A stream of changed(path, content, at; null content: removed) into findings by batch: for each path its newest state in the batch, with its findings.

    The table holds a row for each batch and path (`batch_id`, `path`, `removed`) with the findings
    as an array; `current` reads from it what holds now.  A batch that is done again writes the same folder again.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "at").alias("content"), F.max("at").alias("at"))
        found = scan(newest.where("content is not null").select("path", "content"))
        gathered = found.groupBy("path").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "path"])).alias("findings"))
        out = newest.select("path", "at", F.col("content").isNull().alias("removed")).join(gathered, "path", "left")
        out.write.mode("overwrite").parquet(f"{findings_path}/batch_id={batch_id}")

    return changed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(batches: DataFrame) -> DataFrame:
    """Findings that hold after all batches: those of each path's newest row."""
    newest = batches.groupBy("path").agg(F.max_by(F.struct("removed", "findings"), F.struct("at", "batch_id")).alias("s"))
    return newest.where("not s.removed").select("path", F.explode("s.findings").alias("f")).select("path", "f.*")
