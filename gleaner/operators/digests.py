"""One hash over the files of each group, in order: the flat values that manifests and audits carry.

Rows go to a task by group and pass through it in order of path; the digest is
fed as they pass, so no row and no task holds a group.  A flat hash is a chain,
and one task must read a group's rows; for integrity those are the files' own
hashes of 64 characters, made before the exchange.  `manifest.integrity` hashes
in blocks instead, where a group is too large for that.

Cases: null contents are empty, and a null path comes first; a group without
files has no row; rows of one path are put in order by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import matcher

#: Names that hashes leave out, of folders and files.
NOT_HASHED, NOT_INTEGRITY = ("node_modules", "package-lock.json"), r"node_modules|\.git"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, digest, files = None, None, 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[], [], []], (pa.string(), pa.string(), pa.int64()), strict=True)], ["group", "digest", "files"])

    for batch in batches:
        out = []
        for group, piece in zip(batch.column("group"), batch.column("piece"), strict=True):
            if digest is None or group.as_py() != held:
                if digest is not None:
                    out.append((held, digest.hexdigest(), files))
                held, digest, files = group.as_py(), hashlib.sha256(), 0
            digest.update(piece.as_buffer() or b"")
            files += 1
        yield done(out)
    if digest is not None:
        yield done([(held, digest.hexdigest(), files)])


def in_order(files: DataFrame, by: str, order: list[Column], piece: Column) -> DataFrame:
    """(by, digest, files): for each value of `by` the SHA-256 of the pieces in order."""
    matcher.workers_find_the_package(files.sparkSession)
    keys = [o.alias(f"o{k}") for k, o in enumerate(order)]
    rows = files.select(F.col(by).cast("string").alias("group"), *keys, piece.cast("binary").alias("piece"))
    dealt = rows.repartition("group").sortWithinPartitions("group", *[f"o{k}" for k in range(len(keys))], "piece").select("group", "piece")
    return dealt.mapInArrow(_digests, "group string, digest string, files long").withColumnRenamed("group", by)


def _parts(path: Column) -> Column:
    """The order in which a walk meets a path: folder by folder, by name."""
    return F.split(path, "/", -1)


def integrity(files: DataFrame, by: str, path: str = "path", content: str = "content") -> DataFrame:
    """(by, digest, files): the SHA-256 of the files' hashes, one after the other as a walk in order of names meets them; path is relative to the group."""
    kept = files.where(~F.coalesce(F.col(path).rlike(NOT_INTEGRITY), F.lit(False)))
    return in_order(kept, by, [_parts(F.col(path))], F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))


def content_hash(files: DataFrame, by: str, path: str = "path", content: str = "content") -> DataFrame:
    """(by, digest, files): the SHA-256 of each file's `/path:` and content in order of path, with the name of the method ahead; names with a dot, packages and their lock are left out."""
    p = F.coalesce(F.col(path), F.lit(""))
    left_out = F.exists(_parts(p), lambda x: x.startswith(".") | x.isin(*NOT_HASHED))
    piece = F.concat(F.concat(F.lit("/"), p, F.lit(":")).cast("binary"), F.coalesce(F.col(content), F.lit("")).cast("binary"))
    return in_order(files.where(~left_out), by, [p], piece).withColumn("digest", F.concat(F.lit("sha256:"), "digest"))
