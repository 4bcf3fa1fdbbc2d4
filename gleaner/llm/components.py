"""Connected components by alternating large-star and small-star steps, all in Spark; few edges are joined within one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import known_to_workers, written

#: Edges that are joined within one task, at most; of more, stars are made in rounds.
AT_ONCE = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of AT_ONCE edges or fewer: each node points to a smaller one, until it points to the smallest."""
    held = [[np.asarray(batch.column(k)) for k in (0, 1)] for batch in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at.reshape(2, -1)
        to, last = np.arange(len(nodes)), None
        while last is None or (to != last).any():
            last = to.copy()
            low = np.minimum(to[x], to[y])
            for end in (x, y):
                np.minimum.at(to, to[end], low)
                np.minimum.at(to, end, low)
            while (to != to[to]).any():
                to = to[to]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): each node that has an edge, with the smallest node of its component; roots too."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    if state[0] <= AT_ONCE:
        known_to_workers(edges.sparkSession)
        return e.coalesce(1).mapInArrow(_roots, "node long, root long")
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.withColumnRenamed("m", "b")).distinct()
        e = written(small, "edges")
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
