"""Uniform shuffle into shards whose row counts differ by at most one.

Rows fall into blocks by a hash of their id.  How many rows each block sends to
each shard is drawn first, as a matrix: its rows sum to the block sizes, its
columns to the exact shard sizes, and each block's row is multivariate
hypergeometric in what room the shards have left.  Then each block is permuted
by itself and dealt out by its row of the matrix, rows go to their shards, and
each shard is permuted again.  Every permutation is by a seeded hash, so reruns
agree.  Only the matrix passes through the driver: at most max_blocks rows,
whatever the input.

Cases: null text has no bytes (size 1, CRC-32 of nothing); null ids hash as a
constant and are told apart by their text's CRC-32; repeated rows are
interchangeable and take a slot each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import written

#: The library's own draw is limited to fewer rows than this.
LIBRARY_BELOW = 10**9


def _chances(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """The hypergeometric law of how many of n rows are good: the least count and the chances from there on.

    Chances follow from each other by their ratios, from the likeliest count out
    to 40 standard deviations, where less than 1e-300 is left.
    """
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    far = 50 + int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(low, mode - far), min(high, mode + far)
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) * (n - up)) - np.log((up + 1) * (bad - n + up + 1)))
    fall = np.cumsum(np.log(down * (bad - n + down)) - np.log((good - down + 1) * (n - down + 1)))
    chances = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    return low, chances / chances.sum()


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n rows taken from good + bad, how many are good."""
    if good + bad < LIBRARY_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    low, chances = _chances(good, bad, n)
    return low + int(np.searchsorted(np.cumsum(chances), rng.random(), "right").clip(0, len(chances) - 1))


def communication_matrix(sizes: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """counts[block, shard]: row sums are sizes, column sums differ by at most one."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for block, left in enumerate(sizes):
        others = sum(room)
        for shard in range(shards):
            others -= room[shard]
            out[block, shard] = n = _draw(rng, room[shard], others, left) if left else 0
            left -= n
        room = [a - int(b) for a, b in zip(room, out[block], strict=True)]
    return out


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, block_rows: int = 4096, max_blocks: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot and grown_shard for each row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard")
    n = slim.count()
    blocks = max(1, min(max_blocks, -(-n // block_rows)))

    def key(k: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(k), "id", "text_crc32", "size")

    keyed = slim.withColumn("block", _bucket(key(0), blocks))
    sizes = dict(keyed.groupBy("block").count().collect())  # at most max_blocks rows
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    upto = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(matrix.cumsum(axis=1))], "block int, upto array<long>")
    order = ["id", "text_crc32", "size"]
    dealt = (
        keyed.withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy(key(1), *order)))
        .join(F.broadcast(upto), "block")
        .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
        .select(*order, "shard", _bucket(key(2), blocks).alias("cell"), key(3).alias("key"))
    )
    dealt = written(dealt, "dealt")
    # a shard's order is by cell, then by key: each cell is sorted by itself, however large the shard
    before = dealt.groupBy("shard", "cell").count().withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("cell")) - F.col("count")).drop("count")
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", *order)) - 1
    return (
        dealt.withColumn("within", within)
        .join(F.broadcast(before), ["shard", "cell"])  # at most shards * max_blocks rows
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
