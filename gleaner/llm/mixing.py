"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash of their id.  A target of f
times a source's words takes every block floor(f) times, and of the blocks in a
permuted order those that the fraction pays for; one block is taken in part,
document by document, the last of them word by word.  These exact block quotas
are then split among the output shards: at each node of a binary tree every
source's quota goes left and right by a multivariate hypergeometric draw, which
is made by ranking the quota's places by a seeded hash.  A leaf draws its quota
from the source's permuted blocks, each place once, and rows carry a hashed key
by which a shard is shuffled locally.

Only tables of sources and of blocks are ever sorted as a whole.  There are
`least_blocks` blocks and one for each source, or more, so that a block has no
more than about `block_rows` documents: the one block of a source that is taken in
part is ordered in one task.  Documents move once, with their id and size alone.

Cases: null text has no words and counts 0; a null source is a source of its
own, the last; null ids hash as the empty string; repeated rows are taken each;
a source without words has target 0 and its rows are taken 0 times; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import free_name, small, word_count, written

#: By order of source, repeating.
WEIGHTS = (3, 1, 2)


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts]))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """by_source(source, source_size) with each source's place and target.

    Shares go by weight; a source stops at `most` times its size and what is over
    is shared out again.  In order of most * size / weight, the sources that stop
    are the first few, and the others get what is left at one rate for each unit of weight.
    """
    # one row for each source
    place = by_source.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    s = place.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    every, rest = W.partitionBy(), W.orderBy((F.col("cap") / F.col("weight")), "place")
    s = s.select(
        "*", F.sum("source_size").over(every).alias("total"),
        (F.sum("cap").over(rest) - F.col("cap")).alias("capped"), (F.sum("weight").over(every) - F.sum("weight").over(rest) + F.col("weight")).alias("weights"),
    )
    s = s.withColumn("rate", (share * F.col("total") - F.col("capped")) / F.col("weights"))
    # the rate rises from place to place while sources stop, and falls once one is stopped that shouldn't be: the largest is the one sought
    rate = F.max("rate").over(every)
    return s.select(*by_source.columns, "place", F.least(F.col("cap").cast("double"), rate * F.col("weight")).alias("target"))


def split_quotas(places: DataFrame, levels: int, seed: str) -> DataFrame:
    """places(source_place, k) with the shard that each goes to: 2 ** levels shards of equal size, up to one place."""
    node = F.lit(0)
    for level in range(levels):
        places = places.withColumn("node", node)
        at = W.partitionBy("node")
        rank = F.row_number().over(at.orderBy(_hash(seed, F.lit(level), F.col("source_place"), F.col("k")), "source_place", "k"))
        left = rank <= F.floor((F.count("*").over(at) + 1) / 2)
        node = (2 * F.col("node") + F.when(left, 0).otherwise(1)).cast("int")
        places = places.withColumn("next", node).drop("node").withColumnRenamed("next", "node")
        node = F.col("node")
    return places.withColumnRenamed("node", "shard") if levels else places.withColumn("shard", F.lit(0))


def mix(docs: DataFrame, carry: list[str] = (), size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, levels: int = 4, least_blocks: int = 2048, block_rows: int = 50_000, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: struct `carry` of the named columns, id, source, size, source_size, target, and `takes`, an array of (pass, shard, taken words, shuffle key)."""
    filler = F.lit(0).alias(free_name(list(carry), "_"))
    sized = docs.select(
        F.struct(filler, *[F.col(f"`{c}`") for c in carry]).alias("carry"),
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"), _hash(seed, F.col(id_col)).alias("key"),
    )
    slim = written(sized.drop("carry"), "sizes")
    counted = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    total, every = F.sum("source_size").over(W.partitionBy()), F.greatest(F.lit(least_blocks), F.ceil(F.sum("n").over(W.partitionBy()) / block_rows))
    blocks = F.greatest(F.lit(1), F.ceil(every * F.col("source_size") / F.greatest(total, F.lit(1))), F.ceil(F.col("n") / block_rows)).cast("long")
    plan = written(targets(counted, weights, share, most).withColumn("blocks", blocks), "sources")

    def placed(df: DataFrame) -> DataFrame:
        found = df.join(small(plan), df["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        return found.withColumn("block", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("blocks")))

    # blocks in permuted order, with the words before each
    sums = placed(slim).groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    order = W.partitionBy("place").orderBy(_hash(seed, F.col("place"), F.col("block")), "block")
    permuted = sums.select(
        "place", "block", "words", whole.alias("whole"), F.row_number().over(order).alias("k"), F.count("*").over(W.partitionBy("place")).alias("n"),
        (F.floor("target").cast("long") - whole * F.col("source_size") - F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("words")).alias("left"),
    )
    # each pass below `whole` takes every block, pass `whole` those that the fraction pays for
    room = lambda p: F.when(p < F.col("whole"), F.col("words")).when(p == F.col("whole"), F.least("left", "words")).otherwise(0)
    uses = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda p: F.struct(p.alias("pass"), room(p).alias("room"), (p * F.col("n") + F.col("k")).alias("at")))
    quota = permuted.select("place", "block", "words", F.explode(uses).alias("use")).select("place", "block", "words", "use.*").where("room > 0")
    quota = quota.withColumn("q", F.row_number().over(W.partitionBy("place").orderBy("at")))
    tree = split_quotas(quota.select(F.col("place").alias("source_place"), F.col("q").alias("k")), levels, seed)
    # a leaf's draws are disjoint runs of the quota: its n places take the next n blocks
    runs = tree.withColumn("q", F.row_number().over(W.partitionBy("source_place").orderBy("shard", "k"))).select(F.col("source_place").alias("place"), "q", "shard")
    drawn = quota.join(runs, ["place", "q"]).groupBy("place", "block").agg(F.max("words").alias("words"), F.min("room").alias("least"), F.sort_array(F.collect_list(F.struct("pass", "shard", "room"))).alias("draws"))
    drawn = written(drawn, "draws")

    base = placed(sized if carry else slim.withColumn("carry", F.struct(filler)))
    base = base.join(small(drawn), ["place", "block"], "left")
    in_part = F.coalesce(F.col("least") < F.col("words"), F.lit(False))
    ahead = F.sum("size").over(W.partitionBy("place", "block").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = base.where(~in_part).withColumn("ahead", F.lit(0).cast("long")).unionByName(base.where(in_part).withColumn("ahead", ahead))  # one block of a source is taken in part
    taken = lambda d: F.when(d["room"] == F.col("words"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), d["room"] - F.col("ahead")))).cast("long")
    takes = F.transform("draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), taken(d).alias("taken"), _hash(seed, F.col("id"), d["pass"], d["shard"]).alias("shuffle_key")))
    return rows.select("carry", "id", "source", "size", "source_size", "target", F.coalesce(F.filter(takes, lambda t: t["taken"] > 0), F.array().cast(TAKES)).alias("takes"))


TAKES = "array<struct<pass:int,shard:int,taken:bigint,shuffle_key:string>>"


def taken_words() -> Column:
    return F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["taken"])
