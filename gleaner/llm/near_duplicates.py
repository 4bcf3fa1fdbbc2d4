"""Near-duplicates of whole documents by a chosen-path similarity join.

Documents with equal shingle sets form a class, which takes part once.  In each
of several independent trees the classes branch by their minwise tokens: a
node's path is the tokens chosen on the way to it, and two sets stay together
with the probability that equals their similarity at each level.  A node with
few classes is a leaf and its classes are compared exhaustively, by sketches of
one byte for each token; a larger one branches again.  Nodes that are still
large at full depth hold sets that are much alike: they are dealt into blocks of
a leaf's size at random, in each tree and once more for what is still apart, so
that nearly all of a group is linked in time proportional to its size.  Large
nodes of all trees that have one largest component in common are then one group.
What stands outside that component is compared with all of the group in tiles: a
tile holds a part of the one and a part of the other, its sets are compared
inside the task, and out come no more links than join its components.

Candidates are confirmed on whole sets in two steps, so that a large group of
copies costs links in proportion to its size: first each class's likeliest
partner; after that, in each leaf, all classes that have a candidate which they
aren't connected with by then. The pairs of a leaf are never made as rows.

With 16 trees, a pair at the threshold 0.8 that parts in leaves at depth 3 is
missed with probability (1 - 0.8**3)**16, about 1 in 100,000; at depth 5 with 1
in 600; at depth 8 with 1 in 20.  A pair in a group of large nodes is not missed
once each of the two is in such a node of any tree.  Sketches of 128 bytes drop a
pair at the threshold with a probability below 1 in 100,000 (they must agree in
82 places).

Cases: ids are whole numbers (others are cast, and null where that fails); a
null or empty text or one without words has an empty set, is its own
component and is kept; a row with a null id is linked with nothing and kept,
with a null component; repeated rows have one component; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm import shingles
from gleaner.llm.common import discard, known_to_workers, small, written
from gleaner.llm.components import components
from gleaner.llm.tokenization import arrow_rows

TREES, DEPTH, LEAF = 16, 8, 100
#: Levels at which the stages end: the first by itself, since most nodes end there, then some at a time.
STAGES = (2, 5, DEPTH + 1)
#: Of the sketch's bytes, how many must agree: 4.5 standard deviations below the threshold.
ALIKE = 82
#: Sets in each side of a tile, and shingles in them all together, on average at most.
TILE, TILE_ITEMS = 256, 500_000


def sets(docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, hi, lo (128 bits of the set), its minwise tokens and its sketch; n is 0 and the rest null without words."""
    factors = shingles.multipliers(TREES * DEPTH)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, raw in arrow_rows(batches):
            items = np.unique(shingles.windows(shingles.word_hashes(raw)[0], span))
            if len(items):
                both = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
                tokens = shingles.minima(items, factors)
                out.append((doc_id, len(items), int(both[0]), int(both[1]), tokens.view(np.int32), (tokens & np.uint32(255)).astype(np.uint8).tobytes()))
            else:
                out.append((doc_id, 0, None, None, None, None))
            if len(out) >= 2000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"id": pa.int64(), "n": pa.int64(), "hi": pa.int64(), "lo": pa.int64(), "tokens": pa.list_(pa.int32()), "sketch": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(made, "id long, n long, hi long, lo long, tokens array<int>, sketch binary")


def leaves(classes: DataFrame) -> DataFrame:
    """(path, cid, count, big), written: the nodes in which trees end, of `count` classes, two or more; big ones are large at full depth."""
    # paths from one level to another need no more than a class's tokens, so a stage has one row for each class and tree, with the paths of all its levels
    tokens, trees = classes.select("cid", "tokens"), F.sequence(F.lit(0), F.lit(TREES - 1))
    step = lambda path, tree, level: F.xxhash64(path, F.get("tokens", tree * DEPTH + level - 1))
    rows = tokens.select("cid", F.explode(F.transform(trees, lambda t: F.struct(t.alias("tree"), step(t, t, F.lit(1)).alias("path1")))).alias("r")).select("cid", "r.*")
    ends, nodes = [], []
    for first, last in zip((1, *STAGES), STAGES, strict=False):
        paths = [f"path{level}" for level in range(first, last)]
        # counts are a table of their own, so that in the join a large node may be split; a node's count is the sum of those below it
        sums = rows.groupBy(*paths).agg(F.count("*").alias(f"count{last - 1}"))
        for k, level in enumerate(range(first, last - 1)):
            sums = sums.withColumn(f"count{level}", F.sum(f"count{last - 1}").over(W.partitionBy(*paths[: k + 1])))
        # a branch ends at the first level whose node is not large, or at the last one
        over = lambda kind: F.coalesce(*[F.when(F.col(f"count{level}") <= LEAF, F.col(f"{kind}{level}")) for level in range(first, last - 1)], F.col(f"{kind}{last - 1}"))
        wanted = written(sums.select(F.col(paths[-1]), over("path").alias("path"), over("count").alias("count")).where("count > 1"), "counts")
        live = written(rows.join(small(wanted), paths[-1]).select("path", "cid", "tree", "count"), "nodes")
        discard(wanted)
        nodes.append(live)
        large = F.col("count") > LEAF
        if last > DEPTH:
            ends.append(live.select("path", "cid", "count", large.alias("big")))
            break
        ends.append(live.where(~large).select("path", "cid", "count", F.lit(False).alias("big")))
        if live.where(large).isEmpty():
            break
        rows = live.where(large).join(tokens, "cid").withColumnRenamed("path", f"path{last - 1}")
        for level in range(last, STAGES[STAGES.index(last) + 1]):
            rows = rows.withColumn(f"path{level}", step(F.col(f"path{level - 1}"), F.col("tree"), F.lit(level)))
        rows = rows.drop(f"path{last - 1}", "tokens", "count")
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    out = written(out, "leaves")
    discard(*nodes)
    return out


def _agreement(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int16)
    for at in range(0, len(a), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = (sketch[a[s]] == sketch[b[s]]).sum(axis=1)
    return out


def _pairs_in_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of places in the same run of equal keys, no run longer than LEAF."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    within = np.arange(n) - start[run]
    b = np.repeat(np.arange(n), within)
    a = np.arange(len(b)) - np.repeat(np.cumsum(within) - within, within) + start[run][b]
    return a, b


def in_blocks(rows: DataFrame, turn: int) -> DataFrame:
    """rows with big nodes dealt into blocks of about a leaf's size, by a hash of class, node and turn, as nodes of their own."""
    block = F.pmod(F.xxhash64("cid", "path", F.lit(turn)), F.ceil(F.col("count") / LEAF))
    return rows.withColumn("path", F.when(F.col("big"), F.xxhash64("path", block, F.lit(turn))).otherwise(F.col("path")))


def compared(rows: DataFrame, across: bool, ratio: tuple[int, int]) -> DataFrame:
    """Of rows(path, cid, n, sketch, root) what sketches leave to be compared: classes with different roots in one node.

    In the first step (across false) pairs (a, b, alike): each class's likeliest
    earlier partner in its node.  In the second the rows (path, cid, root) that
    have a candidate in their node.  Rows are dealt out
    and sorted by path, so a task holds one stretch of rows at a time, and nodes
    longer than a leaf are cut into blocks.
    """

    def candidates(chunk: list[np.ndarray]) -> pa.RecordBatch:
        path, node, cid, n, root, sketch = chunk
        a, b = _pairs_in_runs(path)
        keep = ratio[1] * np.minimum(n[a], n[b]) >= ratio[0] * np.maximum(n[a], n[b])
        keep &= root[a] != root[b]
        a, b = a[keep], b[keep]
        alike = _agreement(sketch, a, b)
        keep = alike >= ALIKE
        a, b, alike = a[keep], b[keep], alike[keep]
        if across:
            at = np.unique(np.concatenate([a, b]))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(cid[at]), pa.array(root[at])], ["path", "cid", "root"])
        if len(b):
            order = np.lexsort((a, -alike, b))
            order = order[np.r_[True, np.diff(b[order]) != 0]]
            a, b, alike = a[order], b[order], alike[order]
        x, y = cid[a], cid[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(alike.astype(np.int32))], ["a", "b", "alike"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, place = [], None, 0
        for batch in batches:
            raw = [np.asarray(batch.column(k)) for k in range(4)]
            raw.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            held = [np.concatenate([h, r]) for h, r in zip(held, raw, strict=True)] if held else raw
            path = held[0]
            # whole runs, and of a run that is longer than a leaf whole blocks; the last one waits for more rows
            cut = int(np.flatnonzero(np.r_[True, path[1:] != path[:-1]])[-1])
            cut += (len(path) - cut) // LEAF * LEAF if len(path) - cut > LEAF else 0
            if cut:
                yield candidates(blocked([h[:cut] for h in held]))
                held = [h[cut:] for h in held]
        if held and len(held[0]):
            yield candidates(blocked(held))

    def blocked(chunk: list[np.ndarray]) -> list[np.ndarray]:
        """Keys that part runs into blocks of a leaf's size."""
        path = chunk[0]
        start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        within = np.arange(len(path)) - np.repeat(start, np.diff(np.r_[start, len(path)]))
        return [np.cumsum(within % LEAF == 0), *chunk]

    dealt = rows.select("path", "cid", "n", "root", "sketch").repartition("path").sortWithinPartitions("path", "cid")
    return dealt.mapInArrow(run, "path long, cid long, root long" if across else "a long, b long, alike int")


def whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, items) of wanted(cid): whole sets in order, made again from the texts of the classes concerned."""
    wanted = written(wanted.join(classes.select("cid", "rep", "hi", "lo"), "cid"), "wanted")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for cid, hi, lo, raw in arrow_rows(batches):
            items = np.unique(shingles.windows(shingles.word_hashes(raw)[0], span))
            if np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist() == [hi, lo]:
                out.append((cid, items.view(np.int64)))
            if len(out) >= 500:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["cid", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    found = texts.join(small(wanted), "rep").select("cid", "hi", "lo", "text").mapInArrow(whole, "cid long, items array<long>")
    # rows with the same id and text give the same set
    found = written(found, "sets")
    discard(wanted)
    return found


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, span: int, ratio: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are as alike as asked."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    found = whole_sets(wanted, classes, docs, span, id_col, text_col)
    left, right = (found.select(F.col("cid").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    links = pairs.select("a", "b").join(left, "a").join(right, "b").where(ratio[1] * shared >= ratio[0] * (F.size("items_a") + F.size("items_b") - shared))
    links = written(links.select("a", "b").distinct(), "links")
    discard(found)
    return links


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a node's sets: a product of 0-1 matrices, some columns at a time, of the items that two sets or more hold."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    column = column.reshape(-1)
    row, column = row[held[column] > 1], number[column[held[column] > 1]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(number[-1]) + 1, 4096):
        s = slice(*np.searchsorted(column, [first, first + 4096]))
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[s], column[s] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def linked_in_nodes(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Links (a, b) of rows(path, cid, root, items), no more than join a node's components: its classes are compared exhaustively on whole sets."""

    def links(cid: list[int], root: list[int], sets: list[np.ndarray]) -> list[tuple]:
        out, to = [], {r: r for r in root}

        def top(r: int) -> int:
            while to[r] != r:
                r = to[r]
            return r

        if len(to) > 1:
            both, n, of = _shared(sets), np.array([len(x) for x in sets]), np.array(root)
            hit = np.triu((ratio[1] * both >= ratio[0] * (n[:, None] + n[None, :] - both)) & (of[:, None] != of[None, :]), 1)
            for x, y in zip(*np.nonzero(hit), strict=True):
                p, q = top(root[x]), top(root[y])
                if p != q:
                    to[max(p, q)] = min(p, q)
                    out.append((min(cid[x], cid[y]), max(cid[x], cid[y])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = ([], [], []), None, []
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                if path != last:
                    out += links(*held)
                    held, last = ([], [], []), path
                held[0].append(batch.column(1)[k].as_py())
                held[1].append(batch.column(2)[k].as_py())
                held[2].append(batch.column(3)[k].values.to_numpy())
            yield made(out)
            out = []
        yield made(links(*held))

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.select("path", "cid", "root", "items").repartition("path").sortWithinPartitions("path", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_tiles(rows: DataFrame) -> DataFrame:
    """(path, cid, root): tiles in which all that stands outside the largest component of a group of large nodes meets all of the group."""
    sizes = rows.groupBy("path", "root").count()
    main = sizes.groupBy("path").agg(F.max(F.struct("count", "root")).alias("x")).select("path", F.col("x.root").alias("main"))
    group = written(rows.join(main, "path").select("main", "cid", "root", "n").distinct(), "groups")
    outside = F.col("root") != F.col("main")
    parts = lambda where: F.ceil(F.greatest(F.count(F.when(where, 1)) / TILE, F.sum(F.when(where, F.col("n"))) / TILE_ITEMS)).cast("int")
    dealt = group.groupBy("main").agg(parts(F.lit(True)).alias("parts"), parts(outside).alias("parts_out")).where("parts_out > 0")
    group = group.join(small(dealt), "main")
    own = lambda k: F.pmod(F.xxhash64("cid", "main"), F.col(k)).cast("int")
    every = group.select("main", "cid", "root", own("parts").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts_out") - 1)).alias("y"))
    apart = group.where(outside).select("main", "cid", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), own("parts_out").alias("y"))
    return every.unionByName(apart).select(F.xxhash64("main", "x", "y").alias("path"), "cid", "root").distinct()


def near_duplicates(docs: DataFrame, span: int = 5, ratio: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept for each row; linked are sets with ratio[1] * |both| >= ratio[0] * |either|."""
    known_to_workers(docs.sparkSession)
    made = written(sets(docs, span, id_col, text_col), "rows")
    grouped = made.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # what classes hold of tokens and sketches isn't kept twice
    rows = written(made.select("id", "n", "hi", "lo"), "ids")
    discard(made)
    with_set = rows.where("n > 0 and id is not null")
    ends = leaves(classes)
    told = classes.select("cid", "n", "sketch")

    def likely_links(rows: DataFrame) -> DataFrame:
        """Confirmed links (a, b) of each class's likeliest partner."""
        likeliest = compared(rows, False, ratio).groupBy("b").agg(F.max(F.struct("alike", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
        pairs = written(likeliest, "pairs")
        out = confirmed(pairs, classes, docs, span, ratio, id_col, text_col)
        discard(pairs)
        return out

    def apart(roots: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one component."""
        rows = ends.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
        mixed = written(rows.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("path"), "mixed")
        # sketches are joined to what is open alone
        out = written(rows.join(small(mixed), "path").join(told, "cid"), "open")
        discard(mixed, roots)
        return out

    links = likely_links(in_blocks(ends.join(told, "cid").withColumn("root", F.col("cid")), 0))
    open_ends = apart(written(components(links), "roots"))
    big = open_ends.where("big")
    if not big.isEmpty():
        links = links.unionByName(likely_links(in_blocks(big, 1)))
        stale, open_ends = open_ends, apart(written(components(links), "roots"))
        discard(stale)
    # in leaves, the classes that have a candidate across components are compared on whole sets where they stand
    across = written(compared(open_ends.where("not big"), True, ratio), "across")
    found = whole_sets(across.select("cid").distinct(), classes, docs, span, id_col, text_col)
    more = linked_in_nodes(across.join(found, "cid"), ratio)
    big = open_ends.where("big")
    if not big.isEmpty():
        tiles = written(in_tiles(big), "tiles")
        more = more.unionByName(linked_in_nodes(tiles.join(whole_sets(tiles.select("cid").distinct(), classes, docs, span, id_col, text_col), "cid"), ratio))
    roots = written(components(links.unionByName(more)), "roots")

    named = classes.select("cid", "rep", "hi", "lo").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "root").select("hi", "lo", "component_id")
    linked = with_set.select("id", "n", "hi", "lo").join(named, ["hi", "lo"]).select("id", "n", "component_id")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
