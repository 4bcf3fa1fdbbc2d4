"""Context-triggered piecewise hashing of whole texts.

A rolling hash of seven bytes ends a chunk wherever it hits the last residue of
the block size; each chunk gives one base-64 character of the signature.  The
block size is the largest of 3 * 2**k at which a text has at least `least`
chunks (3 if none has), so a fingerprint is "block:signature:signature at twice
the block".  Fingerprints are compared where block sizes are compatible, by the
edit distance of their signatures.

A text that says one phrase over and over ends a chunk in each period or in none,
so its chunks may stay many at any block size.  As the method has it, a signature
is then bounded: the last of `most` characters stands for all the rest.  Other
texts have about twice `least` chunks, and never so many.

Cases: null text is empty; an empty text has the fingerprint "3::" and is like
another empty one (1) and no other (0); equal texts have equal fingerprints;
ids are whole numbers (others are cast, and null where that fails);
rows are put in order by id (null first), then by a hash of the text, so equal
rows are each other's neighbours; a single row is its own neighbour; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import known_to_workers, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, SMALLEST = 7, 3
#: Odd multipliers for the bytes of the rolling window, the newest first.
WEIGHTS = [pow(0x01000193, k + 1, 1 << 32) for k in range(WINDOW)]


def rolling(raw: bytes) -> np.ndarray:
    """At each byte a hash of it and the six before it."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = x * np.uint32(WEIGHTS[0])
    for k in range(1, min(WINDOW, len(x))):
        out[k:] += x[:-k] * np.uint32(WEIGHTS[k])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def fingerprint(raw: bytes, least: int = 32, most: int = 128) -> str:
    if not raw:
        return f"{SMALLEST}::"
    hashes = rolling(raw)
    block = SMALLEST
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
    at = hashes[ends]
    while (keep := at % np.uint32(2 * block) == 2 * block - 1).sum() >= least:  # ends at twice the block are some of those at the block
        block, ends, at = 2 * block, ends[keep], at[keep]

    def signature(cuts: list[int]) -> str:
        cuts = cuts[: most - 1]
        if not cuts or cuts[-1] != len(raw):
            cuts = [*cuts, len(raw)]
        return "".join(ALPHABET[zlib.crc32(raw[a:b]) >> 26] for a, b in zip([0, *cuts], cuts, strict=False))

    return f"{block}:{signature((ends[:most] + 1).tolist())}:{signature((ends[keep][:most] + 1).tolist())}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best share of equal characters, by edit distance, of two signatures at one block size; 0 where no block size is shared."""

    def part(x: Column, k: int) -> Column:
        return F.split_part(x, F.lit(":"), F.lit(k))

    def like(x: Column, y: Column) -> Column:
        most = F.greatest(F.length(x), F.length(y))
        return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / most)

    block_a, block_b = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) <= 3) | (F.length(b) <= 3), F.lit(0.0))
        .when(block_a == block_b, F.greatest(like(part(a, 2), part(b, 2)), like(part(a, 3), part(b, 3))))
        .when(block_a == 2 * block_b, like(part(a, 2), part(b, 3)))
        .when(block_b == 2 * block_a, like(part(a, 3), part(b, 2)))
        .otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    """The last quarter of the text gives way to as much of the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
ROW = f"{OUT}, part int, role string, text string"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def _result(doc_id: int | None, text: str, mine: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following).encode()
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mine, fingerprint(changed), theirs


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], NAMES)


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for each row of a sorted partition but the last, which waits for the next partition's first; both are passed on with their text."""
    part, held, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for doc_id, text in zip(*(x.slice(at, 256).to_pylist() for x in batch.columns), strict=True):
                text = text or ""
                mine = fingerprint(text.encode())
                if held is None:
                    out.append((doc_id, None, None, mine, None, None, part, "first", text))
                else:
                    out.append((*_result(*held, text, mine), part, "done", None))
                held = doc_id, text, mine
            if len(out) >= 2000:
                yield _batch(out)
                out = []
    if held is not None:
        out.append((held[0], None, None, held[2], None, None, part, "last", held[1]))
    yield _batch(out)


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(x.to_pylist() for x in batch.columns), strict=True)
        yield _batch([(*_result(*row), None, None, None) for row in rows])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint and length, its edited text's hash and fingerprint, and how like they and the next text's are.

    One exchange of the texts, by ranges of id; within a range each row's
    successor is the next row of the stream.  Of each partition two rows, its
    first and last, are joined to their neighbours in other partitions.
    """
    known_to_workers(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id, or of none, are parted by their texts, and equal ones by their place, so that no id fills a range
    order = ["doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place")]
    dealt = slim.select(*order, "text").repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    rows = written(dealt.select("doc_id", "text").mapInArrow(_in_order, ROW), "fingerprints")
    edges = rows.where("role != 'done'")
    firsts = edges.where("role = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    # of partitions that have rows, each one's successor; the last one's is the first: one short row for each partition
    ring = firsts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("after"))
    waiting = edges.where("role = 'last'").join(ring, "part").join(firsts.withColumnRenamed("part", "after"), "after")
    patched = waiting.select("doc_id", "text", "fingerprint", "following", "theirs").mapInArrow(_across, ROW)
    found = rows.where("role = 'done'").unionByName(patched)
    mine = F.col("fingerprint")
    return found.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(mine, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(mine, F.col("next_fingerprint")).alias("near_next"),
    )
