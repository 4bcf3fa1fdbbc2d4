"""Sum-of-squares online packing of documents into token windows.

Each task packs the documents of its own scan partition, so nothing is
exchanged.  A document longer than a window fills whole windows first; what is
left over is placed online: of all fill levels that still have room (and a new
window) the one is taken after which the sum of squared counts of partially
filled windows is smallest.  The counts are kept in a level array.  Windows
still open at the end, or when they hold more than `most_open` tokens, are
poured together in order of level, cut at window borders, so that each task
leaves at most one window that is not full.

Cases: null text is an empty document, which is its end token alone; null ids
stay; repeated rows are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import tokenization
from gleaner.llm.common import known_to_workers

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
FAR = 1 << 40


class LevelPacker:
    """Places items of fewer tokens than a window; full windows come out of add(), the others out of pour()."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.shut = np.full(window + 1, FAR, np.int64)  # levels without an open window can't be chosen
        self.shut[0] = 0
        self.open: dict[int, list[list]] = defaultdict(list)
        self.held = 0

    def level(self, size: int) -> int:
        """The level whose window takes the item; 0 is a new window.

        Moving a window from level h to h + size changes the sum of squares by
        2 * (count[h + size] - count[h] + 1); new and filled windows have one term less.
        """
        change = 2 * (self.count[size:] - self.count[: self.window - size + 1]) + self.shut[: self.window - size + 1]
        change[0] -= 1
        change[-1] -= 1
        return int(change.argmin())

    def add(self, piece: tuple, size: int) -> Iterator[list]:
        level = self.level(size)
        pieces = self.take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self.put(level + size, pieces)
            if self.held > self.most_open:
                yield from self.pour(last=False)

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.held -= level
        if not self.count[level]:
            self.shut[level] = FAR
        return self.open[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.held += level
        self.shut[level] = 0
        self.open[level].append(pieces)

    def pour(self, last: bool) -> Iterator[list]:
        """All open windows in one stream, cut at window borders; if not last, the rest stays open."""
        filled, room = [], self.window
        for level in sorted(self.open):
            while self.open[level]:
                for doc_id, start, ids, total in self.take(level):
                    while len(ids) >= 4 * room:
                        yield [*filled, (doc_id, start, ids[: 4 * room], total)]
                        start, ids, filled, room = start + room, ids[4 * room :], [], self.window
                    if ids:
                        filled.append((doc_id, start, ids, total))
                        room -= len(ids) // 4
        if filled and last:
            yield filled
        elif filled:
            self.put(self.window - room, filled)


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, most_open: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts in the document's ids, its length and CRC-32, and its window and offset there."""
    known_to_workers(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenization.encoder(tokenizer, want_ids=True), LevelPacker(window, most_open)
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in pieces:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(NAMES))], NAMES)
            out.clear()
            return batch

        for rows in tokenization.by_bytes(tokenization.arrow_rows(batches)):
            for (doc_id, _), ids in zip(rows, encode.batch([x[1] for x in rows]), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([(doc_id, start, ids[4 * start : 4 * (start + window)], total)])
                if whole < total:
                    for pieces in packer.add((doc_id, whole, ids[4 * whole :], total), total - whole):
                        emit(pieces)
            if len(out) >= 10_000:
                yield flush()
        for pieces in packer.pour(last=True):
            emit(pieces)
        yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(packed, SCHEMA).withColumnRenamed("doc_id", id_col)
