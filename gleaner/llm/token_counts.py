"""Token counts: lengths only, from batch encoding in Arrow functions.

Cases: null text counts as empty (0 bytes, 0 tokens); null ids stay; repeated
rows are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import tokenization
from gleaner.llm.common import known_to_workers

TOKENIZER = "word_bpe_49k.json"


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit for each row of docs.

    No exchange: the scan's partitions, which Spark balances by file bytes, are
    encoded where they are read.  A batch holds about batch_bytes of text, however
    many rows that is; see tokenization for how long texts are cut.
    """

    known_to_workers(docs.sparkSession)
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenization.encoder(tokenizer)
        for rows in tokenization.by_bytes(tokenization.arrow_rows(batches), batch_bytes):
            raws = [x[1] for x in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], id_type), pa.array(map(len, raws), pa.int64()), pa.array(encode.batch(raws), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = pa.int64() if dict(slim.dtypes)["id"] == "bigint" else pa.string()
    if id_type == pa.string():
        slim = slim.withColumn("id", F.col("id").cast("string"))
    kind = "long" if id_type == pa.int64() else "string"
    out = slim.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
