"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def known_to_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, and before that in what --py-files brings them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/gleaner-shared"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later job reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("gleaner-"):
                path.getFileSystem(conf).delete(path, True)


def free_name(taken: list[str], base: str) -> str:
    """base, or the first of base_, base__ and so on of which no taken name is a start, whatever the case."""
    while any(t.lower().startswith(base.lower()) for t in taken):
        base += "_"
    return base


def _bytes(kind: str, name: str) -> Column:
    """About how many bytes a value takes: of strings their own, of numbers eight."""
    c, fields = F.col(f"`{name}`"), max(1, kind.count(":"))
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if "string" in kind or "binary" in kind:
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return 8 * fields * F.greatest(F.size(c), F.lit(1)) + 16 if kind.startswith("array") else F.lit(8 * fields)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df to be broadcast if its values have no more than `most` bytes; else as it is, for a shuffled join. df is a written table, so that adding up is cheap."""
    size = df.agg(F.sum(sum((_bytes(kind, name) for name, kind in df.dtypes), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
