"""Secret scans: candidates in whole texts, judged by how many owners hold them.

A task finds candidates in its texts: the values of assignments, access keys,
long hexadecimal strings, and tokens of letters of both cases and digits.  Over
the whole corpus the hash of each value is counted by distinct repositories and
owners.  A value of `wide` owners or more is a widely copied example; one that a
single owner has, and that looks live (many different characters, letters and
digits, no placeholder), is that owner's own, and its place is added as a span
`live`.  The first three kinds are spans in any case.

Candidates are short rows that are added up before they are sent, so a value that
a third of the documents hold is one row for each owner and task.  Texts are read
once and never exchanged; verdicts return by a join on the hash, which may be
split, and only documents with candidates take part in it.

Cases: null text is empty; a null owner or repository is one of its own; repeated
rows are rows of their own; spans count code points, the end exclusive; a text
without candidates has no spans; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import known_to_workers, small, written

NAMES = ("password", "passwd", "secret", "token", "api_?key")
#: Any case, but of ASCII letters only, in the syntax that Python and RE2 share.
_ANY_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", x) for x in NAMES)
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that fails the least length holds no other that passes it, so these are asked for at once.
ACCESS, HEX, TOKEN = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "token", "live"]
BASE = KINDS[:3]
LEAST_VALUE, LEAST_DIFFERENT = 8, 10
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "0123456", "1234567", "abcdef0", "deadbeef")
_MAY = "|".join([rf"""({_ANY_CASE})["']?\x20*[:=]""", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{20}"])
_FIND = [("assign", re.compile(ASSIGN), 2), ("access", re.compile(ACCESS), 0), ("hex", re.compile(HEX), 0)]
_TOKEN = re.compile(TOKEN)


def looks_live(value: str) -> bool:
    """Letters and digits, many different characters, no placeholder."""
    low = value.lower()
    return len(set(value)) >= LEAST_DIFFERENT and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)) and not any(x in low for x in PLACEHOLDERS)


def candidates(text: str) -> list[tuple[str, int, int, int, int, str]]:
    """kind, span, and the value with its own span; tokens only where no other candidate's span overlaps them."""
    out = []
    for kind, pattern, group in _FIND:
        out += [(kind, *m.span(), *m.span(group), m[group]) for m in pattern.finditer(text) if kind != "assign" or len(m[group]) >= LEAST_VALUE]
    taken = sorted(x[1:3] for x in out)
    for m in _TOKEN.finditer(text):
        if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")) and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append(("token", *m.span(), *m.span(), m[0]))
    return out


SPAN = "struct<kind: int, start: long, end: long, value_start: long, value_end: long, hash: binary, live: boolean>"
_SPAN = pa.struct([("kind", pa.int32()), *[(x, pa.int64()) for x in ("start", "end", "value_start", "value_end")], ("hash", pa.binary()), ("live", pa.bool_())])


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        may = pc.match_substring_regex(texts, _MAY).to_pylist()
        spans = [
            [
                {"kind": KINDS.index(k), "start": a, "end": b, "value_start": c, "value_end": d, "hash": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v)}
                for k, a, b, c, d, v in (candidates(texts[i].as_py()) if hit else ())
            ]
            for i, hit in enumerate(may)
        ]
        kept = [batch.column(x) for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(_SPAN))], [*[x for x in batch.schema.names if x != "text"], "found"])


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate's hash its distinct owners and repositories."""
    each = found.select("owner", "repository", F.explode("found.hash").alias("hash")).groupBy("hash", "owner", "repository").count()
    return each.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct(F.struct("owner", "repository")).alias("repositories"), F.sum("count").alias("places"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repository_cols: tuple[str, ...] = ("source", "lang"), wide: int = 3) -> DataFrame:
    """id_col and, in order, spans (kind, start, end, verdict, owners, repositories) for each row of docs.

    A verdict is example (of `wide` owners or more), own (of one owner, looks
    live) or unclear; a candidate that is neither of the three kinds nor own is
    left out.
    """
    known_to_workers(docs.sparkSession)

    def held_by(columns: tuple[str, ...]) -> Column:
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)]))

    slim = docs.select(F.col(id_col).alias("id"), held_by(owner_cols).alias("owner"), held_by(repository_cols).alias("repository"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, owner string, repository string, found array<{SPAN}>"
    table = written(slim.mapInArrow(_found, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = table.where(F.size("found") > 0)
    counted = written(ownership(some).where((F.col("owners") == 1) | (F.col("owners") >= wide)), "owners")
    each = some.select("row", "id", F.explode("found").alias("c")).select("row", "id", "c.*")
    judged = each.join(small(counted), "hash", "left")
    verdict = F.when(F.col("owners") >= wide, "example").when(F.col("live") & (F.col("owners") == 1), "own").otherwise("unclear")
    token, live = KINDS.index("token"), KINDS.index("live")

    def span(kind: Column, start: str, end: str) -> Column:
        return F.struct(F.col(start).alias("start"), kind.alias("rank"), F.col(end).alias("end"), "verdict", "owners", "repositories")

    spans = F.array_compact(F.array(F.when(F.col("kind") != token, span(F.col("kind"), "start", "end")), F.when(F.col("verdict") == "own", span(F.lit(live), "value_start", "value_end"))))
    grouped = judged.withColumn("verdict", verdict).withColumn("spans", spans).groupBy("row", "id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort("spans"), lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["verdict"].alias("verdict"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    out = grouped.select("id", ordered.alias("spans"))
    return out.unionByName(table.where(F.size("found") == 0).select("id", F.array().cast(out.schema["spans"].dataType).alias("spans"))).withColumnRenamed("id", id_col)


def written_spans(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
