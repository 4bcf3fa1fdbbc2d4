"""Fill-in-the-middle: texts cut at seeded token boundaries and put in another order.

Equal texts share one entry of a distinct-text index: they are grouped by
digest, and the group holds the set of its whole contents, so that what is in
one entry is equal byte for byte.  Each content's token ends are found once and
kept as an Elias-Fano list (about two bits and a few low bits for each token).
Documents are joined to the index by digest; both of a document's cuts are
selected from the list, and the pieces are put together by Spark.

The texts pass one exchange, in which equal ones are collapsed before they are
sent; the other side of the join is an id and a digest for each document.  A
text that more than `split_at` documents have is dealt out: its entry is
repeated once for each `split_at` of them, so no task gets all of its copies.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`.  Draws are taken from
sha256 of `seed:id`.  The form is plain (the text as it is), psm
(`<P>`prefix`<S>`suffix`<M>`middle) or spm (`<S>`suffix`<P>`prefix`<M>`middle).

Cases: null text is empty; an empty text, and one that holds a marker, stays
plain; a text of white space is one token; a null id is drawn as an empty one;
repeated rows are rows of their own and come out alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import known_to_workers, small, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HEAD = struct.Struct("<QB")


def token_ends(text: str) -> np.ndarray:
    """Code points before the end of each token."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = ~blank
    ends[:-1] &= blank[1:]
    if len(ends):
        ends[-1] = True  # white space at the end is a token, or else a word ends there
    return np.flatnonzero(ends) + 1


def elias_fano(values: np.ndarray) -> bytes:
    """An ascending list: its low bits as they are, its high bits in unary."""
    n = len(values)
    low = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
    lows = (values[:, None] >> np.arange(low)) & 1
    high = np.zeros((int(values[-1]) >> low) + n if n else 0, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    return HEAD.pack(n, low) + np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def selected(raw: bytes, places: list[int]) -> list[int]:
    """The values at these places of a list (from 1; 0 is before the first): where the k-th one bit of its high part stands, and its low bits."""
    n, low = HEAD.unpack_from(raw)
    size = (n * low + 7) // 8
    lows = np.frombuffer(raw, np.uint8, size, HEAD.size)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -1, HEAD.size + size), bitorder="little"))

    def value(k: int) -> int:
        bits = int.from_bytes(lows[k * low // 8 : ((k + 1) * low + 7) // 8].tobytes(), "little") >> (k * low % 8)
        return (int(ones[k]) - k) << low | bits & ((1 << low) - 1)

    return [value(k - 1) if k else 0 for k in places]


def _boundaries(texts: pa.Array) -> pa.Array:
    ends = [token_ends(x.as_py()) for x in texts]
    return pa.StructArray.from_arrays([pa.array(map(len, ends), pa.int64()), pa.array(map(elias_fano, ends), pa.binary())], ["n", "ends"])


def _cuts(lists: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    at = [(None, None) if a is None else selected(x.as_py(), [a, b]) for x, a, b in zip(lists, first.to_pylist(), second.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in at], pa.int64()) for k in (0, 1)], ["first", "second"])


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """keyed(digest, text) to the index: a row for each content with digest, text, content (its check), n and ends.

    The lists are found once for each content and joined to it by digest: what
    Python returns has lost its place, while the texts stay where their one
    exchange (which both sides share) has put them.
    """
    groups = keyed.groupBy("digest").agg(F.collect_set("text").alias("texts"))
    each = groups.select("digest", F.explode("texts").alias("text")).withColumn("content", F.xxhash64("text"))
    lists = each.withColumn("index", F.arrow_udf(_boundaries, "n long, ends binary")("text")).select(F.col("digest").alias("of"), F.col("content").alias("of_content"), "index.*")
    return each.join(lists, (F.col("digest") == F.col("of")) & _same("content", "of_content")).select("digest", "content", "text", "n", "ends")


def _same(a: str, b: str) -> Column:
    """a = b as a condition that isn't a key of a join, which would want both sides dealt anew."""
    return F.col(a).bitwiseXOR(F.col(b)) == 0


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def arranged(joined: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """joined(id, text, n, ends) with the form, the cuts and the output."""
    text, n = F.col("text"), F.col("n")
    draws = joined.withColumn("draws", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    first, second, third, fourth = (_draw(F.col("draws"), k) for k in range(4))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (third % 100 >= rate), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    units = [F.when(F.col("form") != "plain", pick(first % (n + 1), second % (n + 1))) for pick in (F.least, F.greatest)]
    found = draws.withColumn("form", form).withColumn("at", F.arrow_udf(_cuts, "first long, second long")("ends", *units))
    a, b = F.col("at.first"), F.col("at.second")
    prefix, middle, suffix = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")), F.substring(text, (b + 1).cast("int"), F.length(text))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return found.select("id", "n", "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form.  A piece holds no marker and none can arise where two pieces meet, so each stands once."""

    def between(start: str, end: str | None) -> Column:
        at = F.locate(start, output) + len(start)
        return F.substring(output, at, (F.locate(end, output) if end else F.length(output) + 1) - at)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, split_at: int = 512) -> DataFrame:
    """id_col, n (tokens), form, prefix_chars, middle_chars and output for each row of docs; `rate` percent are cut, `spm` percent of those as spm."""
    known_to_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    slim = written(keyed.select("id", "digest", F.xxhash64("text").alias("check"), F.monotonically_increasing_id().alias("row")), "fim-documents")
    copied = written(slim.groupBy("digest").count().where(F.col("count") > split_at).select("digest", F.ceil(F.col("count") / split_at).cast("int").alias("parts")), "fim-copied")
    dealt, texts = slim.join(small(copied), "digest", "left"), keyed.select("digest", "text")
    index = distinct_texts(texts.join(small(copied), "digest", "left_anti"))
    few = index.join(dealt.where("parts is null").withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & _same("content", "check"))
    parted = distinct_texts(texts.join(small(copied), "digest", "left_semi")).join(small(copied), "digest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pick = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")  # by numbers that are written, so that a task done again deals out alike
    drawn = dealt.where("parts is not null").select("id", F.col("digest").alias("d"), "check", pick.alias("p"))
    many = parted.join(drawn, (F.col("digest") == F.col("d")) & (F.col("part") == F.col("p")) & _same("content", "check"))
    columns = ["id", "text", "n", "ends"]
    return arranged(few.select(columns).unionByName(many.select(columns)), seed, rate, spm).withColumnRenamed("id", id_col)
