"""Line dedup by a join of deletion neighbourhoods, keeping the earliest line.

A line is dropped if an equal line stands earlier (by document id, then line
number), or a line within the edit bound that is kept.  The bound is one edit (a
character put in, left out or changed) if the shorter of two lines has at least
`least` characters, that is about 1 in 20; in a shorter line one character
makes another word, so the bound is none.  Equal lines meet by hash.  For the
rest each distinct line takes part once, by its first place.

One edit leaves a line equal before and after one segment of it.  So lines that
share no half with another are out at once, and those left are cut into short
segments, of which only those count whose surroundings another line shares.
There every variant within the edit bound is emitted as a hashed key: the
segment with one character left out, at each place, and the segment itself.
Lines that meet at a place left out differ in that character; a line that
meets another one's segment with a character left out has one more.  In each
such group only the earliest matters, so groups are reduced by minimum and no
pairs of a group are made.  A line that isn't kept drops no other: in rounds, a
line is kept once all earlier ones within the bound are dropped, and dropped once
one of them is kept; after a few rounds, small components of lines that are
still open (such as rulers, each a character longer than the last) are gone
through in order of place, each within one row.  The pair that decides, of a line and the earliest kept one
that it meets, is verified by edit distance.

Cases: lines without a word are never dropped and match nothing; a null or empty
text has no lines; a null id comes first; an empty table gives no rows.  In
`dropped` a place is an id and a line number, rows of one id are one document,
and other columns are not read.  `without_repeats` tells rows apart: by id and
text, so that only equal rows of one id share each decision, and where the id is
null by all columns, so that each such row is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, free_name, small, written
from gleaner.llm.components import components

LEAST, SEGMENT = 20, 32
#: Rounds after which components of lines that are few are decided at once, and how many rows those have.
ROUNDS, MOST_MEETINGS = 3, 200_000


def _bound(m: Column, parts: Column, j: Column) -> Column:
    """Where segment j of a line of m characters begins."""
    return F.floor(j * m / parts).cast("int")


def _surroundings(line: Column, n: Column, m: Column, parts: Column, j: Column) -> Column:
    """Hash of what stands before and after segment j, for a line of n characters seen as one of m with n - m more in the segment."""
    a, b = _bound(m, parts, j), _bound(m, parts, j + 1)
    return F.xxhash64(m, j, F.substring(line, F.lit(1), a), F.lit("|"), F.substring(line, n - m + b + 1, m - b))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no from 0, line) of each line with a word."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return d.where(F.col("line").rlike(WORD))


def _seen_as(n: Column, least: int) -> Column:
    """The lengths of the shorter line of a pair that this one may be in."""
    return F.filter(F.array(n, n - 1), lambda m: m >= least)


def dropped(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each dropped line: id_col, line_no, kept_doc_id and kept_line_no of the line it repeats, and the edits between them."""
    return _dropped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), least).withColumnRenamed("doc_id", id_col)


def _dropped(docs: DataFrame, least: int) -> DataFrame:
    """`dropped` for docs(doc_id, text), where doc_id is anything that can be ordered."""
    line, n, two = F.col("line"), F.col("n"), F.lit(2)
    every = lines(docs, "doc_id", "text").withColumn("n", F.length("line"))
    halves = F.flatten(F.transform(_seen_as(n, least), lambda m: F.array(*[_surroundings(line, n, m, two, F.lit(j)) for j in (0, 1)])))
    every = written(every.select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), halves.alias("halves")), "lines")
    grouped = every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("halves").alias("halves"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "line-classes")

    keys = classes.select("cid", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    active = keys.join(shared, "key").select("cid").distinct()
    active = written(classes.select("cid", "at", "h1").join(active, "cid"), "active")
    # the text of each such line, from its document
    wanted = active.select("cid", "h1", F.col("at.line_no").alias("line_no"), F.col("at.doc_id").alias("first_id"))
    found = docs.join(small(written(wanted, "wanted-lines")), F.col("doc_id").eqNullSafe(F.col("first_id")))
    found = found.select("cid", "h1", F.get(F.split("text", "\n", -1), F.col("line_no")).alias("line")).where(F.xxhash64("line") == F.col("h1"))
    found = written(found.groupBy("cid").agg(F.first("line").alias("line")).withColumn("n", F.length("line")), "line-texts")

    parts = lambda m: F.ceil(m / SEGMENT).cast("int")
    seen = found.select("cid", "line", "n", F.explode(_seen_as(n, least)).alias("m"))
    m = F.col("m")
    segments = F.transform(F.sequence(F.lit(0), parts(m) - 1), lambda j: F.struct(j.alias("j"), _surroundings(line, n, m, parts(m), j).alias("key")))
    placed = written(seen.select("cid", "m", F.explode(segments).alias("s")).select("cid", "m", "s.*"), "segments")
    shared = placed.groupBy("key").agg(F.count("*").alias("count")).where("count > 1").select("key")
    a, b = _bound(m, parts(m), F.col("j")), _bound(m, parts(m), F.col("j") + 1)
    met = placed.join(shared, "key").join(found, "cid").select("cid", "key", (n - m).alias("more"), F.substring(line, a + 1, n - m + b - a).alias("part"))
    part, more = F.col("part"), F.col("more")
    without = lambda i: F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.length(part)))
    places = F.sequence(F.lit(1), F.length(part))
    one = lambda key, role: F.struct(key.alias("variant"), F.lit(role).alias("role"))
    variants = F.when(more == 0, F.concat(
        F.transform(places, lambda i: one(F.xxhash64(F.lit("changed"), "key", i, without(i)), "changed")), F.array(one(F.xxhash64(F.lit("more"), "key", part), "less")),
    )).otherwise(F.transform(places, lambda i: one(F.xxhash64(F.lit("more"), "key", without(i)), "more")))
    emitted = met.select("cid", F.explode(variants).alias("v")).select("cid", "v.*").distinct().join(active.select("cid", "at"), "cid")
    emitted = written(emitted, "variants")
    shared = emitted.groupBy("variant").agg(F.count("*").alias("count")).where("count > 1").select("variant")
    near = _nearest_kept(written(emitted.join(shared, "variant"), "meetings"))
    # verified on the lines themselves
    by_place = found.join(active.select("cid", "at"), "cid").select("at", F.col("line").alias("other"))
    near = near.select("cid", "earlier").join(found, "cid").join(by_place, F.col("earlier").eqNullSafe(F.col("at"))).where(F.levenshtein("line", "other", 1).between(0, 1)).select("cid", "earlier")

    decided = classes.select("h1", "h2", "cid", "at").join(near, "cid", "left").drop("cid")
    out = every.select("doc_id", "line_no", "h1", "h2").join(decided, ["h1", "h2"])
    kept = F.coalesce("earlier", "at")
    mine = F.struct("doc_id", "line_no")
    return out.where(~mine.eqNullSafe(kept)).select(
        "doc_id", "line_no", kept["doc_id"].alias("kept_doc_id"), kept["line_no"].alias("kept_line_no"), F.when(F.col("earlier").isNull(), 0).otherwise(1).alias("edits")
    )


def _nearest_kept(met: DataFrame) -> DataFrame:
    """(cid, at, earlier) of dropped lines: of met(variant, cid, role, at), the earliest kept line that each one meets before itself."""

    def before(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """(cid, name): the earliest line of `of` that each line of rows meets and that stands before it."""
        first = lambda role: F.min(F.when(F.col("role") == role, F.col("at"))).alias(role)
        groups = of.groupBy("variant").agg(*[first(r) for r in ("changed", "less", "more")])
        other = F.when(F.col("role") == "more", F.col("less")).when(F.col("role") == "less", F.col("more")).otherwise(F.col("changed"))
        return rows.join(groups, "variant").select("cid", "at", other.alias(name)).where(F.col(name) < F.col("at")).groupBy("cid", "at").agg(F.min(name).alias(name))

    open_rows, kept, gone, rounds = met, None, None, 0
    while not open_rows.isEmpty():
        rounds += 1
        if rounds == ROUNDS + 1:
            # what is left are chains, each link of which would take a round
            open_rows, now, hit = _settled(open_rows)
            kept, gone = written(kept.unionByName(now), "kept-meetings"), gone.unionByName(hit)
            continue
        waits = before(open_rows, open_rows, "waits").select("cid", "waits")
        lines = open_rows.select("cid").distinct()
        ready = written(lines.join(waits, "cid", "left_anti"), "kept-lines")
        now = open_rows.join(ready, "cid")
        kept = now if kept is None else written(kept.unionByName(now), "kept-meetings")
        hit = written(before(open_rows.join(ready, "cid", "left_anti"), now, "hit").select("cid"), "dropped-lines")
        gone = hit if gone is None else gone.unionByName(hit)
        open_rows = written(open_rows.join(ready.unionByName(hit), "cid", "left_anti"), "open-lines")
    if kept is None:
        return met.select("cid", "at", F.col("at").alias("earlier"))
    return before(met.join(gone, "cid", "left_semi"), kept, "earlier")


def _settled(met: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """met without the lines of components of MOST_MEETINGS rows or fewer, which are decided in order of place within one row: the rows of those kept, and (cid) of those dropped."""
    heads = met.groupBy("variant").agg(F.min("cid").alias("head"))
    roots = components(met.join(heads, "variant").where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")))
    rooted = written(met.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node"), "rooted")
    few = written(rooted.groupBy("root").count().where(F.col("count") <= MOST_MEETINGS).select("root"), "small-components")
    mine = rooted.join(few, "root", "left_semi")
    other = F.when(F.col("role") == "more", "less").when(F.col("role") == "less", "more").otherwise(F.col("role"))
    lines = mine.groupBy("root", "cid", "at").agg(F.collect_list(F.xxhash64("variant", "role")).alias("shows"), F.collect_list(F.xxhash64("variant", other)).alias("looks"))
    whole = lines.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("at", "cid", "shows", "looks"))).alias("lines"))
    none = F.array().cast("array<long>")

    def step(acc: Column, line: Column) -> Column:
        # a line is kept if it meets no line that is
        hit = F.arrays_overlap(acc["shows"], line["looks"])
        shows, kept = F.concat(acc["shows"], line["shows"]), F.concat(acc["kept"], F.array(line["cid"]))
        return F.struct(F.when(hit, acc["shows"]).otherwise(shows).alias("shows"), F.when(hit, acc["kept"]).otherwise(kept).alias("kept"))

    kept = whole.select(F.explode(F.aggregate("lines", F.struct(none.alias("shows"), none.alias("kept")), step)["kept"]).alias("cid"))
    kept = written(kept, "settled-lines")
    now = mine.join(kept, "cid", "left_semi").drop("root")
    hit = written(mine.select("cid").distinct().join(kept, "cid", "left_anti"), "dropped-lines")
    return written(rooted.join(few, "root", "left_anti").drop("root"), "open-lines"), now, hit


def _own(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells a row of docs from the others, ordered by id."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias(free_name(docs.columns, "own"))))
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col, F.when(F.col(id_col).isNull(), rest)).alias("key"))


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their texts without dropped lines; rows of which no line with a word is left go, rows that had none stay."""
    # of null-id rows that are equal in all columns the first keeps its lines and the others lose all with a word
    alike, own = F.col(id_col).isNull() & F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)), free_name(docs.columns, "own")
    every = docs.withColumn(own, _own(docs, id_col, text_col))
    once = every.where(alike).groupBy(own).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*", own)
    every = every.where(~alike).unionByName(once)
    # the lines of equal rows are equal, so those of all rows may be compared
    compared = docs.select(_own(docs, id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = written(_dropped(compared, least), "dropped").groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone_lines"))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = every.select(F.col(own).alias("own"), carried).join(gone, F.col("own").eqNullSafe(F.col("gone_id")), "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone_lines", i)), "\n")
    left = joined.select("row", F.col("gone_lines").isNull().alias("whole"), F.when(F.col("gone_lines").isNull(), text).otherwise(kept).alias("text_left"))
    left = left.where(F.col("whole") | F.col("text_left").rlike(WORD))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.col("text_left")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("whole"), out["n_chars"]).otherwise(F.length("text_left")).cast("long")
    return left.select(*[v.alias(k) for k, v in out.items()])
