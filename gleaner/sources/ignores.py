"""Ignore files as data: each file meets the rules of the folders that it is in, and the last rule that matches decides.

Rules are rows (folder, rank, pattern, negated), of any number and in any number
of folders; files are joined with the folders above them, so the plan is the same
for one ignore file and for a million.

Cases: blank lines and comments are no rules; a line that begins with `!` takes
back what an earlier or higher rule ignores; rules of a deeper folder come after
those of a higher one, within a folder files come in order of `IGNORE_FILES` and
lines in order; a file without rules above it is kept; null contents hold no
rules; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.files import IGNORE_FILES, depth, name


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def glob_pattern(glob: Column) -> Column:
    """functions.text.glob_regex for a column: a pattern as a regex on paths relative to its folder."""
    anchored, whole = glob.startswith("/"), glob.endswith("/")
    body = F.regexp_replace(glob, "^/+|/+$", "")
    body = F.regexp_replace(body, r"([.+^$(){}|\[\]\\~#&@!,;:<>=%\"'`])", r"\\$1")
    body = F.replace(F.replace(F.replace(F.replace(body, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.when(anchored, "^").otherwise("(^|/)"), body, F.when(whole, "/.*").otherwise("(/|$)"))


def rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(folder, rank, pattern, negated) of the ignore files among files(path, content); rank orders a folder's rules."""
    held = files.where(name(F.col("path")).isin(*names))
    place = F.array_position(F.array(*map(F.lit, names)), name(F.col("path")))
    lines = held.select(folder(F.col("path")).alias("folder"), place.alias("place"), F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    line = F.trim(F.regexp_replace("line", "\r$", ""))
    told = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    negated = F.col("line").startswith("!")
    glob = F.trim(F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line")))
    return told.select("folder", F.struct("place", "line_no").alias("rank"), glob_pattern(glob).alias("pattern"), negated.alias("negated"))


def kept(files: DataFrame, told: DataFrame) -> DataFrame:
    """files(path, ...) without those that the rules ignore.

    A folder's rules are one short array, as long as its ignore files; a file
    meets one row for each folder above it that has rules.
    """
    by_folder = told.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("rank", "pattern", "negated"))).alias("rules"))
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.select("path").distinct().select("path", F.explode(above).alias("folder")).join(by_folder, "folder")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("folder") + 2, F.length("path")))
    last = F.try_element_at(F.filter("rules", lambda r: F.rlike(rest, r["pattern"])), F.lit(-1))
    decided = rows.select("path", F.struct(depth(F.concat("folder", F.lit("/"))).alias("deep"), F.length("folder").alias("long")).alias("deep"), last.alias("last")).where("last is not null")
    gone = decided.groupBy("path").agg(F.max_by("last.negated", "deep").alias("taken_back")).where("not taken_back").select(F.col("path").alias("gone_path"))
    return files.join(gone, F.col("path") == F.col("gone_path"), "left_anti")
