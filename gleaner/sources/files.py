"""Files as documents: listing, gate by name and size, ignore files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import extension, glob_regex

#: What is never scanned.
BINARY = (
    "jpg", "jpeg", "png", "gif", "webp", "ico", "pdf", "doc", "docx", "zip", "tar", "gz", "rar", "7z", "exe", "bin", "dll", "so", "dylib",
    "mp3", "mp4", "wav", "avi", "mov", "woff", "woff2", "ttf", "eot",
)
EXCLUDED_DIRS = ("node_modules", ".git", ".cache", ".npm", "__pycache__", "venv", ".venv", "dist", "build", "coverage")
EXCLUDED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
EXCLUDED_PATHS = (
    r"\.xsd$", r"\.xsl$", r"\.dtd$", r"schemas?/", r"\.min\.js$", r"\.bundle\.js$", r"vendor\.js$", r"fixtures?/", r"test-data/", r"docs?/images?/", r"assets?/images?/",
    r"THIRD_PARTY", r"NOTICES?\.md$", r"LICENSE", r"\.security-scan-passed$", r"\.security-scan$", r"\.lock$", r"\.sum$",
    r"references?/", r"examples?/", r"samples?/", r"tutorials?/", r"templates?/", r"common_secrets", r"secret_patterns", r"credential_examples",
)
MAX_BYTES = 1 << 20
#: Fixed values of the collector: folders, extensions, depth and number of files.
COLLECT_DIRS = ("node_modules", ".git", "__pycache__", "dist", "build", ".cache", "vendor", "coverage")
COLLECT_BINARY = ("jpg", "jpeg", "png", "gif", "webp", "ico", "pdf", "zip", "tar", "gz", "exe", "bin", "dll", "so", "mp3", "mp4", "woff", "woff2", "ttf")
MAX_DEPTH, MAX_FILES = 20, 10_000
#: Fixed values of the signature walker.
SIGNATURE_DIRS, SIGNATURE_BINARY = ("node_modules", ".git", "__pycache__", "dist", "build"), ("jpg", "png", "gif", "pdf", "zip", "exe", "bin")
#: Names of files that instruct an agent, how deep they are sought, and where not.
INSTRUCTIONS = ("skill.md", "agents.md", "system.md", "prompt.md", "instructions.md", "readme.md", "soul.md", "tools.md")
INSTRUCTION_DEPTH, INSTRUCTION_DIRS = 5, ("node_modules", ".git", "__pycache__", "dist", "build", ".cache", "vendor")
#: What names of files hold that only their owner should read.
SENSITIVE = (".env", "api_key", "credentials.json", "secrets.json", "config.json", ".pem", ".key", "id_rsa", "id_ed25519", "id_ecdsa", ".p12", ".pfx")
#: Files that say what not to scan, in order; the second kind counts in every folder.
IGNORE_FILES = (".vetignore", ".gitignore")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(relative_path: Column) -> Column:
    """How many folders a relative path goes through."""
    return F.size(F.split(relative_path, "/")) - 1


def _in_dirs(path: Column, dirs: tuple[str, ...]) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in dirs) + ")/")


def gate(path: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    excluded = path.rlike("(?i)" + "|".join(EXCLUDED_PATHS))
    return ~_in_dirs(path, EXCLUDED_DIRS) & ~name(path).isin(*EXCLUDED_FILES) & ~extension(path).isin(*BINARY) & ~excluded & (length <= max_bytes)


def signature_gate(path: Column, length: Column) -> Column:
    """What signatures are matched against: other folders and extensions, and no other paths are excluded."""
    return ~_in_dirs(path, SIGNATURE_DIRS) & ~extension(path).isin(*SIGNATURE_BINARY) & (length < MAX_BYTES)


def collected(listing: DataFrame, path: str = "path", max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES) -> DataFrame:
    """Of a listing with relative paths those that the bounded collector takes: not too deep, and the first max_files in order of path (the limit is what this operator is for)."""
    p = F.col(path)
    kept = listing.where(~_in_dirs(p, COLLECT_DIRS) & ~name(p).isin(*EXCLUDED_FILES) & ~extension(p).isin(*COLLECT_BINARY) & (depth(p) <= max_depth))
    return kept.orderBy(path).limit(max_files)


def for_reputation(listing: DataFrame, path: str = "path", most: int = 50) -> DataFrame:
    """The first files in order of path whose addresses are looked up: look-ups cost, so their number is bounded."""
    p = F.col(path)
    return listing.where(~_in_dirs(p, EXCLUDED_DIRS) & ~name(p).isin(*EXCLUDED_FILES) & ~extension(p).isin(*BINARY)).orderBy(path).limit(most)


def instructions(path: Column) -> Column:
    """A relative path of a file that instructs an agent."""
    return F.lower(name(path)).isin(*INSTRUCTIONS) & (depth(path) <= INSTRUCTION_DEPTH) & ~_in_dirs(path, INSTRUCTION_DIRS)


def mode_findings(listing: DataFrame, path: str = "path", mode: str = "mode") -> DataFrame:
    """Of a listing with file modes as numbers: sensitive files that others than their owner may read."""
    bits = F.col(mode).bitwiseAND(0o777)
    octal = F.conv(bits.cast("string"), 10, 8)
    held = F.exists(F.array(*[F.lit(s) for s in SENSITIVE]), lambda s: F.contains(name(F.col(path)), s))
    severity = F.when(F.substring(F.lpad(octal, 3, "0"), 3, 1) != "0", "critical").otherwise("warning")
    return listing.where(held & ~octal.isin("600", "400")).select(
        F.col(path).alias("path"), F.lit("permission-sensitive-files").alias("rule_id"), severity.alias("severity"), F.lit("Sensitive file that others may read").alias("description"),
        F.lit(0).cast("long").alias("line"), F.concat(F.lit("Current: "), octal, F.lit(", Recommended: 600")).alias("snippet"), F.lit("Give read and write to the owner only.").alias("recommendation"),
        F.lit(True).alias("fixable"), octal.alias("current_mode"),
    )


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mode) of the files under a folder, with what Spark's readers pass over: the file system's own listing, names alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, rows = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toUri().getPath(), f.getLen(), f.getPermission().toShort() & 0o777))
    return spark.createDataFrame(rows, "path string, length long, mode int")


def scan_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: tuple[str, ...] = (), nested: bool = False) -> DataFrame:
    """(path, content, length) of the text files under a folder, or of one file; the size test reaches the listing, so larger files aren't read.

    Paths are gated as they stand below the root. `ignore` are patterns on those
    paths; with `nested` the folder's ignore files count too, and those of the
    folders below, the last rule that matches deciding (ignores). Names that begin with a dot or an underscore are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    files = files.withColumn("rel", relative(F.col("path"), root)).where(gate(F.col("rel"), F.col("length"), max_bytes))
    files = files.where(~ignored(F.col("rel"), ignore))
    if nested:
        from gleaner.sources import ignores  # which reads names and depths from here

        files = ignores.kept(files.withColumnsRenamed({"path": "full", "rel": "path"}), ignores.rules(ignore_files(spark, root))).withColumnsRenamed({"path": "rel", "full": "path"})
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length")


def expanded(listing: DataFrame, patterns: tuple[str, ...], path: str = "path", max_depth: int = 10) -> DataFrame:
    """(pattern, path): paths of a listing that patterns with * and ** name, down to max_depth folders; a pattern that names none stands for itself."""
    told = [{"pattern": x, "regex": "^" + glob_regex(x).removeprefix("(^|/)").removeprefix("^").removesuffix("(/|$)") + "$"} for x in dict.fromkeys(patterns)]
    named, p = F.from_json(F.lit(json.dumps(told)), "array<struct<pattern: string, regex: string>>"), F.col(path)
    asked = listing.sparkSession.range(1).select(F.explode(named).alias("n")).select("n.pattern")
    found = listing.where(depth(p) <= max_depth).select(p.alias("path"), F.explode(named).alias("n")).where(F.rlike("path", F.col("n.regex"))).select(F.col("n.pattern").alias("pattern"), "path").distinct()
    return asked.join(found, "pattern", "left").select("pattern", F.coalesce("path", "pattern").alias("path"))


def signature_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of the files that signatures are matched against: by their own gate, whatever ignore files say."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") < MAX_BYTES)
    kept = files.where(signature_gate(relative(F.col("path"), root), F.col("length")))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length")


def relative(path: Column, root: str) -> Column:
    """The path below a folder; of a single file its name."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    inside = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    return F.when(inside.startswith("/"), name(path)).otherwise(inside)


def _lines(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip() for x in text.split("\n") if x.strip() and x.strip()[0] not in "#!"))


def _text(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ignore_patterns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """An ignore file's patterns in order: no blanks, comments, negations or repeats. Spark's readers pass over files whose name begins with a dot, so its file system is asked."""
    return _lines(_text(spark, path))


def ignore_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the ignore files under a folder: all kinds at the root, the second kind below; as many rows as there are such files."""
    every = listed(spark, root).where(name(F.col("path")).isin(*IGNORE_FILES)).select(relative(F.col("path"), root).alias("rel")).collect()
    found = [r.rel for r in every if not any(d in r.rel.split("/") for d in EXCLUDED_DIRS) and ("/" not in r.rel or r.rel.endswith(IGNORE_FILES[1]))]
    return spark.createDataFrame([(p, _text(spark, f"{root}/{p}")) for p in found], "path string, content string")


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """path, relative to the ignore file's folder, matches a pattern."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out
