"""One scan: documents to findings of all producers in one schema, suppressed, deduplicated and counted."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import catalog, manifest, reputation, scan, signatures
from gleaner.operators.catalog import Rule
from gleaner.operators.signatures import Signature
from gleaner.sources import files

#: The columns of findings, whoever makes them.
FINDING = {
    "rule_id": "string", "severity": "string", "description": "string", "path": "string", "line": "long", "column": "long", "snippet": "string", "line_content": "string",
    "recommendation": "string", "category": "string", "source": "string", "tags": "array<string>", "url": "string", "score": "double", "fixable": "boolean", "current_mode": "string",
}
#: The order in which producers' findings are appended; the first of equal ones is kept.
SOURCES = ("static", "custom", "permission", "signature", "dependency", "analysis", "reputation")


def shaped(findings: DataFrame, source: str) -> DataFrame:
    """findings with every column of FINDING, absent ones null, and the number of their source."""
    held = {c: (F.col(c) if c in findings.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FINDING.items() if c != "source"}
    return findings.select(*held.values(), F.lit(source).alias("source"), F.lit(SOURCES.index(source)).alias("seq"))


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    suppressed: DataFrame
    every: DataFrame | None = None  # both in one table, with the column `suppressed`: to be written once where both are wanted

    def counts(self) -> DataFrame:
        """One row: findings in all and by severity."""
        return scan.severity_counts(self.findings)

    def fixable(self) -> DataFrame:
        return self.findings.where("fixable")


def dependencies(advisories: DataFrame) -> DataFrame:
    """advisories(path, name, level, title) as findings: high and critical are critical, moderate a warning, the rest info."""
    level = F.col("level")
    severity = F.when(level.isin("high", "critical"), "critical").when(level == "moderate", "warning").otherwise("info")
    return advisories.select("path", F.concat(F.lit("deps-"), "name").alias("rule_id"), severity.alias("severity"), F.col("title").alias("description"), F.col("name").alias("snippet"), F.lit(0).cast("long").alias("line"))


def analysed(found: DataFrame) -> DataFrame:
    """found(path, type, severity, title, evidence, confidence) of analysis.findings as findings: high and critical are critical, medium a warning, the rest info."""
    level = F.col("severity")
    severity = F.when(level.isin("high", "critical"), "critical").when(level == "medium", "warning").otherwise("info")
    return found.select("path", F.concat(F.lit("llm-"), "type").alias("rule_id"), severity.alias("severity"), F.col("title").alias("description"), F.col("evidence").alias("snippet"), F.col("confidence").alias("score"), F.lit(0).cast("long").alias("line"))


def looked_up(docs: DataFrame, table: DataFrame, budget: int = 10) -> DataFrame:
    """Addresses in docs(path, content) that a table(target, malicious, total) knows as bad: malicious ones are critical, suspicious ones a warning."""
    known = reputation.verdicts(reputation.targets(docs, "path", "content", budget).where("checked"), table).where("verdict in ('malicious', 'suspicious')")
    severity = F.when(F.col("verdict") == "malicious", "critical").otherwise("warning")
    return known.select("path", F.concat_ws("-", F.lit("reputation"), "verdict").alias("rule_id"), severity.alias("severity"), F.lit("Address with a bad reputation").alias("description"), F.col("target").alias("snippet"), F.col("target").alias("url"), "score", F.lit(0).cast("long").alias("line"))


def vet(
    docs: DataFrame, severity: str = "info", builtin: bool = True, custom: Sequence[Rule] = (), with_signatures: bool = True, more_signatures: Sequence[Signature] = (),
    signed: DataFrame | None = None, listing: DataFrame | None = None, advisories: DataFrame | None = None, analysis: DataFrame | None = None, addresses: DataFrame | None = None, suppress: bool = True,
) -> Result:
    """Findings of docs(path, content), a row for each file.

    Static and custom rules at or above `severity`, signatures, file modes of a
    `listing`, `advisories` on packages, results of an `analysis` and a table of
    known `addresses`: each producer takes part where its input is given.
    Signatures are matched against `signed` where that is given, since their gate
    takes other files.  Then
    comments that suppress take effect and of each file, rule and line the first
    finding stays.
    """
    made = []
    rules = catalog.select(catalog.rules(), severity) if builtin else []
    for source, found in (("static", rules), ("custom", catalog.select(list(custom), severity))):
        if found:
            made.append(shaped(scan.located(docs, found, "path").withColumn("category", F.lit(source)), source))
    if listing is not None:
        made.append(shaped(files.mode_findings(listing), "permission"))
    every = [*(signatures.BUILT_IN if with_signatures else []), *more_signatures]
    if every:
        found = signatures.scan(docs if signed is None else signed, every, "path")
        made.append(shaped(found.where(T.severity_passes(F.col("severity"), severity)), "signature"))
    if advisories is not None:
        made.append(shaped(dependencies(advisories), "dependency"))
    if analysis is not None:
        made.append(shaped(analysed(analysis), "analysis"))
    if addresses is not None:
        made.append(shaped(looked_up(docs, addresses), "reputation"))
    findings = made[0] if made else docs.sparkSession.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in FINDING.items()) + ", seq int")
    for f in made[1:]:
        findings = findings.unionByName(f)
    every = scan.marked(findings, scan.suppressions(docs, "path"), "path") if suppress else findings.withColumn("suppressed", F.lit(False))
    # of suppressed findings each stays; of the others the first of a file, rule and line
    first = F.row_number().over(W.partitionBy("suppressed", "path", "rule_id", "line").orderBy("seq", "column", "snippet"))
    every = every.withColumn("_n", first).where("suppressed or _n = 1").drop("_n", "seq")
    return Result(every.where("not suppressed").drop("suppressed"), every.where("suppressed").drop("suppressed"), every)


def vet_path(spark: SparkSession, root: str, max_bytes: int = files.MAX_BYTES, ignore: tuple[str, ...] = (), nested: bool = True, modes: bool = True, **options: object) -> Result:
    """Findings of the files under a folder, or of one file, with its ignore files and file modes; paths are relative."""
    docs, signed = (d.withColumn("path", files.relative(F.col("path"), root)) for d in (files.scan_files(spark, root, max_bytes, ignore, nested), files.signature_files(spark, root)))
    listing = files.listed(spark, root).withColumn("path", files.relative(F.col("path"), root)) if modes else None
    return vet(docs, signed=signed, listing=listing, **options)


#: Options of a scan and what they are where nothing says otherwise.
DEFAULTS = {"severity": "info", "ignore": (), "max_bytes": files.MAX_BYTES, "nested": True, "modes": True, "builtin": True, "with_signatures": True, "suppress": True}
#: Names of options in files, and ours.
NAMED = {"severity": "severity", "ignore": "ignore", "maxFileSize": "max_bytes", "yara": "with_signatures", "checkPermissions": "modes", "builtinRules": "builtin"}


def options_from(text: str, **given: object) -> dict[str, object]:
    """Options of vet_path: what is given comes before what a file (YAML or JSON) says, and that before the defaults; patterns to ignore are those of both.  A file that can't be read says nothing, and options of other names are left out."""
    try:
        import yaml

        read = yaml.safe_load(text)
    except ImportError:
        try:
            read = json.loads(text)
        except ValueError:
            read = None
    except yaml.YAMLError:
        read = None
    said = {NAMED[k]: v for k, v in (read if isinstance(read, dict) else {}).items() if k in NAMED and v is not None}
    out = DEFAULTS | said | {k: v for k, v in given.items() if v is not None}
    patterns = [x for held in (said.get("ignore", ()), given.get("ignore") or ()) for x in ([held] if isinstance(held, str) else held)]
    return out | {"ignore": tuple(dict.fromkeys(patterns))}


def merged(*counts: DataFrame) -> DataFrame:
    """One row: the sums of counters of several scans."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.agg(*[F.sum(c).alias(c) for c in counts[0].columns])


def by_target(findings: DataFrame, target: str = "target") -> DataFrame:
    """Counts by severity of each target and, with null as target and `every` true, of all: one pass over findings(target, path, rule_id, line, severity) of many roots.

    A finding that several targets show (one file, rule and line) counts once for each of them and once in all.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("path", "rule_id", "line")]
    once = findings.select(F.col(target).alias("_target"), *keys, "severity").groupBy("_target", "path", "rule_id", "line").agg(F.min("severity").alias("severity"))
    # a pair of a row for its target and one for all, of which the latter is counted once however many targets have it
    sets = once.select(F.explode(F.array(F.struct(F.col("_target").alias("target"), F.lit(False).alias("every")), F.struct(F.lit(None).cast(once.schema["_target"].dataType).alias("target"), F.lit(True).alias("every")))).alias("s"), "path", "rule_id", "line", "severity")
    distinct = sets.groupBy("s.target", "s.every", "path", "rule_id", "line").agg(F.min("severity").alias("severity"))
    return scan.severity_counts(distinct, "target", "every").withColumnRenamed("target", target)


#: Parts of the ids of rules that find agent frameworks.
FRAMEWORKS = r"langchain|autogen|crewai|openai-assistant|anthropic|semantic-kernel|vercel-ai"


def discovered(findings: DataFrame) -> DataFrame:
    """One row: how many files hold tool servers and agents, and the names of the frameworks that findings of the discovery rules tell."""
    r = F.col("rule_id")
    frameworks = F.array_sort(F.collect_set(F.when(r.rlike(FRAMEWORKS), F.replace(r, F.lit("-"), F.lit(" ")))))  # at most as many as there are rules
    return findings.agg(F.count_distinct(F.when(r.contains("mcp-server"), F.col("path"))).alias("servers"), F.count_distinct(F.when(r.contains("agent") | r.contains("bot"), F.col("path"))).alias("agents"), frameworks.alias("frameworks"))


def usage(docs: DataFrame) -> DataFrame:
    """(path, category, permission) that files of code show."""
    return manifest.usage(docs.where(manifest.is_code(F.col("path"))), "path")
