"""Reports of findings: JSON, SARIF, Markdown and HTML text, gates. Findings stay distributed: a report is one aggregated row, or lines that Spark sorts and writes."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import SEVERITIES

#: From the gravest; a severity that isn't listed blocks at every threshold.
GATE = ("critical", "high", "medium", "low", "info")


def bucket(severity: Column) -> Column:
    return F.when(severity.isin("warning", "medium"), "WARNING").when(severity.isin("info", "low"), "INFO").otherwise(F.upper(severity))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "warning", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Each rule once, as its first finding has it."""
    place = F.struct("path", "line", "column")
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("description", "severity"), place).alias("f"))
    return first.select("rule_id", "f.description", sarif_level(F.col("f.severity")).alias("level"))


def _result() -> Column:
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.coalesce("column", F.lit(1).cast("long")).alias("startColumn")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("snippet"), F.lit("")), F.col("rule_id"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result for each finding; those without a line have no region."""
    return findings.select(_result().alias("result"))


#: The order of a report's lines: its part, then the place of a finding.
ORDER = ("part", "path", "line", "column", "rule_id")
_LINES = "part int, path string, line long, `column` long, rule_id string, text string"


def _fixed(findings: DataFrame, texts: list[tuple[int, str]]) -> DataFrame:
    return findings.sparkSession.createDataFrame([(part, "", k, 0, "", t) for k, (part, t) in enumerate(texts)], _LINES)


def _each(findings: DataFrame, part: int, text: Column) -> DataFrame:
    return findings.select(F.lit(part).alias("part"), F.coalesce("path", F.lit("")).alias("path"), "line", "column", "rule_id", text.alias("text"))


def sarif(findings: DataFrame, tool: str = "gleaner", version: str = "0", uri: str = "") -> DataFrame:
    """A SARIF 2.1.0 document as lines; see write_lines."""
    driver = {"name": tool, "version": version} | ({"informationUri": uri} if uri else {})
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + json.dumps(driver)[:-1] + ', "rules": ['
    rules = sarif_rules(findings).select(
        "rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.coalesce("description", "rule_id").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"))).alias("r"),
    )
    rule_lines = rules.select(F.lit(1).alias("part"), F.lit("").alias("path"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), "rule_id", F.concat(F.lit(","), "r").alias("text"))
    results = _each(findings, 4, F.concat(F.lit(","), _result()))
    # a comma stands before each item, and the first of each list is the tool's own
    own = json.dumps({"id": "scan", "name": "scan", "shortDescription": {"text": "A scan took place"}, "defaultConfiguration": {"level": "none"}})
    done = json.dumps({"ruleId": "scan", "level": "none", "message": {"text": "A scan took place"}})
    return _fixed(findings, [(0, head + own), (2, ']}}, "results": [' + done), (5, "]}]}")]).unionByName(rule_lines).unionByName(results)


def json_lines(findings: DataFrame) -> DataFrame:
    """Each finding as JSON, in order of place."""
    return _each(findings, 1, F.to_json(F.struct(*[F.col(f"`{c}`") for c in findings.columns])))


def quiet(findings: DataFrame) -> DataFrame:
    """One row: a line that says how many findings there are of each severity."""
    shown = [F.when(F.sum((F.col("severity") == s).cast("long")) > 0, F.concat(F.sum((F.col("severity") == s).cast("long")).cast("string"), F.lit(f" {s}"))) for s in ("critical", "high", "warning", "info")]
    return findings.agg(F.when(F.count("*") == 0, "No issues found").otherwise(F.array_join(F.array_compact(F.array(*shown)), ", ")).alias("summary"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in order, as text files whose names are in order too: together they are the report. Spark sorts them by ranges, so none passes through the driver."""
    lines.orderBy(*ORDER).select("text").write.mode("overwrite").text(path)


def gate(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """One row: how many findings block at the threshold, and whether any does."""
    place = F.array_position(F.array(*[F.lit(s) for s in GATE]), F.col("severity")) - 1
    blocking = F.coalesce(F.sum((place <= GATE.index(threshold)).cast("long")), F.lit(0))
    return findings.agg(blocking.alias("blocking"), (blocking > 0).alias("blocked"))


def exit_status(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.max((F.col("severity") == "critical").cast("int")), F.lit(0)).alias("status"))


def guardrail(findings: DataFrame, files: int) -> DataFrame:
    """One row: total checks are findings and files, files count as passed."""
    return findings.agg((F.count("*") + files).alias("total"), F.lit(files).cast("long").alias("passed"), F.count("*").alias("failed"))


def markdown(findings: DataFrame, title: str = "Scan report") -> DataFrame:
    """Lines of a Markdown report: counts by severity, then a table of findings."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("long")
    counted = counts.select(F.lit(1).alias("part"), F.lit("").alias("path"), rank.alias("line"), F.lit(0).cast("long").alias("column"), F.lit("").alias("rule_id"), F.concat(F.lit("- "), "severity", F.lit(": "), F.col("n").cast("string")).alias("text"))
    clean = F.translate(F.coalesce("snippet", F.lit("")), "|`\n", "   ")
    rows = _each(findings, 3, F.concat(F.lit("| "), "severity", F.lit(" | "), "rule_id", F.lit(" | "), _place(), F.lit(" | `"), clean, F.lit("` |")))
    return _fixed(findings, [(0, f"# {title}"), (2, "| severity | rule | place | evidence |"), (2, "|---|---|---|---|")]).unionByName(counted).unionByName(rows)


def _place() -> Column:
    return F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"))


def html_report(findings: DataFrame, title: str = "Scan report") -> DataFrame:
    def escaped(c: Column) -> Column:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit("</td>")) for k in ("severity", "rule_id", "path", "line", "column", "snippet")]
    fixed = [(0, f"<!doctype html><title>{html.escape(title)}</title><table>"), (2, "</table>")]
    return _fixed(findings, fixed).unionByName(_each(findings, 1, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))))


def text_report(findings: DataFrame) -> DataFrame:
    return _each(findings, 1, F.concat(F.rpad(F.upper("severity"), 9, " "), F.lit(" "), "rule_id", F.lit("  "), _place(), F.lit("  "), F.coalesce("snippet", F.lit(""))))


REPORTS = {"json": json_lines, "sarif": sarif, "markdown": markdown, "html": html_report, "text": text_report}
