"""Documents to findings: gate, match, suppress, locate.

Which rules match a document comes first (matcher), and only for those is the
place of each match found.  Rules are literals in the plan, so there is no join
of documents with rules and each regex is compiled once a task.
"""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import matcher
from gleaner.operators.catalog import Rule


def _told(rules: Sequence[Rule], *names: str) -> Column:
    """What is known of each rule, by its number: a constant."""
    known = [{"rule_id": r.id} | {n: getattr(r, n) for n in names} for r in rules]
    return F.from_json(F.lit(json.dumps(known)), f"array<struct<rule_id: string{''.join(f', {n}: string' for n in names)}>>")


def flagged(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id") -> DataFrame:
    """(key, rule_id, severity, module) of each rule that matches a row of docs(key, content, path?)."""
    numbers = F.concat(F.expr("transform(hit, h -> h.k)"), matcher.hits(rules, "path" in docs.columns))
    rows = matcher.prepared(docs, rules).select(key, F.explode(numbers).alias("k"))
    return rows.select(key, F.get(_told(rules, "severity", "module"), F.col("k")).alias("r")).select(key, "r.*")


def matched(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", *names: str) -> DataFrame:
    """A row for each rule that matches a document: key, path, content, rule_id, severity and what else is asked for, and found, its matches (line, column, offset, match).

    Workers give the places of rules that have a form in RE2.  Others mark the
    text where they match, and marks are turned into places once, after rows are made.
    """
    with_path = "path" in docs.columns
    d = matcher.prepared(docs, rules, places=True).withColumn("clean", T.unmarked(F.col("content")))
    left = [k for k, r in enumerate(rules) if matcher.for_workers(r, exact=True) is None]
    found, places = F.expr("transform(hit, h -> struct(h.k, h.found, cast(null as string) as marked))"), F.col("f.found")
    if left:
        marks = [f"regexp_replace(clean, {matcher.quoted('(' + rules[k].java + ')')}, '{T.OPEN}$1{T.CLOSE}')" for k in left]
        d = d.withColumn("left", matcher.hits(rules, with_path, places=True))
        found = F.concat(found, F.expr(f"transform(left, k -> struct(k, cast(null as {matcher.PLACES}) as found, {matcher.by_number(marks, left)} as marked))"))
        places = F.when(F.col("f.marked").isNull(), F.col("f.found")).otherwise(T.places(F.col("f.marked")))
    keep = [*dict.fromkeys([key, *(["path"] if with_path else [])])]
    rows = d.select(*keep, "content", F.explode(found).alias("f")).select(*keep, "content", "f", F.get(_told(rules, "severity", *names), F.col("f.k")).alias("r"))
    return rows.select(*keep, "content", "r.*", places.alias("found"))


def located(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id") -> DataFrame:
    """A row for each match: key, rule, line, column, snippet (masked), line_content."""
    rows = matched(docs, rules, key, "description", "recommendation").withColumn("lines", F.split("content", "\n", -1)).drop("content")
    told = [c for c in rows.columns if c not in ("lines", "found")]
    placed = rows.select(*told, "lines", F.explode("found").alias("m"))
    return placed.select(
        *told, F.col("m.line").cast("long").alias("line"), F.col("m.column").cast("long").alias("column"), T.masked(F.col("rule_id"), F.col("m.match")).alias("snippet"),
        F.substring(F.trim(F.element_at("lines", F.col("m.line"))), 1, 100).alias("line_content"),
    )


#: The word that a suppressing comment begins with, and how such comments open.
DIRECTIVE = "vet-ignore"


def suppressions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, rule_id): lines on which findings are suppressed; a null rule means all."""
    lines = docs.where(F.contains("content", F.lit(DIRECTIVE))).select(key, F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    pattern = rf"(?://|#|/\*|<!--)\s*{DIRECTIVE}(-next-line)?([ \t]+[\w-]+(?:[ \t]*,[ \t]*[\w-]+)*)?"
    found = lines.where(F.col("text").rlike(pattern)).select(
        key, (F.col("n") + 1 + (F.regexp_extract("text", pattern, 1) != "").cast("int")).cast("long").alias("line"), F.regexp_extract("text", pattern, 2).alias("ids")
    )
    ids = F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("--"))
    return found.select(key, "line", F.explode_outer(ids).alias("rule_id")).distinct()


def marked(findings: DataFrame, rules_off: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings with `suppressed`: one join with the lines that rules_off(key, line, rule_id; null: all) names."""
    off = rules_off.groupBy(F.col(key).alias("_off_key"), F.col("line").alias("_off_line")).agg(F.collect_set("rule_id").alias("_off"), F.max(F.col("rule_id").isNull()).alias("_all"))
    met = findings.join(off, (findings[key] == F.col("_off_key")) & (findings["line"] == F.col("_off_line")), "left")
    suppressed = F.coalesce(F.col("_all") | F.array_contains("_off", F.col("rule_id")), F.lit(False))
    return met.withColumn("suppressed", suppressed).drop("_off_key", "_off_line", "_off", "_all")


def split_suppressed(findings: DataFrame, rules_off: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) findings: two views of marked()."""
    every = marked(findings, rules_off, key)
    return every.where("not suppressed").drop("suppressed"), every.where("suppressed").drop("suppressed")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    counts = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in T.SEVERITIES]
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def deduplicated(findings: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first finding of each file, rule and line."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("path", "rule_id", "line").orderBy(*order))
    return findings.withColumn("_n", first).where("_n = 1").drop("_n")
