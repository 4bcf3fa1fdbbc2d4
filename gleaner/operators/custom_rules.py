"""User rules: records or YAML, normalised and compiled into the catalogue's form."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.operators.catalog import Rule

#: Severities that users may write, and what they count as; unknown ones are warnings.
SEVERITY = {"critical": "critical", "high": "critical", "warning": "warning", "medium": "warning", "info": "info", "low": "info"}


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _/-" else "\\" + c for c in text)


def from_records(records: list[dict]) -> list[Rule]:
    """A rule for each pattern of each enabled record; string patterns match as they stand, and no pattern minds case."""
    out = []
    for r in records:
        if not r.get("enabled", True):
            continue
        for pattern in r.get("patterns") or [r["pattern"]]:
            body = quoted(pattern) if r.get("type", "regex") == "string" else pattern
            out.append(Rule(
                r["id"], SEVERITY.get(r.get("severity", "warning"), "warning"), "(?i)" + body, r.get("message") or r.get("description") or r.get("name") or r["id"], "custom",
                r.get("recommendation", ""), file_patterns=tuple(r.get("filePatterns", ())),
            ))
    return out


def valid(rules: list[Rule]) -> list[Rule]:
    """Those whose pattern Python can read too: an early test for files written by hand; catalog.checked asks the JVM."""
    good = []
    for r in rules:
        try:
            re.compile(r.pattern)
            good.append(r)
        except re.error:
            continue
    return good


def from_yaml(text: str) -> list[Rule]:
    """rules: a list of records, in YAML (or JSON, which YAML reads)."""
    try:
        import yaml
    except ImportError:
        import json as yaml

        return from_records(yaml.loads(text).get("rules", []))
    return from_records((yaml.safe_load(text) or {}).get("rules", []))


def from_path(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of the files under a path, each a list of records, in order of path; a rule file is small."""
    texts = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path")).orderBy("path").collect()
    return [rule for t in texts for rule in from_yaml(t.value)]
