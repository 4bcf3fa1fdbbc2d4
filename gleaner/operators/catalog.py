"""The catalogue of detectors: rules as data, in packs.

Patterns are in JavaScript's dialect, which `dialect` writes out for Spark (and
for RE2); literals that matches need are taken from the patterns.  Built in are
about 200; larger catalogues are loaded from rule files: see `load`, and
custom_rules.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from gleaner.functions import dialect
from gleaner.operators.packs import FIXED, OWN, PACKS

#: Rules whose ids begin so look at code; they skip documentation files.
CODE_PREFIXES, DOC_EXTENSIONS = ("mcp-", "command-"), ("md", "mdx", "txt", "rst")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    pattern: str
    description: str
    module: str
    recommendation: str = "Review this finding and remove what it shows if it isn't meant."
    file_patterns: tuple[str, ...] = ()
    flags: str = ""
    language: str = "js"  # or java: the pattern goes to Spark as it stands
    literal: str | None = None  # in lower case, where a rule file tells one that every match holds

    @property
    def java(self) -> str:
        return dialect.java(self.pattern, self.flags) if self.language == "js" else f"(?{self.flags})" * bool(self.flags) + self.pattern

    @property
    def needs(self) -> tuple[dialect.Clause, ...]:
        """Sets of literals in lower case, of each of which every match holds one: a cheap test before the regex."""
        return ((self.literal,),) if self.literal else dialect.needs(self.pattern, self.flags) if self.language == "js" else ()

    @property
    def code_only(self) -> bool:
        return self.id.startswith(CODE_PREFIXES)


MODULES = sorted({*PACKS, *FIXED})


def rules(*modules: str) -> list[Rule]:
    """The rules of the named packs, or of all."""
    unknown = set(modules) - set(MODULES)
    if unknown:
        raise ValueError(f"no such packs: {sorted(unknown)}")
    out = []
    for m in modules or MODULES:
        out += [Rule(*r, module=m) for r in PACKS.get(m, ())]
        out += [Rule(id, severity, pattern, id.replace("-", " ").capitalize(), m, flags=flags) for id, severity, pattern, flags in FIXED.get(m, ())]
    return out


def own(module: str) -> list[Rule]:
    """Rules of our own that a pack has besides."""
    return [Rule(*r, module=module) for r in OWN.get(module, ())]


def load(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a rule file (or a folder of them) in JSON lines: id, severity, pattern, module, description and, where given, recommendation, needs (a literal), flags, language (js, or java, the default) and filePatterns.

    A catalogue is a parameter: however many rules it has, one automaton over their literals tells which to ask.  Patterns that
    don't compile are told by `checked`.
    """
    fields = "id string, severity string, pattern string, module string, description string, recommendation string, needs string, flags string, language string, filePatterns array<string>"
    rows = spark.read.schema(fields).json(path).where("id is not null and pattern is not null").orderBy("module", "id").collect()  # a rule file is small
    return [
        Rule(
            r.id, r.severity or "warning", r.pattern, r.description or r.id, r.module or "loaded", r.recommendation or Rule.recommendation, tuple(r.filePatterns or ()),
            "".join(f for f in r.flags or "" if f in "ims"), r.language or "java", r.needs.lower() if r.needs else None,
        )
        for r in rows
    ]


def select(found: list[Rule], severity: str = "info") -> list[Rule]:
    """Rules at or above a severity; any unknown severity means all."""
    place = {"critical": 0, "warning": 1}
    return [r for r in found if place.get(r.severity, 2) <= place.get(severity, 2)]


def checked(spark: SparkSession, found: list[Rule]) -> tuple[list[Rule], list[str]]:
    """Rules whose pattern compiles, and the ids of the others."""
    good, bad = [], []
    for r in found:
        try:
            spark._jvm.java.util.regex.Pattern.compile(r.java)
            good.append(r)
        except Exception:  # py4j wraps the JVM's syntax error, and a pattern may be none in its own language
            bad.append(r.id)
    return good, bad


def catalog(spark: SparkSession, found: list[Rule] | None = None) -> DataFrame:
    fields = "id string, severity string, description string, regex string, module string, recommendation string, code_only boolean"
    return spark.createDataFrame([(r.id, r.severity, r.description, r.pattern, r.module, r.recommendation, r.code_only) for r in (rules() if found is None else found)], fields)


def renamed(rule: Rule, **changes: object) -> Rule:
    return replace(rule, **changes)
