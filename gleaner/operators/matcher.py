"""Which of many rules match a text, and where: regexes of workers' RE2 behind one automaton over the literals that matches need.

Each rule's literals come from its own regular expression (dialect.needs).  A
worker builds one Aho-Corasick automaton over those of all rules and reads each
text once, whatever the number of rules; the few rules that it names are then
asked of the texts of an Arrow batch by Arrow's RE2, in whose form dialect has
them.  Rules without literals, or all where they are few, are asked of every
text.  Rules that have no form in RE2 are asked by Spark, each regular
expression at the leaf of a search tree over rule numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import replace
from functools import lru_cache
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dialect
from gleaner.functions import text as T
from gleaner.operators.catalog import DOC_EXTENSIONS, Rule

#: From so many rules on, one pass over the text costs less than a search for each.
MANY = 48
#: Literals of a clause that are searched for one by one, where rules are few; and rules in one array.
FEW, CHUNK = 4, 40


Needs = tuple[tuple[tuple[str, ...], ...], ...]


@lru_cache(8)
def _automaton(needs: Needs) -> tuple[object, list[tuple[tuple[int, int], ...]]]:
    """Of the rules' literals an automaton over their numbers, and by number (rule, clause) of each that a literal belongs to."""
    import ahocorasick

    owners: dict[str, list[tuple[int, int]]] = {}
    for k, clauses in enumerate(needs):
        for c, clause in enumerate(clauses):
            for x in clause:
                owners.setdefault(x, []).append((k, c))
    made = ahocorasick.Automaton()
    for n, x in enumerate(owners):
        made.add_word(x, n)
    if owners:
        made.make_automaton()
    return made, [tuple(ks) for ks in owners.values()]


def named(texts: pa.Array, needs: Needs) -> list[list[int]]:
    """Of each text the rules, in order, of whose every clause it holds a literal."""
    automaton, owners = _automaton(needs)
    if not len(automaton):
        return [[] for _ in range(len(texts))]
    out, number = [], itemgetter(1)
    for x in texts:
        clauses = {c for n in set(map(number, automaton.iter(dialect.normal(x.as_py() or "")))) for c in owners[n]}
        counts = Counter(k for k, _ in clauses)
        out.append(sorted(k for k, n in counts.items() if n == len(needs[k])))
    return out


@lru_cache(4096)
def _compiles(regex: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), f"({regex})")
    except pa.ArrowInvalid:
        return False
    return True


def for_workers(rule: Rule, exact: bool) -> str | None:
    """The rule's regex for RE2, if it has a form there; exact where places are asked for."""
    if rule.language != "js" or not dialect.in_re2(rule.pattern, rule.flags, exact):
        return None
    regex = dialect.re2(rule.pattern, rule.flags, exact)
    return regex if _compiles(regex) else None


PLACES = "array<struct<line: int, column: int, offset: int, match: string>>"


def _places(marked: str) -> list[dict]:
    """As T.places()."""
    out, line, column, offset = [], 1, 0, 0
    for piece in marked.split(T.OPEN):
        match, closed, after = piece.partition(T.CLOSE)
        if closed and match:
            out.append({"line": line, "column": column + 1, "offset": offset, "match": match})
        plain = match + after
        breaks = plain.count("\n")
        line, column, offset = line + breaks, len(plain) - plain.rfind("\n") - 1 if breaks else column + len(plain), offset + len(plain)
    return out


def answers(content: Column, rules: Sequence[Rule], places: bool) -> Column:
    """(named, hit): numbers, ascending, of the rules without a form in RE2 that may match, as far as literals tell, and k of those others that match; with places, found too, as T.places() has it."""
    regexes = tuple(for_workers(r, exact=places) for r in rules)
    needs = tuple(r.needs for r in rules) if len(rules) >= MANY else ((),) * len(rules)
    hit = "struct<k: int" + f", found: {PLACES}" * places + ">"
    kind = pa.struct([("k", pa.int32()), *([("found", pa.list_(pa.struct([("line", pa.int32()), ("column", pa.int32()), ("offset", pa.int32()), ("match", pa.string())])))] * places)])

    def answered(texts: pa.Array) -> pa.Array:
        may = named(texts, needs)
        rows: dict[int, list[int]] = {}
        for i, ks in enumerate(may):
            for k in ks:
                rows.setdefault(k, []).append(i)
        clean = texts
        if places:
            for mark in (T.OPEN, T.CLOSE):
                clean = pc.replace_substring(clean, mark, "")
        found: list[list[dict]] = [[] for _ in may]
        for k, regex in enumerate(regexes):
            if regex is None or (needs[k] and k not in rows):
                continue
            at = np.array(rows[k]) if needs[k] else np.arange(len(texts))
            matches = pc.match_substring_regex(texts.take(pa.array(at)) if needs[k] else texts, regex)
            at = at[np.asarray(matches.fill_null(False))]
            if places and len(at):
                marked = pc.replace_substring_regex(clean.take(pa.array(at)), f"({regex})", f"{T.OPEN}\\1{T.CLOSE}")
                for i, text in zip(at.tolist(), marked, strict=True):
                    found[i].append({"k": k, "found": _places(text.as_py())})
            else:
                for i in at.tolist():
                    found[i].append({"k": k})
        rest = [[k for k in ks if regexes[k] is None] for ks in may]
        return pa.StructArray.from_arrays([pa.array(rest, pa.list_(pa.int32())), pa.array(found, pa.list_(kind))], ["named", "hit"])

    return F.arrow_udf(answered, f"struct<named: array<int>, hit: array<{hit}>>")(content)


def quoted(text: str) -> str:
    """A text as a literal of Spark's SQL, in which nothing is taken for a variable."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def by_number(leaves: Sequence[str], numbers: Sequence[int]) -> str:
    """SQL: leaves[i] where k is numbers[i], found by halving; numbers ascend and k is one of them.  As text, since hundreds of regexes are many Columns."""
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return f"CASE WHEN k < {numbers[half]} THEN {by_number(leaves[:half], numbers[:half])} ELSE {by_number(leaves[half:], numbers[half:])} END"


def asked(rule: Rule, with_path: bool) -> str:
    """SQL of whether the rule matches, whatever its literals; of a row with content, ext and path."""
    found = f"content RLIKE {quoted(rule.java)}"
    if rule.code_only:
        found = f"ext NOT IN ({', '.join(map(quoted, DOC_EXTENSIONS))}) AND {found}"
    if rule.file_patterns and with_path:
        found = f"path RLIKE {quoted('|'.join(T.glob_regex(p) for p in rule.file_patterns))} AND {found}"
    return f"({found})"


def hit(rule: Rule, with_path: bool) -> str:
    """asked() behind a search for the rule's literals; of a row that has lower too."""
    clauses = [c for c in map(dialect.words_of, rule.needs) if len(c) <= FEW and all(c)]
    searched = ["(" + " OR ".join(f"contains(lower, {quoted(x)})" for x in clause) + ")" for clause in clauses]
    return "(" + " AND ".join([*searched[:2], asked(rule, with_path)]) + ")"


def hits(rules: Sequence[Rule], with_path: bool, places: bool = False) -> Column:
    """Numbers of the rules without a form in RE2 that match; of a row of prepared()."""
    left = [k for k, r in enumerate(rules) if for_workers(r, places) is None]
    known = [k for k in left if rules[k].needs] if len(rules) >= MANY else []
    rest = [f"IF({hit(rules[k], with_path)}, {k}, NULL)" for k in left if k not in set(known)]
    parts = [F.expr(f"array_compact(array({', '.join(rest[at : at + CHUNK])}))") for at in range(0, len(rest), CHUNK)]
    if known:
        parts.append(F.expr(f"filter(known.named, k -> {by_number([asked(rules[n], with_path) for n in known], known)})"))
    return F.concat(*parts) if parts else F.array().cast("array<int>")


def gate(rules: Sequence[Rule]) -> str:
    """SQL of whether rule h.k looks at a file of such an ext and path."""
    code = [str(k) for k, r in enumerate(rules) if r.code_only]
    tests = [f"NOT (ext IN ({', '.join(map(quoted, DOC_EXTENSIONS))}) AND h.k IN ({', '.join(code)}))"] if code else []
    tests += [f"(h.k <> {k} OR path RLIKE {quoted('|'.join(T.glob_regex(p) for p in r.file_patterns))})" for k, r in enumerate(rules) if r.file_patterns]
    return " AND ".join(tests) or "true"


def prepared(docs: DataFrame, rules: Sequence[Rule], places: bool = False) -> DataFrame:
    """docs(content, path?) with the columns that hits() reads, and hit, the answers of rules that have a form in RE2."""
    with_path = "path" in docs.columns
    workers_find_the_package(docs.sparkSession)
    out = docs.withColumn("ext", T.extension(F.col("path")) if with_path else F.lit("")).withColumn("known", answers(F.col("content"), rules, places))
    asked = [r if with_path else replace(r, file_patterns=()) for r in rules]
    return out.withColumn("lower", F.lower("content")).withColumn("hit", F.expr(f"filter(known.hit, h -> {gate(asked)})"))


def workers_find_the_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, after what --py-files brings them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
