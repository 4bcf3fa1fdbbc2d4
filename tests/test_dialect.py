"""The regex dialect in both engines, the literals that matches need, and the matcher over many rules."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import dialect
from gleaner.operators import catalog, matcher, scan

#: pattern, flags, texts that it matches, texts that it doesn't, as JavaScript has it.
CASES = [
    (r"\buser\b", "", ["a user", "中user", "éuser", "user中", "user-1"], ["users", "_user", "user1"]),
    (r"\bx|y\b", "", ["éx", "y中", " x"], ["axb", "yb"]),
    (r"a\Bb|\B!", "", ["ab", "!", "é!"], ["a!"]),
    (r"\w+é", "", ["aé"], ["éé"]),
    (r"^\d+$", "", ["12"], ["12\n", "١٢", "a1"]),
    (r"^a$", "m", ["b\na\nc", "a", "x\na"], ["ab", "ba"]),
    (r"a.b", "", ["a\x85b", "a中b", "a\x0bb"], ["a\nb", "a\rb", "a b"]),
    (r"a.b", "s", ["a\nb", "a b"], ["ab"]),
    (r"a[^]b", "", ["a\nb", "axb"], ["ab"]),
    (r"a\sb", "", ["a b", "a﻿b", "a　b", "a\x0bb"], ["a\x85b", "a\x1cb"]),
    (r"a\Sb", "", ["a\x85b"], ["a b"]),
    (r"mask", "i", ["MASK", "mAsK"], ["maſk", "masK"]),
    (r"straße|Ärger", "i", ["STRAßE", "ärger"], ["STRASSE"]),
    (r"[^a-z]", "i", ["1", "ſ"], ["A", "q"]),
    (r"[\w.]+@(?<host>[a-z]+)", "", ["a.b@c"], ["@c"]),
    (r"x{0,2000}y{1001,}z", "", ["y" * 1001 + "z"], ["y" * 1000 + "z"]),
    (r"\/\*\{a}", "", ["/*{a}"], ["/*a"]),
    (r"а|\x41", "", ["а", "A"], ["a"]),
    (r"b(?!cd)", "", ["b", "bc", "bce", "abx"], ["abcd"]),
    (r"(?<!un)safe", "", ["safe", "nsafe"], ["unsafe"]),
    (r"key(?=\s*=)", "", ["key =", "key="], ["key"]),
    (r"(?<=\$)x(?!y)", "", ["$x", "$xz"], ["x", "$xy"]),
]


@pytest.mark.parametrize(("pattern", "flags", "yes", "no"), CASES)
def test_both_engines_read_as_javascript(spark, pattern, flags, yes, no):
    texts = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert {r.t for r in texts.where(F.col("t").rlike(dialect.java(pattern, flags))).collect()} == set(yes)
    assert dialect.in_re2(pattern, flags, exact=False)
    assert [t for t in yes + no if duckdb.execute("SELECT regexp_matches(?, ?)", [t, dialect.re2(pattern, flags, exact=False)]).fetchone()[0]] == yes


def test_what_re2_has_no_form_of():
    assert not dialect.in_re2(r"a(?!b*)c", "", False) and not dialect.in_re2(r"(a)\1", "", False)
    assert not dialect.in_re2(r"b(?!c)") and dialect.in_re2(r"b(?!c)", "", False)  # without more characters there is none


def test_every_rule_says_the_same_in_both_engines(spark):
    """A text of each rule, alone, between letters of other alphabets, in other cases and with other white space."""
    rules = [r for r in catalog.rules() if dialect.in_re2(r.pattern, r.flags, exact=False)]
    made = []
    for r in rules:
        t = dialect.sample(r.pattern, r.flags)
        made += [(r.id, x) for x in (t, f"é{t}中", f"x{t}x", t.upper(), t.replace(" ", " "), t.replace(" ", "\x85"), t[:-1], f"\n{t}\r\n")]
    by_id = {r.id: r for r in rules}
    duck = [duckdb.execute("SELECT regexp_matches(?, ?)", [t, dialect.re2(by_id[k].pattern, by_id[k].flags, exact=False)]).fetchone()[0] for k, t in made]
    texts = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(made)], "n int, id string, content string")
    found = spark.createDataFrame([(r.id, r.java) for r in rules], "id string, java string")
    got = {r.n: r.hit for r in texts.join(found, "id").select("n", F.expr("content RLIKE java").alias("hit")).collect()}
    assert [got[n] for n in range(len(made))] == duck
    assert all(duck[::8]), [k for (k, _), hit in list(zip(made, duck, strict=True))[::8] if not hit]


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.data())
def test_matches_hold_a_literal_of_each_clause(data):
    """A literal that a match might lack would hide it."""
    rule = data.draw(st.sampled_from([r for r in catalog.rules() if r.needs]))
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True))
    assert all(any(x in dialect.normal(text) for x in clause) for clause in rule.needs)
    assert all(any(x in text.lower() for x in dialect.words_of(clause)) for clause in rule.needs)


@pytest.mark.parametrize(
    ("pattern", "clauses"),
    [
        (r"act\s+as\s+(?:if\s+)?you", ((" ".join(["act as if you"]), "act as you"),)), (r"(?:curl|wget)\s[^|]*\|\s*sh", (("curl ", "wget "), ("| sh", "|sh"))), (r"[a-z]+", ()), (r"(?:ab|[0-9]+)x?", ()), (r"a?bc*de", (("de",),)),
        (r"x(?:foo|bar)?yy|zz\s*z", (("xbaryy", "xfooyy", "xyy", "zz z", "zzz"),)),
    ],
)
def test_literals_come_from_the_tree(pattern, clauses):
    assert {frozenset(c) for c in dialect.needs(pattern)} == {frozenset(c) for c in clauses}


def test_many_rules_find_what_few_find(spark):
    rules = catalog.rules()
    texts = [f"é{dialect.sample(r.pattern, r.flags)}\n{dialect.sample(q.pattern, q.flags)} end" for r, q in zip(rules, rules[7:] + rules[:7], strict=True)] + ["", None]
    docs = spark.createDataFrame([(k, f"src/f{k}.{'md' if k % 5 == 0 else 'py'}", t) for k, t in enumerate(texts)], "doc_id long, path string, content string")
    few = [matcher.MANY - 1] * (len(rules) // (matcher.MANY - 1) + 1)
    apart = {(r.doc_id, r.rule_id) for k in range(len(few)) for r in scan.flagged(docs, rules[k * few[k] : (k + 1) * few[k]]).collect()} if few else set()
    assert {(r.doc_id, r.rule_id) for r in scan.flagged(docs, rules).collect()} == apart
    assert {(r.doc_id, r.rule_id) for r in scan.located(docs, rules).collect()} == apart
    assert scan.flagged(docs, []).count() == 0 == scan.located(docs, []).count()


def test_places_of_very_many_matches(spark):
    text = "ab " * 3000 + "\n" + "xab\n" * 500
    rows = spark.createDataFrame([(0, "a.txt", text)], "doc_id long, path string, content string")
    rule = catalog.Rule("own", "info", "ab", "Two letters", "own")
    got = sorted((r.line, r.column) for r in scan.located(rows, [rule]).collect())
    assert got == [(1, 3 * k + 1) for k in range(3000)] + [(k + 2, 2) for k in range(500)]


def test_patterns_of_java_come_through_as_they_stand(spark):
    """Quotes, backslashes and what Spark's SQL would take for a variable."""
    rule = catalog.Rule("own", "info", r"""it's "\$\{x}"|\p{Lu}\Qa.b\E|${0}nothing""", "Odd", "own", language="java")
    rows = spark.createDataFrame([(0, 'it\'s "${x}" '), (1, "Éa.b"), (2, "éa.b"), (3, "Éaxb")], "doc_id long, content string")
    assert sorted(r.doc_id for r in scan.flagged(rows, [rule]).collect()) == [0, 1]
    many = [catalog.Rule(f"own-{k}", "info", rf"\$\{{v{k}}}'", "Odd", "own", language="java", literal="${v") for k in range(matcher.MANY)]
    odd = spark.createDataFrame([(0, "say ${v7}'")], "doc_id long, content string")
    assert [r.rule_id for r in scan.flagged(odd, many).collect()] == ["own-7"] == [r.rule_id for r in scan.located(odd, many).collect()]
