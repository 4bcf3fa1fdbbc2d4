"""Ignore rules, targets and scans of what changed."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import catalog, custom_rules, reputation, scan, vet
from gleaner.sources import files, ignores
from gleaner.streaming import increment, messages

RULE = [catalog.Rule("own", "high", "key[0-9]+", "A key", "own")]


@pytest.mark.parametrize("glob", ["*.js", "/a/*.js", "a/**/c.js", "dist/", "f?.py", "a.b", "/x+(y)/", "**/z", "a b", "#x", "[k]"])
def test_globs_of_columns_are_those_of_texts(spark, glob):
    assert spark.range(1).select(ignores.glob_pattern(F.lit(glob))).first()[0].replace("\\", "") == T.glob_regex(glob).replace("\\", "")


def test_the_last_rule_that_matches_decides(spark):
    held = {
        ".vetignore": "*.js\n!keep.js\n# *.md\n\nlogs/\r\n", ".gitignore": "!also.js\n", "a/.gitignore": "keep.js\n!a.js\n/b/\n", "a/b/.gitignore": "!back.md\n", "empty/.gitignore": None,
    }
    paths = ["x.js", "keep.js", "also.js", "x.md", "logs/x.md", "a/keep.js", "a/a.js", "a/x.js", "a/b/x.md", "a/b/back.md", "a/c/b/x.md", "empty/x.js", "empty/x.md", "b/keep.js", "b/a.js", "x.md"]
    rows = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, k int")
    told = ignores.rules(spark.createDataFrame([*held.items(), ("x.md", "*")], "path string, content string"))
    assert sorted(r.path for r in ignores.kept(rows, told).collect()) == sorted(["keep.js", "also.js", "x.md", "a/a.js", "a/b/back.md", "a/c/b/x.md", "empty/x.md", "b/keep.js", "x.md"])
    assert ignores.kept(rows, told.limit(0)).count() == len(paths) and ignores.kept(rows.limit(0), told).count() == 0


def test_nested_ignore_files_of_a_folder(spark, tmp_path):
    for path, body in {".gitignore": "*.py\n!keep.py\n", "keep.py": "1", "x.py": "2", "sub/.gitignore": "!x.py\nkeep.py\n", "sub/x.py": "3", "sub/keep.py": "4", "sub/deep/x.py": "5"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    assert sorted(r.content for r in files.scan_files(spark, str(tmp_path), nested=True).collect()) == ["1", "3", "5"]


def test_signatures_have_a_gate_of_their_own(spark, tmp_path):
    """An ignored file and one in a folder of examples are no input of rules, but signatures see them."""
    for path, body in {".gitignore": "skip.md\n", "skip.md": "ignore previous instructions key1", "examples/e.md": "ignore previous instructions key2", "node_modules/n.md": "ignore previous instructions", "a.md": "key3"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    found = vet.vet_path(spark, str(tmp_path), builtin=False, custom=RULE, modes=False).findings.collect()
    assert {r.path for r in found if r.source == "signature"} == {"skip.md", "examples/e.md"} and {r.path for r in found if r.source == "custom"} == {"a.md"}


def test_counts_by_target(spark):
    rows = [("a", "x.py", "r1", 1, "high"), ("a", "x.py", "r1", 1, "high"), ("b", "x.py", "r1", 1, "high"), ("b", "y.py", "r2", 2, "low"), (None, "y.py", "r2", 2, "low"), (None, "z.py", None, None, "critical")]
    out = vet.by_target(spark.createDataFrame(rows, "target string, path string, rule_id string, line long, severity string")).collect()
    got = {(r.target, r.every): (r.total, r.critical, r.high, r.low) for r in out}
    assert got == {("a", False): (1, 0, 1, 0), ("b", False): (2, 0, 1, 1), (None, False): (2, 1, 0, 1), (None, True): (3, 1, 1, 1)}


def run(docs):
    return scan.located(docs, RULE, "path").select("path", "rule_id", "line", "column")


def test_a_scan_of_changes_equals_a_full_scan(spark):
    rng = random.Random(1)
    text = lambda: "\n".join(rng.choice(["key1", "plain", "key22 key3", ""]) for _ in range(4))
    before = {f"f{k}": text() for k in range(40)}
    after = {p: (t if k % 3 else text()) for k, (p, t) in enumerate(before.items()) if k % 5} | {f"n{k}": text() for k in range(5)} | {"null": None}
    rows = lambda d: spark.createDataFrame([*d.items(), *[("twice", x) for x in ("key1", "key2")]], "path string, content string")
    told = {r.path: r.change for r in increment.changes(increment.snapshot(rows(before)), increment.snapshot(rows(after))).collect()}
    assert "twice" not in told and {p for p, c in told.items() if c == "removed"} == set(before) - set(after) and {p for p, c in told.items() if c == "changed"} == {p for p in before if p in after and before[p] != after[p]}
    seen = []
    watched = lambda d: run(d.join(spark.createDataFrame(sorted((r.path,) for r in seen.append(d.select("path").collect()) or seen[-1]) or [("",)], "path string").distinct(), "path", "left_semi"))
    got = increment.rescanned(rows(after), increment.snapshot(rows(before)), run(rows(before)), watched)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, run(rows(after)).collect()))
    assert {r.path for r in seen[0]} == {p for p, c in told.items() if c != "removed"}
    empty = increment.snapshot(rows(before)).limit(0)
    assert increment.rescanned(rows(after), empty, run(rows(after)).limit(0), run).count() == run(rows(after)).count()


def test_a_stream_of_changes(spark, tmp_path):
    batches = [[("a", "key1", 1), ("b", "key2 key3", 1), ("c", "x", 1)], [("b", "key4", 2), ("a", None, 2)], [("a", "key5\nkey6", 4), ("a", "key7", 3), ("d", "", 3)]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("path", "content", "at"), r, strict=True))) for r in rows))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + 60 * k,) * 2)
    source = messages.json_lines(spark, str(tmp_path / "in"), "path string, content string, at long", 1)
    increment.follow(source, run, str(tmp_path / "found"), str(tmp_path / "c")).awaitTermination()
    held = increment.current(spark.read.parquet(str(tmp_path / "found")))
    assert sorted((r.path, r.line) for r in held.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_suppressed_findings_are_marked_in_one_table(spark):
    docs = spark.createDataFrame([("a.py", "key1 // vet-ignore own\nkey2 key3 // vet-ignore\nkey4\n# vet-ignore-next-line other, own\nkey5\nkey6 // vet-ignore other")], "path string, content string")
    out = vet.vet(docs, builtin=False, with_signatures=False, custom=RULE)
    assert sorted((r.line, r.column, r.suppressed) for r in out.every.collect()) == [(1, 1, True), (2, 1, True), (2, 6, True), (3, 1, False), (5, 1, True), (6, 1, False)]
    assert sorted(r.line for r in out.findings.collect()) == [3, 6] and out.suppressed.count() == 4 and out.findings.columns == out.suppressed.columns
    assert {r.suppressed for r in vet.vet(docs, builtin=False, with_signatures=False, custom=RULE, suppress=False).every.collect()} == {False}


def test_options_are_merged_in_order():
    got = vet.options_from(json.dumps({"severity": "warning", "maxFileSize": 10, "ignore": ["a", "b"], "yara": False, "unknown": 1, "checkPermissions": None}), severity="critical", ignore=("b", "c"), modes=None)
    assert got == vet.DEFAULTS | {"severity": "critical", "max_bytes": 10, "ignore": ("a", "b", "c"), "with_signatures": False}
    assert vet.options_from("{") == vet.options_from("") == vet.options_from("[1]") == vet.DEFAULTS


def test_rules_from_paths(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"r{k}.yaml").write_text(json.dumps({"rules": [{"id": f"own-{k}", "pattern": f"x{k}"}]}))
    assert [r.id for r in custom_rules.from_path(spark, str(tmp_path))] == ["own-1", "own-2"] and [r.id for r in custom_rules.from_path(spark, str(tmp_path / "r2.yaml"))] == ["own-2"]


def test_globs_name_paths_or_themselves(spark):
    listing = spark.createDataFrame([("a.js",), ("s/b.js",), ("s/t/c.js",), ("s/t/c.py",), ("/".join("d" * 12) + "/e.js",)], "path string")
    got = sorted((r.pattern, r.path) for r in files.expanded(listing, ("*.js", "s/**/*.js", "s/t/c.*", "none/*.x", "*.js")).collect())
    assert got == [("*.js", "a.js"), ("none/*.x", "none/*.x"), ("s/**/*.js", "s/t/c.js"), ("s/t/c.*", "s/t/c.js"), ("s/t/c.*", "s/t/c.py")]


def test_status_is_one_row(spark):
    asked = spark.createDataFrame([(True,), (False,), (True,)], "allowed boolean")
    assert tuple(reputation.status(asked, spark.range(7)).first()) == (3, 2, 4, 7) and tuple(reputation.status(asked.limit(0), spark.range(0)).first()) == (0, 0, 4, 0)
