"""Column builders for matching in text: flags, places, masks. Usable in batch and in streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
#: Severities as findings carry them, and the rank by which a severity filter keeps rules: what isn't critical or warning ranks as info.
SEVERITIES = ("critical", "high", "warning", "medium", "info", "low")


def rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def severity_passes(severity: Column, least: str) -> Column:
    return rank(severity) <= rank(F.lit(least))


def count_flags(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions], F.lit(0))


def unmarked(content: Column) -> Column:
    """Text without the characters that mark matches."""
    return F.translate(F.coalesce(content, F.lit("")), OPEN + CLOSE, "")


def marked(clean: Column, pattern: str) -> Column:
    """unmarked() text with each non-overlapping match between marks."""
    return F.regexp_replace(clean, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}"))


#: Pieces of a text that are gone through together, so that gathering many matches doesn't copy all of them for each.
TOGETHER = 64


def places(text: Column) -> Column:
    """Of marked() text every match: array of (line, column, offset, match), lines and columns from 1, offsets from 0, in code points.

    The text is split at the marks; the place of a match follows from the lines
    and characters of the pieces before it.  Matches of nothing are left out.
    """
    kind = "array<struct<line:int,column:int,offset:int,match:string>>"

    def state(line: Column, column: Column, offset: Column, found: Column) -> Column:
        return F.struct(line.alias("line"), column.alias("column"), offset.alias("offset"), found.alias("found"))

    def none(kind: str) -> Column:
        return F.array().cast(kind)

    def step(acc: Column, piece: Column) -> Column:
        # piece: a match up to CLOSE, then text; acc: line, and characters since the last newline
        match = F.substring_index(piece, CLOSE, 1)
        plain = F.replace(piece, F.lit(CLOSE), F.lit(""))
        breaks = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
        column = F.when(breaks > 0, F.length(F.substring_index(plain, "\n", -1))).otherwise(acc["column"] + F.length(plain))
        this = F.struct(acc["line"].alias("line"), (acc["column"] + 1).alias("column"), acc["offset"].alias("offset"), match.alias("match"))
        here = F.when(F.contains(piece, F.lit(CLOSE)) & (F.length(match) > 0), F.concat(acc["found"], F.array(this))).otherwise(acc["found"])
        return state(acc["line"] + breaks, column, acc["offset"] + F.length(plain), here)

    def many(acc: Column, pieces: Column) -> Column:
        part = F.aggregate(pieces, state(acc["line"], acc["column"], acc["offset"], none(kind)), step)
        return F.aggregate(F.array(part), acc, lambda a, x: state(x["line"], x["column"], x["offset"], F.concat(a["found"], F.array(x["found"]))))

    pieces = F.split(text, OPEN, -1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / TOGETHER).cast("int")), lambda b: F.slice(pieces, b * TOGETHER + 1, F.lit(TOGETHER)))
    return F.flatten(F.aggregate(blocks, state(F.lit(1), F.lit(0), F.lit(0), none(f"array<{kind}>")), many)["found"])


def matches(content: Column, pattern: str) -> Column:
    """places() of a pattern's matches in any text."""
    return places(marked(unmarked(content), pattern))


def masked(rule_id: Column, match: Column) -> Column:
    """Evidence that is safe to show: credentials lose their middle, other matches their end."""
    secret = rule_id.startswith("credential-") & (F.length(match) > 20)
    cut = F.when(F.length(match) > 60, F.concat(F.substring(match, 1, 57), F.lit("..."))).otherwise(match)
    return F.when(secret, F.concat(F.substring(match, 1, 10), F.lit("***"), F.right(match, F.lit(4)))).otherwise(cut)


def line_text(content: Column, line: Column) -> Column:
    return F.substring(F.trim(F.element_at(F.split(content, "\n", -1), line)), 1, 100)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def glob_regex(glob: str) -> str:
    """An ignore pattern as a regex on a relative path: * within a name, ** across, ? one character; a leading / anchors, a trailing / is a folder."""
    anchored, folder, body = glob.startswith("/"), glob.endswith("/"), glob.strip("/")
    out, k = "", 0
    while k < len(body):
        if body[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(body[k], body[k] if body[k].isalnum() or body[k] in "/_- " else "\\" + body[k])
        k += 1
    return ("^" if anchored else "(^|/)") + out + ("/.*" if folder else "(/|$)")
