"""One regular expression, read once, for both engines: rules are written in JavaScript's dialect and come out as Java's or RE2's.

What the three read differently is written out so that nothing is left to an
engine: `\\w \\d \\s` and the ends of words are sets of code points, ignoring case
adds the letters that fold together (an ASCII letter only with its own other
case), `.` stops at the four line ends, `^` and `$` are the ends of the text or,
with m, of lines.  RE2 has no lookaround; where it stands at an edge of the
pattern and asks for one character or a fixed word, what it asks for becomes part
of the match, which tells whether there is a match all the same.

`needs` takes from the same tree sets of literals of each of which every match holds one.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache, reduce
from re import _constants as C  # the tree that the standard library reads from a pattern
from re import _parser

TOP = 0x10FFFF
Ranges = tuple[tuple[int, int], ...]
DIGIT: Ranges = ((48, 57),)
WORD: Ranges = ((48, 57), (65, 90), (95, 95), (97, 122))
SPACE: Ranges = ((9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
LINE_END: Ranges = ((10, 10), (13, 13), (0x2028, 0x2029))
#: Literals of a clause and of a run of items, clauses of a rule, and characters that are telling by themselves; other literals have two characters or more.
MOST_LITERALS, MOST_OF_RUN, MOST_CLAUSES, RARE = 256, 64, 4, "@`$|{<"
RE2_REPEAT = 1000


class Untranslatable(ValueError):
    """RE2 has no form of a pattern."""


def joined(ranges: list[tuple[int, int]]) -> Ranges:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return tuple(out)


def inverted(ranges: Ranges) -> Ranges:
    at, out = 0, []
    for lo, hi in ranges:
        if at < lo:
            out.append((at, lo - 1))
        at = hi + 1
    return (*out, (at, TOP)) if at <= TOP else tuple(out)


@lru_cache(1)
def _folds() -> list[list[int]]:
    """Characters that are one when case is ignored: those of one upper-case character, ASCII ones apart."""
    groups: dict[int, list[int]] = {}
    for c in range(0x10000):
        upper = chr(c).upper()
        one = c if len(upper) != 1 or (c > 127 and ord(upper) < 128) else ord(upper)
        groups.setdefault(one, []).append(c)
    return [g for g in groups.values() if len(g) > 1]


@lru_cache(4096)
def folded(ranges: Ranges) -> Ranges:
    if not ranges or ranges[-1][1] < 128:  # ASCII letters fold among themselves
        return joined([*ranges, *((c ^ 32, c ^ 32) for lo, hi in ranges for c in range(lo, hi + 1) if chr(c).isalpha())])
    held = lambda c: any(lo <= c <= hi for lo, hi in ranges)
    return joined([*ranges, *((c, c) for g in _folds() if any(map(held, g)) for c in g)])


_CATEGORY = {
    C.CATEGORY_DIGIT: DIGIT, C.CATEGORY_NOT_DIGIT: inverted(DIGIT), C.CATEGORY_WORD: WORD, C.CATEGORY_NOT_WORD: inverted(WORD), C.CATEGORY_SPACE: SPACE, C.CATEGORY_NOT_SPACE: inverted(SPACE),
}


@lru_cache(4096)
def parsed(pattern: str, flags: str = "") -> tuple:
    """The tree of a pattern and its flags; g is nothing here."""
    source = re.sub(r"(?<!\\)((?:\\\\)*)\[\^\]", r"\1[\\s\\S]", pattern)
    source = re.sub(r"(?<!\\)((?:\\\\)*)\(\?<(?=[A-Za-z_])", r"\1(?P<", source)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _parser.parse(source, sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in set(flags) & set("ims")))
    return tuple(tree), tree.state.flags


def _set(op: object, value: object, flags: int) -> Ranges | None:
    """The characters that a node of one character matches."""
    if op is C.LITERAL or op is C.NOT_LITERAL:
        ranges: Ranges = ((value, value),)
    elif op is C.ANY:
        return ((0, TOP),) if flags & re.S else inverted(LINE_END)
    elif op is C.IN:
        parts: list[tuple[int, int]] = []
        for kind, v in value:
            parts += [(v, v)] if kind is C.LITERAL else [v] if kind is C.RANGE else _CATEGORY[v] if kind is C.CATEGORY else []
        ranges = joined(parts)
    else:
        return None
    if flags & re.I:
        ranges = folded(ranges)
    return inverted(ranges) if op is C.NOT_LITERAL or (op is C.IN and value and value[0][0] is C.NEGATE) else ranges


def _char(c: int) -> str:
    return chr(c) if chr(c).isalnum() and c < 128 else f"\\x{{{c:X}}}"


def _class(ranges: Ranges) -> str:
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return _char(ranges[0][0])
    rest = inverted(ranges)
    if not ranges or not rest:
        return r"[^\x{0}-\x{10FFFF}]" if not ranges else r"[\x{0}-\x{10FFFF}]"
    shown, sign = (rest, "^") if len(rest) < len(ranges) else (ranges, "")
    return f"[{sign}" + "".join(_char(lo) if lo == hi else f"{_char(lo)}-{_char(hi)}" for lo, hi in shown) + "]"


_WORD = _class(WORD)
_ENDS = {
    "java": {
        C.AT_BOUNDARY: f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", C.AT_NON_BOUNDARY: f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
        "^": f"(?<!{_class(inverted(LINE_END))})", "$": f"(?!{_class(inverted(LINE_END))})",
    },
    "re2": {C.AT_BOUNDARY: r"\b", C.AT_NON_BOUNDARY: r"\B", "^": "(?m:^)", "$": "(?m:$)"},
}


def _first(items: list, flags: int, way: int = 1) -> Ranges | None:
    """The characters that a match of the items may begin (or, backwards, end) with, if it has one."""
    for op, value in items if way > 0 else reversed(items):
        ranges = _set(op, value, flags)
        if ranges is not None:
            return ranges
        if op is C.SUBPATTERN:
            return _first(list(value[3]), (flags | value[1]) & ~value[2], way)
        if op is C.BRANCH:
            parts = [_first(list(b), flags, way) for b in value[1]]
            return None if None in parts else joined([r for p in parts for r in p])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            return _first(list(value[2]), flags, way)
        return None
    return None


def _boundary(before: list, after: list, flags: int) -> str:
    """The end of a word for Java: one look is enough where what stands beside it is of a word; the cheap look comes first."""
    begins, ends = _first(after, flags), _first(before, flags, -1)
    within = lambda s: s is not None and joined([*s, *WORD]) == WORD
    if within(begins):
        return f"(?={_class(begins)})(?<!{_WORD})"
    return f"(?!{_WORD})" if within(ends) else _ENDS["java"][C.AT_BOUNDARY]


def _end(at: object, flags: int, kind: str) -> str:
    lines = flags & re.M
    if at in (C.AT_BEGINNING, C.AT_BEGINNING_STRING):
        return _ENDS[kind]["^"] if lines and at is C.AT_BEGINNING else r"\A"
    if at in (C.AT_END, C.AT_END_STRING):
        return _ENDS[kind]["$"] if lines and at is C.AT_END else r"\z"
    return _ENDS[kind][at]


def _edge(item: tuple, flags: int) -> str | None:
    """A lookaround at an edge of the pattern as part of an RE2 match; None if it isn't of one character or a fixed word."""
    op, (way, body) = item
    body = list(body)
    sets = [_set(o, v, flags) for o, v in body]
    if op is C.ASSERT:
        return _text(body, flags, "re2")
    if not sets or None in sets:
        return None
    outside = r"\z" if way > 0 else r"\A"
    if way < 0:
        sets.reverse()
    out = ""
    for s in reversed(sets):  # not the word: its end, or another first character, or the first one and then not the rest
        first, other = _class(s), _class(inverted(s))
        out = f"(?:{outside}|{other})" if not out else f"(?:{outside}|{other}|{first}{out})" if way > 0 else f"(?:{outside}|{other}|{out}{first})"
    return out


def _text(items: list, flags: int, kind: str, edges: bool = False) -> str:
    out = ""
    for k, (op, value) in enumerate(items):
        ranges = _set(op, value, flags)
        if ranges is not None:
            out += _class(ranges)
        elif op is C.AT:
            out += _boundary(items[:k], items[k + 1 :], flags) if kind == "java" and value is C.AT_BOUNDARY else _end(value, flags, kind)
        elif op is C.BRANCH:
            out += "(?:" + "|".join(_text(list(b), flags, kind, edges and len(items) == 1) for b in value[1]) + ")"
        elif op is C.SUBPATTERN:
            group, add, drop, body = value
            out += ("(" if group else "(?:") + _text(list(body), (flags | add) & ~drop, kind, edges and len(items) == 1) + ")"
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            piece = _text(list(body), flags, kind)
            one = len(body) == 1 and (_set(*body[0], flags) is not None or body[0][0] is C.SUBPATTERN)
            out += _repeated(piece if one else f"(?:{piece})", int(low), None if high is C.MAXREPEAT else int(high), "?" * (op is C.MIN_REPEAT), kind)
        elif op is C.GROUPREF and kind == "java":
            out += f"(?:\\{value})"
        elif op in (C.ASSERT, C.ASSERT_NOT) and kind == "java":
            way, body = value
            out += f"(?{'<' * (way < 0)}{'=' if op is C.ASSERT else '!'}{_text(list(body), flags, kind)})"
        elif op in (C.ASSERT, C.ASSERT_NOT) and edges and k == (0 if value[0] < 0 else len(items) - 1) and (edge := _edge((op, value), flags)) is not None:
            out += edge
        else:
            raise Untranslatable(str(op))
    return out


def _repeated(piece: str, low: int, high: int | None, lazy: str, kind: str) -> str:
    if (low, high) in ((0, None), (1, None), (0, 1)):
        return piece + {(0, None): "*", (1, None): "+", (0, 1): "?"}[low, high] + lazy
    if kind == "java" or max(low, high or 0) <= RE2_REPEAT:
        return f"{piece}{{{low}{'' if high == low else ',' if high is None else f',{high}'}}}{lazy}"
    out = f"{piece}{{{RE2_REPEAT}}}" * (low // RE2_REPEAT) + f"{piece}{{{low % RE2_REPEAT}}}" * bool(low % RE2_REPEAT)
    if high is None:
        return f"(?:{out}{piece}*{lazy})"
    more = high - low
    return f"(?:{out}" + f"{piece}{{0,{RE2_REPEAT}}}{lazy}" * (more // RE2_REPEAT) + f"{piece}{{0,{more % RE2_REPEAT}}}{lazy}" * bool(more % RE2_REPEAT) + ")"


@lru_cache(4096)
def java(pattern: str, flags: str = "") -> str:
    """The pattern for Spark."""
    return _text(list(parsed(pattern, flags)[0]), parsed(pattern, flags)[1], "java")


@lru_cache(4096)
def re2(pattern: str, flags: str = "", exact: bool = True) -> str:
    """The pattern for RE2; with exact=False it may match more characters than the pattern does, but not elsewhere and not in other texts."""
    return _text(list(parsed(pattern, flags)[0]), parsed(pattern, flags)[1], "re2", edges=not exact)


def in_re2(pattern: str, flags: str = "", exact: bool = True) -> bool:
    try:
        re2(pattern, flags, exact)
    except Untranslatable:
        return False
    return True


def _better(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """The set of literals that fewer texts hold, as far as lengths tell."""
    worth = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return max(a, b, key=worth)


def normal(text: str) -> str:
    """A text as literals are looked for in it: in lower case, each run of white space one blank, and a blank at both ends."""
    return f" {' '.join(text.lower().replace(chr(0xFEFF), ' ').split())} "


def _letters(ranges: Ranges | None) -> list[str]:
    """The few ASCII characters that a node may be, as in a normal text; none if there are others."""
    if ranges is None:
        return []
    rest = [(lo, hi) for lo, hi in ranges if not any(a <= lo and hi <= b for a, b in SPACE)]
    if sum(hi - lo + 1 for lo, hi in rest) > 6 or rest and rest[-1][1] > 127:
        return []
    return sorted({chr(c).lower() for lo, hi in rest for c in range(lo, hi + 1)} | ({" "} if len(rest) < len(ranges) else set()))


Clause = tuple[str, ...]


def _literals(items: list, flags: int) -> tuple[list[Clause], Clause | None]:
    """Clauses: sets of literals of each of which a match holds one; and all texts that the items match, in lower case, if those are few."""
    clauses: list[Clause] = []
    run: Clause = ("",)  # all texts of the items since the last that may be anything
    whole = True
    for op, value in items:
        one = _letters(_set(op, value, flags))
        held: list[Clause] = []
        if one:
            every: Clause | None = tuple(one)
        elif op is C.SUBPATTERN:
            held, every = _literals(list(value[3]), (flags | value[1]) & ~value[2])
        elif op is C.BRANCH:
            parts = [_literals(list(b), flags) for b in value[1]]
            best = [reduce(_better, h, ()) for h, _ in parts]
            held = [tuple(sorted({x for b in best for x in b}))] if all(best) else []
            every = tuple(sorted({x for _, e in parts for x in e})) if all(e is not None for _, e in parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            held, every = _literals(list(value[2]), flags)
            if every != (" ",) and value[1] != 1:  # white space comes out as one blank, however much there is
                every = None
            if value[0] == 0:
                held, every = [], ("", *every) if every is not None else None
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            every = None
        clauses += [h for h in held if len(h) <= MOST_LITERALS]
        if every is not None and len(run) * len(every) <= MOST_OF_RUN:
            run = tuple(sorted({re.sub(" +", " ", a + b) for a in run for b in every}))
        else:
            whole = False
            clauses += [run] * all(run)
            run = every if every is not None and len(every) <= MOST_OF_RUN else ("",)
    return clauses + [run] * all(run), run if whole else None


@lru_cache(4096)
def needs(pattern: str, flags: str = "") -> tuple[Clause, ...]:
    """Clauses of literals, the most telling first: of each of them every match holds one, as normal() writes it."""
    tree, read = parsed(pattern, flags)
    found: list[Clause] = []
    for clause in _literals(list(tree), read)[0]:
        kept = tuple(x for x in clause if not any(y in x and y != x for y in clause))
        if all(len(x) > 1 or x in RARE for x in kept) and kept not in found:
            found.append(kept)
    # a clause says nothing more where each literal of another holds one of its own
    told = [c for c in found if not any(d != c and all(any(x in y for x in c) for y in d) for d in found)]
    return tuple(sorted(told, key=lambda c: (-min(map(len, c)), len(c), c))[:MOST_CLAUSES])


def words_of(clause: Clause) -> Clause:
    """The longest parts without blanks of a clause's literals: what a text in lower case holds as it stands."""
    return tuple(dict.fromkeys(max(x.split(" "), key=len) for x in clause))


def _sample(items: list, flags: int) -> str:
    out = ""
    for k, (op, value) in enumerate(items):
        ranges = _set(op, value, flags)
        if value is C.AT_BOUNDARY and out and k and items[k - 1][0] in (C.MAX_REPEAT, C.MIN_REPEAT) and items[k - 1][1][0] == 0:
            out += " "  # what may be nothing parts two words
        elif ranges is not None:
            liked = [c for lo, hi in ranges for c in range(lo, min(hi, lo + 127) + 1) if c == 32 or chr(c).isalnum()]
            out += chr(value) if op is C.LITERAL else chr(min(liked, default=ranges[0][0], key=lambda c: (c > 127, c == 32, c)))
        elif op is C.BRANCH:
            out += _sample(list(value[1][0]), flags)
        elif op is C.SUBPATTERN:
            out += _sample(list(value[3]), (flags | value[1]) & ~value[2])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += _sample(list(value[2]), flags) * int(value[0])
        elif op is C.ASSERT:
            out += _sample(list(value[1]), flags)
    return out


def sample(pattern: str, flags: str = "") -> str:
    """A short text that the pattern is likely to match: first alternatives, least repeats."""
    tree, read = parsed(pattern, flags)
    return _sample(list(tree), read)
