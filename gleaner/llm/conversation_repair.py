"""Conversation structure repair: the cheapest edits after which roles alternate.

Rows are dealt out by a hash of the conversation and sorted by turn.  In each
batch of a task DuckDB runs one recursive query: every recursion advances one
turn for all of the batch's conversations at once, and keeps for each grammar
state the least cost and, of equal costs, the least audit.  Turns are cut into
stretches of `STRETCH`, which are advanced from every state at the same time;
the same query then advances a stretch at a time, and so on, so the number of
recursions grows with the logarithm of a conversation's length.  Equal costs in
one state have audits of which neither starts the other, so the least audit so
far stays the least, whatever follows.

A conversation that is longer than a batch is carried on: for each state its
cost, audit and a running digest, never its rows.  The digest of a conversation
is a chain over its turns, so one task must read them in order; all else about a
conversation that holds a third of the rows (where a message was said first, the
marks of faults) is found before, dealt out by message, with counts that are
added up before they are sent.

Grammar: initials of roles read `(s?(ua)+)?`.  Keep costs 0, Rerole (to user or
assistant, whichever may stand there) 2, Delete 3 (blank and duplicate rows must
go), Insert an empty row of user or assistant 2; each truncated row that stays 1.

Cases: null role or text is one space; a null turn comes first, a null
conversation is one of its own; rows of one turn are put in order by role and
text; repeated rows are duplicates; roles of other initials can't be kept as
they are; a conversation without rows has an empty audit; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import known_to_workers, small, written

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Grammar states: nothing yet, after system, after user, after assistant; what a role's initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that an inserted or renamed row takes in each state, and where that leads.
TAKES = {q: ("assistant", ASSISTANT) if q == USER else ("user", USER) for q in range(4)}
#: Inserts that end a conversation from each state.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
STRETCH = 64


def moves() -> list[tuple[str, int, int, int, int, str]]:
    """For a row of an initial ('' for others) and a fault: from one state to another, the least cost and audit, inserts before the row included."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for fault in range(4):
            for start in range(4):
                at, before = start, ""
                for _ in range(3):  # two inserts lead to every state; more would only go round
                    cost, extra = INSERT * len(before), CUT_OFF * (fault == TRUNCATED)
                    options = [(at, cost + DELETE, before + "D")]
                    if fault in (FINE, TRUNCATED):
                        options.append((TAKES[at][1], cost + RENAME + extra, before + "R"))
                        if (at, initial) in LEADS:
                            options.append((LEADS[at, initial], cost + KEEP + extra, before + "K"))
                    for to, price, audit in options:
                        key = (initial, fault, start, to)
                        out[key] = min(out.get(key, (price, audit)), (price, audit))
                    at, before = TAKES[at][1], before + "I"
    return [(*key, *best) for key, best in out.items()]


#: One recursion advances every stretch of every conversation by one step.
WALK = """
CREATE OR REPLACE TEMP TABLE walked AS
WITH RECURSIVE sizes AS (SELECT conv, stretch, max(step) + 1 AS size FROM steps GROUP BY ALL),
begun AS (SELECT conv, stretch, entry FROM sizes, (SELECT unnest(range(4)) AS entry) WHERE entry = 0 OR stretch > 0 OR conv = carried()),
walk(conv, stretch, entry, state, best, step) AS (
  SELECT conv, stretch, entry, entry, {'cost': CAST(0 AS BIGINT), 'audit': ''}, CAST(0 AS BIGINT) FROM begun
  UNION ALL
  SELECT w.conv, w.stretch, w.entry, s.state, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit}), w.step + 1
  FROM walk w JOIN steps s ON s.conv = w.conv AND s.stretch = w.stretch AND s.step = w.step AND s.entry = w.state
  GROUP BY w.conv, w.stretch, w.entry, s.state, w.step)
SELECT conv, stretch, entry, state, best.cost AS cost, best.audit AS audit FROM walk JOIN sizes USING (conv, stretch) WHERE step = size
"""
TURNS = f"""
CREATE OR REPLACE TEMP TABLE steps AS
SELECT conv, place // {STRETCH} AS stretch, place % {STRETCH} AS step, entry, state, cost, audit FROM turns JOIN moves USING (initial, fault)
"""
STRETCHES = f"""
CREATE OR REPLACE TEMP TABLE steps AS
SELECT conv, stretch // {STRETCH} AS stretch, stretch % {STRETCH} AS step, entry, state, cost, audit FROM walked
"""


class Walker:
    """DuckDB with the grammar's moves: turns of a batch to (entry, state, cost, audit) of each of its conversations."""

    def __init__(self) -> None:
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        self.db.register("every_move", pa.table(dict(zip(("initial", "fault", "entry", "state", "cost", "audit"), zip(*moves(), strict=True), strict=True))))
        self.db.execute("CREATE TABLE moves AS FROM every_move")

    def walked(self, turns: pa.Table, carried: int) -> dict[int, list[tuple[int, int, int, str]]]:
        """carried: the conversation that an earlier batch began, which may be in any state (-1: none)."""
        self.db.register("turns", turns)
        self.db.execute(f"CREATE OR REPLACE TEMP MACRO carried() AS {carried}")
        self.db.execute(TURNS)
        self.db.execute(WALK)
        while self.db.execute("SELECT coalesce(max(stretch), 0) FROM walked").fetchone()[0]:
            self.db.execute(STRETCHES)
            self.db.execute(WALK)
        out: dict[int, list[tuple[int, int, int, str]]] = {}
        for conv, *path in self.db.execute("SELECT conv, entry, state, cost, audit FROM walked").fetchall():
            out.setdefault(conv, []).append(tuple(path))
        self.db.unregister("turns")
        return out


class Path:
    """How a conversation so far came to a state."""

    def __init__(self, state: int = START, cost: int = 0, audit: str = "", digest=None, rows: int = 0) -> None:
        self.state, self.cost, self.audit, self.digest, self.rows = state, cost, audit, digest or hashlib.sha256(), rows

    def then(self, cost: int, audit: str, rows: list[tuple[str, str]]) -> Path:
        new = Path(self.state, self.cost + cost, self.audit + audit, self.digest.copy(), self.rows)
        for role, text, state in edited(audit, rows, self.state):
            new.digest.update(f"{chr(10) if new.rows else ''}{role}:{text}".encode())
            new.rows, new.state = new.rows + 1, state
        return new


def edited(audit: str, rows: Iterable[tuple[str, str]], state: int) -> Iterator[tuple[str, str, int]]:
    """The rows (role, text) that an audit leaves, and the state after each."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit in "IR":
            role, state = TAKES[state]
        elif edit == "K":
            state = LEADS[state, role[:1]]
        if edit != "D":
            yield role, text, state


class Conversation:
    """What is carried of a conversation from batch to batch."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.paths = conv_id, [Path()]
        self.counts, self.least, self.most, self.turns, self.illegal, self.last = [0] * 4, None, None, 0, 0, None

    def add(self, turn: int | None, role: str, text: str, earlier: bool, blank: bool, truncated: bool) -> int:
        """Count a row; its first fault."""
        same = self.last is not None and self.last[1:] == (role, text)
        fault = BLANK if blank else DUPLICATE if earlier or same else TRUNCATED if truncated else FINE
        self.counts[fault] += 1
        self.illegal += self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        if turn is not None:
            self.turns += self.last is None or self.last[0] != turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last = turn, role, text
        return fault

    def advance(self, found: list[tuple[int, int, int, str]], rows: list[tuple[str, str]]) -> None:
        by_state = {p.state: p for p in self.paths}
        best: dict[int, tuple] = {}
        for entry, state, cost, audit in found:
            if entry in by_state:
                p = by_state[entry]
                key = (p.cost + cost, p.audit + audit)
                if state not in best or key < best[state][0]:
                    best[state] = key, p, cost, audit
        self.paths = [p.then(cost, audit, rows) for _, p, cost, audit in best.values()]

    def ended(self, found: list[tuple[int, int, int, str]], rows: list[tuple[str, str]]) -> tuple:
        """The result, once the last rows are there (none: found is empty)."""
        by_state = {p.state: p for p in self.paths}
        ways = found or [(q, q, 0, "") for q in by_state]
        options = [(by_state[e].cost + c + INSERT * len(ENDS[q]), by_state[e].audit + a + ENDS[q], e, c, a + ENDS[q]) for e, q, c, a in ways if e in by_state]
        cost, audit, entry, c, a = min(options)
        path = by_state[entry].then(c, a, rows)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, audit, path.digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walker, open_ = Walker(), None
    kind = None

    def result(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        convs = [open_] if open_ else []
        turns, said = {"conv": [], "place": [], "initial": [], "fault": []}, [[] for _ in convs]
        for conv_id, turn, role, text, dropped, earlier, blank, truncated in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not convs or convs[-1].conv_id != conv_id:
                convs.append(Conversation(conv_id))
                said.append([])
            if not dropped:
                turns["conv"].append(len(convs) - 1)
                turns["place"].append(len(said[-1]))
                turns["initial"].append(role[:1] if role[:1] in ("s", "u", "a") else "")
                turns["fault"].append(convs[-1].add(turn, role, text, earlier, blank, truncated))
                said[-1].append((role, text))
        found = walker.walked(pa.table(turns, schema=pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("initial", pa.string()), ("fault", pa.int8())])), 0 if open_ else -1)
        yield result([c.ended(found.get(k, []), said[k]) for k, c in enumerate(convs[:-1])])
        if convs:
            open_ = convs[-1]
            if said[-1]:
                open_.advance(found[len(convs) - 1], said[-1])
    if open_:
        yield result([open_.ended([], [])])


def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text, without nulls in role and text, none dropped and each once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(False).alias("dropped"), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of conversation and turn; what is dropped stays as a mark that the conversation exists."""
    rows = rows_of(conversations)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with earlier (role and text stand in an earlier turn of the conversation), blank and truncated, a row for each copy."""
    told = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    again = told.where("not dropped").groupBy("conv_id", "role", "digest").agg(F.min("when").alias("first"), F.max("when").alias("last")).where("first < last")
    again = written(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "said-again")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    flags = [F.coalesce(F.col("first") < F.col("when"), F.lit(False)).alias("earlier"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")]
    joined = told.join(small(again), same, "left").select("conv_id", "turn", "role", "text", "dropped", *flags, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return joined.drop("copy")


def _in_order(rows: DataFrame, *ahead: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *ahead, F.col("turn").asc_nulls_first(), "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows_of() or damaged(): gaps between turns, faults, cost, audit and the digest of the repaired `role:text` lines."""
    known_to_workers(rows.sparkSession)
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return _in_order(_marked(rows)).mapInArrow(_repairs, schema)


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit comes ahead of its rows."""
    names = ["conv_id", "place", "role", "text", "edit"]
    conv_id, audit, at, state, place = None, "", 0, START, 0

    def inserted(out: list) -> None:
        nonlocal at, state, place
        while audit[at : at + 1] == "I":
            role, state = TAKES[state]
            out.append((conv_id, place, role, "", "I"))
            at, place = at + 1, place + 1

    for batch in batches:
        out: list[tuple] = []
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for conv, header, _, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if header:
                conv_id, audit, at, state, place = conv, text, 0, START, 0
            else:
                edit = audit[at]
                for new_role, _, state in edited(edit, [(role, text)], state):  # noqa: B020
                    out.append((conv_id, place, new_role, text, edit))
                    place += 1
                at += 1
            inserted(out)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations' turns after repair: conv_id, place, role, text and edit; found is what repairs(rows) returned."""
    known_to_workers(rows.sparkSession)
    kept = rows.where("not dropped").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("conv_id", F.lit(False).alias("header"), "turn", "role", "text")
    heads = found.select("conv_id", F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string, edit string"
    return _in_order(kept.unionByName(heads), F.col("header").desc()).mapInArrow(_applied, schema)
