"""Tool-call policies: ordered rules, the first that matches decides."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    id: str
    action: str
    tool: tuple[str, ...] = ()
    tool_pattern: str | None = None
    args: dict[str, dict] = field(default_factory=dict)
    reason: str = ""


#: The policy that holds where none is given.
DEFAULT = (
    Policy("block-shell", "block", tool=("bash", "shell", "exec", "run_command"), reason="Shell tools"),
    Policy("block-delete", "block", tool_pattern="*delete*", reason="Deletion"),
)


def tool_regex(glob: str) -> str:
    """* is any text and ? any character; a dot stays a regex dot."""
    return "^" + glob.replace("*", ".*").replace("?", ".") + "$"


def argument(value: Column, matcher: dict) -> Column:
    """equals, contains (any of), matches, and not, which holds a matcher; a missing value is empty text."""
    value = F.coalesce(value, F.lit(""))
    tests = []
    if "equals" in matcher:
        tests.append(value == matcher["equals"])
    if "contains" in matcher:
        tests.append(reduce(lambda a, b: a | b, [F.contains(value, F.lit(x)) for x in matcher["contains"]], F.lit(False)))
    if "matches" in matcher:
        tests.append(value.rlike(matcher["matches"]))
    if "not" in matcher:
        tests.append(~argument(value, matcher["not"]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def applies(policy: Policy, tool: Column, args: Column) -> Column:
    tests = [F.lit(True)]
    if policy.tool:
        tests.append(tool.isin(*policy.tool))
    if policy.tool_pattern:
        tests.append(tool.rlike(tool_regex(policy.tool_pattern)))
    tests += [argument(args[k], m) for k, m in policy.args.items()]
    return reduce(lambda a, b: a & b, tests)


def evaluate(requests: DataFrame, policies: tuple[Policy, ...] = DEFAULT, default: str = "allow", dry_run: bool = False) -> DataFrame:
    """requests(method, tool, args map) with action, rule_id and reason; only tools/call is judged. A dry run warns where it would act."""
    called = F.col("method") == "tools/call"
    decided = F.when(~called, F.struct(F.lit("allow").alias("action"), F.lit(None).cast("string").alias("rule_id"), F.lit("").alias("reason")))
    for p in policies:
        decided = decided.when(applies(p, F.col("tool"), F.col("args")), F.struct(F.lit(p.action).alias("action"), F.lit(p.id).alias("rule_id"), F.lit(p.reason).alias("reason")))
    decided = decided.otherwise(F.struct(F.lit(default).alias("action"), F.lit(None).cast("string").alias("rule_id"), F.lit("").alias("reason")))
    action = F.when((F.col("_d.action") != "allow") & F.lit(dry_run), "warn").otherwise(F.col("_d.action"))
    return requests.withColumn("_d", decided).withColumn("action", action).withColumn("rule_id", F.col("_d.rule_id")).withColumn("reason", F.col("_d.reason")).drop("_d")


def stats(evaluated: DataFrame) -> DataFrame:
    """Counts by action of the requests that a rule decided."""
    return evaluated.where("rule_id is not null").groupBy("rule_id", "action").agg(F.count("*").alias("n"))


def from_yaml(text: str) -> tuple[tuple[Policy, ...], str]:
    """The rules of a policy file, in order of priority where they have one, and its default action."""
    try:
        import yaml

        read = yaml.safe_load(text) or {}
    except ImportError:
        import json

        read = json.loads(text)
    rules = sorted(enumerate(read.get("rules", [])), key=lambda x: (-(x[1].get("priority") or 0), x[0]))
    made = []
    for k, r in rules:
        match = r.get("match") or r
        tool = match.get("tool") or ()
        args = {name: m if isinstance(m, dict) else {"equals": str(m)} for name, m in (match.get("args") or {}).items()}
        made.append(Policy(str(r.get("id") or f"rule-{k}"), r["action"], (tool,) if isinstance(tool, str) else tuple(tool), match.get("toolPattern"), args, r.get("reason") or ""))
    return tuple(made), read.get("defaultAction") or read.get("default_action") or "allow"
