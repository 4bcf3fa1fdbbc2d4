"""Quality rules: text statistics, a fixed base rule, and a learned decision list.

The list is learned by sequential covering from labelled documents.  Each rule
is a conjunction of thresholds on ratios of the statistics; it is grown literal
by literal on one part of the labelled rows and cut back to its best prefix on
the rest, and taken if it is precise enough on both.  Learning reads counts
only: labelled rows by feature and quantile bin, added up by Spark.  What comes
out is an ordered list of conditions, and so one Spark conditional expression.

Cases: a null or empty text has no words, all its counts are 0 and it fails the
base rule; null ids stay and match no label; null labels are not used; of a
document with several labels each counts as a labelled row, conflicting ones on
both sides; without
labelled rows of both kinds there are no rules and the base rule decides;
repeated rows are judged each; an empty table gives no rows; columns of any
name may be carried, as the statistics stand in one struct of a name of their own.

Repeated windows are found by sorting 64-bit keys that hold a hash's high bits
and the window's position, and comparing whole hashes of neighbours: with n
words the chance of a wrong count is below n**3 / 2**64.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, written

SPAN = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_upper", "n_marks"]


def statistics(docs: DataFrame, text: str, carry: list[str], name: str) -> DataFrame:
    """carry, and the counts of each text in a struct column `name`."""

    def only(keep: str) -> Column:
        return F.length(F.regexp_replace("text", keep, ""))

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    kept = F.struct(*[F.col(f"`{c}`") for c in carry])
    d = docs.select(kept.alias("carry"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select(
        "carry",
        F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)).alias("w"),
        only(r"[\x20\x09-\x0D]+").alias("word_chars"),
        only(r"[^#*$%&|<>]+").alias("n_symbols"),
        only(r"[^\p{Lu}]+").alias("n_upper"),
        only(r"[^!?]+").alias("n_marks"),
        lines.alias("lines"),
    )
    w = F.col("w")
    windows = F.transform(F.slice(w, SPAN, F.greatest(F.size(w) - (SPAN - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN - 1)], x))
    d = d.select("*", windows.alias("h")).withColumn("unit", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h") + 1))).cast("long"))
    h, unit = F.col("h"), F.col("unit")
    place = unit - 1  # the bits of a key that hold the position
    d = d.withColumn("s", F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(-unit).bitwiseOR(i.cast("long")))))
    s = F.col("s")

    def same(x: Column, y: Column) -> Column:
        at = lambda k: F.get(h, k.bitwiseAND(place).cast("int"))
        return (x.bitwiseXOR(y).bitwiseAND(-unit) == 0) & (at(x) == at(y))

    twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
    d = d.withColumn("p", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(place).cast("int"))))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(x - F.get(p, i - 1), F.lit(SPAN)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.size("w"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": covered,
        "n_upper": F.col("n_upper"), "n_marks": F.col("n_marks"),
    }
    return d.select("carry.*", F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]).alias(name))


def base_failed(name: str) -> Column:
    n = F.col(f"{name}.n_words")
    return (n < 10) | (100 * F.col(f"{name}.n_repeat_words") > 20 * n)


def features(name: str) -> dict[str, Column]:
    """What the learned conditions are on: ratios, so that they hold at any length."""
    n, chars = F.greatest(F.col(f"{name}.n_words"), F.lit(1)), F.greatest(F.col(f"{name}.word_chars"), F.lit(1))
    of = lambda k, whole: F.col(f"{name}.{k}") / whole
    return {
        "word_length": of("word_chars", n), "symbols": of("n_symbols", n), "dup_lines": of("n_dup_lines", n),
        "repeats": of("n_repeat_words", n), "upper": of("n_upper", chars), "marks": of("n_marks", n), "words": F.col(f"{name}.n_words").cast("double"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float
    bin: int

    def on(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def on_bins(self) -> Column:
        x = F.col(f"bin_{self.feature}")
        return x > self.bin if self.above else x <= self.bin


Rule = tuple[Literal, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [x.on_bins() for x in rule], F.lit(True))


def learn(train: DataFrame, names: list[str], bins: int = 32, most_rules: int = 8, most_literals: int = 3, least_precision: float = 0.97, least_rows: int = 5) -> list[Rule]:
    """Rules for bad rows of train(bad boolean, fold int, and a column for each name), the most useful first.

    Each step is one Spark aggregation; at most bins rows for each feature come back.
    """
    steps = [k / bins for k in range(1, bins)]
    found = train.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    binned = train.select(
        "bad", "fold", *[reduce(lambda a, b: a + b, [(F.col(n) > t).cast("int") for t in cuts[n]], F.lit(0)).alias(f"bin_{n}") for n in names]
    )
    binned = written(binned, "bins")
    rules: list[Rule] = []
    tally = lambda where: F.sum(F.when(where & F.col("bad"), 1).otherwise(0)), lambda where: F.sum(F.when(where & ~F.col("bad"), 1).otherwise(0))
    while len(rules) < most_rules:
        left = binned.where(~reduce(lambda a, b: a | b, [_all(r) for r in rules], F.lit(False)))
        rule: Rule = ()
        score = None
        while len(rule) < most_literals:
            rows = (
                left.where((F.col("fold") != 0) & _all(rule))
                .select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"bin_{n}").alias("bin")) for n in names])).alias("x"))
                .groupBy("x.feature", "x.bin").agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("n")).collect()
            )
            best = _best(rows, cuts, least_rows)
            if best is None or (score is not None and best[0] <= score + 1e-9):
                break
            score, literal, pure = best
            rule = (*rule, literal)
            if pure:
                break
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        held = left.where("fold = 0").agg(*[f(_all(p)).alias(f"{k}_{i}") for i, p in enumerate(prefixes) for k, f in zip("bg", tally, strict=True)]).first()
        worth = [((b - g) / (b + g) if b + g else -1.0, -i, b, g) for i in range(len(prefixes)) for b, g in [(held[f"b_{i}"] or 0, held[f"g_{i}"] or 0)]]
        value, at, b, g = max(worth)
        rule = prefixes[-at]
        n_bad, n_good = left.where((F.col("fold") != 0) & _all(rule)).agg(tally[0](F.lit(True)), tally[1](F.lit(True))).first()
        b, g = b + (n_bad or 0), g + (n_good or 0)
        if b < least_rows or b < least_precision * (b + g) or value < 2 * least_precision - 1:
            break
        rules.append(rule)
    return rules


def _best(rows: list, cuts: dict[str, list[float]], least_rows: int) -> tuple[float, Literal, bool] | None:
    """The literal with the largest gain: bad rows that it covers times the rise of their share's logarithm."""
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows:
        counts.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["n"])
    best = None
    for feature, by_bin in sorted(counts.items()):
        bad, n = (sum(x[k] for x in by_bin.values()) for k in (0, 1))
        if not bad or bad == n:
            continue
        low_bad = low_n = 0
        for k, threshold in enumerate(cuts[feature]):
            b, m = by_bin.get(k, (0, 0))
            low_bad, low_n = low_bad + b, low_n + m
            for above, b, m in ((False, low_bad, low_n), (True, bad - low_bad, n - low_n)):
                if b >= least_rows:
                    gain = b * (math.log2(b / m) - math.log2(bad / n))
                    if gain > 0 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Literal(feature, above, threshold, k), b == m
    return best


def conditional(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The number (from 1) of the first rule that holds, else 0, as one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, [x.on(columns) for x in rule])
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], name: str = "quality_rules", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """carry, the counts in struct `name`, and `name`_base_failed, `name`_rule (0: none holds) and `name`_kept."""
    counted = written(statistics(docs, text_col, carry, name), "statistics")
    ratios = features(name)
    known = labels.where("quality is not null").select(F.col("doc_id").alias("labelled_id"), (F.col("quality") == 0).alias("bad"))
    # rows that fail the base rule need no learned rule
    train = counted.where(~base_failed(name)).select(F.col(id_col).alias("own_id"), *[c.alias(n) for n, c in ratios.items()]).join(known, F.col("own_id") == F.col("labelled_id"))
    train = written(train.select("bad", F.pmod(F.xxhash64("own_id"), F.lit(3)).cast("int").alias("fold"), *ratios), "labelled")
    rules = learn(train, list(ratios))
    out = counted.withColumn(f"{name}_base_failed", base_failed(name)).withColumn(f"{name}_rule", conditional(rules, ratios))
    return out.withColumn(f"{name}_kept", ~F.col(f"{name}_base_failed") & (F.col(f"{name}_rule") == 0))
