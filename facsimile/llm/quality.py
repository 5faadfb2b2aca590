"""Quality rules: a learned decision list over document statistics, in column expressions only.

Statistics of every whole text are native expressions.  Sequential covering learns, from all labelled
documents, an ordered list of threshold conjunctions that reject: a rule grows by the condition of
the highest information gain on two thirds of the labelled rows, is pruned to its best prefix on the
other third, and what it covers is taken away before the next rule grows.  Every step is one grouped
count over the narrow table of labelled statistics; only counts per (feature, threshold, label)
reach the driver.  The list becomes one ordered conditional expression.

Null or empty texts have no words and fail the base rule.  Null labels are left out; a document with
several labels counts as bad if most of them are; without usable labels the list is empty and the
base rule alone decides.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.store import keep, typed
from facsimile.llm.words import SPACE

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Thresholds tried for each feature.
SHARES = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0]
GRID = {
    "words": [5.0, 10.0, 20.0, 30.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 50000.0],
    "word_length": [2.0 + 0.25 * k for k in range(41)],
    "symbol_share": SHARES, "mark_share": SHARES, "stop_share": SHARES,
    "dup_line_share": SHARES, "repeat_share": SHARES, "distinct_share": SHARES,
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def count_of(text: str, characters: str) -> Column:
    """Occurrences of any of ``characters``."""
    left = [F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in characters]
    return sum(left[1:], left[0]).cast("long")


def pair_hashes(apart: int):
    """Combines each hash of an array with the one ``apart`` places on (null beyond the end)."""
    return lambda hashes: F.zip_with(hashes, F.slice(hashes, F.lit(apart + 1), F.greatest(F.size(hashes), F.lit(1))),
                                     lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column, width: int = 8) -> Column:
    """Hashes of all windows of ``width`` (a power of two) words, by doubling."""
    hashes, size = F.transform(words, lambda w: F.xxhash64(w)), 1
    while size < width:
        hashes = let(hashes, pair_hashes(size))
        size *= 2
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def covered_words(hashes: Column, width: int = 8) -> Column:
    """Words that lie in a window whose hash occurs more than once."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) \
            | ((j < last) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"]))
        return F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: F.get(s, j)["i"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-width).alias("last"))
    step = lambda a, x: F.struct((a["total"] + F.least(F.lit(width), x - a["last"])).alias("total"), x.alias("last"))
    return F.aggregate(F.array_sort(let(ordered, starts)), begin, step, lambda a: a["total"])


def statistics(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """``carried`` and the statistics of each row of ``docs``, of its column ``text``."""
    rows = docs.select(carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    repeated = let(window_hashes(F.col("words")), lambda h: F.when(
        F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long")).otherwise(covered_words(h)))
    return rows.withColumn("words", words).select(
        carried, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of("text", SYMBOLS).alias("n_symbols"), count_of("text", "!?").alias("n_marks"), count_of("text", ".").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        F.when(F.size("words") < 8, F.lit(0).cast("long")).otherwise(repeated).alias("n_repeat_words")) \
        .select("*", "lines.*").drop("lines")


def features() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {"words": F.col("n_words").cast("double"), "word_length": per_word("word_chars"), "symbol_share": per_word("n_symbols"),
            "mark_share": per_word("n_marks"), "stop_share": per_word("n_stops"),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": per_word("n_repeat_words"), "distinct_share": per_word("n_distinct")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def best_condition(rows: DataFrame, refused: set[Condition], least_rows: int) -> tuple[Condition, float] | None:
    """The condition with the highest gain on ``rows``, and the share of bad rows it leaves."""
    cells = [F.struct(F.lit(name).alias("feature"),
                      sum(((F.col(f"f_{name}") > t).cast("int") for t in grid), F.lit(0)).alias("cell")) for name, grid in GRID.items()]
    counts = rows.select("bad", F.explode(F.array(*cells)).alias("at")).groupBy("at.feature", "at.cell") \
        .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("all")).collect()
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        found.setdefault(r["feature"], {})[r["cell"]] = (r["bad"], r["all"])
    best = None
    for name in sorted(found):
        bad, every = (sum(v[k] for v in found[name].values()) for k in (0, 1))
        if bad == 0 or bad == every:
            return None
        before = math.log2(bad / every)
        low_bad = low_all = 0
        for cell, threshold in enumerate(GRID[name]):  # cell k: above k thresholds
            b, a = found[name].get(cell, (0, 0))
            low_bad, low_all = low_bad + b, low_all + a
            for above, b, a in ((False, low_bad, low_all), (True, bad - low_bad, every - low_all)):
                if b and least_rows <= a < every and Condition(name, above, threshold) not in refused:
                    gain = b * (math.log2(b / a) - before)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, threshold), b / a)
    return best and (best[1], best[2])


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.95,
          least_rows: int = 5, max_refused: int = 4) -> list[Rule]:
    """Sequential covering over ``labelled`` (statistics and ``bad``).  A rule is taken if, on the
    pruning third, at least ``least_precision`` of what it covers is bad, or, where the third holds
    none of its rows, if that holds for at least ``least_rows`` growing rows.  A rule that fails is not
    started with its first condition again; after ``max_refused`` failures in a row learning ends."""
    shown = labelled.select("*", *[c.alias(f"f_{n}") for n, c in features().items()],
                            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"))
    rules: list[Rule] = []
    refused: set[Condition] = set()
    left = shown
    while len(rules) < max_rules and len(refused) < max_refused:
        grown: list[Condition] = []
        rest = left.where(~F.col("pruning"))
        while len(grown) < max_conditions:
            step = best_condition(rest, set() if grown else refused, least_rows)
            if step is None:
                break
            grown.append(step[0])
            rest = rest.where(step[0].column())
            if step[1] >= 0.999:
                break
        if not grown:
            break
        prefixes = [Rule(tuple(grown[:k])) for k in range(1, len(grown) + 1)]
        sums = [F.sum((r.column() & (F.col("pruning") == third) & (F.col("bad") == bad)).cast("long"))
                for r in prefixes for third in (True, False) for bad in (True, False)]
        got = [v or 0 for v in left.agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)]).first()]
        scored = []
        for k, rule in enumerate(prefixes):
            p, n, grow_p, grow_n = got[4 * k:4 * k + 4]
            if p + n:
                scored.append(((p - n) / (p + n), p, rule, p / (p + n)))
            elif grow_p + grow_n >= least_rows:
                scored.append(((grow_p - grow_n) / (grow_p + grow_n), 0, rule, grow_p / (grow_p + grow_n)))
        best = max(scored, key=lambda x: x[:2], default=None)
        if best is None or best[3] < least_precision:
            refused.add(grown[0])
            continue
        rules.append(best[2])
        refused.clear()
        left = left.where(~best[2].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the number of the first rule that rejects, or null."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(k))
    return out.cast("int")


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    marks = typed(labels, doc_id="long", quality="double").dropna().groupBy("doc_id") \
        .agg((F.avg("quality") < 0.5).alias("bad"))
    return keep(stats.join(marks, "doc_id"), "quality-labelled")


def judge(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """One row per row of ``docs``: the statistics, base_failed, rule (number of the learned rule
    that rejects, or null) and kept."""
    stats = keep(statistics(typed(docs, doc_id="long", text="string")), "quality-statistics")
    return stats.withColumns({"base_failed": F.expr(BASE_FAILED), "rule": verdict(learn(labelled_statistics(stats, labels), **learning))}) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def passing(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    labelled = typed(docs, doc_id="long", text="string").join(typed(labels, doc_id="long").distinct(), "doc_id", "left_semi")
    rules = learn(labelled_statistics(statistics(labelled), labels), **learning)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return statistics(rows, "row").where(~F.expr(BASE_FAILED) & verdict(rules).isNull()).select("row.*")
