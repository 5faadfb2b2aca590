"""Exact quantiles of many columns at once.

A first pass keeps one mergeable KLL sketch per column, whose error is known, and so brackets the
values in which the wanted ranks must lie.  One pass counts the rows below each bracket, and one counts
the values inside: only these few in a hundred are grouped, all columns in one tall table, and ranked
by one grouped running sum.  The number of jobs does not depend on the number of columns or quantiles.
Should a sketch ever miss by more than three times its error, the counts show it, and the column is
ranked again with wider brackets; values are exact in any case.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.operators import scale
from facsimile.operators.ordered import merged, running

#: Size of a sketch (about 100 kB), and its rank error at 99 percent.
SKETCH = 4000
ERROR = 2.296 / SKETCH ** 0.9723


def wanted_ranks(n: int, qs: Sequence[float]) -> list[int]:
    return sorted({r for q in qs for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})


def bracketed(sketches: DataFrame, names: Sequence[str], ranks: Mapping[str, Sequence[int]], sizes: Mapping[str, int], slack: float) -> dict[str, list]:
    """For each column the disjoint ranges of values that hold its wanted ranks."""
    asked: list[Column] = []
    for i, c in enumerate(names):
        shares = [min(1.0, max(0.0, (r + up) / sizes[c] + (slack if up else -slack))) for r in ranks[c] for up in (0, 1)]
        at = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
        asked.append(F.kll_sketch_get_quantile_double(F.col(f"s{i}"), at).alias(f"b{i}"))
    row = sketches.select(*asked).first()
    out = {}
    for i, c in enumerate(names):
        edges = row[f"b{i}"]
        pairs = []
        for k, r in enumerate(ranks[c]):
            lo = -math.inf if r / sizes[c] <= slack else edges[2 * k]
            hi = math.inf if (r + 1) / sizes[c] + slack >= 1 else edges[2 * k + 1]
            pairs.append((lo, hi))
        out[c] = merged(pairs)
    return out


def between(c: Column, bracket: tuple[float, float]) -> Column:
    lo, hi = (F.lit(v).cast("double") for v in bracket)
    return (c >= lo) & (c <= hi)


def order_statistics(numbers: DataFrame, brackets: Mapping[str, list], ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The values at the ``ranks`` that do lie in the columns' brackets."""
    spark, names = numbers.sparkSession, list(brackets)
    below = numbers.agg(*[F.count_if(F.col(f"`{c}`") < F.lit(lo).cast("double")).alias(f"{i}_{j}")
                          for i, c in enumerate(names) for j, (lo, _) in enumerate(brackets[c])]).first()
    parts = []
    for i, c in enumerate(names):  # a pass over each column alone, compiled; few of its rows go on
        x = F.col(f"`{c}`")
        where = F.coalesce(*[F.when(between(x, b), F.lit(j)) for j, b in enumerate(brackets[c])])
        parts.append(numbers.select(F.lit(i).alias("c"), where.alias("j"), x.alias("v")).filter("j is not null"))
    # read by several passes
    counts = scale.cut(reduce(DataFrame.unionAll, parts).groupBy("c", "j", "v").agg(F.count("*").alias("n")))
    ranked = running(counts, ["v"], sums={"upto": "n"}, by=["c", "j"])
    starts = [(i, j, r, r - below[f"{i}_{j}"]) for i, c in enumerate(names) for j in range(len(brackets[c])) for r in ranks[c]
              if r >= below[f"{i}_{j}"]]
    asked = F.broadcast(spark.createDataFrame(starts, "c int, j int, rank long, inside long"))  # a few rows per column
    found = ranked.join(asked, ["c", "j"]).filter((F.col("inside") >= F.col("upto") - F.col("n")) & (F.col("inside") < F.col("upto")))
    return {(names[r["c"]], r["rank"]): r["v"] for r in found.select("c", "rank", "v").collect()}


def exact_quantiles_of(df: DataFrame, columns: Mapping[str, Column], qs: Sequence[float]) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of every named expression; None for one without values.  Values
    that are not numbers count as infinite, as the largest ones."""
    numbers = df.select(*[F.nanvl(c.cast("double"), F.lit(float("inf"))).alias(name) for name, c in columns.items()])
    names = list(columns)
    aggregates = [F.kll_sketch_agg_double(F.col(f"`{c}`"), F.lit(SKETCH)).alias(f"s{i}") for i, c in enumerate(names)]
    row = numbers.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)], *aggregates).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(names) if row[f"n{i}"]}
    if not sizes:
        return dict.fromkeys(names)
    sketches = df.sparkSession.createDataFrame(
        [tuple(row[f"s{i}"] for i, _ in enumerate(names))], ", ".join(f"s{i} binary" for i, _ in enumerate(names)))
    sketches = sketches.select(*[F.col(f"s{names.index(c)}").alias(f"s{i}") for i, c in enumerate(sizes)])
    ranks = {c: wanted_ranks(n, qs) for c, n in sizes.items()}
    found: dict[tuple[str, int], float] = {}
    slack = 3 * ERROR
    while True:
        missing = [c for c in sizes if any((c, r) not in found for r in ranks[c])]
        if not missing:
            break
        # beyond half of all ranks a bracket holds everything
        brackets = bracketed(sketches, list(sizes), ranks, sizes, slack) if slack < 0.5 else dict.fromkeys(sizes, [(-math.inf, math.inf)])
        found |= order_statistics(numbers, {c: brackets[c] for c in missing}, ranks)
        slack *= 8
    out: dict[str, list[float] | None] = dict.fromkeys(names)
    for c, n in sizes.items():
        values = []
        for q in qs:
            h = q * (n - 1)
            a, b = found[c, math.floor(h)], found[c, math.ceil(h)]
            values.append(a + (b - a) * (h - math.floor(h)) if a != b else a)
        out[c] = values
    return out
