"""Declared column strategies as ordinary column or table expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions import keyed, money
from facsimile.operators import ordered
from facsimile.sources import locales

ROW_STRATEGIES = ("sequence", "categorical", "numeric")
TABLE_STRATEGIES = ("derived", "formula", "rollup", "tax", "conditional")


def sequence(index: Column, start: int = 1, prefix: str = "", zero_pad: int = 0) -> Column:
    """``index`` counts from 0."""
    no = index + F.lit(start)
    if not prefix and not zero_pad:
        return no
    return ordered.format_id(no, prefix, zero_pad)


def gamma_grid(shape: float, points: int = 1001) -> list[float]:
    """Quantiles of the unit-scale gamma on an even grid, by bisection on its series CDF."""

    def cdf(x: float) -> float:
        term = total = 1.0 / shape
        k = 1
        while k < 2000 and term > total * 1e-15:
            term *= x / (shape + k)
            total += term
            k += 1
        return min(1.0, total * math.exp(-x + shape * math.log(x) - math.lgamma(shape))) if x > 0 else 0.0

    out, lo = [0.0], 0.0
    top = shape + 12 * math.sqrt(shape) + 12
    for i in range(1, points):
        p = min(i / (points - 1), 0.9999)
        a, b = lo, top
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if cdf(m) < p else (a, m)
        lo = (a + b) / 2
        out.append(lo)
    return out


def interpolate(grid: Sequence[float], u: Column) -> Column:
    """Value of an even quantile grid at u in [0, 1]."""
    arr = keyed.literal_array([float(g) for g in grid])
    at = u * F.lit(float(len(grid) - 1))
    i = F.least(F.floor(at), F.lit(len(grid) - 2)).cast("int")
    lo, hi = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
    return lo + (hi - lo) * (at - i)


def numeric(u: Column, u2: Column, distribution: str = "empirical", mean: float = 0.0, std: float = 1.0,
            shape: float = 2.0, low: float = 0.0, high: float = 1.0, grid: Sequence[float] | None = None) -> Column:
    if distribution == "normal":
        return keyed.normal(u, u2, mean, std)
    if distribution == "lognormal":
        return F.exp(keyed.normal(u, u2, mean, std))
    if distribution == "uniform":
        return keyed.uniform_num(u, low, high)
    if distribution == "gamma":
        return interpolate(gamma_grid(shape), u) * F.lit(mean / shape)
    if distribution == "empirical":
        return interpolate(grid or [low, high], u)
    raise ValueError(f"unknown distribution {distribution!r}")


def row_value(s: Mapping[str, Any], index: Column, u: Column, u2: Column) -> Column:
    args = {k: v for k, v in s.items() if k != "kind"}
    if s["kind"] == "sequence":
        return sequence(index, **args)
    if s["kind"] == "categorical":
        return keyed.weighted_choice(u, args["weights"])
    return numeric(u, u2, **args)


def derived(source: str, template: str = "{value}", domain: str = "example.com") -> Column:
    """``{value}`` is the source value and ``{domain}`` the domain."""
    parts = re.split(r"(\{value\}|\{domain\})", template)
    cols = [F.col(source).cast("string") if p == "{value}" else F.lit(domain if p == "{domain}" else p)
            for p in parts if p]
    return F.concat(*cols)


def formula(df: DataFrame, expr: str) -> Column:
    """Arithmetic over columns of the table; any other name is refused before Spark sees it."""
    names = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", expr))
    unknown = names - set(df.columns)
    if unknown:
        raise ValueError(f"formula uses unknown name(s) {sorted(unknown)}")
    if not re.fullmatch(r"[\w\s.+\-*/%()]*", expr):
        raise ValueError("formula may hold only names, numbers and arithmetic")
    return F.expr(expr)


ROLLUPS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def rollup(parent: DataFrame, key: str, child: DataFrame, fk: str, column: str, out: str,
           operation: str = "sum") -> DataFrame:
    """Aggregate of the children per parent; sum and count of no children are 0."""
    agg = child.groupBy(F.col(fk).alias(key)).agg(ROLLUPS[operation](column).alias(out))
    res = parent.join(agg, key, "left")
    return res.withColumn(out, F.coalesce(out, F.lit(0))) if operation in ("sum", "count") else res


def tax_amount(base: Column | str, rate: str, inclusive: bool = False) -> Column:
    """Tax on a base in minor units; an inclusive base already holds its tax."""
    b = F.col(base) if isinstance(base, str) else base
    if not inclusive:
        return money.pct_of(b, rate)
    net = F.bround(b.cast("decimal(20,0)") / (F.lit(1) + F.lit(rate).cast("decimal(12,8)")).cast("decimal(13,8)"), 0)
    return b.cast("bigint") - net.cast("bigint")


def locale_tax(df: DataFrame, base: str, out: str, locale: str) -> DataFrame:
    """Sum of a locale's tax rules on one column."""
    total = None
    for rule in locales.pack(locale)["tax_rules"]:
        t = tax_amount(base, rule["rate"], rule["inclusive"])
        total = t if total is None else total + t
    return df.withColumn(out, total)


def conditional(depends_on: str, mapping: Mapping[str, Any], default: Any = None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(F.col(depends_on).cast("string") == str(k), F.lit(v)).otherwise(out)
    return out


def table_value(df: DataFrame, name: str, s: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    kind = s["kind"]
    if kind == "derived":
        return df.withColumn(name, derived(s["from_column"], s.get("template", "{value}"), s.get("domain", "example.com")))
    if kind == "formula":
        return df.withColumn(name, formula(df, s["expr"]))
    if kind == "tax":
        return locale_tax(df, s.get("base_column", "subtotal"), name, s.get("locale", locales.DEFAULT))
    if kind == "conditional":
        return df.withColumn(name, conditional(s["depends_on"], s["mapping"]))
    child = tables.get(s["source_table"])
    if child is None:
        raise ValueError(f"rollup source {s['source_table']!r} is not generated yet")
    return rollup(df.drop(name), s["key"], child, s["group_by"], s["source_column"], name, s.get("operation", "sum"))


# --- missingness ---------------------------------------------------------------------------------


def missing_rate(rate: float, mechanism: str = "MCAR", position: Column | None = None) -> Column:
    """Chance that a value goes missing.

    MCAR is constant.  MAR and MNAR grow linearly with ``position`` in [0, 1] (where the driver, or
    the value itself, lies between its smallest and largest value) and keep the mean near ``rate``.
    """
    if mechanism == "MCAR" or position is None:
        return F.lit(float(rate))
    return F.least(F.lit(2.0 * rate) * F.coalesce(position, F.lit(0.5)), F.lit(1.0))


def position_in_range(c: Column, low: float, high: float) -> Column:
    span = high - low
    return (c.try_cast("double") - F.lit(low)) / F.lit(span) if span else F.lit(0.5)


def many_to_many(left: DataFrame, left_key: str, right: DataFrame, right_key: str, seed: int,
                 cuts_left: Sequence[float], top: int | None = None) -> DataFrame:
    """Join table: each left key meets as many different right keys as drawn (all, if that is more
    than there are).  The right keys are numbered, and a left key takes every ``stride``-th from a
    drawn start on, around the end; strides share no factor with the count, so nothing repeats."""
    from facsimile.operators import domains

    drawn = keyed.draw_count(keyed.uniform(seed, "degree", left_key, key=left_key), cuts_left, top=top)
    numbered = ordered.dense_ids(right.select(right_key).distinct(), [right_key], start=0, name="__no")
    size = numbered.count()
    if not size:
        return left.select(left_key).join(numbered.select(right_key).limit(0), F.lit(True))
    stubs = domains.fan_out(left.select(left_key), F.least(drawn, F.lit(size)).cast("int"))
    start = F.floor(keyed.uniform(seed, "start", key=left_key) * F.lit(float(size))).cast("bigint")
    stride = keyed.choice(keyed.uniform(seed, "stride", key=left_key), strides(size))
    at = F.pmod(start + (F.col("seq") - 1).cast("bigint") * stride.cast("bigint"), F.lit(size)).cast("bigint")
    return stubs.select(left_key, at.alias("__no")).join(numbered.withColumn("__no", F.col("__no").cast("bigint")), "__no") \
        .select(left_key, right_key)


def strides(size: int, most: int = 64) -> list[int]:
    """Up to ``most`` numbers without a common factor with ``size``, spread over it."""
    out, step = [], max(1, size // most)
    for k in range(1, size + 1, step):
        while math.gcd(k, size) != 1:
            k += 1
        out.append(k % size if size > 1 else 0)
    return sorted(set(out))[:most]

