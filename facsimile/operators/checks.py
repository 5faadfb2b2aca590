"""Integrity checks: each one is a DataFrame of offending rows and a one-row count.

Child tables are reduced to distinct keys (with counts) before a join, so a key that holds a
third of the rows travels as one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Dataset = Mapping[str, DataFrame]


# --- counts (one row, column ``violations``) ------------------------------------------------


def count_where(df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, null_is_orphan: bool = False) -> DataFrame:
    """Child rows without a parent.  A null key counts only in the strict flavour."""
    keys = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    if not null_is_orphan:
        keys = keys.filter(F.col("k").isNotNull())
    parents = parent.select(F.col(pk).alias("k")).distinct()
    return keys.join(parents, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str, null_is_orphan: bool = False) -> DataFrame:
    """The offending rows themselves: the orphan keys are found first, then picked from the child."""
    keys = child.select(F.col(fk)).distinct()
    if not null_is_orphan:
        keys = keys.filter(F.col(fk).isNotNull())
    parents = parent.select(F.col(pk).alias(fk)).distinct()
    bad = keys.join(parents, fk, "left_anti").withColumnRenamed(fk, "__bad")
    return child.join(bad, child[fk].eqNullSafe(bad["__bad"]), "left_semi")


def childless(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    kids = child.select(F.col(fk).alias("k")).distinct()
    return (parent.select(F.col(pk).alias("k")).join(kids, "k", "left_anti")
            .agg(F.count("*").alias("violations")))


def rollup_mismatch(parent: DataFrame, pk: str, stored: Column, child: DataFrame, fk: str,
                    part: Column, total: Callable[[Column], Column] = F.sum,
                    differs: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Parents whose stored value differs from the aggregate of their children (inner: a parent
    without children is not flagged)."""
    sums = child.groupBy(F.col(fk).alias("k")).agg(total(part).alias("expected"))
    stored_df = parent.select(F.col(pk).alias("k"), stored.alias("actual"))
    differs = differs or (lambda a, b: a != b)
    return stored_df.join(sums, "k").agg(
        F.count_if(differs(F.col("actual"), F.col("expected"))).alias("violations"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """rows - distinct non-null keys, so a null key counts as a duplicate."""
    return df.agg((F.count("*") - F.count_distinct(key)).alias("violations"))


def out_of_order(child: DataFrame, fk: str, child_date: str, parent: DataFrame, pk: str,
                 parent_date: str) -> DataFrame:
    """Child rows dated before their parent.  Children collapse to (key, date) counts first."""
    days = child.groupBy(F.col(fk).alias("k"), F.col(child_date).alias("d")).agg(F.count("*").alias("n"))
    start = parent.select(F.col(pk).alias("k"), F.col(parent_date).alias("s"))
    late = days.join(start, "k").filter(F.col("d") < F.col("s"))
    return late.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


# --- named checks --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A label, the tables it needs, and a function that returns one row with ``violations``."""

    label: str
    tables: tuple[str, ...]
    count: Callable[[Dataset], DataFrame]
    severity: str = "error"
    rows: Callable[[Dataset], DataFrame] | None = field(default=None, compare=False)
    bad: Callable[[], Column] | None = field(default=None, compare=False)


def row_check(label: str, table: str, bad: Callable[[], Column], severity: str = "error") -> Check:
    """A check on single rows; ``prove`` counts all of a table's row checks in one pass."""
    return Check(label, (table,), lambda t: count_where(t[table], bad()), severity,
                 lambda t: t[table].filter(bad()), bad)


def fk_check(child: str, fk: str, parent: str, pk: str, strict: bool = False, label: str | None = None) -> Check:
    return Check(
        label or f"{child}.{fk} has no matching {parent}.{pk}", (child, parent),
        lambda t: orphans(t[child], fk, t[parent], pk, strict),
        rows=lambda t: orphan_rows(t[child], fk, t[parent], pk, strict))


def retail_checks() -> list[Check]:
    c = F.col
    return [
        fk_check("orders", "customer_id", "customers", "customer_id", True, "orders: customer unknown"),
        fk_check("order_items", "order_id", "orders", "order_id", True, "order_items: order unknown"),
        fk_check("order_items", "sku", "products", "sku", True, "order_items: product unknown"),
        Check("orders: subtotal is not what the lines add up to", ("orders", "order_items"),
              lambda t: rollup_mismatch(t["orders"], "order_id", c("subtotal"), t["order_items"],
                                        "order_id", c("line_total"))),
        row_check("orders: total is not subtotal less discount plus tax", "orders",
                  lambda: c("total") != c("subtotal") - c("discount") + c("tax")),
        row_check("order_items: line_total is not quantity times price", "order_items",
                  lambda: c("line_total") != c("quantity") * c("unit_price")),
        Check("orders: older than the customer's signup", ("orders", "customers"),
              lambda t: out_of_order(t["orders"], "customer_id", "order_date", t["customers"],
                                     "customer_id", "signup_date")),
        Check("orders: without lines", ("orders", "order_items"),
              lambda t: childless(t["orders"], "order_id", t["order_items"], "order_id")),
        Check("customers: repeated id", ("customers",), lambda t: duplicate_keys(t["customers"], "customer_id")),
        Check("orders: repeated id", ("orders",), lambda t: duplicate_keys(t["orders"], "order_id")),
        Check("order_items: repeated id", ("order_items",), lambda t: duplicate_keys(t["order_items"], "item_id")),
        row_check("orders: total below zero", "orders", lambda: c("total") < 0),
    ]


def fintech_checks() -> list[Check]:
    return [
        fk_check("transactions", "account_id", "accounts", "account_id", True,
                 "transactions: account unknown"),
        fk_check("cards", "account_id", "accounts", "account_id", True, "cards: account unknown"),
        fk_check("transactions", "merchant_id", "merchants", "merchant_id", True,
                 "transactions: merchant unknown"),
    ]


def link_checks(links: Sequence[tuple[str, str, str, str]]) -> list[Check]:
    """One nullable orphan check per (child, fk, parent, pk) link."""
    return [fk_check(*link) for link in links]


def contract_checks(constraints: Sequence[tuple[str, str, str]]) -> list[Check]:
    """PK / NOT NULL / UNIQUE constraints given as (table, column, rule)."""
    out = []
    for table, col, rule in constraints:
        if rule in ("primary_key", "unique"):
            # SQL UNIQUE ignores nulls; a primary key does not
            fn = (lambda t, table=table, col=col: duplicate_keys(t[table], col)) if rule == "primary_key" else (
                lambda t, table=table, col=col: duplicate_keys(t[table].filter(F.col(col).isNotNull()), col))
        elif rule == "not_null":
            out.append(row_check(f"{table}.{col} {rule}", table, lambda col=col: F.col(col).isNull()))
            continue
        else:
            raise ValueError(f"unknown constraint {rule!r}")
        out.append(Check(f"{table}.{col} {rule}", (table,), fn))
    return out


def prove(tables: Dataset, checks: Sequence[Check], spark: SparkSession | None = None) -> DataFrame:
    """Run every check whose tables are present: (check, violations, passed, error).

    A check that can't be planned, or fails while it runs, reports -1 and the error instead of
    stopping the proof: the row checks of a table run together, and one by one only if that fails.
    """
    spark = spark or next(iter(tables.values())).sparkSession
    schema = "check string, violations bigint, passed boolean, error string"
    todo = [c for c in checks if all(t in tables for t in c.tables)]
    rows: list[tuple] = []

    def settle(label: str, counts: Callable[[], DataFrame]) -> None:
        try:
            n = counts().first()[0]
            rows.append((label, int(n), n == 0, None))
        except Exception as e:  # noqa: BLE001 - the failure is the result
            rows.append((label, -1, False, str(e).split("\n")[0]))

    for table in dict.fromkeys(c.tables[0] for c in todo if c.bad):
        fitting = [c for c in todo if c.bad and c.tables[0] == table]
        try:
            counted = tables[table].agg(*[F.count_if(c.bad()).alias(f"v{i}") for i, c in enumerate(fitting)]).first()
            rows += [(c.label, counted[i], counted[i] == 0, None) for i, c in enumerate(fitting)]
        except Exception:  # noqa: BLE001 - one of them fails: each for itself
            for chk in fitting:
                settle(chk.label, lambda chk=chk: tables[table].agg(F.count_if(chk.bad())))
    for chk in (c for c in todo if not c.bad):
        settle(chk.label, lambda chk=chk: chk.count(tables).select(F.col("violations").cast("bigint")))
    return spark.createDataFrame(rows, schema)


def table_stats(tables: Dataset) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- business rules --------------------------------------------------------------------------------


def row_rule(rule_id: str, table: str, expr: str, severity: str = "error") -> Check:
    """``expr`` must hold for every row; a null outcome counts as a violation."""
    return row_check(rule_id, table, lambda: ~F.coalesce(F.expr(expr), F.lit(False)), severity)


ROLLUPS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def rollup_rule(rule_id: str, parent: str, pk: str, stored: str, child: str, fk: str, part: str,
                operation: str = "sum", severity: str = "error") -> Check:
    return Check(rule_id, (parent, child),
                 lambda t: rollup_mismatch(t[parent], pk, F.col(stored), t[child], fk, F.col(part),
                                           ROLLUPS[operation]), severity)


def ref_rule(rule_id: str, child: str, fk: str, parent: str, pk: str, severity: str = "error") -> Check:
    base = fk_check(child, fk, parent, pk, True)
    return Check(rule_id, base.tables, base.count, severity, base.rows)


def run_rules(tables: Dataset, rules: Sequence[Check]) -> DataFrame:
    out = prove(tables, rules)
    sev = {r.label: r.severity for r in rules}
    mapping = F.create_map(*[x for k, v in sev.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("severity", F.element_at(mapping, F.col("check")))


ROLLUP_RULE = re.compile(r"(\w+)\.(\w+) == (sum|count|min|max|avg)\((\w+)\.(\w+) by (\w+)\)")
REF_RULE = re.compile(r"(\w+)\.(\w+) in (\w+)\.(\w+)")


def declared_rules(rules: Sequence, keys: Mapping[str, str]) -> list[Check]:
    """A contract's rules as checks.  ``t.x == sum(c.y by k)`` compares a stored roll-up, ``c.k in p.k``
    looks a reference up, anything else is a condition over the rows of one table, whose name its
    columns carry.  ``keys`` names each table's key."""
    out = []
    for r in rules:
        if m := ROLLUP_RULE.fullmatch(r.expr):
            parent, stored, operation, child, part, fk = m.groups()
            out.append(rollup_rule(r.id, parent, keys[parent], stored, child, fk, part, operation, r.severity))
        elif m := REF_RULE.fullmatch(r.expr):
            out.append(ref_rule(r.id, *m.groups(), r.severity))
        else:
            table = next((t for t in keys if re.search(rf"\b{t}\.", r.expr)), None)
            if table is None:
                raise ValueError(f"rule {r.id} names no table")
            out.append(row_rule(r.id, table, re.sub(rf"\b{table}\.(\w+)", r"`\1`", r.expr), r.severity))
    return out
