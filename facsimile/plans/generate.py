"""Contract-driven generation: one expression per column, then foreign keys from the parents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.functions.fictional import fictional
from facsimile.operators import degrade, domains, ordered, strategies
from facsimile.plans.contract import Column, Contract, Outliers, Relationship, Table

FIRST_ID = 10_001  # fixed value: where id sequences start unless the contract says otherwise
DEFAULT_START, DEFAULT_END = "2023-01-01", "2025-12-31"


def _plain_value(c: Column, table: str, seed: int, locale: str) -> SparkColumn:
    u = keyed.uniform(seed, "contract", table, c.name, key="row_no")
    u2 = keyed.uniform(seed, "contract", table, c.name, key="row_no", lane=1)
    if c.strategy and c.strategy.get("kind") in strategies.ROW_STRATEGIES:
        return strategies.row_value(c.strategy, F.col("row_no"), u, u2)
    if c.kind in ("id", "fk"):
        first = int(c.start) if isinstance(c.start, int) else FIRST_ID
        no = F.col("row_no") + F.lit(first)
        return ordered.format_id(no, f"{c.name}-", 6) if c.text_key else no
    if c.kind == "cat" and c.weights:
        return keyed.weighted_choice(u, c.weights)
    if c.kind == "bool":
        return u < F.lit(float(c.true_rate))
    if c.kind in ("int", "num", "money"):
        lo, hi = keyed.default_range(c.name)
        lo = lo if c.minimum is None else float(c.minimum)
        hi = hi if c.maximum is None else float(c.maximum)
        return keyed.uniform_num(u, lo, hi, integral=c.kind != "num")
    return fictional(c.name, F.col("row_no"), seed, locale)


def synthesize_from_contract(spark: SparkSession, table: Table, n: int | None = None, seed: int = 42,
                             locale: str = "us", keep_row_no: bool = False, given: DataFrame | None = None) -> DataFrame:
    """Rows of one table from its contract alone; no sample is needed.

    ``given`` may bring the rows: a number ``row_no`` each, from which all draws are keyed, and any of
    the table's columns, which are then taken over instead of drawn."""
    n = table.rows if n is None else n
    ready = [c.name for c in table.columns if given is not None and c.name in given.columns]
    df = given.select("row_no", *[F.col(f"`{c}`").alias(f"__given_{c}") for c in ready]) if given is not None \
        else spark.range(n).withColumnRenamed("id", "row_no")
    dates = [c for c in table.columns if c.name not in ready and c.kind in ("date", "datetime") and not (
        c.strategy and c.strategy.get("kind") in strategies.ROW_STRATEGIES)]
    for c in dates:
        s = c.strategy or {}
        u = keyed.uniform(seed, "contract", table.name, c.name, key="row_no")
        df = domains.weighted_dates(
            df, u, s.get("start") or (c.start if isinstance(c.start, str) else DEFAULT_START),
            s.get("end") or c.end or DEFAULT_END, c.name, s.get("weekday_weights") or domains.WEEKDAY_WEIGHTS,
            s.get("seasonality", "retail"))
    out = []
    for c in table.columns:
        if c.name in ready:
            out.append(F.col(f"__given_{c.name}").alias(c.name))
            continue
        if c in dates:
            v = F.col(c.name) if c.kind == "date" else F.col(c.name).cast("timestamp_ntz")
        else:
            v = _plain_value(c, table.name, seed, locale)
        if c.null_rate > 0 and c.kind != "id":
            gone = keyed.uniform(seed, "contract", table.name, c.name, "null", key="row_no") < F.lit(c.null_rate)
            v = F.when(~gone, v)
        out.append(v.alias(c.name))
    return df.select(*out, *(["row_no"] if keep_row_no else []))


def children(parent: DataFrame, parent_key: str, rel: Relationship, fk: str, seed: int) -> DataFrame:
    """Rows of a child table as its relationship declares: per parent a drawn number of children, as
    (row_no, fk).  1:1 gives each parent one child."""
    if rel.cardinality == "1:1":
        rows = parent.select(F.col(parent_key).alias(fk), F.lit(1).alias("n"))
    else:
        cuts = keyed.count_cuts(rel.dist, mean=rel.mean_children, dispersion=rel.dispersion, top=rel.max_children, low=rel.min_children)
        u = keyed.uniform(seed, "children", rel.parent, rel.child, key=parent_key)
        n = keyed.draw_count(u, cuts, rel.min_children, rel.max_children)
        rows = parent.select(F.col(parent_key).alias(fk), n.alias("n"))
    placed = ordered.running(rows.withColumn("n", F.col("n").cast("bigint")), [fk], sums={"upto": "n"})
    return domains.fan_out(placed, F.col("n").cast("int")).select((F.col("upto") - F.col("n") + F.col("seq") - 1).alias("row_no"), fk)


def with_missing(df: DataFrame, table: Table, keep: set[str], seed: int) -> DataFrame:
    """The table's declared missingness: each value goes with its column's rate; under MAR the chance
    grows with the driver column, under MNAR with the value itself."""
    m = table.missing
    rates = {c.name: m.per_column.get(c.name, m.default_rate) for c in table.columns if c.name not in keep and c.kind != "id"}
    rates = {c: r for c, r in rates.items() if r > 0}
    if not rates:
        return df
    where = {c: m.driver if m.mechanism == "MAR" else c for c in rates} if m.mechanism != "MCAR" else {}
    numbers = {d: F.col(f"`{d}`").try_cast("double") for d in set(where.values()) - {None} if d in df.columns}
    ends = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(numbers.values()) for k, f in (("lo", F.min), ("hi", F.max))]).first() \
        if numbers else None
    position = {d: strategies.position_in_range(v, ends[f"lo{i}"], ends[f"hi{i}"]) if ends[f"lo{i}"] is not None else None
                for i, (d, v) in enumerate(numbers.items())}
    out = {}
    for c, rate in rates.items():
        u = keyed.uniform(seed, "missing", table.name, c, key="row_no")
        out[c] = F.when(u >= strategies.missing_rate(rate, m.mechanism, position.get(where.get(c))), F.col(f"`{c}`"))
    return df.withColumns(out)


def generate_from_contract(spark: SparkSession, contract: Contract, rows: Mapping[str, int] | None = None,
                           seed: int = 42, locale: str | None = None, given: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every table of a contract, parents first.

    A table's rows are ``given``, or counted in ``rows``, or fan out from the parent of its first
    declared relationship, or number as many as the contract says.  Other foreign keys are drawn from
    their parents' keys; an N:N relationship makes its child the join table of its two parents' keys.
    Declared missing values and outliers come last."""
    rows, given = dict(rows or {}), dict(given or {})
    links = contract.links()
    out: dict[str, DataFrame] = {}
    for name in contract.dependency_order():
        table = contract.table(name)
        mine = [link for link in links if link[0] == name and link[2] != name]
        made = given.get(name)
        if made is None and name not in rows:
            for rel in contract.relationships:
                link = next((x for x in mine if rel.child == name and rel.parent == x[2] and rel.child_key in ("", x[1])), None)
                if link:
                    made = children(out[link[2]], link[3], rel, link[1], seed)
                    if rel.cardinality == "N:N" and len(mine) > 1:
                        other = next(x for x in mine if x != link)
                        cuts = keyed.count_cuts(rel.dist, mean=rel.mean_children, dispersion=rel.dispersion, top=rel.max_children,
                                                low=rel.min_children)
                        a, b = (out[x[2]].select(F.col(x[3]).alias(x[1])) for x in (link, other))
                        pairs = strategies.many_to_many(a, link[1], b, other[1], seed, cuts, rel.max_children)
                        made = ordered.dense_ids(pairs, [link[1], other[1]], start=0, name="row_no")
                    break
        df = synthesize_from_contract(spark, table, rows.get(name, table.rows), seed, locale or contract.locale, True, made)
        for _, fk, parent, key in mine:
            if made is not None and fk in made.columns:
                continue
            u = keyed.uniform(seed, "fk", name, fk, key="row_no")
            df = domains.fk_sample(df.drop(fk), u, out[parent], key, fk)
            nulls = table.column(fk).null_rate
            if nulls > 0:
                gone = keyed.uniform(seed, "contract", name, fk, "null", key="row_no") < F.lit(nulls)
                df = df.withColumn(fk, F.when(~gone, F.col(fk)))
        keys = {link[1] for link in mine} | {table.key}
        df = with_missing(df, table, keys, seed)
        if table.outliers.rate > 0 and table.outliers != Outliers():
            kinds = {c.name: c.kind for c in table.columns if c.name not in keys}
            df, _ = degrade.inject_outliers(df, kinds, table.outliers.rate, "row_no", table.outliers.method, seed, table.outliers.factor)
        out[name] = df.select(*[c.name for c in table.columns])
    for name in reversed(contract.dependency_order()):  # children first, so parents can roll them up
        table = contract.table(name)
        for c in table.columns:
            if c.strategy and c.strategy.get("kind") in strategies.TABLE_STRATEGIES:
                s = {"key": table.key, **c.strategy}
                out[name] = strategies.table_value(out[name], c.name, s, out).select(*[x.name for x in table.columns])
    return out


def preview(spark: SparkSession, contract: Contract, n: int = 50, seed: int = 42,
            given: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A few rows per table, without links or exports; of given rows the first by number."""
    given = given or {}
    return {t.name: synthesize_from_contract(spark, t, min(n, t.rows), seed, contract.locale, given=given[t.name].orderBy("row_no").limit(n)
                                             if t.name in given else None) for t in contract.tables}
