"""Primary- and foreign-key detection from values and names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators import profile as pf

KEY_NAMES = ("id", "pk", "key")


def key_scores(df: DataFrame, cols: Sequence[str] | None = None, unique: DataFrame | None = None) -> DataFrame:
    """Score of every column that is at least 95 % unique.

    ``sequential_rate`` is the share of neighbours in sorted order that differ by exactly 1.  Nothing is
    sorted: such neighbours are the largest value of one whole-number cell and the smallest of the next.
    """
    cols = list(cols or pf.scalar_columns(df))
    fams = {f.name: pf.family(f.dataType) for f in df.schema.fields}
    facts = pf.one_row_per_column(df, {c: f"struct(count(`{c}`) as n)" for c in cols})
    facts = facts.join(F.broadcast(unique if unique is not None else pf.distinct_profile(df, cols)), "column")  # one row per column
    rows = [r for r in facts.collect() if r["n"] > 0 and r["n_unique"] / r["n"] >= 0.95]
    spark = df.sparkSession
    schema = "column string, position int, uniqueness double, sequential_rate double, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    numeric = [r["column"] for r in rows if fams[r["column"]] == "numeric"]
    step = {}
    if numeric:
        parts = []
        for c in numeric:
            exact = isinstance(df.schema[c].dataType, T.IntegralType)  # a cell is one value: only its place counts
            v = F.lit(0.0) if exact else F.col(f"`{c}`").cast("double")
            cell = F.col(f"`{c}`").cast("decimal(38,0)") if exact else F.floor(v).cast("double").try_cast("decimal(38,0)")
            parts.append(df.select(F.lit(c).alias("column"), cell.alias("cell"), v.alias("v"),
                                   F.lit(1.0 if exact else 0.0).alias("up")).filter("cell is not null"))
        cells = reduce(DataFrame.unionAll, parts).groupBy("column", "cell", "up").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        ends = cells.select("column", F.explode(F.array(
            F.struct("cell", F.col("hi").alias("hi"), F.lit(None).cast("double").alias("lo")),
            F.struct((F.col("cell") - 1).cast("decimal(38,0)").alias("cell"), F.lit(None).cast("double").alias("hi"),
                     (F.col("lo") + F.col("up")).alias("lo")))).alias("e"))
        met = ends.groupBy("column", "e.cell").agg((F.max("e.lo") - F.max("e.hi") == 1).cast("long").alias("hit"))
        step = {r["column"]: r["s"] or 0 for r in met.groupBy("column").agg(F.sum("hit").alias("s")).collect()}
    out = []
    for r in rows:
        c, uniq = r["column"], r["n_unique"] / r["n"]
        rate = step.get(c, 0) / (r["n"] - 1) if c in step and r["n"] > 1 else 0.0
        score = uniq + (0.5 if pf.ID_NAME.search(c) else 0.0)
        if fams[c] == "numeric":
            score += 0.1 + (0.3 if rate > 0.9 else 0.0)
        if c.lower() in KEY_NAMES:
            score += 0.4
        out.append((c, r["position"], uniq, rate, score))
    return spark.createDataFrame(out, schema)


def detect_primary_key(df: DataFrame, cols: Sequence[str] | None = None,
                       unique: DataFrame | None = None) -> str | None:
    """The best-scoring column; the earliest one on ties."""
    best = key_scores(df, cols, unique).collect()
    return min(best, key=lambda r: (-round(r["score"], 9), r["position"]))["column"] if best else None


def name_similar(column: str, table: str) -> bool:
    c, t = column.lower(), table.lower()
    return c.replace("_id", "") in t or t.replace("s", "") in c


#: Values of the longest table that the shared sample holds, about.
SAMPLED = 65_536
#: Containment that is reported at all, and how sure a discard must be (one pair in so many is wrong).
LEAST_CONTAINMENT, SURE = 0.8, 1e9


def texts_of(df: DataFrame, column: str) -> Column:
    return pf.brief(F.col(f"`{column}`").cast("string"))


def possible_pairs(children: Sequence[tuple[str, str]], parents: Mapping[str, str], tables: Mapping[str, DataFrame],
                   sampled: int = SAMPLED) -> list[tuple[str, str, str]]:
    """The (table, column, parent) that may reach the least containment.

    All columns share one threshold on the hash of a value, so that a value is in the sample of every
    column that has it, as in theta sketches of one theta.  What share of a column's sample a key holds
    estimates the containment, and Hoeffding's bound says how far it can be off.  Only the sample is
    shuffled; a column with few sampled values is never discarded, and costs as little afterwards.
    """
    rows = max((df.count() for df in tables.values()), default=0)
    share = min(1.0, sampled / max(rows, 1))
    bound = F.lit(int(share * (1 << 40)))

    def sample(df: DataFrame, column: str, *names: Column) -> DataFrame:
        v = texts_of(df, column)
        return df.select(*names, v.alias("v")).filter(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < bound))

    kid = reduce(DataFrame.unionAll, [sample(tables[t], c, F.lit(i).alias("k")) for i, (t, c) in enumerate(children)]).distinct()
    names = list(parents)
    par = reduce(DataFrame.unionAll, [sample(tables[p], parents[p], F.lit(j).alias("p")) for j, p in enumerate(names)]).distinct()
    owners = par.groupBy("v").agg(F.collect_set("p").alias("ps"))  # at most one entry per table
    met = kid.join(owners, "v", "left").groupBy("k").agg(
        F.count("*").alias("n"), *[F.count_if(F.array_contains("ps", j)).alias(f"h{j}") for j in range(len(names))])
    found = {r["k"]: r for r in met.collect()}  # one row per column
    out = []
    for i, (t, c) in enumerate(children):
        for j, p in enumerate(names):
            r = found.get(i)
            off = math.sqrt(math.log(SURE) / (2 * r["n"])) if r else 1.0
            if t != p and (r is None or share == 1.0 and r[f"h{j}"] >= LEAST_CONTAINMENT * r["n"]
                           or share < 1.0 and r[f"h{j}"] / r["n"] + off >= LEAST_CONTAINMENT):
                out.append((t, c, p))
    return out


def detect_foreign_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, str | None] | None = None,
                        sampled: int = SAMPLED) -> DataFrame:
    """Containment of every column's distinct values in every other table's primary key.

    Pairs that a shared sample rules out are discarded first (``possible_pairs``).  The columns that
    are left are compared in one shuffle on the value, where a value meets at most one row per
    column; no table-by-table joins.
    """
    keys = dict(keys) if keys is not None else {n: detect_primary_key(d) for n, d in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    schema = ("child_table string, child_column string, parent_table string, parent_column string, "
              "containment double, name_similarity boolean, confidence string")
    children = [(name, c) for name, df in tables.items() for c in pf.scalar_columns(df)]
    parents = {name: keys[name] for name in tables if keys.get(name)}
    possible = possible_pairs(children, parents, tables, sampled) if parents and children else []
    if not possible:
        return spark.createDataFrame([], schema)
    columns = sorted({(t, c) for t, c, _ in possible})
    kid = reduce(DataFrame.unionAll, [tables[t].select(F.lit(t).alias("t"), F.lit(c).alias("c"), texts_of(tables[t], c).alias("v"))
                                      for t, c in columns]).filter("v is not null").distinct()
    par = reduce(DataFrame.unionAll, [tables[p].select(F.lit(p).alias("p"), texts_of(tables[p], parents[p]).alias("v"))
                                      for p in sorted({p for _, _, p in possible})]).filter("v is not null").distinct()
    sizes = kid.groupBy("t", "c").agg(F.count("*").alias("n"))
    owners = par.groupBy("v").agg(F.collect_set("p").alias("ps"))  # at most one entry per table
    met = kid.join(owners, "v").select("t", "c", F.explode("ps").alias("p")).filter("t <> p")
    hits = met.groupBy("t", "c", "p").agg(F.count("*").alias("hits"))
    pairs = hits.join(F.broadcast(sizes), ["t", "c"]).filter("n >= 2")  # one row per column
    out = []
    for r in pairs.collect():  # columns x tables
        share, near = r["hits"] / r["n"], name_similar(r["c"], r["p"])
        if share >= 0.95 or (share >= LEAST_CONTAINMENT and near):
            out.append((r["t"], r["c"], r["p"], keys[r["p"]], round(share, 3), near,
                        "high" if share >= 0.95 and near else "review"))
    return spark.createDataFrame(out, schema)
