"""Gaussian copula: learn marginals and correlations from a table, sample look-alike rows.

Fitting returns a model-sized object (quantile grids, short category lists, a k x k matrix);
sampling is an embarrassingly parallel projection over ``spark.range``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions import keyed, mathx
from facsimile.operators import domains, ordered, scale, strategies
from facsimile.operators import profile as pf

# Grid size, modelled kinds, clip of the uniform scores, boolean spellings, DP bins.
GRID = 1001
MODELLED = ("int", "num", "date", "datetime", "cat", "money", "bool")
CLIP = 1e-6
TRUE_TEXT = tuple(pf.TRUE_WORDS)
FALSE_TEXT = tuple(w for w in pf.BOOL_WORDS if w not in pf.TRUE_WORDS)
DP_BINS = 64
DP_UNIT = 1_000_000  # noised counts become whole weights of this resolution
INLINE_CATEGORIES = 256


def to_numeric(c: Column, kind: str, dtype: T.DataType) -> Column:
    """Seconds since the epoch for dates, 1/0 for booleans, a number (or null) otherwise."""
    if kind in ("date", "datetime"):
        t = pf.parse_time(c, pf.family(dtype))
        clock = F.hour(t) * 3600 + F.minute(t) * 60
        return (F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400.0
                + clock.cast("double") + F.extract(F.lit("SECOND"), t).cast("double"))
    if kind == "bool":
        s = F.lower(c.cast("string"))
        return F.when(s.isin(*TRUE_TEXT), 1.0).when(s.isin(*FALSE_TEXT), 0.0)
    return pf.parse_number(c, pf.family(dtype))


def category_spans(df: DataFrame, col: str, epsilon: float | None = None, seed: int = 0) -> domains.Spans:
    """Each category with its interval [lo, hi) on a line of whole weights, most frequent first."""
    counts = (df.select(F.col(f"`{col}`").cast("string").alias("value")).filter("value is not null")
              .groupBy("value").agg(F.count("*").alias("cnt")))
    if epsilon is None:
        weighted = counts.withColumn("weight", F.col("cnt"))
    else:
        u = keyed.uniform(seed, "dp_category", col, key="value")
        noised = F.greatest(F.col("cnt") + keyed.laplace(u, 1.0 / epsilon), F.lit(0.0))
        weighted = counts.withColumn("weight", F.rint(noised * DP_UNIT).cast("bigint"))
        if not weighted.agg(F.sum("weight")).first()[0]:
            weighted = weighted.withColumn("weight", F.lit(1).cast("bigint"))
    return domains.spans(weighted.withColumn("__neg", -F.col("weight")), "weight", ["__neg", "value"])


def fit_categorical(df: DataFrame, col: str, epsilon: float | None = None, seed: int = 0) -> DataFrame:
    """(value, prob, cum): shares and cumulative shares, most frequent first."""
    line = category_spans(df, col, epsilon, seed)
    total = F.lit(float(max(line.total, 1)))
    return line.table.select("value", (F.col("weight") / total).alias("prob"), (F.col("hi") / total).alias("cum"))


def fit_boolean(df: DataFrame, col: str, epsilon: float | None = None, seed: int = 0) -> float:
    """Share of true; 0.5 without data.  Noise goes on the two counts."""
    x = to_numeric(F.col(f"`{col}`"), "bool", df.schema[col].dataType)
    yes, no = df.agg(F.count_if(x == 1), F.count_if(x == 0)).first()
    if epsilon is not None and yes + no:
        us = df.sparkSession.range(2).select(keyed.uniform(seed, "dp_bool", col, key="id").alias("u"))
        a, b = (r["u"] for r in us.collect())
        yes, no = max(yes + _laplace(a, 1 / epsilon), 0.0), max(no + _laplace(b, 1 / epsilon), 0.0)
    return yes / (yes + no) if yes + no > 0 else 0.5


def _laplace(u: float, scale_: float) -> float:
    v = max(u, 1e-12) - 0.5
    return -scale_ * math.copysign(1, v) * math.log(1 - 2 * abs(v)) if v else 0.0


def fit_numeric(df: DataFrame, col: str, kind: str) -> list[float]:
    """Quantile grid of 1001 points; zeros when the column holds no value."""
    x = to_numeric(F.col(f"`{col}`"), kind, df.schema[col].dataType)
    qs = ordered.exact_quantiles(df.select(x.alias("x")), "x", [i / (GRID - 1) for i in range(GRID)])
    return [0.0] * GRID if qs[0] is None else qs


def dp_histogram(df: DataFrame, col: str, kind: str, epsilon: float, low: float, high: float,
                 seed: int = 0) -> DataFrame:
    """64 equal bins over the clipped range with noised, non-negative counts: (bin, cnt, noised)."""
    x = to_numeric(F.col(f"`{col}`"), kind, df.schema[col].dataType)
    at = (F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))) - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
    b = F.least(F.floor(at * DP_BINS), F.lit(DP_BINS - 1)).cast("bigint")
    counts = df.select(F.when(x.isNotNull(), b).alias("bin")).filter("bin is not null").groupBy("bin").agg(
        F.count("*").alias("cnt"))
    spine = df.sparkSession.range(DP_BINS).withColumnRenamed("id", "bin")
    full = spine.join(F.broadcast(counts), "bin", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))  # 64 rows
    u = keyed.uniform(seed, "dp_histogram", col, key="bin")
    return full.withColumn("noised", F.greatest(F.col("cnt") + keyed.laplace(u, 1.0 / epsilon), F.lit(0.0)))


def dp_grid(hist: DataFrame, low: float, high: float) -> list[float]:
    h = np.array([r["noised"] for r in hist.orderBy("bin").collect()])
    cdf = np.concatenate([[0.0], np.cumsum(h)]) / max(h.sum(), 1e-9)
    return np.interp(np.linspace(0, 1, GRID), cdf, np.linspace(low, high, DP_BINS + 1)).tolist()


# --- the model ------------------------------------------------------------------------------------


@dataclass
class CopulaModel:
    """Everything that sampling needs.  Marginals are ``{"type": "cat" | "bool" | "num", ...}``;
    a category list too long to inline is kept as a table in ``domains``."""

    cols: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    null_rate: dict[str, float] = field(default_factory=dict)
    marginals: dict[str, dict[str, Any]] = field(default_factory=dict)
    corr: list[list[float]] = field(default_factory=list)
    domains: dict[str, domains.Spans] = field(default_factory=dict, repr=False)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write the model to a folder: one JSON text, and a table for each long category list."""
        names = list(self.domains)
        facts = {c: {"place": i, "total": self.domains[c].total, "size": self.domains[c].size} for i, c in enumerate(names)}
        inline = CopulaModel(self.cols, self.kinds, self.null_rate, self.marginals, self.corr)
        text = json.dumps({"model": inline.to_json(), "domains": facts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")
        for i, c in enumerate(names):
            self.domains[c].table.select("value", "lo", "hi").write.mode("overwrite").parquet(f"{folder}/domain-{i}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CopulaModel:
        d = json.loads(spark.read.text(f"{folder}/model", wholetext=True).first()["value"])
        out = cls.from_json(d["model"])
        out.domains = {c: domains.Spans(spark.read.parquet(f"{folder}/domain-{f['place']}"), f["total"], f["size"])
                       for c, f in d["domains"].items()}
        return out

    def to_json(self) -> str:
        """The model as one text; one with table-sized category lists is saved by ``save``."""
        if self.domains:
            raise ValueError("a model with table-sized category lists is written by save()")
        return json.dumps({k: getattr(self, k) for k in ("cols", "kinds", "null_rate", "marginals", "corr")})

    @classmethod
    def from_json(cls, text: str) -> CopulaModel:
        return cls(**json.loads(text))


def make_psd(c: np.ndarray) -> np.ndarray:
    """Nearest usable correlation matrix: clip eigenvalues, restore the unit diagonal."""
    c = np.nan_to_num(np.array(c, dtype=float), nan=0.0, posinf=1.0, neginf=-1.0)
    np.fill_diagonal(c, 1.0)
    values, vectors = np.linalg.eigh(c)
    fixed = (vectors * np.clip(values, CLIP, None)) @ vectors.T
    d = np.sqrt(np.diag(fixed))
    d[d == 0] = 1.0
    return fixed / np.outer(d, d)


def fit_marginal(df: DataFrame, col: str, kind: str, dp: Any = None, seed: int = 0) -> dict[str, Any]:
    """Marginal of one column; ``dp`` is epsilon or (epsilon, low, high)."""
    eps = dp[0] if isinstance(dp, (tuple, list)) else dp
    if kind == "cat":
        line = category_spans(df, col, eps, seed)
        if line.size > INLINE_CATEGORIES:
            return {"type": "cat", "spans": line}
        rows = line.table.orderBy("lo").collect()
        return {"type": "cat", "spans": line, "cats": [r["value"] for r in rows],
                "cum": [r["hi"] / max(line.total, 1) for r in rows]}
    if kind == "bool":
        return {"type": "bool", "p": fit_boolean(df, col, eps, seed)}
    dtype = df.schema[col].dataType
    x = to_numeric(F.col(f"`{col}`"), kind, dtype)
    lo, hi, off = df.agg(F.min(x), F.max(x), F.count_if(x % 86400 != 0)).first()
    if lo is None:
        grid = [0.0] * GRID
    elif dp is not None:
        low, high = (dp[1], dp[2]) if isinstance(dp, (tuple, list)) and len(dp) == 3 else (lo, hi)
        grid = dp_grid(dp_histogram(df, col, kind, eps, low, high, seed), low, high)
    else:
        grid = fit_numeric(df, col, kind)
    is_date = kind in ("date", "datetime")
    return {"type": "num", "grid": grid, "is_int": kind in ("int", "money"), "is_date": is_date,
            "day_only": bool(is_date and lo is not None and off == 0)}


def uniform_scores(df: DataFrame, kinds: Mapping[str, str], key: str, seed: int = 0,
                   marginals: Mapping[str, dict] | None = None, method: str = "exact") -> DataFrame:
    """(key, u_<col> ...): every modelled value as a uniform score; a null draws at random.

    ``method="grid"`` reads numeric scores off the fitted quantile grid: no shuffle at all, accurate
    to a thousandth.  "exact" ranks every value, one grouping and one join per numeric column.
    """
    marginals = marginals or {}
    cols = [c for c in df.columns if kinds.get(c) in MODELLED]
    out = df.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`") for c in cols if c != key],
                    *([F.col(f"`{key}`")] if key in cols else []))
    for c in cols:
        kind, dtype = kinds[c], df.schema[c].dataType
        u = keyed.uniform(seed, "score", c, key="__key")
        if kind == "cat":
            line = marginals.get(c, {}).get("spans") or category_spans(df, c)
            dim = line.table.select(F.col("value").alias("__v"), "lo", "hi")
            out = scale.lookup(out.withColumn("__v", F.col(f"`{c}`").cast("string")), dim, "__v", "left",
                               lambda line=line: line.hot("value"), line.size)
            score = (F.col("lo") + u * (F.col("hi") - F.col("lo"))) / F.lit(float(max(line.total, 1)))
            out = out.withColumn(f"u_{c}", F.coalesce(score, u)).drop("__v", "lo", "hi")
        elif kind == "bool":
            x = to_numeric(F.col(f"`{c}`"), "bool", dtype)
            p = marginals[c]["p"] if c in marginals else fit_boolean(df, c)
            out = out.withColumn(f"u_{c}", F.when(x == 1, F.lit(1 - p) + u * F.lit(p))
                                 .when(x == 0, u * F.lit(1 - p)).otherwise(u))
        else:
            out = out.withColumn("__x", to_numeric(F.col(f"`{c}`"), kind, dtype))
            if method == "grid":
                score = _grid_position(F.col("__x"), marginals[c]["grid"])
            else:
                src = df.select(to_numeric(F.col(f"`{c}`"), kind, dtype).alias("__x"))
                dim, distinct, n, hot = ordered.rank_table(src, "__x", "__rank")
                out = scale.lookup(out, dim, "__x", "left", hot, distinct)
                score = (F.col("__rank") - F.lit(0.5)) / F.lit(float(max(n, 1)))
            out = out.withColumn(f"u_{c}", F.when(F.col("__x").isNotNull(), score).otherwise(u)).drop("__x", "__rank")
    return out.select(F.col("__key").alias(key), *[f"u_{c}" for c in cols])


def _grid_position(x: Column, grid: Sequence[float]) -> Column:
    """Where x lies on a quantile grid, as a share; ties sit in the middle of their run."""
    points = np.asarray(grid, dtype=float)

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        a = v.to_numpy(dtype=float)
        mid = (np.searchsorted(points, a, "left") + np.searchsorted(points, a, "right") - 1) / 2
        return pd.Series(np.clip(mid / (len(points) - 1), 0.0, 1.0))

    return place(x)


def score_correlation(scores: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix of the normal scores; all pairs in one aggregate."""
    z = [mathx.norm_ppf(F.least(F.greatest(F.col(f"u_{c}"), F.lit(CLIP)), F.lit(1 - CLIP))).alias(f"z{i}")
         for i, c in enumerate(cols)]
    k = len(cols)
    m = np.eye(k)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    if pairs:
        row = scores.select(*z).agg(*[mathx.correlation(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            v = row[f"c{i}_{j}"]
            m[i, j] = m[j, i] = 0.0 if v is None or math.isnan(v) else v
    return m


def fit(df: DataFrame, kinds: Mapping[str, str], key: str, seed: int = 0, dp: Mapping[str, Any] | None = None,
        method: str = "exact") -> CopulaModel:
    """Learn a model from rows with a stable ``key``."""
    dp = dict(dp or {})
    cols = [c for c in df.columns if kinds.get(c) in MODELLED]
    if not cols:
        return CopulaModel()
    row = df.agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"r{i}")
                                            for i, c in enumerate(cols)]).first()
    if not row["n"]:
        return CopulaModel()
    marginals = {c: fit_marginal(df, c, kinds[c], dp.get(c), seed) for c in cols}
    scores = uniform_scores(df, {c: kinds[c] for c in cols}, key, seed, marginals, method)
    corr = make_psd(score_correlation(scores, cols))
    lines = {c: m.pop("spans") for c, m in marginals.items() if "spans" in m}
    tables = {c: line for c, line in lines.items() if line.size > INLINE_CATEGORIES}
    return CopulaModel(cols, {c: kinds[c] for c in cols}, {c: row[f"r{i}"] for i, c in enumerate(cols)},
                       marginals, corr.tolist(), tables)


def correlated_normals(row: str, corr: Sequence[Sequence[float]], seed: int) -> tuple[list[Column], list[Column]]:
    """Independent normals per row, and their correlated mixes (a Cholesky row is a linear expression)."""
    chol = np.linalg.cholesky(np.array(corr))
    k = len(chol)
    e = []
    for j in range(k):
        u1 = keyed.uniform(seed, "copula", j // 2, key=row, lane=2 * (j % 2))
        u2 = keyed.uniform(seed, "copula", j // 2, key=row, lane=2 * (j % 2) + 1)
        e.append(keyed.normal(u1, u2).alias(f"__e{j}"))
    return e, [sum((F.lit(float(chol[i, j])) * F.col(f"__e{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(k)]


def inverse_marginal(u: Column, m: Mapping[str, Any]) -> Column:
    """Value of a marginal at u in [0, 1)."""
    if m["type"] == "cat":
        if not m["cats"]:
            return F.lit(None).cast("string")
        return F.element_at(keyed.literal_array(m["cats"]), (keyed.bucket_of(u, m["cum"][:-1]) + 1).cast("int"))
    if m["type"] == "bool":
        return u >= F.lit(1.0 - m["p"])
    x = strategies.interpolate(m["grid"], u)
    if m["is_date"]:
        days, sec = F.floor(x / 86400.0), None
        day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
        if m["day_only"]:
            return day
        sec = F.floor(x - days * 86400.0).cast("bigint")
        return F.timestamp_add("SECOND", sec, day.cast("timestamp_ntz"))
    return F.rint(x).cast("bigint") if m["is_int"] else F.round(x, 6)


def sample(spark: SparkSession, model: CopulaModel, n: int, seed: int = 42, row: str = "row_no") -> DataFrame:
    """``n`` synthetic rows numbered from 0; nulls come back at their observed rates."""
    base = spark.range(n).withColumnRenamed("id", row)
    if not model.cols:
        return base
    e, z = correlated_normals(row, model.corr, seed)
    base = base.select(row, *e).select(row, *[mathx.norm_cdf(c).alias(f"__u{i}") for i, c in enumerate(z)])
    for i, c in enumerate(model.cols):
        if c in model.domains:
            line = model.domains[c]
            line = domains.Spans(line.table.withColumnRenamed("value", f"__v{i}"), line.total, line.size)
            base = domains.draw_from_spans(base, F.least(F.col(f"__u{i}"), F.lit(1 - 1e-12)), line, [f"__v{i}"])
    out = []
    for i, c in enumerate(model.cols):
        v = F.col(f"__v{i}") if c in model.domains else inverse_marginal(F.col(f"__u{i}"), model.marginals[c])
        rate = model.null_rate.get(c, 0.0)
        if rate > 0:
            v = F.when(keyed.uniform(seed, "copula_null", c, key=row) >= F.lit(rate), v)
        out.append(v.alias(c))
    return base.select(row, *out)


def model_summary(spark: SparkSession, model: CopulaModel) -> DataFrame:
    rows = [(c, model.kinds[c], model.null_rate[c], len(model.cols)) for c in model.cols]
    return spark.createDataFrame(rows, "column string, kind string, null_rate double, columns_modeled int")
