"""Learn from a table and sample look-alike rows, end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.functions.fictional import fictional
from facsimile.operators import copula, degrade, domains, ordered, privacy, scale
from facsimile.operators import profile as pf

ROW = "row_no"


@dataclass
class Synthesis:
    """The synthetic rows (numbered by ``row_no``) and what they were learned from."""

    rows: DataFrame
    profile: list
    kinds: dict[str, str]
    model: copula.CopulaModel
    train: DataFrame
    holdout: DataFrame | None
    outliers: int = 0
    warnings: list[str] = field(default_factory=list)
    dp_applied: bool = False


def synthesize(df: DataFrame, n: int, key: str, seed: int = 42, actions: Mapping[str, str] | None = None,
               dp: Mapping[str, Any] | None = None, salt: str = privacy.DEFAULT_SALT,
               null_config: Mapping[str, float] | None = None, outlier_rate: float = 0.0,
               outlier_method: str = "iqr_extreme", constraints: Sequence[Mapping] | None = None,
               locale: str = "us", method: str = "exact", kinds: Mapping[str, str] | None = None) -> Synthesis:
    """Profile, hold out, fit, sample, fill what a model cannot learn, then degrade and protect.

    ``key`` identifies the source rows.  Directly identifying columns never reach the model.
    """
    spark = df.sparkSession
    df = scale.spread(df, keep=True)  # many passes follow
    prof = pf.profile(df).orderBy("position").collect()  # one row per column
    found = {r["column"]: r["kind"] for r in prof}
    found.update(kinds or {})
    train, hold = domains.split_holdout(df, keyed.uniform(seed, "holdout", key=key), key)
    direct = {r["column"] for r in prof if r["pii"] == "direct" and found[r["column"]] not in ("id", "date", "datetime")}
    learn = {c: k for c, k in found.items() if c not in direct}
    model = copula.fit(train, learn, key, seed, dp, method)
    out = copula.sample(spark, model, n, seed, ROW)
    types = {f.name: f.dataType for f in df.schema.fields}
    ids = [c for c, k in found.items() if k == "id" and pf.family(types[c]) == "numeric"]
    tops = df.agg(*[F.max(F.col(f"`{c}`")).cast("bigint").alias(f"m{i}") for i, c in enumerate(ids)]).first() if ids else None

    def filled(c: str) -> Column | None:
        kind = found[c]
        if c in direct:
            return fictional(c, ROW, seed, locale)
        if c in out.columns:
            return F.col(f"`{c}`")
        if kind == "id":
            if c in ids:
                return F.col(ROW) + F.lit((tops[f"m{ids.index(c)}"] or 0) + 1)
            stem = c.replace("_id", "").replace("id", "").strip("_") or c
            return ordered.format_id(F.col(ROW), f"{stem}-", 6)
        if kind in ("text", "email", "phone", "address", "url"):
            return fictional(c, ROW, seed, locale)
        return None

    values = {c: filled(c) for c in df.columns if c in found}
    out = out.select(ROW, *[v.alias(c) for c, v in values.items() if v is not None])
    if null_config:
        out = degrade.inject_nulls(out, null_config, ROW, seed)
    hits = 0
    if outlier_rate > 0:
        out, hits = degrade.inject_outliers(scale.cut(out), found, outlier_rate, ROW, outlier_method, seed)
    warnings: list[str] = []
    if constraints:
        out, warnings = degrade.enforce_constraints(scale.cut(out), constraints, ROW)
    if actions:
        out = privacy.apply_privacy(out, actions, ROW, salt=salt, seed=seed, locale=locale)
    return Synthesis(out, prof, found, model, train, hold, hits, warnings, bool(dp))
