"""Text builders for the oracle SQL: the same published formulas, spelt for another engine."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from facsimile.functions import keyed, mathx


def u(seed: int, *path: object, key: str, lane: int = 0) -> str:
    prefix = "/".join(str(p) for p in (seed, *path))
    start = 1 + lane * keyed.LANE_HEX
    return (f"(cast(('0x'||substr(sha256('{prefix}/'||cast({key} as varchar)),{start},{keyed.LANE_HEX})) "
            f"as bigint)::double/4503599627370496::double)")


def dbl(x: float) -> str:
    return f"({float(x)!r}::double)"


def bucket_of(x: str, cuts: Sequence[float]) -> str:
    """How many cuts are <= x."""
    arr = ",".join(dbl(c) for c in cuts)
    return f"len(list_filter([{arr}]::double[], lambda c: c <= {x}))" if cuts else "0"


def quoted(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def array(values: Sequence[object]) -> str:
    return "[" + ",".join(quoted(v) for v in values) + "]"


def choice(x: str, values: Sequence[object]) -> str:
    return f"({array(values)})[1+floor({x}*{float(len(values))!r}::double)::int]"


def weighted(x: str, weights: Mapping[object, float]) -> str:
    cuts = keyed.cumulative(list(weights.values()))[:-1]
    return f"({array(list(weights))})[1+{bucket_of(x, cuts)}]"


def normal(u1: str, u2: str, mu: object = 0.0, sigma: object = 1.0) -> str:
    mu = dbl(mu) if isinstance(mu, (int, float)) else mu
    sigma = dbl(sigma) if isinstance(sigma, (int, float)) else sigma
    return f"({mu}+{sigma}*(sqrt(-2.0::double*ln(1.0::double-{u1}))*cos({dbl(2 * math.pi)}*{u2})))"


def laplace(x: str, scale: str) -> str:
    v = f"(greatest({x},1e-12::double)-0.5::double)"
    return f"(-({scale})*sign({v})*ln(1.0::double-2.0::double*abs({v})))"


def rint(x: str) -> str:
    return f"round_even({x},0)"


def _horner(coef: Sequence[float], x: str) -> str:
    acc = dbl(coef[0])
    for c in coef[1:]:
        acc = f"({acc}*{x}+{dbl(c)})"
    return acc


def norm_ppf(p: str) -> str:
    lo = f"sqrt(-2.0::double*ln({p}))"
    hi = f"sqrt(-2.0::double*ln(1.0::double-{p}))"
    q = f"({p}-0.5::double)"
    r = f"({q}*{q})"
    centre = f"{_horner(mathx.PPF_A, r)}*{q}/{_horner((*mathx.PPF_B, 1.0), r)}"
    low = f"{_horner(mathx.PPF_C, lo)}/{_horner((*mathx.PPF_D, 1.0), lo)}"
    high = f"-{_horner(mathx.PPF_C, hi)}/{_horner((*mathx.PPF_D, 1.0), hi)}"
    return (f"(case when {p} < {dbl(mathx.PPF_LOW)} then {low} "
            f"when {p} > {dbl(1.0 - mathx.PPF_LOW)} then {high} else {centre} end)")


def pct(amount: str, rate: str) -> str:
    """Half-even share with exact decimals."""
    return f"round_even(cast({amount} as decimal(20,0))*cast({rate} as decimal(12,8)),0)::bigint"


def union_all(parts: Sequence[str]) -> str:
    return " union all ".join(parts)
