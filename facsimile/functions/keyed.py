"""Keyed randomness: every draw is a pure function of (seed, path, row key).

``rand()`` depends on how rows are partitioned, so a lost executor or a different
cluster size changes the data.  A SHA-256 of the path and the row key does not, and
any SQL engine can repeat it.  One digest carries four independent 52-bit draws
(``lane`` 0-3); Catalyst computes the digest once when lanes share a projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0
LANE_HEX = 13


def _key(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def digest(seed: int, *path: object, key: Column | str) -> Column:
    prefix = "/".join(str(p) for p in (seed, *path))
    return F.sha2(F.concat_ws("/", F.lit(prefix), _key(key)), 256)


def uniform(seed: int, *path: object, key: Column | str, lane: int = 0, fast: bool = False) -> Column:
    """A double in [0, 1).  ``fast`` swaps SHA-256 for xxhash64 (about five times cheaper)."""
    if fast:
        prefix = "/".join(str(p) for p in (seed, *path, lane))
        h = F.xxhash64(F.lit(prefix), _key(key))
        return F.shiftrightunsigned(h, 12).cast("double") / F.lit(TWO52)
    if not 0 <= lane <= 3:
        raise ValueError("lane must be 0..3")
    hexa = F.substring(digest(seed, *path, key=key), 1 + lane * LANE_HEX, LANE_HEX)
    return F.conv(hexa, 16, 10).cast("bigint").cast("double") / F.lit(TWO52)


def short_hash(value: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(_key(value), 256), 1, n)


def uniform_int(u: Column, lo: int, hi: int) -> Column:
    """Integer in the half-open range [lo, hi)."""
    return (F.lit(lo) + F.floor(u * F.lit(float(hi - lo)))).cast("bigint")


def uniform_num(u: Column, lo: float, hi: float, integral: bool = False) -> Column:
    x = F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))
    return F.rint(x).cast("bigint") if integral else x


# Default numeric ranges picked from a word in the column name.
RANGE_HINTS = (
    (("rating", "score"), (1.0, 5.0)),
    (("distance", "length"), (1.0, 50.0)),
    (("fare", "amount", "price"), (5.0, 150.0)),
)


def default_range(name: str) -> tuple[float, float]:
    low = name.lower()
    for words, bounds in RANGE_HINTS:
        if any(w in low for w in words):
            return bounds
    return (0.0, 10000.0)


def cumulative(weights: Sequence[float]) -> list[float]:
    """Cumulative shares; negative weights count as zero."""
    w = [max(float(x), 0.0) for x in weights]
    total = math.fsum(w)
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    out, run = [], 0.0
    for x in w:
        run += x
        out.append(run / total)
    out[-1] = 1.0
    return out


def bucket_of(x: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are <= x, as a balanced tree of comparisons (log2 tests per row)."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(float(cuts[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _literal(v: object) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v) if abs(v) < 2**31 else f"{v}L"
    if isinstance(v, float) and math.isfinite(v):
        return f"{v!r}D"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return None


def literal_array(values: Sequence[object]) -> Column:
    """An array constant, sent to the JVM as one expression rather than one call per value."""
    parts = [_literal(v) for v in values]
    if parts and all(p is not None for p in parts):
        return F.expr(f"array({', '.join(parts)})")
    return F.array(*[F.lit(v) for v in values])


def choice(u: Column, values: Sequence[object]) -> Column:
    idx = (F.lit(1) + F.floor(u * F.lit(float(len(values))))).cast("int")
    return F.element_at(literal_array(values), idx)


def weighted_choice(u: Column, weights: Mapping[object, float]) -> Column:
    cdf = cumulative(list(weights.values()))
    return F.element_at(literal_array(list(weights)), (bucket_of(u, cdf[:-1]) + F.lit(1)).cast("int"))


def zipf_weights(n: int, s: float) -> list[float]:
    return [1.0 / k**s for k in range(1, n + 1)]


def zipf_index(u: Column, n: int, s: float) -> Column:
    """1-based rank with weight 1/rank^s; for domains of at most a few hundred values.

    Larger domains go through ``operators.domains.draw_from_domain``."""
    return bucket_of(u, cumulative(zipf_weights(n, s))[:-1]) + F.lit(1)


def normal(u1: Column, u2: Column, mu: float | Column = 0.0, sigma: float | Column = 1.0) -> Column:
    """Box-Muller; u1 is mirrored to (0, 1] so the logarithm is finite."""
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    mu = F.lit(mu) if not isinstance(mu, Column) else mu
    sigma = F.lit(sigma) if not isinstance(sigma, Column) else sigma
    return mu + sigma * z


def clip(x: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """greatest/least skip nulls, so a null is kept null here."""
    y = x
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), y)


def lognormal(u1: Column, u2: Column, mu: float, sigma: float, lo: float, hi: float) -> Column:
    x = F.exp(normal(u1, u2, mu, sigma))
    return F.least(F.greatest(F.rint(x), F.lit(float(lo))), F.lit(float(hi))).cast("bigint")


def laplace(u: Column, scale: float | Column) -> Column:
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    v = F.greatest(u, F.lit(1e-12)) - F.lit(0.5)
    return -b * F.signum(v) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(v))


def bernoulli(u: Column, p: float | Column) -> Column:
    return u < (p if isinstance(p, Column) else F.lit(float(p)))


# --- discrete count distributions, inverted from a short driver-side table ---------


def _truncate(pmf: Sequence[float]) -> list[float]:
    """Cumulative table whose last entry takes the whole upper tail."""
    run, out = 0.0, []
    for p in pmf:
        run += p
        out.append(min(run, 1.0))
    return out


#: A count's table ends where less than this is left above, if no ``top`` is given.
TAIL = 1e-12


def negbin_cdf(mean: float, dispersion: float, top: int | None = None) -> list[float]:
    p = dispersion / (dispersion + mean)
    pmf, cur, left, k = [], p**dispersion, 1.0, 0
    while k < top if top is not None else left > TAIL:
        pmf.append(cur)
        left -= cur
        cur *= (k + dispersion) / (k + 1) * (1 - p)
        k += 1
    return _truncate(pmf)


def poisson_cdf(mean: float, top: int | None = None) -> list[float]:
    pmf, cur, left, k = [], math.exp(-mean), 1.0, 0
    while k < top if top is not None else left > TAIL:
        pmf.append(cur)
        left -= cur
        cur *= mean / (k + 1)
        k += 1
    return _truncate(pmf)


def count_cuts(dist: str, mean: float = 3.0, dispersion: float = 1.5, top: int = 60,
               low: int = 0, weights: Sequence[float] | None = None) -> list[float]:
    """Cut points for ``draw_count``: entry k is P(X <= k)."""
    if dist == "negbin":
        return negbin_cdf(mean, dispersion, top)
    if dist == "poisson":
        return poisson_cdf(mean, top)
    if dist == "zipf":
        return [0.0] * max(low, 1) + cumulative(zipf_weights(top, dispersion))[:-1]
    if dist == "uniform":
        n = top - low + 1
        return [0.0] * low + [(k + 1) / n for k in range(n - 1)]
    if dist == "empirical":
        return cumulative(list(weights or [1.0]))[:-1]
    if dist == "fixed":
        return [0.0] * int(mean)
    raise ValueError(f"unknown count distribution {dist!r}")


def draw_count(u: Column, cuts: Sequence[float], low: int = 0, top: int | None = None) -> Column:
    n = bucket_of(u, cuts)
    if low:
        n = F.greatest(n, F.lit(low))
    if top is not None:
        n = F.least(n, F.lit(top))
    return n.cast("int")
