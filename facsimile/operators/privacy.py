"""Column-level protection: mask, pseudonymise, replace, add noise, drop.

Everything here is a plain per-row expression, so it needs no shuffle and also works on a
streaming DataFrame.  A null stays null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions import keyed
from facsimile.operators import domains
from facsimile.operators.ordered import format_id
from facsimile.sources import locales

DEFAULT_SALT = "project-salt"
ACTIONS = ("keep", "mask", "hash", "synthetic", "exclude", "dp_noise")


def mask(c: Column, show_last: int = 2) -> Column:
    s = c.cast("string")
    n = F.length(s)
    hidden = F.repeat(F.lit("*"), F.greatest(n - F.lit(show_last), F.lit(0)))
    return F.when(n <= show_last, F.repeat(F.lit("*"), n)).otherwise(F.concat(hidden, F.right(s, F.lit(show_last))))


def pseudonymize(c: Column, salt: str = DEFAULT_SALT, length: int = 12) -> Column:
    """Salted hash: equal inputs stay equal, so joins survive.  This is not anonymisation."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, length)


def _vocab(u: Column, second: Column, words: Sequence[str], tails: Sequence[str]) -> Column:
    return F.concat_ws(" ", keyed.choice(u, words), keyed.choice(second, tails))


def synthetic_replace(name: str, index: Column, seed: int = 42, locale: str = "us") -> Column:
    """A fictional value for a column, picked by words in its name; ``index`` numbers the rows."""
    hint = name.lower()
    u = [keyed.uniform(seed, "synthetic", name, key=index, lane=i) for i in range(3)]

    def has(*words: str) -> bool:
        return any(w in hint for w in words)

    if has("email"):
        return F.concat(format_id(index, "user", 5), F.lit("@example.com"))
    if has("phone", "mobile", "cell"):
        return format_id(index, "+00-000-", 7)
    if has("name"):
        return locales.full_name(locale, seed, index, f"synthetic/{name}")
    if has("address", "street"):
        return F.concat_ws(" ", (F.floor(u[2] * 900.0) + 1).cast("string"),
                           _vocab(u[0], u[1], domains.FIRST_WORDS, domains.SECOND_WORDS), F.lit("Street"))
    if has("company", "org"):
        return keyed.choice(u[0], locales.pack(locale)["companies"])
    if has("city"):
        return locales.city(locale, u[0])
    if has("ssn", "cnic", "passport"):
        return format_id(index, "XXX-XX-", 4)
    if has("card", "account", "iban"):
        return format_id(index, "XXXX-XXXX-XXXX-", 4)
    if has("ip"):
        return F.concat(F.lit("10.0."), F.floor(index / 256).cast("string"), F.lit("."), (index % 256).cast("string"))
    return format_id(index, f"{name}-", 6)


@dataclass(frozen=True)
class Noise:
    epsilon: float
    low: float | None = None
    high: float | None = None


def value_range(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Minimum and maximum of several columns in one job (one row to the driver)."""
    if not cols:
        return {}
    row = df.agg(*[f(F.col(f"`{c}`").try_cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def dp_noise(c: Column, u: Column, epsilon: float, low: float | None, high: float | None,
             integral: bool = False) -> Column:
    """Laplace noise of scale max(range, 1)/epsilon per value, clipped to the range.

    This blurs single values; it is not a differentially private release.
    """
    if low is None or high is None or epsilon <= 0:
        return c
    x = c.try_cast("double")
    noised = x + keyed.laplace(u, max(high - low, 1.0) / epsilon)
    out = F.least(F.greatest(noised, F.lit(float(low))), F.lit(float(high)))
    out = F.when(x.isNotNull(), out)
    return F.rint(out).cast("bigint") if integral else out


def exclude(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def apply_privacy(df: DataFrame, actions: Mapping[str, str], key: Column | str, index: Column | None = None,
                  salt: str = DEFAULT_SALT, seed: int = 42, locale: str = "us",
                  noise: Mapping[str, Noise | float] | None = None) -> DataFrame:
    """Apply one action per column in a single projection.

    ``key`` identifies a row (it feeds the keyed noise); ``index`` numbers the rows for synthetic
    values and defaults to ``key``, which then has to be numeric.  Unknown columns are ignored.
    """
    noise = dict(noise or {})
    bad = set(actions.values()) - set(ACTIONS)
    if bad:
        raise ValueError(f"unknown privacy action(s) {sorted(bad)}")
    key_col = F.col(key) if isinstance(key, str) else key
    index = index if index is not None else key_col
    conf = {}
    for c, a in actions.items():
        if a == "dp_noise" and c in df.columns:
            n = noise.get(c, 1.0)
            conf[c] = n if isinstance(n, Noise) else Noise(float(n))
    ranges = value_range(df, [c for c, n in conf.items() if n.low is None or n.high is None])
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        c, action = F.col(f"`{name}`"), actions.get(name, "keep")
        if action == "exclude":
            continue
        if action == "mask":
            c = mask(c)
        elif action == "hash":
            c = pseudonymize(c, salt)
        elif action == "synthetic":
            c = synthetic_replace(name, index, seed, locale)
        elif action == "dp_noise":
            n = conf[name]
            lo, hi = ranges.get(name, (None, None))
            c = dp_noise(c, keyed.uniform(seed, "dp_noise", name, key=key_col), n.epsilon,
                         n.low if n.low is not None else lo, n.high if n.high is not None else hi,
                         isinstance(types[name], T.IntegralType))
        out.append(c.alias(name))
    return df.select(*out)
