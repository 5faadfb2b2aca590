"""Money in integer minor units; half-even rounding through DECIMAL, never floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency code -> (symbol, minor digits).
CURRENCIES = {
    "USD": ("$", 2),
    "PKR": ("Rs.", 2),
    "GBP": ("£", 2),
    "EUR": ("€", 2),
    "INR": ("₹", 2),
    "AED": ("AED", 2),
    "JPY": ("¥", 0),
    "BHD": ("BHD", 3),
}


def _col(x: Column | str | int) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def to_minor(x: Column | str, digits: int = 2) -> Column:
    """Human amount -> minor units.  A double goes through its shortest decimal text."""
    d = _col(x).cast("string").cast("decimal(30,8)")
    return F.bround(d * F.lit(10**digits).cast("decimal(7,0)"), 0).cast("bigint")


def from_minor(m: Column | str, digits: int = 2) -> Column:
    d = _col(m).cast("decimal(24,0)")
    return (d / F.lit(10**digits).cast("decimal(7,0)")).cast(f"decimal(28,{digits})")


def pct_of(minor: Column | str, rate: Column | str) -> Column:
    """Half-even share of an amount; a ``str`` rate is a decimal literal such as '0.18'."""
    r = rate.cast("decimal(12,8)") if isinstance(rate, Column) else F.lit(rate).cast("decimal(12,8)")
    return F.bround(_col(minor).cast("decimal(20,0)") * r, 0).cast("bigint")


def add(*amounts: Column | str) -> Column:
    total = _col(amounts[0]).cast("bigint")
    for a in amounts[1:]:
        total = total + _col(a).cast("bigint")
    return total


def sub(a: Column | str, b: Column | str) -> Column:
    return _col(a).cast("bigint") - _col(b).cast("bigint")


def mul(minor: Column | str, qty: Column | str | int) -> Column:
    return _col(minor).cast("bigint") * _col(qty).cast("bigint")


def split_amount(total: Column | str, parts: int) -> Column:
    """Array of ``parts`` amounts that sum exactly; the first parts take the remainder."""
    if parts <= 0:
        raise ValueError("parts must be positive")
    t = _col(total).cast("bigint")
    rem = F.pmod(t, F.lit(parts).cast("bigint"))
    base = F.call_function("div", t - rem, F.lit(parts).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)),
                       lambda i: base + F.when(i < rem, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def _fmt_one(m: Column, symbol: str, digits: int) -> Column:
    mag = F.abs(m)
    sign = F.when(m < 0, F.lit("-")).otherwise(F.lit(""))
    scale = F.lit(10**digits).cast("bigint")
    frac = mag % scale
    whole = F.format_number(F.call_function("div", mag, scale), 0)
    parts = [sign, F.lit(symbol), whole]
    if digits:
        parts += [F.lit("."), F.lpad(frac.cast("string"), digits, "0")]
    return F.concat(*parts)


def fmt(minor: Column | str, currency: Column | str = "USD", show_code: bool = False) -> Column:
    """Display text.  ``currency`` is a code, or a column holding codes."""
    m = _col(minor).cast("bigint")
    if isinstance(currency, str):
        sym, digits = CURRENCIES.get(currency, (currency, 2))
        out = _fmt_one(m, sym, digits)
        return F.concat(out, F.lit(f" {currency}")) if show_code else out
    out = None
    for code, (sym, digits) in CURRENCIES.items():
        hit, text = currency == F.lit(code), _fmt_one(m, sym, digits)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    frac = F.abs(m) % 100
    unknown = F.concat(F.when(m < 0, F.lit("-")).otherwise(F.lit("")), currency,
                       F.format_number(F.call_function("div", F.abs(m), F.lit(100).cast("bigint")), 0),
                       F.lit("."), F.lpad(frac.cast("string"), 2, "0"))
    out = out.otherwise(unknown)
    return F.concat(out, F.lit(" "), currency) if show_code else out


def reconcile(expected: Column | str, actual: Column | str, label: str = "amount") -> Column:
    e, a = _col(expected).cast("bigint"), _col(actual).cast("bigint")
    return F.struct(F.lit(f"{label} reconciliation").alias("check"), e.alias("expected"),
                    a.alias("actual"), (a - e).alias("diff"), (e == a).alias("passed"))


# Locale date patterns -> Spark patterns.
DATE_PATTERNS = {
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "DD.MM.YYYY": "dd.MM.yyyy",
}


def format_date(d: Column | str, pattern: str) -> Column:
    return F.date_format(_col(d), DATE_PATTERNS[pattern])
