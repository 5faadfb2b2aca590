"""Column profiling: aggregates of a few columns' facts each, or of their counted values; one row per column out."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators import scale
from facsimile.operators.quantiles import exact_quantiles_of

# Value patterns, name hints, boolean spellings, date formats, quantile points.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE = r"^[\+]?[\d\s\-\(\)]{7,20}$"
URL = r"(?i)^https?://[^\s]+$"
MONEY = r"^[\$£€₹¥]?\s*[\d,]+\.?\d{0,2}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ID_NAME = re.compile(r"(^id$|_id$|^id_|_key$|_pk$|_code$)", re.I)
MONEY_NAME = re.compile(r"(price|amount|total|balance|cost|fee|tax|discount|salary|income|revenue|"
                        r"payment|charge|rate$)", re.I)
DIRECT_NAME = re.compile(r"(^name$|_name$|first.?name|last.?name|full.?name|email|phone|mobile|cell|"
                         r"address|street|cnic|ssn|passport|national.?id|dob|birth|date.?of.?birth|"
                         r"salary|income|credit.?card|account.?num)", re.I)
FINANCIAL_NAME = re.compile(r"(salary|income)", re.I)
QUASI_NAME = re.compile(r"(age|gender|sex|zip|postal|city|state|country|occupation|ethnicity|race|religion)", re.I)
BOOL_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
TRUE_WORDS = ["true", "1", "yes", "t", "y"]
DATE_SHAPES = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("d/M/yyyy", "M/d/yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", ("d MMM yyyy",)),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", ("MMM d, yyyy",)),
)
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
# what every match of a pattern holds: looked for first, at a fraction of a pattern's cost
HOLDS = {"email": "@", "url": "://", "iso_date": "-"}
PATTERNS = {"email": EMAIL, "phone": PHONE, "url": URL, "money": MONEY, "iso_date": ISO_DATE}

COMPILED = 2  # columns of one aggregate of facts: with more than a hundred fields it would run uncompiled
EXACT_ROWS = 2_000_000  # above this many rows exact quantiles are found by ranking, not in one buffer


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "string"


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def text_of(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(" \t\r\n"))


def parse_number(c: Column, fam: str) -> Column:
    if fam == "numeric":
        return c.cast("double")
    if fam == "bool":
        return c.cast("int").cast("double")
    s = text_of(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_time(c: Column, fam: str) -> Column:
    """Zone-less timestamp of a date-like value, null when it is not one.

    A format is tried only on values of its shape: a failed parse costs far more than a regex.
    """
    if fam in ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    if fam != "string":
        return F.lit(None).cast("timestamp_ntz")
    s = text_of(c)
    shaped = None
    for shape, formats in DATE_SHAPES:
        parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")
        shaped = F.when(s.rlike(shape), parsed) if shaped is None else shaped.when(s.rlike(shape), parsed)
    return (F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), s.try_cast("timestamp_ntz"))
            .when(s.rlike("|".join(shape for shape, _ in DATE_SHAPES)), shaped))


def match_rate(c: Column, pattern: str) -> Column:
    """Aggregate: share of the non-null values that match."""
    return F.avg(c.cast("string").rlike(pattern).cast("double"))


def pii_class_by_name(name: str) -> str:
    if DIRECT_NAME.search(name):
        return "quasi" if FINANCIAL_NAME.search(name) else "direct"
    return "quasi" if QUASI_NAME.search(name) else "none"


def _tick(name: str) -> str:
    return f"`{name}`"


def _number_sql(c: str, fam: str) -> str:
    if fam == "numeric":
        return f"cast({c} as double)"
    s = f"trim(both ' \\t\\r\\n' from cast({c} as string))"
    return f"case when rlike({s}, r'{NUMBER}') then try_cast({s} as double) end" if fam == "string" \
        else "cast(null as double)"


def _word_sql(c: str, dtype: T.DataType) -> str:
    """The place among the boolean words of a value's text; only texts and decimals need be written out for it."""
    if isinstance(dtype, T.IntegralType):
        return f"case {c} when 1 then {BOOL_WORDS.index('1') + 1}L when 0 then {BOOL_WORDS.index('0') + 1}L end"
    if isinstance(dtype, T.BooleanType):
        return f"case when {c} then {BOOL_WORDS.index('true') + 1}L when not {c} then {BOOL_WORDS.index('false') + 1}L end"
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType) or family(dtype) in ("date", "timestamp"):
        return "cast(null as bigint)"
    words = "array(" + ", ".join(f"'{w}'" for w in BOOL_WORDS) + ")"
    s = f"trim(both ' \\t\\r\\n' from cast({c} as string))"
    return f"case when length({s}) <= 5 then array_position({words}, lower({s})) end"


def _parsed(df: DataFrame, cols: Sequence[str], fams: Mapping[str, str], *keep: str) -> DataFrame:
    """Parse each value once: value, text, boolean-word code, number and time per column.

    Wide expressions are written as SQL text: one call per column instead of hundreds.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [F.col(k) for k in keep]
    for i, name in enumerate(cols):
        c, fam = _tick(name), fams[name]
        s = f"trim(both ' \\t\\r\\n' from cast({c} as string))" if fam == "string" else "cast(null as string)"
        when = parse_time(F.col(c), fam)
        out += [F.expr(f"{c} as v{i}"), F.expr(f"{s} as s{i}"), F.expr(f"{_word_sql(c, types[name])} as w{i}"),
                F.expr(f"{_number_sql(c, fam)} as x{i}"), when.alias(f"t{i}")]
    return df.select(*out)


def _facts_sql(i: int, fam: str, dtype: T.DataType, times: str | None = None) -> str:
    """All facts of a column, of rows or of values that each stand for so many rows (``times``; no moments then)."""
    is_text, is_num = fam == "string", fam in ("numeric", "string")
    is_time = fam in ("date", "timestamp", "string")
    true_codes = ", ".join(str(BOOL_WORDS.index(t) + 1) for t in TRUE_WORDS)

    def only(flag: bool, sql: str, dtype: str, empty: str = "null") -> str:
        return sql if flag else f"max(cast({empty} as {dtype}))"

    def matches(kind: str) -> str:
        held = f"contains(s{i}, '{HOLDS[kind]}') and " if kind in HOLDS else ""
        return f"{held}rlike(s{i}, r'{PATTERNS[kind]}')"

    def number_of(cond: str) -> str:
        return f"coalesce(sum(case when {cond} then {times} end), 0)" if times else f"count_if({cond})"

    def number_with(c: str) -> str:
        return number_of(f"{c} is not null") if times else f"count({c})"

    n = f"cast(count(x{i}) as double)"
    skew = f"case when {n} > 2 then skewness(x{i}) * sqrt({n} * ({n} - 1)) / ({n} - 2) else 0.0D end"
    kurt = (f"case when {n} > 3 then ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis(x{i}) + 6) "
            "else 0.0D end")
    size = f"length(cast(v{i} as string))"
    moments = is_num and not times
    mean_size = f"sum({size} * {times}) / sum(case when v{i} is not null then {times} end)" if times else f"avg({size})"
    whole = number_with(f"x{i}") if isinstance(dtype, T.IntegralType) else number_of(f"x{i} - rint(x{i}) = 0")
    parts = {
        "n_total": number_of("true") if times else "count(*)", "n": number_with(f"v{i}"), "bool_hits": number_of(f"w{i} > 0"),
        "bool_words": f"bit_count(coalesce(bit_or(case when w{i} > 0 then shiftleft(1, cast(w{i} as int)) end), 0))",
        "true_hits": number_of(f"w{i} in ({true_codes})"),
        "num_hits": only(is_num, number_with(f"x{i}"), "bigint", "0"),
        "whole_hits": only(is_num, whole, "bigint", "0"),
        **{f"{k}_hits": only(is_text, number_of(matches(k)), "bigint", "0") for k in PATTERNS},
        "time_hits": only(is_time, number_with(f"t{i}"), "bigint", "0"),
        "midnight_hits": only(is_time, number_of(f"t{i} = cast(date_trunc('day', t{i}) as timestamp_ntz)"), "bigint", "0"),
        "min": only(is_num, f"min(x{i})", "double"), "max": only(is_num, f"max(x{i})", "double"),
        "mean": only(moments, f"avg(x{i})", "double"), "std": only(moments, f"stddev_samp(x{i})", "double"),
        "skewness": only(moments, skew, "double"), "kurtosis": only(moments, kurt, "double"),
        "first_time": only(is_time, f"min(t{i})", "timestamp_ntz"),
        "last_time": only(is_time, f"max(t{i})", "timestamp_ntz"),
        "avg_length": only(is_text, mean_size, "double"),
        "max_length": only(is_text, f"cast(max({size}) as bigint)", "bigint"),
        "min_length": only(is_text, f"cast(min({size}) as bigint)", "bigint"),
    }
    return "struct(" + ", ".join(f"{sql} as {k}" for k, sql in parts.items()) + ")"


def _facts_of_rows(df: DataFrame, cols: Sequence[str], fams: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """Facts found on the rows, of ``COMPILED`` columns a pass, which reads these only.  ``names`` gives the positions."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for start in range(0, len(cols), COMPILED):
        some = cols[start:start + COMPILED]
        found = one_row_per_column(_parsed(df, some, fams), {c: _facts_sql(i, fams[c], types[c]) for i, c in enumerate(some)})
        at = ", ".join(f"'{c}', {names.index(c)}" for c in some)
        parts.append(found.withColumn("position", F.expr(f"map({at})[column]")))
    return reduce(DataFrame.unionAll, parts)


def moments(values: Sequence[tuple[float, int]]) -> dict[str, float | None]:
    """Mean, deviation and shape of distinct values, each with its number of rows."""
    n = float(sum(k for _, k in values))
    if not n:
        return {"mean": None, "std": None, "skewness": 0.0, "kurtosis": 0.0}
    mean = sum(x * k for x, k in values) / n if len(values) > 1 else values[0][0]
    m2, m3, m4 = (sum(p) for p in zip(*(_powers(x - mean, k) for x, k in values), strict=True))
    bent = peaked = None
    if m2 / n:
        std = math.sqrt(m2 / n)
        bent, peaked = m3 / n / std / std / std, m4 * n / m2 / m2 - 3
    return {"mean": mean, "std": math.sqrt(m2 / (n - 1)) if n > 1 else None,
            "skewness": 0.0 if n <= 2 else None if bent is None else bent * math.sqrt(n * (n - 1)) / (n - 2),
            "kurtosis": 0.0 if n <= 3 else None if peaked is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * peaked + 6)}


def _powers(d: float, k: int) -> tuple[float, float, float]:
    return k * d * d, k * d * d * d, k * d * d * d * d


def quantiles_of(values: Sequence[tuple[float, int]], qs: Sequence[float]) -> list[float] | None:
    """Linear-interpolated quantiles of sorted distinct values, each with its number of rows."""
    upto = list(accumulate(k for _, k in values))
    out = []
    for q in qs if values else ():
        h = q * (upto[-1] - 1)
        a, b = (values[bisect_right(upto, r)][0] for r in (math.floor(h), math.ceil(h)))
        out.append((math.ceil(h) - h) * a + (h - math.floor(h)) * b if a != b else a)
    return out or None


def _facts_of_values(df: DataFrame, cols: Sequence[str], fams: Mapping[str, str], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, quantiles) of columns of few values.  Rows are only counted by value; parsing, patterns, moments
    and ranks need each value once."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        values = _parsed(df.groupBy(F.col(_tick(c))).agg(F.count("*").alias("__n")), [c], fams, "__n")
        found = values.selectExpr(f"{_facts_sql(0, fams[c], types[c], '__n')} as f",
                                  "collect_list(case when x0 is not null then struct(x0, __n) end) as xs")  # few, as was counted
        parts.append(found.selectExpr(f"'{c}' as column", f"{names.index(c)} as position", "f.*", "xs"))
    both = reduce(DataFrame.unionAll, parts)
    fields = [f for f in both.schema.fields if f.name != "xs"]
    times = [f.name for f in fields if isinstance(f.dataType, T.TimestampNTZType)]  # as texts: Python's have no year 10000
    facts, ranked = [], []
    for r in both.withColumns({t: F.col(t).cast("string") for t in times}).collect():  # one row per column
        rows: Counter[float] = Counter()  # texts may write one number in several ways
        for x, k in r["xs"]:
            rows[x] += k
        xs = sorted(rows.items(), key=lambda e: (math.isnan(e[0]), e[0]))  # what is not a number is the largest
        of_xs = moments(xs) if fams[r["column"]] in ("numeric", "string") else {}
        facts.append(tuple(of_xs.get(f.name, r[f.name]) for f in fields))
        ranked.append((r["column"], quantiles_of(xs, QUANTILES)))
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in fields])
    made = df.sparkSession.createDataFrame(facts, plain).withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})
    return made, df.sparkSession.createDataFrame(ranked, "column string, quantiles array<double>")


def _quantiles_sql(name: str, fam: str, exact: bool) -> str:
    if fam not in ("numeric", "string"):
        return "struct(max(cast(null as array<double>)) as quantiles)"
    q, x = "array(" + ", ".join(f"{p}D" for p in QUANTILES) + ")", _number_sql(_tick(name), fam)
    call = f"percentile({x}, {q})" if exact else f"percentile_approx({x}, {q}, 10000)"
    return f"struct({call} as quantiles)"


def _ranked_quantiles(df: DataFrame, cols: Sequence[str], fams: Mapping[str, str]) -> DataFrame:
    numbers = {str(i): F.expr(_number_sql(_tick(c), fams[c])) for i, c in enumerate(cols) if fams[c] in ("numeric", "string")}
    found = exact_quantiles_of(df, numbers, QUANTILES) if numbers else {}
    rows = [(c, i, found.get(str(i))) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, quantiles array<double>")


def one_row_per_column(df: DataFrame, structs: dict[str, str]) -> DataFrame:
    """Evaluate one struct of aggregates per column in a single pass, then unpivot the only row."""
    wide = df.selectExpr(*[f"{sql} as __{i}" for i, sql in enumerate(structs.values())])
    items = ", ".join(f"struct('{name}' as column, {i} as position, __{i} as f)" for i, name in enumerate(structs))
    return wide.selectExpr(f"explode(array({items})) as e").selectExpr("e.column", "e.position", "e.f.*")


def brief(text: Column) -> Column:
    """A text, or its 64-digit hash where it is longer: what equality needs of it moves, not more."""
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def distinct_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_unique).  Exact counts group one pruned column at a time, so no row is expanded
    k-fold; ``approx`` keeps one HyperLogLog sketch per column in a single pass.  Whole numbers are told apart
    by the bits of a word for each 64 neighbours, so that dense ones make few groups."""
    cols = list(cols or scalar_columns(df))
    if approx:
        return one_row_per_column(df, {c: f"struct(approx_count_distinct(`{c}`) as n_unique)" for c in cols}) \
            .drop("position")
    types, parts = {f.name: f.dataType for f in df.schema.fields}, []
    for c in cols:
        v = F.col(_tick(c))
        if isinstance(types[c], T.IntegralType):
            words = df.select(v.cast("bigint").alias("v")).filter("v is not null").groupBy(F.expr("shiftright(v, 6)").alias("w")) \
                .agg(F.expr("bit_or(shiftleft(1L, cast(v & 63 as int)))").alias("bits"))
            n = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("n_unique"))
        else:
            v = brief(v) if family(types[c]) == "string" else v
            n = df.select(v.alias("v")).filter("v is not null").distinct().agg(F.count("*").alias("n_unique"))
        parts.append(n.select(F.lit(c).alias("column"), "n_unique"))
    return reduce(DataFrame.unionByName, parts)


def few_values(df: DataFrame, unique: Mapping[str, int]) -> list[str]:
    """The columns whose values, each with its count, the driver may take; texts that are compared by other
    rules than their bytes are not among them."""
    limit = scale.setting(df.sparkSession, "boundedRows", scale.BOUNDED_ROWS)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c, n in unique.items() if n <= limit and (not isinstance(types[c], T.StringType) or types[c].collation == "UTF8_BINARY")]


def column_facts(df: DataFrame, cols: Sequence[str] | None = None, exact: bool | None = None,
                 approx_distinct: bool = False, unique: DataFrame | None = None,
                 quantiles: bool = False, few: Sequence[str] = ()) -> DataFrame:
    """One row of counts and moments per column.  ``unique`` may carry ready distinct counts, ``few`` the
    columns with at most ``facsimile.boundedRows`` values, of which each is looked at once."""
    cols = list(cols or scalar_columns(df))
    fams = {f.name: family(f.dataType) for f in df.schema.fields}
    spark, exact = df.sparkSession, exact is not False
    few = [c for c in cols if c in few]
    many = [c for c in cols if c not in few]
    facts, quant = _facts_of_values(df, few, fams, cols) if few else (None, None)
    if many:
        by_rank = quantiles and exact and df.count() > scale.setting(spark, "exactPercentileRows", EXACT_ROWS)
        dealt = scale.spread(df)  # much work per value
        found = _facts_of_rows(dealt, many, fams, cols)
        facts = found if facts is None else facts.unionByName(found)
        if quantiles:
            ranks = _ranked_quantiles(dealt, many, fams) if by_rank else one_row_per_column(
                dealt, {c: _quantiles_sql(c, fams[c], exact) for c in many})
            ranks = ranks.drop("position")
            quant = ranks if quant is None else quant.unionByName(ranks)
    named = spark.createDataFrame(
        [(c, fams[c], bool(MONEY_NAME.search(c)), bool(ID_NAME.search(c)), pii_class_by_name(c)) for c in cols],
        "column string, family string, money_name boolean, id_name boolean, pii_name string")
    facts = facts.join(F.broadcast(named), "column")  # one row per column
    uniq = unique if unique is not None else distinct_profile(df, cols, approx_distinct)
    facts = facts.join(F.broadcast(uniq), "column")  # one row per column
    if quantiles:
        facts = facts.join(F.broadcast(quant), "column")  # one row per column
        facts = facts.withColumn("method", F.lit("exact" if exact else "approx"))
    return facts


CLOCK = "case when midnight_hits = time_hits then 'date' else 'datetime' end"
# the ordered cascade over one column's facts; the first match wins
KIND = f"""case when n = 0 then 'text'
  when family = 'bool' then 'bool'
  when bool_hits = n and bool_words <= 3 then 'bool'
  when family = 'numeric' and money_name then 'money'
  when family = 'numeric' and whole_hits = n then 'int'
  when family = 'numeric' then 'num'
  when family in ('date', 'timestamp') then {CLOCK}
  when num_hits / n >= 0.9 and money_name then 'money'
  when num_hits / n >= 0.9 then 'num'
  when email_hits / n > 0.7 then 'email'
  when iso_date_hits / n > 0.9 and time_hits / n >= 0.9 then {CLOCK}
  when phone_hits / n > 0.7 then 'phone'
  when url_hits / n > 0.7 then 'url'
  when time_hits / n >= 0.9 then {CLOCK}
  when money_hits / n > 0.7 then 'money'
  when n_unique <= greatest(20, floor(0.05D * n)) then 'cat'
  else 'text' end"""


def kind_of_facts() -> Column:
    return F.expr(KIND)


def infer_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return column_facts(df, cols).select("column", kind_of_facts().alias("kind"))


PII = "case when n > 0 and email_hits / n > 0.7 then 'direct' else pii_name end"


def pii_of_facts() -> Column:
    return F.expr(PII)


def profile(df: DataFrame, cols: Sequence[str] | None = None, primary_key: str | None | bool = True,
            exact: bool | None = None, approx_distinct: bool = False) -> DataFrame:
    """One row per column.  ``primary_key`` may be given, detected (True) or skipped (None)."""
    from facsimile.operators import keys

    cols = list(cols or scalar_columns(df))
    counted = distinct_profile(df, cols, approx_distinct).collect()
    unique = df.sparkSession.createDataFrame(counted, "column string, n_unique bigint")
    few = [] if exact is False else few_values(df, {r["column"]: r["n_unique"] for r in counted})
    if primary_key is True:
        primary_key = keys.detect_primary_key(df, cols, unique)
    f = column_facts(df, cols, exact, unique=unique, quantiles=True, few=few).withColumn("kind", kind_of_facts())
    pk = "column = '" + primary_key + "'" if primary_key else "false"
    num = "kind in ('int', 'num', 'money') and num_hits > 0"
    day = "kind in ('date', 'datetime') and time_hits > 0"
    text = "kind = 'text' and n > 0"
    keep = {"min": num, "max": num, "max_length": text, "min_length": text}
    return f.selectExpr(
        "column", "position",
        f"case when {pk} or (id_name and n_unique / greatest(n_total, 1) >= 0.95) then 'id' else kind end as kind",
        "n_total", "n_total - n as null_count",
        "round(case when n_total > 0 then (n_total - n) / n_total else 0 end, 4) as null_rate", "n_unique",
        f"{PII} as pii", f"{pk} as is_primary_key",
        *[f"case when {cond} then {c} end as {c}" for c, cond in keep.items()],
        *[f"case when {num} then round({c}, 4) end as {c}" for c in ("mean", "std", "skewness", "kurtosis")],
        f"case when {num} then round(quantiles[3], 4) end as median",
        f"case when {num} then transform(quantiles, v -> round(v, 4)) end as quantiles",
        f"case when {day} then cast(first_time as date) end as min_date",
        f"case when {day} then cast(last_time as date) end as max_date",
        f"case when {day} then timestampdiff(DAY, first_time, last_time) end as date_range_days",
        "case when kind = 'bool' and n > 0 then round(true_hits / n, 4) end as true_rate",
        f"case when {text} then round(avg_length, 1) end as avg_length", "method")


def category_profile(df: DataFrame, cols: Sequence[str], top: int = 50) -> DataFrame:
    """The most frequent values per column: (column, value, n, weight, rank).

    Each column is its own top-k (count descending, then value), so no window has to hold a
    whole column's values.
    """
    parts = []
    for c in cols:
        vals = df.select(F.col(f"`{c}`").cast("string").alias("value")).filter("value is not null")
        counts = vals.groupBy("value").agg(F.count("*").alias("n"))
        best = counts.orderBy(F.desc("n"), "value").limit(top)
        ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value"))).alias("a"))
        ranked = ranked.select(F.posexplode("a").alias("i", "e"))  # at most ``top`` items
        total = vals.agg(F.count("*").alias("t")).scalar()
        parts.append(ranked.select(
            F.lit(c).alias("column"), F.col("e.value").alias("value"), (-F.col("e.k")).alias("n"),
            F.round((-F.col("e.k")) / total, 4).alias("weight"), (F.col("i") + 1).alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or scalar_columns(df))
    return one_row_per_column(df, {c: f"struct(count_if(`{c}` is null) as null_count, "
                                      f"round(avg(cast(`{c}` is null as double)), 4) as null_rate)"
                                   for c in cols}).drop("position")


# --- what may leave the building ---------------------------------------------------------------


def safe_profile(prof: DataFrame, categories: DataFrame, pii_cols: Sequence[str] = ()) -> DataFrame:
    """Allow-list view of a profile: aggregates only for columns without personal data, category
    names only for low-cardinality category columns."""
    pii = (F.col("pii") != "none") | F.col("column").isin(list(pii_cols))
    names = categories.filter("rank <= 30").groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("__c"))  # at most 30 per column
    out = prof.join(F.broadcast(names), "column", "left")  # one row per column
    clear = lambda c: F.when(~pii, F.col(c)).alias(c)
    show = ~pii & (F.col("kind") == "cat") & (F.col("n_unique") <= 50)
    return out.select("column", "position", "kind", "null_rate", "n_unique", pii.alias("is_pii"),
                      *[clear(c) for c in ("min", "max", "mean", "median", "std", "quantiles", "skewness",
                                           "kurtosis", "date_range_days")],
                      F.when(show, F.transform("__c", lambda e: e["value"])).alias("categories"))


def leak_check(payload: str | Column, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Source values longer than five characters that occur inside the payload text."""
    text = F.lit(payload) if isinstance(payload, str) else payload
    parts = []
    for f in df.schema.fields:
        if f.name not in (cols or scalar_columns(df)):
            continue
        v = df.select(F.col(f"`{f.name}`").cast("string").alias("value")).filter("value is not null").distinct()
        hit = (F.length("value") > 5) & (F.instr(text, F.col("value")) > 0)
        hit = hit & ~F.col("value").isin(f.name, f.dataType.simpleString())
        parts.append(v.filter(hit).select(F.lit(f.name).alias("column"), "value"))
    return reduce(DataFrame.unionByName, parts)


def payload_audit(payloads: DataFrame, payload_id: str, prompt: str) -> DataFrame:
    """Per shared payload: a hash of its canonical JSON, columns shared, prompt length, redactions.

    ``payloads`` has one row per shared column (``column``, ``is_pii``) of each payload.
    """
    body = F.to_json(F.array_sort(F.collect_list(F.struct("column", "is_pii"))))  # a table's columns
    return payloads.groupBy(payload_id, prompt).agg(
        F.sha2(F.concat(body, F.lit("\n"), F.max(prompt)), 256).alias("hash"), F.count("*").alias("columns_shared"),
        F.length(F.max(prompt)).alias("prompt_length"),
        F.count_if("is_pii").alias("pii_columns_redacted")).drop(prompt)
