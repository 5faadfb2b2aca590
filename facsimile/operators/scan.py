"""Personal-data scan: value patterns and column names give one verdict per column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.operators import profile as pf

# Value patterns and name patterns of the scan.
PATTERNS = {
    "email": pf.EMAIL,
    "phone": pf.PHONE,
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "national": r"^\d{5}-?\d{7}-?\d{1}$",
    "card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "iso_date": pf.ISO_DATE,
}
DIRECT_HEADER = re.compile(r"(^name$|_name$|first.?name|last.?name|full.?name|email|phone|mobile|cell|"
                           r"cnic|ssn|passport|national.?id|credit.?card|card.?number|account.?num|iban|"
                           r"ip.?addr|mac.?addr|date.?of.?birth|^dob$)", re.I)
QUASI_HEADER = re.compile(r"(^age$|age.?group|^gender$|^sex$|zip.?code|postal.?code|^zip$|"
                          r"city|state|province|country|region|district|occupation|job.?title|profession|"
                          r"ethnicity|race|religion|nationality|education|degree|marital|"
                          r"salary|income|^dob$|birth.?year|year.?of.?birth)", re.I)
SENSITIVE_HEADER = re.compile(r"(salary|income|wage|compensation|health|diagnosis|medical|prescription|"
                              r"criminal|arrest|conviction|political|religion|sexual|disability|"
                              r"password|secret|token|api.?key)", re.I)
QUASI_TYPES = (
    ("geographic", re.compile(r"(zip|postal|city|state|country|region|district)", re.I)),
    ("demographic", re.compile(r"(age|birth|dob|gender|sex)", re.I)),
    ("professional", re.compile(r"(occupation|job|profession|education)", re.I)),
    ("financial", pf.FINANCIAL_NAME),
)

# verdicts: level, type, how it was found, suggested action, confidence
Verdict = tuple[str, str | None, str | None, str, str]
NOTHING: Verdict = ("none", None, None, "keep", "high")
BY_VALUE: dict[str, Verdict] = {
    "email": ("direct", "email", "value_pattern", "synthetic", "high"),
    "phone": ("direct", "phone", "value_pattern", "synthetic", "high"),
    "national_id": ("direct", "national_id", "value_pattern", "hash", "high"),
    "credit_card": ("direct", "credit_card", "value_pattern", "mask", "high"),
    "ip_address": ("direct", "ip_address", "value_pattern", "hash", "high"),
}
RULES = {
    "email": "email_rate > 0.5", "phone": "phone_rate > 0.5",
    "national_id": "(ssn_rate > 0.3 or national_rate > 0.3)", "credit_card": "card_rate > 0.3",
    "ip_address": "ip_rate > 0.5",
}
# The loose phone pattern also fits dates, national ids and cards, so the default tests it last
# and never on dates or plain numbers; "reference" keeps the historic order.
ORDERS = {
    "specific_first": ("national_id", "credit_card", "ip_address", "email", "phone"),
    "reference": ("email", "phone", "national_id", "credit_card", "ip_address"),
}
PROBABLE_NAME: Verdict = ("direct", "probable_name", "heuristic", "synthetic", "review")


def header_verdict(name: str) -> Verdict | None:
    if DIRECT_HEADER.search(name):
        if pf.FINANCIAL_NAME.search(name):
            return ("quasi", "financial", "header_match", "dp_noise", "high")
        kind = "name" if "name" in name.lower() else "identifier"
        return ("direct", kind, "header_match", "synthetic", "high")
    if QUASI_HEADER.search(name):
        kind = next((k for k, rx in QUASI_TYPES if rx.search(name)), "demographic")
        return ("quasi", kind, "header_match", "dp_noise", "review")
    if SENSITIVE_HEADER.search(name):
        return ("quasi", "sensitive", "header_match", "dp_noise", "review")
    return None


def _facts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    structs = {}
    for c in cols:
        s = f"cast(`{c}` as string)"
        rates = [f"coalesce(avg(cast(rlike({s}, r'{p}') as double)), 0) as {k}_rate" for k, p in PATTERNS.items()]
        structs[c] = (f"struct(count(`{c}`) as n, {', '.join(rates)}, "
                      f"avg(length({s}) - length(replace({s}, ' ', ''))) as spaces, "
                      f"max(rlike({s}, r'\\d')) as digits)")
    return pf.one_row_per_column(df, structs).join(F.broadcast(pf.distinct_profile(df, cols)), "column")


def _fields(v: Verdict) -> str:
    txt = ["null" if x is None else f"'{x}'" for x in v]
    return (f"struct({txt[0]} as pii_level, cast({txt[1]} as string) as pii_type, cast({txt[2]} as string) as detected_by, "
            f"{txt[3]} as suggested_action, {txt[4]} as confidence)")


def scan(df: DataFrame, cols: Sequence[str] | None = None, order: str = "specific_first") -> DataFrame:
    """One verdict per column: every value of every column is tested, in one pass."""
    cols = list(cols or pf.scalar_columns(df))
    fams = {f.name: pf.family(f.dataType) for f in df.schema.fields}
    spark = df.sparkSession
    heads = []
    for c in cols:
        v = header_verdict(c)
        heads.append((c, fams[c], v))
    named = spark.createDataFrame([(c, fam, v) for c, fam, v in heads],
                                  "column string, family string, header struct<pii_level:string,pii_type:string,"
                                  "detected_by:string,suggested_action:string,confidence:string>")
    facts = _facts(df, cols).join(F.broadcast(named), "column")  # one row per column
    whens = []
    for kind in ORDERS[order]:
        rule = RULES[kind]
        if kind == "phone" and order == "specific_first":
            rule += " and family = 'string' and iso_date_rate <= 0.9"
        whens.append(f"when {rule} then {_fields(BY_VALUE[kind])}")
    name_like = ("family = 'string' and n > 20 and n_unique / n > 0.8 and spaces > 0.5 and spaces < 3 "
                 "and not coalesce(digits, false)")
    verdict = (f"case {' '.join(whens)} when header is not null then header "
               f"when {name_like} then {_fields(PROBABLE_NAME)} else {_fields(NOTHING)} end")
    return facts.selectExpr("column", "position", f"{verdict} as v").selectExpr("column", "position", "v.*")


def combination_risk(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Smallest group and share of small groups over all quasi-identifiers given."""
    cols = list(quasi)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame(
            [("low", 0, 0.0, "")], "risk string, min_k bigint, pct_groups_below_5 double, columns_checked string")
    return group_sizes(df, cols).agg(
        F.coalesce(F.min("n"), F.lit(0)).alias("min_k"),
        F.round(F.coalesce(F.avg((F.col("n") < 5).cast("double")), F.lit(0.0)), 3).alias("pct_groups_below_5"),
    ).selectExpr(
        "case when min_k <= 1 then 'high' when min_k <= 3 or pct_groups_below_5 > 0.2 then 'moderate' "
        "else 'low' end as risk", "min_k", "pct_groups_below_5", f"'{','.join(cols)}' as columns_checked")


def group_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per group; nulls form a group of their own, apart from any text."""
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("n"))


def scan_table(df: DataFrame, cols: Sequence[str] | None = None, order: str = "specific_first") -> DataFrame:
    """``scan`` plus the combination risk of the quasi-identifiers, on each of them."""
    found = scan(df, cols, order).orderBy("position").collect()  # one row per column
    spark = df.sparkSession
    schema = ("column string, position int, pii_level string, pii_type string, detected_by string, "
              "suggested_action string, confidence string")
    base = spark.createDataFrame([tuple(r) for r in found], schema)
    quasi = [r["column"] for r in found if r["pii_level"] == "quasi"]
    if len(quasi) < 2:
        return base.withColumns({"risk": F.lit(None).cast("string"), "min_k": F.lit(None).cast("bigint"),
                                 "pct_groups_below_5": F.lit(None).cast("double"),
                                 "columns_checked": F.lit(None).cast("string")})
    risk = combination_risk(df, quasi).withColumn("pii_level", F.lit("quasi"))
    return base.join(F.broadcast(risk), "pii_level", "left")  # one row


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count("*").alias("total_columns"),
                       F.count_if(F.col("pii_level") == "direct").alias("direct_pii"),
                       F.count_if(F.col("pii_level") == "quasi").alias("quasi_identifiers"),
                       F.count_if(F.col("pii_level") == "none").alias("safe_columns"))


def suggest_epsilon(scanned: DataFrame, rows: int | Column, only_pii: bool = True) -> DataFrame:
    """Starting noise level per column."""
    n = rows if isinstance(rows, Column) else F.lit(rows)
    out = scanned.filter("pii_level <> 'none'") if only_pii else scanned
    eps = (F.when(F.col("pii_level") == "direct", 0.1)
           .when(F.col("pii_level") == "quasi", F.when(n < 1000, 1.0).otherwise(2.0)).otherwise(5.0))
    return out.select("column", "pii_level", eps.alias("suggested_epsilon")).withColumn(
        "noise_level", F.when(F.col("suggested_epsilon") < 1, "heavy")
        .when(F.col("suggested_epsilon") < 3, "moderate").otherwise("light"))
