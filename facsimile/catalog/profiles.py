"""Profiling and key-detection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.people import CONTACTS, CONTACTS_SQL, contacts
from facsimile.catalog.registry import query
from facsimile.operators import keys
from facsimile.operators import profile as pf
from facsimile.operators.quantiles import exact_quantiles_of

NUM, TXT, TS = "numeric", "string", "timestamp"
COLUMNS = {
    "customer": {"c_custkey": NUM, "c_name": TXT, "c_nationkey": NUM, "c_acctbal": NUM, "c_mktsegment": TXT},
    "orders": {"o_orderkey": NUM, "o_custkey": NUM, "o_orderstatus": TXT, "o_totalprice": NUM, "o_orderdate": TS,
               "o_orderpriority": TXT},
    "lineitem": {"l_orderkey": NUM, "l_partkey": NUM, "l_suppkey": NUM, "l_linenumber": NUM, "l_quantity": NUM,
                 "l_extendedprice": NUM, "l_discount": NUM, "l_tax": NUM, "l_returnflag": TXT, "l_linestatus": TXT,
                 "l_shipdate": TS},
    "part": {"p_partkey": NUM, "p_name": TXT, "p_brand": TXT, "p_type": TXT, "p_size": NUM, "p_retailprice": NUM},
    "events": {"event_id": NUM, "ts": TS, "user_id": NUM, "event_type": TXT, "value": NUM, "props": TXT},
    "documents": {"doc_id": NUM, "text": TXT, "lang": TXT, "source": TXT, "n_chars": NUM},
    "pages": {"page_id": NUM, "url": TXT, "html": TXT},
    "conversations": {"conv_id": NUM, "turn": NUM, "role": TXT, "text": TXT},
    "labels": {"doc_id": NUM, "quality": NUM, "toxic": NUM},
    CONTACTS_SQL: {c: NUM if c in ("customer_id", "age", "salary") else TXT for c in CONTACTS},
}
WORDS = q.array(pf.BOOL_WORDS)
TRUES = q.array(pf.TRUE_WORDS)


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def facts_sql(table: str, col: str, fam: str) -> str:
    """One row of facts about a column, written from the definitions."""
    s = f"trim(cast({col} as varchar), ' \t\r\n')"
    if fam == NUM:
        x = f"cast({col} as double)"
    else:
        x = f"case when regexp_matches({s}, {rx(pf.NUMBER)}) then try_cast({s} as double) end"
    if fam == TS:
        tm = f"cast({col} as timestamp)"
    elif fam == TXT:
        tm = f"case when regexp_matches({s}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_cast({s} as timestamp) end"
    else:
        tm = "null::timestamp"
    num = fam in (NUM, TXT)
    hit = {k: (f"count(*) filter (where regexp_matches({s}, {rx(p)}))" if fam == TXT else "0")
           for k, p in pf.PATTERNS.items()}
    n = f"count({x})" if num else "0"
    quant = ("quantile_cont(x, [" + ",".join(map(str, pf.QUANTILES)) + "])") if num else "null::double[]"
    return f"""select '{col}' as col, '{fam}' as family, {str(bool(pf.MONEY_NAME.search(col))).lower()} as money_name,
 {str(bool(pf.ID_NAME.search(col))).lower()} as id_name, '{pf.pii_class_by_name(col)}' as pii_name,
 count(*) as n_total, count(v) as n, count(distinct v) as n_unique,
 count(*) filter (where lower(s) in (select unnest({WORDS}))) as bool_hits,
 count(distinct case when lower(s) in (select unnest({WORDS})) then lower(s) end) as bool_words,
 count(*) filter (where lower(s) in (select unnest({TRUES}))) as true_hits,
 {"count(x)" if num else "0"} as num_hits, {"count(*) filter (where x - floor(x) = 0)" if num else "0"} as whole_hits,
 {", ".join(f"{h.replace(s, 's')} as {k}_hits" for k, h in hit.items())},
 count(tm) as time_hits, count(*) filter (where tm = date_trunc('day', tm)) as midnight_hits,
 min(x) as mn, max(x) as mx, avg(x) as mean, stddev_samp(x) as std, {quant} as qs,
 {"case when count(x) > 2 and stddev_samp(x) > 0 then skewness(x) else null end" if num else "null::double"} as skewness,
 {"case when count(x) > 3 and stddev_samp(x) > 0 then kurtosis(x) else null end" if num else "null::double"} as kurtosis,
 min(tm) as t0, max(tm) as t1, avg(length(cast(v as varchar))) as avg_length, max(length(cast(v as varchar))) as max_length,
 min(length(cast(v as varchar))) as min_length
 from (select {col} as v, {s} as s, {x if num else 'null::double'} as x, {tm} as tm from {table})""".replace(n, n)


KIND_SQL = """case when n = 0 then 'text' when bool_hits = n and bool_words <= 3 then 'bool'
 when family = 'numeric' and money_name then 'money' when family = 'numeric' and whole_hits = n then 'int'
 when family = 'numeric' then 'num'
 when family = 'timestamp' then case when midnight_hits = time_hits then 'date' else 'datetime' end
 when num_hits >= 0.9*n and money_name then 'money' when num_hits >= 0.9*n then 'num'
 when email_hits > 0.7*n then 'email'
 when iso_date_hits > 0.9*n and time_hits >= 0.9*n then case when midnight_hits = time_hits then 'date' else 'datetime' end
 when phone_hits > 0.7*n then 'phone' when url_hits > 0.7*n then 'url'
 when time_hits >= 0.9*n then case when midnight_hits = time_hits then 'date' else 'datetime' end
 when money_hits > 0.7*n then 'money' when n_unique <= greatest(20, floor(0.05*n)) then 'cat' else 'text' end"""


def all_facts(table: str) -> str:
    return f"(select *, {KIND_SQL} as kind0 from ({q.union_all([facts_sql(table, c, f) for c, f in COLUMNS[table].items()])}))"


def profile_sql(table: str, pk: str | None) -> str:
    num = "kind0 in ('int','num','money') and num_hits > 0"
    day = "kind0 in ('date','datetime') and time_hits > 0"
    txt = "kind0 = 'text' and n > 0"
    is_pk = f"col = '{pk}'" if pk else "false"
    return f"""select col as "column", case when {is_pk} or (id_name and n_unique >= 0.95*n_total) then 'id' else kind0 end as kind,
 n_total, n_total - n as null_count, round((n_total-n)::double/n_total, 4) as null_rate, n_unique,
 case when email_hits > 0.7*n then 'direct' else pii_name end as pii, {is_pk} as is_primary_key,
 case when {num} then mn end as "min", case when {num} then mx end as "max", case when {num} then round(mean,4) end as mean,
 case when {num} then round(qs[4],4) end as median, case when {num} then round(std,4) end as std,
 case when {num} then round(skewness,4) end as skewness, case when {num} then round(kurtosis,4) end as kurtosis,
 case when {num} then round(qs[1],4) end as q01, case when {num} then round(qs[2],4) end as q05,
 case when {num} then round(qs[3],4) end as q25, case when {num} then round(qs[5],4) end as q75,
 case when {num} then round(qs[6],4) end as q95, case when {num} then round(qs[7],4) end as q99,
 case when {day} then strftime(t0,'%Y-%m-%d') end as min_date, case when {day} then strftime(t1,'%Y-%m-%d') end as max_date,
 case when {day} then (date_sub('day', t0, t1)) end as date_range_days,
 case when kind0 = 'bool' and n > 0 then round(true_hits::double/n,4) end as true_rate,
 case when {txt} then round(avg_length,1) end as avg_length, case when {txt} then max_length end as max_length,
 case when {txt} then min_length end as min_length from {all_facts(table)}"""


def flat(p: DataFrame) -> DataFrame:
    cols = [c for c in p.columns if c not in ("position", "quantiles", "method")]
    names = ("q01", "q05", "q25", None, "q75", "q95", "q99")
    return p.select(*[F.col(c).cast("string").alias(c) if c in ("min_date", "max_date") else F.col(c) for c in cols],
                    *[F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(names) if n])


@query("profile_to_contract", """with s as (select min(c_nationkey) a, max(c_nationkey) b, min(c_acctbal) c, max(c_acctbal) d, min(c_custkey) e, max(c_custkey) f,
  count(distinct c_mktsegment) <= greatest(20, floor(0.05*count(*))) as few from customer)
 select 'c_custkey' as "column", 'id' as kind, true as is_unique, 'none' as pii, 'keep' as action, e::double as low, f::double as high from s
 union all select 'c_name', 'text', false, 'direct', 'synthetic', null, null
 union all select 'c_nationkey', 'int', false, 'none', 'keep', a, b from s
 union all select 'c_acctbal', 'num', false, 'none', 'keep', c, d from s
 union all select 'c_mktsegment', case when few then 'cat' else 'text' end, false, 'none', 'keep', null, null from s""")
def _(t):
    from facsimile.plans import contract
    made = contract.from_profile(pf.profile(t.customer).collect(), "customer")  # one row per column
    return t.spark.createDataFrame([(c.name, c.kind, c.unique, c.pii, c.privacy_action, c.minimum, c.maximum) for c in made.columns],
                                   "column string, kind string, is_unique boolean, pii string, action string, low double, high double")


PKS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_extendedprice", "part": "p_partkey", "events": "event_id",
       "documents": "doc_id"}

for _table, _pk in PKS.items():
    query(f"profile_{_table}", profile_sql(_table, _pk))(
        lambda t, table=_table: flat(pf.profile(getattr(t, table))))
query("profile_contacts", profile_sql(CONTACTS_SQL, "customer_id"))(lambda t: flat(pf.profile(contacts(t))))


@query("infer_kinds", q.union_all([f"""select '{n}' as "table", col as "column", kind0 as kind from {all_facts(n)}"""
                                   for n in ("customer", "orders", "part", "events", "pages", "conversations", "labels")]))
def _(t):
    parts = [pf.infer_kinds(getattr(t, n)).select(F.lit(n).alias("table"), "column", "kind")
             for n in ("customer", "orders", "part", "events", "pages", "conversations", "labels")]
    return reduce(DataFrame.unionByName, parts)


@query("match_rates", "select " + ", ".join(
    f"round(avg(regexp_matches({c}, {rx(pf.PATTERNS[p])})::int::double), 6) as {c}_{p}"
    for c, p in (("email", "email"), ("phone_line", "phone"), ("signup", "iso_date"), ("signup", "phone"),
                 ("site", "url"), ("price_text", "money"))) + f" from {CONTACTS_SQL}")
def _(t):
    return contacts(t).agg(*[F.round(pf.match_rate(F.col(c), pf.PATTERNS[p]), 6).alias(f"{c}_{p}") for c, p in (
        ("email", "email"), ("phone_line", "phone"), ("signup", "iso_date"), ("signup", "phone"), ("site", "url"),
        ("price_text", "money"))])


@query("pii_classes", f"""select col as "column", case when email_hits > 0.7*n then 'direct' else pii_name end as pii
 from {all_facts(CONTACTS_SQL)}""")
def _(t):
    return pf.column_facts(contacts(t)).select("column", pf.pii_of_facts().alias("pii"))


@query("null_profile", f"""select * from (select 'segment' as "column", count(*) filter (where segment is null) as null_count,
  round(avg((segment is null)::int::double),4) as null_rate from {CONTACTS_SQL})
 union all select 'email', count(*) filter (where email is null), round(avg((email is null)::int::double),4) from {CONTACTS_SQL}""")
def _(t):
    return pf.null_profile(contacts(t), ["segment", "email"])


@query("distinct_profile", q.union_all([f"""select '{c}' as "column", count(distinct {c}) as n_unique from lineitem"""
                                        for c in COLUMNS["lineitem"]]))
def _(t):
    return pf.distinct_profile(t.lineitem)


def category_sql(table: str, col: str, top: int) -> str:
    return f"""select * from (select '{col}' as "column", {col} as value, count(*) as n,
 round(count(*)::double/(select count({col}) from {table}),4) as weight,
 row_number() over (order by count(*) desc, {col}) as rank from {table} where {col} is not null group by {col}) where rank <= {top}"""


@query("category_profile", q.union_all([category_sql("part", c, 50) for c in ("p_name", "p_brand", "p_type")]))
def _(t):
    return pf.category_profile(t.part, ["p_name", "p_brand", "p_type"])


@query("approx_distinct_within_bound", """select 'ok' as status, 3 as columns""")
def _(t):
    cols = ["l_orderkey", "l_partkey", "l_suppkey"]
    both = pf.distinct_profile(t.lineitem, cols, approx=True).withColumnRenamed("n_unique", "a").join(
        pf.distinct_profile(t.lineitem, cols), "column")
    near = F.abs(F.col("a") - F.col("n_unique")) <= F.lit(0.2) * F.col("n_unique")
    return both.agg(F.when(F.bool_and(near), "ok").otherwise("off").alias("status"),
                    F.count("*").cast("int").alias("columns"))


def key_sql(table: str, cols: dict[str, str]) -> str:
    parts = []
    for i, (c, fam) in enumerate(cols.items()):
        bonus = (0.5 if pf.ID_NAME.search(c) else 0.0) + (0.4 if c.lower() in keys.KEY_NAMES else 0.0) + (
            0.1 if fam == NUM else 0.0)
        seq = (f"(select count(*) from (select lead({c}) over (order by {c}) - {c} as d from {table} where {c} is not null) "
               f"where d = 1)::double / nullif(count({c})-1, 0)") if fam == NUM else "0.0::double"
        parts.append(f"select '{table}' as \"table\", '{c}' as \"column\", count(distinct {c})::double/count({c}) as uniqueness, "
                     f"coalesce({seq},0) as sequential_rate, {bonus}::double as bonus, '{fam}' as fam from {table}")
    return (f"select \"table\", \"column\", round(uniqueness,6) as uniqueness, round(sequential_rate,6) as sequential_rate, "
            f"round(uniqueness + bonus + case when fam = 'numeric' and sequential_rate > 0.9 then 0.3 else 0 end, 6) as score "
            f"from ({q.union_all(parts)}) where uniqueness >= 0.95")


KEY_TABLES = ("customer", "orders", "part", "events", "documents", "pages")


@query("detect_primary_key", q.union_all([f"({key_sql(n, COLUMNS[n])})" for n in KEY_TABLES]))
def _(t):
    parts = [keys.key_scores(getattr(t, n)).select(
        F.lit(n).alias("table"), "column", F.round("uniqueness", 6).alias("uniqueness"),
        F.round("sequential_rate", 6).alias("sequential_rate"), F.round("score", 6).alias("score")) for n in KEY_TABLES]
    return reduce(DataFrame.unionByName, parts)


FK_TABLES = {"region": ("r_regionkey", ["r_regionkey", "r_name"]),
             "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
             "customer": ("c_custkey", list(COLUMNS["customer"])),
             "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
             "part": ("p_partkey", list(COLUMNS["part"])), "orders": ("o_orderkey", list(COLUMNS["orders"])),
             "lineitem": (None, list(COLUMNS["lineitem"]))}


def fk_sql() -> str:
    parts = []
    for t, (_, cols) in FK_TABLES.items():
        for c in cols:
            for p, (pk, _) in FK_TABLES.items():
                if p == t or pk is None:
                    continue
                parts.append(f"""select '{t}' as child_table, '{c}' as child_column, '{p}' as parent_table, '{pk}' as parent_column,
 count(*) as n, count(k) as hits, {str(keys.name_similar(c, p)).lower()} as name_similarity from
 (select distinct {c}::varchar as v from {t} where {c} is not null) a left join (select distinct {pk}::varchar as k from {p}) b on v = k""")
    return f"""select child_table, child_column, parent_table, parent_column, round(hits::double/n,3) as containment, name_similarity,
 case when hits >= 0.95*n and name_similarity then 'high' else 'review' end as confidence from ({q.union_all(parts)})
 where n >= 2 and (hits >= 0.95*n or (hits >= 0.8*n and name_similarity))"""


@query("detect_foreign_keys", fk_sql())
def _(t):
    return keys.detect_foreign_keys({n: getattr(t, n) for n in FK_TABLES}, {n: v[0] for n, v in FK_TABLES.items()})


@query("safe_profile", f"""with p as ({profile_sql('customer', 'c_custkey')}),
 c as (select "column", list(value order by rank) as categories from ({category_sql('customer', 'c_mktsegment', 30)}) group by 1)
 select p."column", kind, null_rate, n_unique, pii <> 'none' or p."column" = 'c_acctbal' as is_pii,
 case when pii = 'none' and p."column" <> 'c_acctbal' then "min" end as "min",
 case when pii = 'none' and p."column" <> 'c_acctbal' then mean end as mean,
 case when pii = 'none' and p."column" <> 'c_acctbal' and kind = 'cat' and n_unique <= 50 then array_to_string(categories, ',') end as categories
 from p left join c using ("column")""")
def _(t):
    prof = pf.profile(t.customer)
    out = pf.safe_profile(prof, pf.category_profile(t.customer, ["c_mktsegment"]), ["c_acctbal"])
    return out.select("column", "kind", "null_rate", "n_unique", "is_pii", "min", "mean",
                      F.array_join("categories", ",").alias("categories"))


PAYLOAD = '{"columns": ["p_name", "p_type"], "categories": ["ECONOMY", "small ring", "Brand#2", "Brand#17"], "n": 2000}'


@query("leak_check", q.union_all([f"""select '{c}' as "column", v as value from (select distinct cast({c} as varchar) as v from part)
 where length(v) > 5 and contains('{PAYLOAD}', v) and v not in ('{c}')""" for c in COLUMNS["part"]]))
def _(t):
    return pf.leak_check(PAYLOAD, t.part)


# one payload per conversation: the columns shared are its distinct roles
@query("payload_audit", """with r as (select distinct conv_id, role, role = 'user' as is_pii from conversations),
 g as (select conv_id, '[' || string_agg('{"column":"' || role || '","is_pii":' || is_pii::varchar || '}', ',' order by role) || ']' as body,
  count(*) as columns_shared, count(*) filter (where is_pii) as pii_columns_redacted from r group by 1)
 select conv_id, sha256(body || chr(10) || 'conv ' || conv_id::varchar) as hash, columns_shared,
  length('conv ' || conv_id::varchar) as prompt_length, pii_columns_redacted from g""")
def _(t):
    shared = t.conversations.select("conv_id", F.col("role").alias("column"), (F.col("role") == "user").alias("is_pii"),
                                    F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("prompt")).distinct()
    return pf.payload_audit(shared, "conv_id", "prompt")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


# all columns share the sketches' pass and the counting passes, whatever the size
@query("all_column_quantiles", " union all ".join(
    f"""select '{c}' as "column", unnest([{','.join(map(str, pf.QUANTILES))}]) as q, unnest(list_transform(quantile_cont({c}::double, [{','.join(map(str, pf.QUANTILES))}]),
 lambda v: round(v, 6))) as value from lineitem""" for c in NUMBERS))
def _(t):
    found = exact_quantiles_of(t.lineitem, {c: F.col(c) for c in NUMBERS}, pf.QUANTILES)
    rows = [(c, float(q), round(v, 6)) for c, values in found.items() for q, v in zip(pf.QUANTILES, values)]
    return t.spark.createDataFrame(rows, "`column` string, q double, value double")
