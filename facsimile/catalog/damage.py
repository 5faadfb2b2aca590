"""Degradation, constraint and edge-case queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.registry import query
from facsimile.operators import degrade, edge
from facsimile.operators import profile as pf

SEED = 42
KINDS = {"o_orderkey": "id", "o_custkey": "int", "o_orderstatus": "cat", "o_totalprice": "num", "o_orderdate": "date",
         "o_orderpriority": "cat"}
COLS = list(KINDS)


def orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                           F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


ORD = "(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::date as o_orderdate, o_orderpriority from orders)"
K = "o_orderkey"
N = "(select count(*) from orders)"


def shown(df):
    """Dates as text and doubles at six places, so both engines print the same."""
    for f in df.schema.fields:
        if pf.family(f.dataType) in ("date", "timestamp"):
            df = df.withColumn(f.name, F.col(f.name).cast("date").cast("string"))
        elif f.dataType.simpleString() == "double":
            df = df.withColumn(f.name, F.round(f.name, 6))
    return df


def day(c):
    return f"strftime({c},'%Y-%m-%d')"


def u(*path, lane=0, root="edge"):
    return q.u(SEED, root, *path, key=K, lane=lane)


def rank(*path, root="edge"):
    return f"row_number() over (order by {u(*path, root=root)}, {K})"


@query("inject_nulls", f"""select o_orderkey, case when {u('o_totalprice', root='nulls')} >= 0.1::double then round(o_totalprice,6) end as o_totalprice,
 case when {u('o_orderstatus', root='nulls')} >= 0.25::double then o_orderstatus end as o_orderstatus from orders""")
def _(t):
    src = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return shown(degrade.inject_nulls(src, {"o_totalprice": 0.1, "o_orderstatus": 0.25, "absent": 0.5}, K, SEED))


@query("inject_nulls_mar_mnar", f"""with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
 select a.o_orderkey, case when {q.u(SEED, 'nulls', 'o_orderstatus', key='a.o_orderkey')} >= least(2.0*0.2::double*((a.o_totalprice-lo)/(hi-lo)),1.0) then o_orderstatus end as mar_status,
  case when {q.u(SEED, 'nulls', 'o_totalprice', key='a.o_orderkey')} >= least(2.0*0.2::double*((a.o_totalprice-lo)/(hi-lo)),1.0) then round(o_totalprice,6) end as mnar_price
 from orders a, s""")
def _(t):
    mar = degrade.inject_nulls(t.orders, {"o_orderstatus": 0.2}, K, SEED, "MAR", "o_totalprice")
    mnar = degrade.inject_nulls(mar.select(K, F.col("o_orderstatus").alias("mar_status"), "o_totalprice"),
                                {"o_totalprice": 0.2}, K, SEED, "MNAR")
    return shown(mnar.withColumnRenamed("o_totalprice", "mnar_price"))


# two numeric columns: o_custkey (whole) and o_totalprice
NOUT = f"greatest(1, floor({N}*0.02::double/2.0))"


def outlier_sql(value: str, extra: str = "") -> str:
    def col(c, whole):
        v = value.replace("COL", c)
        uu = {f"U{i}": u(c, "value", lane=i, root="outliers") for i in range(3)}
        for k, x in uu.items():
            v = v.replace(k, x)
        v = f"{q.rint(v)}::bigint" if whole else f"round({v},6)"
        keep = c if whole else f"round({c},6)"
        return f"case when {rank(c, root='outliers')} <= {NOUT} then {v} else {keep} end as {c}"
    st = ", ".join(f"(select {f} from orders) as {n}_{c}" for c in ("o_custkey", "o_totalprice") for n, f in (
        ("q1", f"quantile_cont({c}::double,0.25)"), ("q3", f"quantile_cont({c}::double,0.75)"), ("mean", f"avg({c})"),
        ("std", f"stddev_samp({c})"), ("mn", f"min({c})::double"), ("mx", f"max({c})::double")))
    return f"with s as (select {st}) select o_orderkey, {col('o_custkey', True)}, {col('o_totalprice', False)} from orders, s"


NUMS = {"o_custkey": "int", "o_totalprice": "num"}
OUTLIERS = {
    "iqr_extreme": "case when U0 < 0.5 then q1_COL - 3.0*(q3_COL-q1_COL) else q3_COL + 3.0*(q3_COL-q1_COL) end + "
                   + q.normal("U1", "U2", 0.0, "((q3_COL-q1_COL)*0.1)"),
    "zscore": "mean_COL + (case when U0 < 0.5 then -1.0 else 1.0 end)*(4.0+U1*2.0)*std_COL",
    "boundary": "case when U0 < 0.5 then mn_COL-(mx_COL-mn_COL)*0.5 else mx_COL+(mx_COL-mn_COL)*0.5 end",
}
for _m, _sql in OUTLIERS.items():
    query(f"outliers_{_m}", outlier_sql(_sql))(lambda t, m=_m: shown(degrade.inject_outliers(
        t.orders.select(K, "o_custkey", "o_totalprice"), NUMS, 0.02, K, m, SEED)[0]))


@query("outliers_custom", f"""select o_orderkey, case when {rank('o_totalprice', root='outliers')} <= greatest(1, floor({N}*0.02::double))
 then -1.0 else round(o_totalprice,6) end as o_totalprice from orders""")
def _(t):
    return shown(degrade.inject_outliers(t.orders.select(K, "o_totalprice"), {"o_totalprice": "num"}, 0.02, K, "custom", SEED,
                                         custom=F.lit(-1.0))[0])


@query("repair_unique_numeric", """with f as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as nth from orders),
 d as (select o_orderkey, row_number() over (order by o_orderkey) as dup from f where nth > 1)
 select o_orderkey, case when dup is null then o_custkey else (select max(o_custkey) from orders) + dup end as o_custkey from f left join d using (o_orderkey)""")
def _(t):
    return degrade.repair_unique(t.orders.select(K, "o_custkey"), "o_custkey", K)


@query("repair_unique_text", """with f as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as nth from part),
 d as (select p_partkey, row_number() over (order by p_partkey) as dup from f where nth > 1)
 select p_partkey, case when dup is null then p_name else p_name || '_' || dup end as p_name from f left join d using (p_partkey)""")
def _(t):
    return degrade.repair_unique(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("clip_range", """select c_custkey, case when c_custkey % 6 <> 0 then least(greatest(c_acctbal, 0.0), 5000.0) end as c_acctbal from customer""")
def _(t):
    src = F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", degrade.clip_range(src, 0.0, 5000.0).alias("c_acctbal"))


@query("enforce_constraints", """with c as (select c_custkey, least(greatest(c_acctbal,0.0),9000.0) as c_acctbal, c_nationkey from customer),
 f as (select *, row_number() over (partition by c_nationkey order by c_custkey) as nth from c),
 d as (select c_custkey, row_number() over (order by c_custkey) as dup from f where nth > 1)
 select c_custkey, c_acctbal, (case when dup is null then c_nationkey else 24 + dup end)::int as c_nationkey from f left join d using (c_custkey)""")
def _(t):
    out, _ = degrade.enforce_constraints(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), [
        {"type": "range", "column": "c_acctbal", "min": 0.0, "max": 9000.0}, {"type": "unique", "column": "c_nationkey"},
        {"type": "gte", "column": "missing", "min": 1}], "c_custkey")
    return out


# --- edge cases ----------------------------------------------------------------------------------------

NB = f"greatest(1, {N}//500)"


def boundary_col(c, whole):
    r, keep = f"r_{c}", c if whole else f"round({c},6)"
    zero = f"when {r} <= 3*{NB} and mn_{c} <= 0 and mx_{c} >= 0 then 0"
    return f"case when {r} <= {NB} then mn_{c} when {r} <= 2*{NB} then mx_{c} {zero} else {keep} end as {c}"


@query("edge_boundary", f"""with s as (select min(o_custkey) mn_o_custkey, max(o_custkey) mx_o_custkey, min(o_totalprice) mn_o_totalprice, max(o_totalprice) mx_o_totalprice from orders),
 r as (select *, {rank('boundary', 'o_custkey')} as r_o_custkey, {rank('boundary', 'o_totalprice')} as r_o_totalprice from orders)
 select o_orderkey, {boundary_col('o_custkey', True)}, {boundary_col('o_totalprice', False)} from r, s""")
def _(t):
    return shown(edge.edge_boundary(t.orders.select(K, "o_custkey", "o_totalprice"), NUMS, K, SEED)[0])


@query("edge_rare_category", f"""select o_orderkey, case when {rank('rare', 'o_orderstatus')} <= greatest(1,{N}//1000) then 'RARE_O_ORDERSTATUS' else o_orderstatus end as o_orderstatus,
 case when {rank('rare', 'o_orderpriority')} <= greatest(1,{N}//1000) then 'RARE_O_ORDERPRIORITY' else o_orderpriority end as o_orderpriority from orders""")
def _(t):
    return edge.edge_rare_category(t.orders.select(K, "o_orderstatus", "o_orderpriority"), KINDS, K, SEED)[0]


def extreme(c):
    return f"(mean_{c} + (case when {u('extreme', c, lane=1)} < 0.5 then -1.0 else 1.0 end)*(5.0+{u('extreme', c, lane=2)}*3.0)*std_{c})"


@query("edge_extreme", f"""with s as (select avg(o_custkey) mean_o_custkey, stddev_samp(o_custkey) std_o_custkey, avg(o_totalprice) mean_o_totalprice, stddev_samp(o_totalprice) std_o_totalprice from orders)
 select o_orderkey, case when {rank('extreme', 'o_custkey')} <= {NB} then {q.rint(extreme('o_custkey'))}::bigint else o_custkey end as o_custkey,
 case when {rank('extreme', 'o_totalprice')} <= {NB} then round({extreme('o_totalprice')},6) else round(o_totalprice,6) end as o_totalprice from orders, s""")
def _(t):
    return shown(edge.edge_extreme(t.orders.select(K, "o_custkey", "o_totalprice"), NUMS, K, SEED)[0])


@query("edge_dates", f"""with r as (select o_orderkey, o_orderdate, {rank('date_boundary', 'o_orderdate')} as r from {ORD})
 select o_orderkey, case when r <= least(8, greatest(1,{N}//200)) then ({q.array(edge.BOUNDARY_DATES)})[r] else {day('o_orderdate')} end as o_orderdate from r""")
def _(t):
    return shown(edge.edge_dates(orders(t).select(K, "o_orderdate"), KINDS, K, SEED)[0])


@query("edge_unicode", f"""with r as (select o_orderkey, o_orderstatus, o_orderpriority, {rank('unicode', 'o_orderstatus')} as a, {rank('unicode', 'o_orderpriority')} as b from orders)
 select o_orderkey, case when a <= least(10, greatest(1,{N}//200)) then ({q.array(edge.UNICODE_TEXTS)})[a] else o_orderstatus end as o_orderstatus,
 case when b <= least(10, greatest(1,{N}//200)) then ({q.array(edge.UNICODE_TEXTS)})[b] else o_orderpriority end as o_orderpriority from r""")
def _(t):
    return edge.edge_unicode(t.orders.select(K, "o_orderstatus", "o_orderpriority"), K, SEED)[0]


@query("edge_duplicates", f"""with r as (select o_orderkey, o_custkey, o_orderstatus, {rank('duplicate', 'target')} <= {NB} as hit,
   1+floor({u('duplicate', 'source')}*{N}::double)::bigint as no from orders),
 n as (select row_number() over (order by o_orderkey) as no, o_custkey, o_orderstatus from orders)
 select r.o_orderkey, case when hit then n.o_custkey else r.o_custkey end as o_custkey, case when hit then n.o_orderstatus else r.o_orderstatus end as o_orderstatus
 from r left join n on r.no = n.no""")
def _(t):
    return edge.edge_duplicates(t.orders.select(K, "o_custkey", "o_orderstatus"), K, SEED)[0]


OTHERS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def picked(cols, lane):
    return q.choice(u('anomaly', 'column', lane=lane), cols)


def anomaly_sql() -> str:
    neg = f"(-floor(100.0+{u('anomaly', 'value', lane=1)}*9900.0))"

    def spike(c):
        return f"mean_{c}+std_{c}*(5.0+{u('anomaly', 'value')}*5.0)"
    miss = {c: f"when k = 'null_required_field' and {picked(OTHERS, 3)} = '{c}' then null" for c in OTHERS}
    nums = ["o_custkey", "o_totalprice"]
    return f"""with s as (select avg(o_custkey) mean_o_custkey, stddev_samp(o_custkey) std_o_custkey, avg(o_totalprice) mean_o_totalprice, stddev_samp(o_totalprice) std_o_totalprice from orders),
 r as (select *, {rank('anomaly', 'pick')} <= greatest(1, floor({N}*0.02::double)) as hit from {ORD}),
 m as (select *, case when hit then {q.choice(u('anomaly', 'pick', lane=1), edge.ANOMALY_TYPES)} end as k from r)
 select o_orderkey, case {miss['o_custkey']} when k='negative_amount' and {picked(nums, 1)}='o_custkey' then {neg}::bigint when k='amount_spike' and {picked(nums, 0)}='o_custkey' then floor({spike('o_custkey')})::bigint else o_custkey end as o_custkey,
 case {miss['o_orderstatus']} else o_orderstatus end as o_orderstatus,
 case {miss['o_totalprice']} when k='negative_amount' and {picked(nums, 1)}='o_totalprice' then {neg} when k='amount_spike' and {picked(nums, 0)}='o_totalprice' then round({spike('o_totalprice')},6) else round(o_totalprice,6) end as o_totalprice,
 case {miss['o_orderdate']} when k='impossible_date' then '2099-13-45' else {day('o_orderdate')} end as o_orderdate,
 case {miss['o_orderpriority']} else o_orderpriority end as o_orderpriority, hit as is_anomaly, k as anomaly_type from m, s"""


@query("label_anomalies", anomaly_sql())
def _(t):
    return shown(edge.label_anomalies(orders(t), KINDS, K, seed=SEED)[0])


@query("materialized_anomalies", f"""with m as (select event_id, ts, row_number() over (order by {q.u(SEED, 'edge', 'anomaly', 'pick', key='event_id')}, event_id) <= greatest(1,floor((select count(*) from events)*0.05::double)) as hit,
  {q.choice(q.u(SEED, 'edge', 'anomaly', 'pick', key='event_id', lane=1), ['duplicate_charge', 'velocity_burst'])} as k from events),
 c as (select event_id, ts, hit, k, unnest(range(0, case when hit and k='duplicate_charge' then 2 when hit then 4 else 1 end)) as copy from m)
 select event_id, hit as is_anomaly, case when hit then k end as anomaly_type, strftime(case when hit and k='velocity_burst' then ts + interval (copy) minute else ts end, '%Y-%m-%d %H:%M:%S') as ts from c""")
def _(t):
    out, _ = edge.label_anomalies(t.events.select("event_id", "ts"), {"event_id": "id"}, "event_id", 0.05,
                                  ["duplicate_charge", "velocity_burst"], SEED, materialize=True, time_col="ts")
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def fx(lane):
    return q.u(SEED, "edge", "fixture", key="i", lane=lane)


FK_ = {"c_custkey": "id", "c_name": "text", "c_mktsegment": "cat", "c_acctbal": "money", "c_nationkey": "int"}


@query("invalid_fixtures", f"""with b as (select unnest(range(0, (select count(*) from customer))) as i), f as (select * from customer order by c_custkey limit 1),
 k as (select i, {q.choice(fx(0), edge.CORRUPTIONS)} as k from b)
 select case when k='null_required' then null else c_custkey::varchar end as c_custkey,
  case when k='special_chars' and {q.choice(fx(1), ['c_name', 'c_mktsegment'])}='c_name' then '<script>alert(''xss'')</script>' when k='empty_string' and {q.choice(fx(1), ['c_name', 'c_mktsegment'])}='c_name' then '' else c_name end as c_name,
  case when k='special_chars' and {q.choice(fx(1), ['c_name', 'c_mktsegment'])}='c_mktsegment' then '<script>alert(''xss'')</script>' when k='empty_string' and {q.choice(fx(1), ['c_name', 'c_mktsegment'])}='c_mktsegment' then '' else c_mktsegment end as c_mktsegment,
  case when k='negative_price' then '-99999' when k='wrong_type' and {q.choice(fx(1), ['c_nationkey', 'c_acctbal'])}='c_acctbal' then 'not_a_number' else c_acctbal::varchar end as c_acctbal,
  case when k='overflow' then '4611686018427387904' when k='wrong_type' and {q.choice(fx(1), ['c_nationkey', 'c_acctbal'])}='c_nationkey' then 'not_a_number' else c_nationkey::varchar end as c_nationkey,
  i as _fixture_id, k as _corruption_type from k, f""")
def _(t):
    return edge.invalid_fixtures(t.customer, FK_, t.customer.count(), "c_custkey", SEED)


@query("injection_log", f"""select 'boundary_values' as type, 'o_custkey' as "column", ({NB}*3)::bigint as count where (select min(o_custkey) from orders) = 0
 union all select 'boundary_values', 'o_custkey', ({NB}*2)::bigint where (select min(o_custkey) from orders) > 0
 union all select 'boundary_values', 'o_totalprice', ({NB}*2)::bigint
 union all select 'rare_category', c, greatest(1,{N}//1000)::bigint from (select unnest(['o_orderstatus','o_orderpriority']) as c)
 union all select 'extreme_numeric', c, {NB}::bigint from (select unnest(['o_custkey','o_totalprice']) as c)
 union all select 'date_boundary', 'o_orderdate', least(8, greatest(1,{N}//200))::bigint
 union all select 'labeled_anomalies', null, greatest(1, floor({N}*0.02::double))::bigint""")
def _(t):
    return edge.inject_all(orders(t), KINDS, K, seed=SEED)[2]


@query("inject_all_label_counts", f"""select {N} as rows, greatest(1, floor({N}*0.05::double))::bigint as anomalies""")
def _(t):
    out, _, _ = edge.inject_all(orders(t), KINDS, K, {"anomaly_rate": 0.05, "duplicates": True, "unicode_names": True}, SEED)
    return out.agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"))


# suggestions for the kinds that the profiler infers on the orders table
@query("suggest_edge_cases", "select * from (values " + ", ".join(
    f"('{a}','{b}',{c}::double,'{d}')" for a, b, c, d in edge.CATALOGUE) + ") v(type, reason, default_rate, priority)")
def _(t):
    kinds = {r["column"]: r["kind"] for r in pf.infer_kinds(orders(t)).collect()}
    return edge.suggest_edge_cases(t.spark, kinds)
