"""Copula fitting, sampling and scoring queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.people import CONTACTS_SQL, contacts
from facsimile.catalog.registry import query
from facsimile.functions import keyed, mathx
from facsimile.operators import copula, domains, score
from facsimile.operators import profile as pf
from facsimile.plans import synthesize as syn

SEED = 42


@query("to_numeric", f"""select c_custkey, (date '2024-01-01' + (c_custkey % 365)::int - date '1970-01-01') * 86400.0::double as signup,
 case when c_custkey % 3 = 0 then 1.0::double else 0.0 end as active, null::double as price_text, c_acctbal as balance from customer""")
def _(t):
    c = contacts(t).select(F.col("customer_id") - 10001, "signup", "active", "price_text").toDF("c_custkey", "signup", "active", "price_text")
    types = {f.name: f.dataType for f in c.schema.fields}
    num = c.select("c_custkey", *[copula.to_numeric(F.col(n), k, types[n]).alias(n) for n, k in (
        ("signup", "date"), ("active", "bool"), ("price_text", "num"))])
    return num.join(t.customer.select("c_custkey", F.col("c_acctbal").alias("balance")), "c_custkey")


# pairwise correlations where each pair has rows of its own need not fit together: a matrix that does is left
# as it is (to the sixth place), one that does not is repaired
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("usable_correlations", " union all ".join(
    f"""select '{a}' as a, '{b}' as b, {'max(1.0::double)' if a == b else f"round(corr({a}, {b}), 6)"} as corr, true as repaired_fits from lineitem"""
    for a in LINE_NUMBERS for b in LINE_NUMBERS))
def _(t):
    k = len(LINE_NUMBERS)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    row = t.lineitem.agg(*[F.corr(LINE_NUMBERS[i], LINE_NUMBERS[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(k)
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"c{i}_{j}"]
    usable = copula.make_psd(m)
    broken = np.where(np.eye(k) > 0, 1.0, np.where(m > 0, 0.95, -0.95))  # the same signs, too strong to fit together
    fixed = copula.make_psd(broken)
    fits = bool(np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1) and np.allclose(fixed, fixed.T))
    rows = [(a, b, round(float(usable[i, j]), 6), fits) for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS)]
    return t.spark.createDataFrame(rows, "a string, b string, corr double, repaired_fits boolean")


@query("to_numeric_timestamps", "select event_id, round(epoch(ts),6) as seconds from events")
def _(t):
    return t.events.select("event_id", F.round(copula.to_numeric(F.col("ts"), "datetime", t.events.schema["ts"].dataType), 6).alias("seconds"))


def spans_sql(table: str, col: str) -> str:
    return (f"(select value, cnt, (sum(cnt) over (order by cnt desc, value))::bigint as hi from "
            f"(select {col}::varchar as value, count(*) as cnt from {table} where {col} is not null group by 1))")


@query("fit_categorical", f"""select value, round(cnt::double/(select count(*) from part),6) as prob, round(hi::double/(select count(*) from part),6) as cum
 from {spans_sql('part', 'p_brand')}""")
def _(t):
    return copula.fit_categorical(t.part, "p_brand").select("value", F.round("prob", 6).alias("prob"), F.round("cum", 6).alias("cum"))


@query("fit_categorical_dp", f"""with c as (select p_brand as value, count(*) as cnt from part group by 1),
 w as (select value, {q.rint(f"greatest(cnt+{q.laplace(q.u(SEED, 'dp_category', 'p_brand', key='value'), '1.0::double/0.5')},0.0)*1000000.0::double")}::bigint as w from c)
 select value, round(w::double/(select sum(w) from w),6) as prob from w""")
def _(t):
    return copula.fit_categorical(t.part, "p_brand", 0.5, SEED).select("value", F.round("prob", 6).alias("prob"))


@query("fit_boolean", f"select round(avg((active='yes')::int::double),6) as p, 0.0::double as all_false from {CONTACTS_SQL}")
def _(t):
    c = contacts(t).withColumn("never", F.lit("no"))
    return t.spark.createDataFrame([(round(copula.fit_boolean(c, "active"), 6), copula.fit_boolean(c, "never"))],
                                   "p double, all_false double")


GRID_LIST = "[" + ",".join(repr(i / 1000) for i in range(1001)) + "]"


@query("fit_numeric_grid", f"""with g as (select 'p_retailprice' as col, quantile_cont(p_retailprice, {GRID_LIST}) as v from part
  union all select 'p_size', quantile_cont(p_size::double, {GRID_LIST}) from part)
 select col, unnest(range(0,1001))::int as i, round(unnest(v),6) as v from g""")
def _(t):
    rows = [(c, i, round(v, 6)) for c, k in (("p_retailprice", "num"), ("p_size", "int"))
            for i, v in enumerate(copula.fit_numeric(t.part, c, k))]
    return t.spark.createDataFrame(rows, "col string, i int, v double")


@query("dp_histogram", f"""with c as (select least(floor((least(greatest(c_acctbal,0.0),10000.0)-0.0)/10000.0::double*64),63)::bigint as bin, count(*) as cnt from customer group by 1),
 s as (select unnest(range(0,64)) as bin) select bin, coalesce(cnt,0) as cnt, round(greatest(coalesce(cnt,0)+{q.laplace(q.u(SEED, 'dp_histogram', 'c_acctbal', key='bin'), '1.0::double/0.5')},0.0),6) as noised
 from s left join c using (bin)""")
def _(t):
    h = copula.dp_histogram(t.customer, "c_acctbal", "num", 0.5, 0.0, 10000.0, SEED)
    return h.select("bin", "cnt", F.round("noised", 6).alias("noised"))


# --- uniform scores: category, boolean and rank based -------------------------------------------------

KINDS = {"c_acctbal": "num", "c_mktsegment": "cat", "rich": "bool"}


def scored(t):
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                             "c_mktsegment", (F.col("c_acctbal") > 4000).alias("rich"))


CK = "c_custkey"
SCORED = "(select c_custkey, case when c_custkey % 8 <> 0 then c_acctbal end as c_acctbal, c_mktsegment, c_acctbal > 4000 as rich from customer)"
AVG_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0::double"
SCORES = f"""(with s as (select * from {SCORED}), sp as (select value, cnt, hi from {spans_sql(SCORED, 'c_mktsegment')}),
 p as (select avg(rich::int::double) as p from s), n as (select count(c_acctbal)::double as n, count(*)::double as rows from s),
 r as (select c_custkey, {AVG_RANK.format(c='c_acctbal')} as rk from s where c_acctbal is not null)
 select s.c_custkey, case when c_acctbal is not null then (rk-0.5::double)/n else {q.u(SEED, 'score', 'c_acctbal', key='s.c_custkey')} end as u_c_acctbal,
  ((hi-cnt) + {q.u(SEED, 'score', 'c_mktsegment', key='s.c_custkey')}*cnt)/rows as u_c_mktsegment,
  case when rich then (1.0-p) + {q.u(SEED, 'score', 'rich', key='s.c_custkey')}*p else {q.u(SEED, 'score', 'rich', key='s.c_custkey')}*(1.0-p) end as u_rich
 from s join sp on value = c_mktsegment left join r using (c_custkey), p, n)"""


def scores(t):
    return copula.uniform_scores(scored(t), KINDS, "c_custkey", SEED)


@query("uniform_scores", f"select c_custkey, round(u_c_acctbal,6) as u_c_acctbal, round(u_c_mktsegment,6) as u_c_mktsegment, round(u_rich,6) as u_rich from {SCORES}")
def _(t):
    return scores(t).select("c_custkey", *[F.round(f"u_{c}", 6).alias(f"u_{c}") for c in KINDS])


Z = {c: q.norm_ppf(f"least(greatest(u_{c},1e-6::double),(1-1e-6::double))") for c in KINDS}


@query("normal_scores", f"select c_custkey, round({Z['c_acctbal']},5) as z from {SCORES}")
def _(t):
    u = F.least(F.greatest(F.col("u_c_acctbal"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return scores(t).select("c_custkey", F.round(mathx.norm_ppf(u), 5).alias("z"))


@query("normal_score_correlation", f"""select a, b, round(c,6) as c from (select unnest(['c_acctbal','c_acctbal','c_mktsegment']) as a, unnest(['c_mktsegment','rich','rich']) as b,
 unnest([corr(z0,z1), corr(z0,z2), corr(z1,z2)]) as c from (select {Z['c_acctbal']} as z0, {Z['c_mktsegment']} as z1, {Z['rich']} as z2 from {SCORES}))""")
def _(t):
    cols = list(KINDS)
    m = copula.score_correlation(scores(t), cols)
    rows = [(cols[i], cols[j], round(float(m[i][j]), 6)) for i in range(3) for j in range(i + 1, 3)]
    return t.spark.createDataFrame(rows, "a string, b string, c double")


# --- inverse marginals, driven by keyed uniforms --------------------------------------------------------

UU = q.u(SEED, "inv", key="o_orderkey")


@query("inverse_marginals", f"""with g as (select quantile_cont(p_retailprice, {GRID_LIST}) as g, quantile_cont(p_size::double, {GRID_LIST}) as h from part),
 d as (select quantile_cont((o_orderdate::date - date '1970-01-01')*86400.0::double, {GRID_LIST}) as d from orders),
 tot as (select count(*)::double as n from customer), sg as (select list(value order by hi) as cats, list(hi/n order by hi) as cum from {spans_sql('customer', 'c_mktsegment')}, tot),
 u as (select o_orderkey, {UU} as u from orders), pos as (select *, least(floor(u*1000.0::double),999)::int as i from u) 
 select o_orderkey, round(g[i+1]+(g[i+2]-g[i+1])*(u*1000.0::double-i),6) as price, {q.rint('(h[i+1]+(h[i+2]-h[i+1])*(u*1000.0::double-i))')}::bigint as size,
  strftime(date '1970-01-01' + floor((d[i+1]+(d[i+2]-d[i+1])*(u*1000.0::double-i))/86400.0)::int, '%Y-%m-%d') as day,
  cats[1+len(list_filter(cum[:len(cum)-1], c -> c <= u))] as segment, u >= 0.7::double as flag from pos, g, d, sg""".replace("c -> c <= u", "lambda c: c <= u"))
def _(t):
    dates = t.orders.select(F.col("o_orderdate").cast("date").alias("day"))
    ms = {"price": copula.fit_marginal(t.part, "p_retailprice", "num"), "size": copula.fit_marginal(t.part, "p_size", "int"),
          "day": copula.fit_marginal(dates, "day", "date"), "segment": copula.fit_marginal(t.customer, "c_mktsegment", "cat"),
          "flag": {"type": "bool", "p": 0.3}}
    u = keyed.uniform(SEED, "inv", key="o_orderkey")
    out = t.orders.select("o_orderkey", *[copula.inverse_marginal(u, m).alias(c) for c, m in ms.items()])
    return out.withColumn("day", F.col("day").cast("string"))


@query("reinject_nulls", f"""select o_orderkey, case when {q.u(SEED, 'nulls', 'o_orderstatus', key='o_orderkey')} >= (select avg((c_custkey % 8 = 0)::int::double) from customer) then o_orderstatus end as o_orderstatus from orders""")
def _(t):
    from facsimile.operators import degrade
    rate = scored(t).agg(F.avg(F.col("c_acctbal").isNull().cast("double"))).first()[0]
    return degrade.inject_nulls(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": rate}, "o_orderkey", SEED)


LINE_KINDS = {"c_nationkey": "int", "c_acctbal": "num", "c_mktsegment": "cat"}


def look_alike(t, n=None):
    model = copula.fit(t.customer, LINE_KINDS, "c_custkey", SEED)
    return model, copula.sample(t.spark, model, n or t.customer.count(), SEED)


# property checks: sampled rows keep the size, the ranges and the categories of the source
@query("copula_sample", """select count(*) as rows, 0::bigint as out_of_range, count(distinct c_mktsegment) as segments from customer""")
def _(t):
    _, s = look_alike(t)
    lo, hi = t.customer.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return s.agg(F.count("*").alias("rows"), F.count_if((F.col("c_acctbal") < lo - 1e-6) | (F.col("c_acctbal") > hi + 1e-6)).alias("out_of_range"),
                 F.count_distinct("c_mktsegment").alias("segments"))


query("copula_sample_rows")(lambda t: look_alike(t)[1])
query("copula_model_summary", """select unnest(['c_nationkey','c_acctbal','c_mktsegment']) as "column", unnest(['int','num','cat']) as kind,
 0.0::double as null_rate, 3 as columns_modeled""")(lambda t: copula.model_summary(t.spark, look_alike(t)[0]))


@query("synthesize", """select count(*) as rows, count(distinct c_custkey) as ids, (select max(c_custkey)+1 from customer) as first_id, 1500::bigint as names from customer""".replace("1500::bigint", "count(distinct c_custkey)"))
def _(t):
    out = syn.synthesize(t.customer, t.customer.count(), "c_custkey", SEED, actions={"c_name": "hash"})
    r = out.rows
    return r.agg(F.count("*").alias("rows"), F.count_distinct("c_custkey").alias("ids"), F.min("c_custkey").alias("first_id"),
                 F.count("c_name").alias("names"))


# --- scoring: a shifted copy of the customers plays the synthetic table -----------------------------------

SHIFT = {"c_custkey": "c_custkey", "c_acctbal": "c_acctbal * 0.9 + (c_custkey % 50)",
         "c_nationkey": "cast((c_nationkey + c_custkey % 3) as int)",
         "c_mktsegment": "case when c_custkey % 10 = 0 then 'OTHER' else c_mktsegment end"}
FAKE = "(select " + ", ".join(f"{e} as {c}" for c, e in SHIFT.items()) + " from customer)"


def fake(t):
    return t.customer.selectExpr(*[f"{e} as {c}" for c, e in SHIFT.items()])


SK = {"c_acctbal": "num", "c_nationkey": "int", "c_mktsegment": "cat"}
TVD = f"""(select 1-sum(abs(coalesce(p,0)-coalesce(q,0)))/2 from (select c_mktsegment v, count(*)::double/(select count(*) from customer) p from customer group by 1) a
 full join (select c_mktsegment v, count(*)::double/(select count(*) from customer) q from {FAKE} group by 1) b using (v))"""


def ks_sql(c):
    return f"""(select 1-max(abs(a-b)) from (select v, sum(sum(a)) over (order by v)/(select count(*) from customer)::double as a, sum(sum(b)) over (order by v)/(select count(*) from customer)::double as b
 from (select {c}::double v, 1 a, 0 b from customer union all select {c}::double, 0, 1 from {FAKE}) group by v))"""


COLS_SQL = f"""select 'c_mktsegment' as "column", {TVD} as score union all select 'c_acctbal', {ks_sql('c_acctbal')} union all select 'c_nationkey', {ks_sql('c_nationkey')}"""


@query("tvd_score", f"""select 'c_mktsegment' as "column", round({TVD},6) as score""")
def _(t):
    return score.tvd_scores(t.customer, fake(t), ["c_mktsegment"]).select("column", F.round("score", 6).alias("score"))


@query("ks_score", f"""select 'c_acctbal' as "column", round({ks_sql('c_acctbal')},6) as score union all select 'c_nationkey', round({ks_sql('c_nationkey')},6)""")
def _(t):
    return score.ks_scores(t.customer, fake(t), SK, ["c_acctbal", "c_nationkey"]).select("column", F.round("score", 6).alias("score"))


@query("bool_score", f"""select 'flag' as "column", round(1-abs((select avg((c_acctbal>0)::int::double) from customer)-(select avg((c_acctbal>500)::int::double) from {FAKE})),6) as score""")
def _(t):
    real = t.customer.select((F.col("c_acctbal") > 0).alias("flag"))
    synth = fake(t).select(F.when(F.col("c_acctbal") > 500, "Yes").otherwise("no").alias("flag"))
    return score.bool_scores(real, synth, ["flag"]).select("column", F.round("score", 6).alias("score"))


@query("column_scores", f"""select "column", round(score,6) as score from ({COLS_SQL})""")
def _(t):
    return score.column_scores(t.customer, fake(t), SK).select("column", F.round("score", 6).alias("score"))



def rho(table, a, b, where="true"):
    return f"""(select corr(ra, rb) from (select {AVG_RANK.format(c=a)} as ra, {AVG_RANK.format(c=b)} as rb from {table} where {where}))"""


LK = {"l_quantity": "num", "l_extendedprice": "num", "l_discount": "num"}


@query("spearman", f"""select 'l_quantity' as a, 'l_extendedprice' as b, round({rho('lineitem', 'l_quantity', 'l_extendedprice')},6) as rho
 union all select 'l_quantity', 'l_discount', round({rho('lineitem', 'l_quantity', '(l_discount+0.0)')},6)
 union all select 'l_extendedprice', 'l_discount', round({rho('lineitem', 'l_extendedprice', '(l_discount+0.0)')},6)""")
def _(t):
    cols = list(LK)
    m = score.spearman_matrix(t.lineitem, cols, LK)
    rows = [(cols[i], cols[j], round(float(m[i, j]), 6)) for i in range(3) for j in range(i + 1, 3)]
    return t.spark.createDataFrame(rows, "a string, b string, rho double")


NUL = "(select case when c_custkey % 8 <> 0 then c_acctbal end as x, case when c_custkey % 5 <> 0 then c_nationkey end as y, c_custkey as k from customer)"


@query("spearman_pairwise_complete", f"""select 'x' as a, 'y' as b, round({rho(NUL, 'x', 'y', 'x is not null and y is not null')},6) as rho
 union all select 'x', 'k', round({rho(NUL, 'x', 'k', 'x is not null')},6) union all select 'y', 'k', round({rho(NUL, 'y', 'k', 'y is not null')},6)""")
def _(t):
    df = t.customer.selectExpr("case when c_custkey % 8 <> 0 then c_acctbal end as x",
                               "case when c_custkey % 5 <> 0 then c_nationkey end as y", "c_custkey as k")
    cols = ["x", "y", "k"]
    m = score.spearman_matrix(df, cols, {c: "num" for c in cols})
    rows = [(cols[i], cols[j], round(float(m[i, j]), 6)) for i in range(3) for j in range(i + 1, 3)]
    return t.spark.createDataFrame(rows, "a string, b string, rho double")


FID = f"""cs as ({COLS_SQL}), pr as (select 1-abs({rho('customer', 'c_acctbal', 'c_nationkey')}-{rho(FAKE, 'c_acctbal', 'c_nationkey')})/2 as p)"""


@query("fidelity", f"""with {FID} select round(100*(0.6*avg(score)+0.4*max(p)),1) as score, round(max(p),3) as pair_mean from cs, pr""")
def _(t):
    f = score.fidelity(t.customer, fake(t), SK)
    return t.spark.createDataFrame([(f["score"], f["pair_mean"])], "score double, pair_mean double")


@query("worst_columns", f"""with {FID} select "column", round(score,3) as score from cs order by score limit 5""")
def _(t):
    f = score.fidelity(t.customer, fake(t), SK)
    return t.spark.createDataFrame([(w["column"], w["score"]) for w in f["worst_columns"]], "column string, score double")


@query("pair_score", f"""with {FID} select round(p,6) as score from pr""")
def _(t):
    cols = ["c_acctbal", "c_nationkey"]
    s = score.pair_scores(*[score.spearman_matrix(d, cols, SK) for d in (t.customer, fake(t))])
    return t.spark.createDataFrame([(round(s[0], 6),)], "score double")


@query("scorable_columns", """select * from (values ('c_nationkey','int'), ('c_acctbal','num'), ('c_mktsegment','cat')) v("column", kind)
 where (select count(*) from customer) > 0""")
def _(t):
    return score.scorable_columns(pf.profile(t.customer)).filter("column <> 'c_custkey'")


@query("pick_target", """select 'c_mktsegment' as "column" where (select count(distinct c_mktsegment) from customer) > 1""")
def _(t):
    return score.pick_target(pf.profile(t.customer))


TK = {"p_size": "int", "p_retailprice": "num", "p_brand": "cat", "p_type": "cat"}


def tstr_frames(t):
    train, hold = domains.split_holdout(t.part, keyed.uniform(SEED, "hold", key="p_partkey"), "p_partkey")
    model = copula.fit(train, TK, "p_partkey", SEED)
    return train, hold, copula.sample(t.spark, model, train.count(), SEED)


@query("tstr_utility")
def _(t):
    train, hold, synth = tstr_frames(t)
    r = score.tstr(train, synth, hold, "p_type", TK, trees=10, depth=5)
    return t.spark.createDataFrame([(r["target"], r["task_type"], r["trtr"], r["tstr"], r["utility"])],
                                   "target string, task_type string, trtr double, tstr double, utility double")


@query("scorecard")
def _(t):
    train, hold, synth = tstr_frames(t)
    card = score.scorecard(t.part, synth, TK, "sample_conditioned", train, hold, None, list(TK))
    rows = [("fidelity", str(card["fidelity"]["score"])), ("exact_match_rate", str(card["privacy"]["exact_match_rate"])),
            ("dcr_ratio", str(card["privacy"]["dcr_ratio"])), ("level", card["privacy"]["level"])]
    return t.spark.createDataFrame(rows, "metric string, value string")
