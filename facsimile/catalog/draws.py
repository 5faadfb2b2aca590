"""Keyed draws and money functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.registry import query
from facsimile.functions import keyed, money
from facsimile.operators import domains, ordered
from facsimile.sources import locales

SEED = 42


def U(*path, key="c_custkey", lane=0):
    return keyed.uniform(SEED, *path, key=key, lane=lane)


def us(*path, key="c_custkey", lane=0):
    return q.u(SEED, *path, key=key, lane=lane)


@query("keyed_uniform", f"""select c_custkey, {us('a')} as u0, {us('a', lane=3)} as u3, {us('b')} as other
  from customer""")
def _(t):
    return t.customer.select("c_custkey", U("a").alias("u0"), U("a", lane=3).alias("u3"), U("b").alias("other"))


@query("short_hash", "select c_custkey, substr(sha256(c_name),1,12) as h from customer")
def _(t):
    return t.customer.select("c_custkey", keyed.short_hash("c_name").alias("h"))


@query("uniform_int", f"select p_partkey, 5 + floor({us('int', key='p_partkey')}*95.0::double)::bigint as n from part")
def _(t):
    return t.part.select("p_partkey", keyed.uniform_int(U("int", key="p_partkey"), 5, 100).alias("n"))


@query("uniform_num", f"""select p_partkey, round(5.0::double + {us('num', key='p_partkey')}*145.0::double, 6) as price,
  {q.rint(f"1.0::double + {us('num', key='p_partkey', lane=1)}*4.0::double")}::bigint as rating from part""")
def _(t):
    price = keyed.uniform_num(U("num", key="p_partkey"), *keyed.default_range("list_price"))
    rating = keyed.uniform_num(U("num", key="p_partkey", lane=1), *keyed.default_range("rating"), integral=True)
    return t.part.select("p_partkey", F.round(price, 6).alias("price"), rating.alias("rating"))


SEGMENTS = {"regular": 0.70, "loyal": 0.25, "vip": 0.05, "never": -1.0}


@query("weighted_choice", f"select c_custkey, {q.weighted(us('seg'), SEGMENTS)} as segment from customer")
def _(t):
    return t.customer.select("c_custkey", keyed.weighted_choice(U("seg"), SEGMENTS).alias("segment"))


@query("zipf_choice_small", f"""select o_orderkey,
  1 + {q.bucket_of(us('z', key='o_orderkey'), keyed.cumulative(keyed.zipf_weights(60, 0.8))[:-1])} as pick from orders""")
def _(t):
    return t.orders.select("o_orderkey", keyed.zipf_index(U("z", key="o_orderkey"), 60, 0.8).alias("pick"))


# the whole part table as a Zipf domain: popularity rank = key order
@query("zipf_choice_domain", f"""
with d as (select p_partkey, row_number() over (order by p_partkey) as rank from part),
 w as (select p_partkey, rank, greatest({q.rint("4294967296.0::double/pow(rank::double, 0.8::double)")},1)::bigint as weight from d),
 s as (select p_partkey, sum(weight) over (order by rank)::bigint as hi, weight from w),
 tot as (select max(hi) as total from s),
 o as (select o_orderkey, floor({us('zd', key='o_orderkey')}*total::double)::bigint as spot from orders, tot)
select o_orderkey, p_partkey from o asof join (select hi-weight as lo, p_partkey from s) x on o.spot >= x.lo""")
def _(t):
    ranked = ordered.dense_ids(t.part.select("p_partkey"), ["p_partkey"], name="rank")
    line = domains.spans(domains.zipf_domain(ranked, "rank", 0.8), "weight", ["rank"])
    return domains.draw_from_spans(t.orders.select("o_orderkey"), U("zd", key="o_orderkey"), line, ["p_partkey"])


@query("keyed_normal", f"""select o_orderkey, round({q.normal(us('n', key='o_orderkey'), us('n', key='o_orderkey', lane=1), 3500.0, 2000.0)}, 4) as x,
  trunc(least(greatest({q.normal(us('n', key='o_orderkey'), us('n', key='o_orderkey', lane=1), 3500.0, 2000.0)},500.0),15000.0))::bigint as clipped
  from orders""")
def _(t):
    x = keyed.normal(U("n", key="o_orderkey"), U("n", key="o_orderkey", lane=1), 3500.0, 2000.0)
    return t.orders.select("o_orderkey", F.round(x, 4).alias("x"),
                           keyed.clip(x, 500.0, 15000.0).cast("bigint").alias("clipped"))


@query("lognormal_price", f"""select p_partkey, least(greatest({q.rint('exp(' + q.normal(us('ln', key='p_partkey'),
  us('ln', key='p_partkey', lane=1), 8.0, 0.9) + ')')},199.0),500000.0)::bigint as price from part""")
def _(t):
    return t.part.select("p_partkey", keyed.lognormal(U("ln", key="p_partkey"), U("ln", key="p_partkey", lane=1),
                                                      8.0, 0.9, 199, 500_000).alias("price"))


@query("laplace_noise", f"select c_custkey, round({q.laplace(us('lap'), '2.5::double')}, 6) as noise from customer")
def _(t):
    return t.customer.select("c_custkey", F.round(keyed.laplace(U("lap"), 2.5), 6).alias("noise"))


@query("bernoulli_flag", f"select c_custkey, {us('flag')} < 0.05::double as flag from customer")
def _(t):
    return t.customer.select("c_custkey", keyed.bernoulli(U("flag"), 0.05).alias("flag"))


NB = keyed.negbin_cdf(3.2, 1.4, 60)


@query("negbin_fan_out", f"""with c as (select c_custkey, {q.bucket_of(us('cnt'), NB)}::int as n from customer)
  select c_custkey, unnest(range(1, n+1))::int as seq from c""")
def _(t):
    return domains.fan_out(t.customer.select("c_custkey"), keyed.draw_count(U("cnt"), NB))


COUNT_DISTS = {"poisson": dict(mean=3.0, top=30), "uniform": dict(low=2, top=7), "fixed": dict(mean=4),
               "zipf": dict(dispersion=1.2, top=20), "empirical": dict(weights=[5, 3, 1, 1]),
               "negbin": dict(mean=3.0, dispersion=1.5, top=60)}


@query("child_count_distributions", "select c_custkey, " + ", ".join(
    f"{q.bucket_of(us('dist', d), keyed.count_cuts(d, **kw))}::int as n_{d}" for d, kw in COUNT_DISTS.items())
    + " from customer")
def _(t):
    cols = [keyed.draw_count(U("dist", d), keyed.count_cuts(d, **kw)).alias(f"n_{d}") for d, kw in COUNT_DISTS.items()]
    return t.customer.select("c_custkey", *cols)


@query("sample_exact", f"select c_custkey, c_name from customer order by {us('samp')}, c_custkey limit 100")
def _(t):
    return ordered.sample_exact(t.customer, 100, U("samp"), "c_custkey").select("c_custkey", "c_name")


@query("holdout_split", f"""select o_orderkey, case when row_number() over (order by {us('hold', key='o_orderkey')}, o_orderkey)
  <= (select floor(count(*)*0.2) from orders) then 'holdout' else 'train' end as part from orders""")
def _(t):
    train, hold = domains.split_holdout(t.orders.select("o_orderkey"), U("hold", key="o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))


@query("holdout_split_threshold", f"""select o_orderkey, case when {us('hold', key='o_orderkey')} < 0.2::double then 'holdout'
  else 'train' end as part from orders""")
def _(t):
    train, hold = domains.split_holdout(t.orders.select("o_orderkey"), U("hold", key="o_orderkey"), exact=False)
    return train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))


def day_weight_sql(day: str, weekday=domains.WEEKDAY_WEIGHTS, seasonality: str | None = "retail") -> str:
    w = q.array([round(x * domains.WEIGHT_UNIT) for x in weekday])
    late = 1.3 if seasonality in ("retail", "financial") else 1.0
    last = 1.15 if seasonality == "retail" else 1.0
    return (f"round_even(({w})[isodow({day})]::double * (case when day({day}) >= 25 then {late}::double else 1.0 end)"
            f" * (case when month({day}) >= 10 then {last}::double else 1.0 end),0)::bigint")


def dates_sql(src: str, key: str, path: str, start: str, end: str, out: str, *weights) -> str:
    return f"""(with cal as (select unnest(generate_series(date '{start}', date '{end}', interval 1 day))::date as d),
 w as (select d, {day_weight_sql('d', *weights)} as weight from cal),
 s as (select d, weight, sum(weight) over (order by d)::bigint as hi from w)
 select o.{key}, x.d as {out} from (select {key}, floor({us(path, key=key)}*(select max(hi) from s)::double)::bigint as spot from {src}) o
 asof join (select hi-weight as lo, d from s) x on o.spot >= x.lo)"""


@query("weighted_dates", f"select o_orderkey, strftime(d, '%Y-%m-%d') as d from {dates_sql('orders', 'o_orderkey', 'wd', '2024-01-01', '2024-12-31', 'd')}")
def _(t):
    out = domains.weighted_dates(t.orders.select("o_orderkey"), U("wd", key="o_orderkey"), "2024-01-01",
                                 "2024-12-31", "d")
    return out.withColumn("d", F.col("d").cast("string"))


# weekday weights of the user's own, days that never come included, with the month-end season and with none
OWN_WEEK = (0.0, 2.0, 1.0, 0.25, 3.0, 0.0, 0.5)
OWN_DATES = ("orders", "o_orderkey", "od", "2023-02-10", "2024-03-05", "d", OWN_WEEK)


@query("temporal_strategy", f"""select o_orderkey, a.d as financial, b.d as plain from {dates_sql(*OWN_DATES, 'financial')} a
 join {dates_sql(*OWN_DATES, None)} b using (o_orderkey)""")
def _(t):
    rows = t.orders.select("o_orderkey")
    for season, name in (("financial", "financial"), (None, "plain")):
        rows = domains.weighted_dates(rows, U("od", key="o_orderkey"), "2023-02-10", "2024-03-05", name, OWN_WEEK, season).drop("weight")
    return rows


@query("fk_sample", f"""with p as (select c_custkey, row_number() over (order by c_custkey) as pid from customer)
 select o_orderkey, c_custkey from (select o_orderkey, 1 + floor({us('fk', 'orders', key='o_orderkey')}
   *(select count(*) from customer)::double)::bigint as pid from orders) join p using (pid)""")
def _(t):
    out = domains.fk_sample(t.orders.select("o_orderkey"), U("fk", "orders", key="o_orderkey"), t.customer,
                            "c_custkey", "c_custkey")
    return out.select("o_orderkey", "c_custkey")


@query("dense_ids", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
 'TX-' || lpad((row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))::varchar, 8, '0') as tx_id
 from lineitem""")
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    out = ordered.dense_ids(t.lineitem.select(*cols), cols)
    return out.select(*cols, ordered.format_id("row_id", "TX-", 8).alias("tx_id"))


@query("running_balance_generic", """select event_id, user_id, sum(cast(round_even(cast(value as decimal(18,6))*100,0) as bigint))
  over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as running,
  row_number() over (partition by user_id order by ts, event_id) as n from events""")
def _(t):
    ev = t.events.select("event_id", "user_id", "ts", money.to_minor("value").alias("amount"))
    out = ordered.running(ev, ["ts", "event_id"], sums={"running": "amount"}, by=["user_id"], row_number="n")
    return out.select("event_id", "user_id", "running", "n")


def _name_sql(code: str) -> str:
    n = locales.NAMES[code]
    k = [q.u(SEED, "locale_names", code, key="c_custkey", lane=i) for i in range(3)]
    return (f"case when {k[0]} < 0.5 then {q.choice(k[1], n['male'])} else {q.choice(k[1], n['female'])} end"
            f" || ' ' || {q.choice(k[2], n['family'])}")


@query("locale_names", f"select c_custkey, {_name_sql('pk')} as pk_name, {_name_sql('eu')} as eu_name from customer")
def _(t):
    return t.customer.select("c_custkey", locales.full_name("pk", SEED, "c_custkey").alias("pk_name"),
                             locales.full_name("eu", SEED, "c_custkey").alias("eu_name"))


LOCALE_CODES = ["pk", "us", "uk", "eu", "in", "ae", "zz"]


@query("locale_pack_lookup", f"""
with f(locale, currency, date_format) as (values {', '.join(f"('{c}','{f['currency']}','{f['date_format']}')" for c, f in locales.FORMATS.items())}),
 s as (select s_suppkey, ({q.array(LOCALE_CODES)})[1 + s_nationkey % 7] as code from supplier)
select s_suppkey, code, currency, date_format from s join f on f.locale = case when code = 'zz' then 'us' else code end""")
def _(t):
    code = F.element_at(keyed.literal_array(LOCALE_CODES), F.col("s_nationkey") % 7 + 1)
    out = locales.with_locale(t.supplier.select("s_suppkey", code.alias("code")), "code")
    return out.select("s_suppkey", "code", "currency", "date_format")


BANK = [f"{a} {b}" for a in domains.FIRST_WORDS for b in domains.SECOND_WORDS]


@query("vocab_bank", f"""with b as (select unnest({q.array(BANK)}) as word),
 r as (select word, row_number() over (order by {q.u(0, 'vocab', 'product', key='word')}, word) as word_no from b qualify word_no <= 200)
select p_partkey, word from part join r on word_no = p_partkey % 200 + 1""")
def _(t):
    bank = domains.vocab_bank(t.spark, "product", 200)
    part = t.part.select("p_partkey", (F.col("p_partkey") % 200 + 1).alias("word_no"))
    return part.join(F.broadcast(bank), "word_no").select("p_partkey", "word")  # 200 rows


# --- money -----------------------------------------------------------------------------------------

MINOR_SQL = "cast(round_even(cast(cast(o_totalprice as varchar) as decimal(30,8))*100,0) as bigint)"


@query("money_to_minor", f"""select o_orderkey, {MINOR_SQL} as minor,
  cast(round_even(cast(cast(o_totalprice as varchar) as decimal(30,8))*10,0) as bigint) as tenths from orders""")
def _(t):
    return t.orders.select("o_orderkey", money.to_minor("o_totalprice").alias("minor"),
                           money.to_minor("o_totalprice", 1).alias("tenths"))


@query("money_from_minor", f"select o_orderkey, {MINOR_SQL}::double/100 as amount from orders")
def _(t):
    return t.orders.select("o_orderkey", money.from_minor(money.to_minor("o_totalprice")).cast("double").alias("amount"))


@query("money_pct_of", f"""select o_orderkey, {q.pct(MINOR_SQL, "'0.18'")} as tax, {q.pct(MINOR_SQL, "'0.05'")} as disc,
  {q.pct('o_orderkey', "'0.5'")} as half from orders""")
def _(t):
    m = money.to_minor("o_totalprice")
    return t.orders.select("o_orderkey", money.pct_of(m, "0.18").alias("tax"), money.pct_of(m, "0.05").alias("disc"),
                           money.pct_of("o_orderkey", "0.5").alias("half"))


@query("money_arithmetic", f"""select l_orderkey, l_linenumber, sum(p*l_quantity::bigint)::bigint as gross,
  sum(p*l_quantity::bigint - d)::bigint as net, sum(p + d)::bigint as added from (select *, cast(round_even(cast(cast(l_extendedprice as varchar) as decimal(30,8))*100,0) as bigint) as p,
  {q.pct("cast(round_even(cast(cast(l_extendedprice as varchar) as decimal(30,8))*100,0) as bigint)", 'l_discount')} as d from lineitem)
  group by all""")
def _(t):
    p = money.to_minor("l_extendedprice")
    d = money.pct_of(p, F.col("l_discount"))
    li = t.lineitem.select("l_orderkey", "l_linenumber", money.mul(p, "l_quantity").alias("gross"),
                           money.sub(money.mul(p, "l_quantity"), d).alias("net"), money.add(p, d).alias("added"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(c).alias(c) for c in ("gross", "net", "added")])


@query("split_amount", f"""with m as (select o_orderkey, {MINOR_SQL} - 20000000 as total from orders)
 select o_orderkey, i + 1 as part_no, (floor(total/3.0)::bigint + case when i < total - 3*floor(total/3.0)::bigint then 1 else 0 end) as amount
 from m, (select unnest(range(0,3)) as i)""")
def _(t):
    total = money.to_minor("o_totalprice") - 20_000_000
    parts = t.orders.select("o_orderkey", F.posexplode(money.split_amount(total, 3)).alias("i", "amount"))
    return parts.select("o_orderkey", (F.col("i") + 1).alias("part_no"), "amount")


def _fmt_sql(m: str, sym: str, digits: int) -> str:
    whole = f"format('{{:,}}', abs({m}) // {10**digits})"
    frac = f" || '.' || lpad((abs({m}) % {10**digits})::varchar, {digits}, '0')" if digits else ""
    return f"case when {m} < 0 then '-' else '' end || '{sym}' || {whole}{frac}"


@query("money_format", f"""with m as (select c_custkey, cast(round_even(cast(cast(c_acctbal as varchar) as decimal(30,8))*100,0) as bigint) as b from customer)
 select c_custkey, {_fmt_sql('b', '$', 2)} as usd, {_fmt_sql('b', '¥', 0)} as jpy, {_fmt_sql('b', 'BHD', 3)} || ' BHD' as bhd,
 {_fmt_sql('b', 'XXX', 2)} as other from m""")
def _(t):
    b = money.to_minor("c_acctbal")
    return t.customer.select("c_custkey", money.fmt(b, "USD").alias("usd"), money.fmt(b, "JPY").alias("jpy"),
                             money.fmt(b, "BHD", True).alias("bhd"), money.fmt(b, F.lit("XXX")).alias("other"))


@query("money_reconcile", """with l as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) s from lineitem group by 1),
 j as (select o_orderkey, cast(s*100 as bigint) as expected, cast(round_even(cast(cast(o_totalprice as varchar) as decimal(30,8))*100,0) as bigint) as actual
   from orders join l on o_orderkey=l_orderkey)
 select o_orderkey, 'order reconciliation' as "check", expected, actual, actual-expected as diff, expected=actual as passed from j""")
def _(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money.to_minor("l_extendedprice")).alias("e"))
    j = t.orders.select("o_orderkey", money.to_minor("o_totalprice").alias("a")).join(sums, "o_orderkey")
    return j.select("o_orderkey", money.reconcile("e", "a", "order").alias("r")).select("o_orderkey", "r.*")


@query("locale_date_format", """select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as pk, strftime(o_orderdate, '%m/%d/%Y') as us,
 strftime(o_orderdate, '%d.%m.%Y') as eu from orders""")
def _(t):
    return t.orders.select("o_orderkey", *[money.format_date("o_orderdate", locales.FORMATS[c]["date_format"]).alias(c)
                                           for c in ("pk", "us", "eu")])
