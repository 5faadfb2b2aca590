"""Generator packs sized by the given tables: one generated entity per customer or part."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.draws import day_weight_sql
from facsimile.catalog.registry import query
from facsimile.functions import fictional as fic
from facsimile.functions import keyed
from facsimile.operators import checks as ck
from facsimile.operators import domains, ordered
from facsimile.plans import contract as ct
from facsimile.plans import fintech as ft
from facsimile.plans import generate as gen
from facsimile.plans import packs
from facsimile.plans import retail as rt
from facsimile.sources import locales

SEED = 42


def u(*path, key, lane=0):
    return q.u(SEED, *path, key=key, lane=lane)


# --- retail ------------------------------------------------------------------------------------------

PK = locales.NAMES["pk"]
CID = "customer_id"
CUSTOMERS = f"""cust as (select customer_id, case when {u('customers', 'name', key=CID)} < 0.5 then {q.choice(u('customers', 'name', key=CID, lane=1), PK['male'])}
   else {q.choice(u('customers', 'name', key=CID, lane=1), PK['female'])} end as first, {q.choice(u('customers', 'name', key=CID, lane=2), PK['family'])} as last,
   {q.weighted(u('customers', 'traits', key=CID), locales.CITIES['pk'])} as city,
   date '2023-01-01' + floor({u('customers', 'traits', key=CID, lane=1)}*1096.0::double)::int as signup_date,
   {q.weighted(u('customers', 'traits', key=CID, lane=2), rt.SEGMENT_WEIGHTS)} as segment
  from (select c_custkey as customer_id from customer))"""
PNO = "product_no"
MINOR = "cast(round_even(cast(cast({} as varchar) as decimal(30,8))*100,0) as bigint)"
PRODUCTS = f"""prod as (select product_no, 'SKU-' || lpad(product_no::varchar,greatest(4,length(product_no::varchar))::int,'0') as sku,
   {q.choice(u('products', 'name', key=PNO), domains.FIRST_WORDS)} || ' ' || {q.choice(u('products', 'name', key=PNO, lane=1), domains.SECOND_WORDS)} as name,
   {q.choice(u('products', 'name', key=PNO, lane=2), rt.CATEGORIES)} as category,
   unit_price from (select row_number() over (order by p_partkey) as product_no, {MINOR.format('p_retailprice')} as unit_price from part)),
 pw as (select product_no, greatest(round_even(4294967296.0/pow(product_no,0.8),0),1.0)::bigint as weight from prod),
 ps as (select product_no as pno, sum(weight) over (order by product_no)::bigint - weight as lo, sum(weight) over ()::bigint as total from pw)"""
OID, IID = "order_id", "item_id"
ORDERS = f"""cnt as (select *, {q.bucket_of(u('orders', 'count', key=CID), keyed.negbin_cdf(3.2, 1.4))}::bigint as n from cust),
 pos as (select *, sum(n) over (order by customer_id)::bigint as upto from cnt),
 o1 as (select customer_id, signup_date, segment, upto-n+seq+500000 as order_id from (select *, unnest(range(1, n+1)) as seq from pos)),
 heads as (select order_id, customer_id, segment, signup_date + floor({u('orders', key=OID)}*(greatest(date '2025-12-31' - signup_date,0)+1)::double)::int as order_date,
   {q.weighted(u('orders', key=OID, lane=1), rt.STATUS_WEIGHTS)} as status from o1)"""
ITEMS = f"""ic as (select order_id, 1+floor({u('items', 'count', key=OID)}*5.0::double)::bigint as n from heads),
 ip as (select *, sum(n) over (order by order_id)::bigint as upto from ic),
 i1 as (select order_id, upto-n+seq+9000000 as item_id from (select *, unnest(range(1, n+1)) as seq from ip)),
 i2 as (select *, pno as product_no, (1+floor({u('items', key=IID, lane=1)}*4.0::double)::bigint)::int as quantity from (select *, floor({u('items', key=IID)}*(select max(total) from ps)::double)::bigint as spot from i1) asof join ps on spot >= lo),
 items as (select item_id, order_id, sku, quantity, unit_price, unit_price*quantity as line_total from i2 join prod using (product_no))"""
PRICED = f"""sums as (select order_id, sum(line_total)::bigint as subtotal from items group by 1),
 d as (select heads.*, subtotal, case segment when 'vip' then {q.pct('subtotal', "'0.10'")} when 'loyal' then {q.pct('subtotal', "'0.05'")} else 0 end as discount
   from heads join sums using (order_id)),
 priced as (select order_id, customer_id, strftime(order_date,'%Y-%m-%d') as order_date, status, subtotal, discount, tax, subtotal-discount+tax as total
   from (select *, {q.pct('subtotal-discount', "'0.18'")} as tax from d))"""


def people(t):
    return t.customer.select(F.col("c_custkey").alias("customer_id"))


def goods(t):
    from facsimile.functions import money
    parts = t.part.select("p_partkey", money.to_minor("p_retailprice").alias("unit_price"))
    return ordered.dense_ids(parts, ["p_partkey"], name="product_no").drop("p_partkey")


def retail(t):
    return rt.generate_retail(t.spark, SEED, people=people(t), goods=goods(t))


def day(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


query("retail_customers", f"""with {CUSTOMERS} select customer_id, first || ' ' || last as full_name,
 lower(first) || '.' || lower(replace(last,' ','')) || customer_id::varchar || '@example.com' as email, city,
 strftime(signup_date,'%Y-%m-%d') as signup_date, segment from cust""")(
    lambda t: day(rt.customers(t.spark, 0, SEED, people=people(t)), "signup_date"))


query("retail_products", f"with {PRODUCTS} select product_no, sku, name, category, unit_price from prod")(
    lambda t: rt.products(t.spark, seed=SEED, goods=goods(t)))
query("retail_orders", f"with {CUSTOMERS}, {PRODUCTS}, {ORDERS}, {ITEMS}, {PRICED} select * from priced")(
    lambda t: day(retail(t)["orders"], "order_date"))
query("retail_items", f"with {CUSTOMERS}, {PRODUCTS}, {ORDERS}, {ITEMS} select * from items")(
    lambda t: retail(t)["order_items"])

PROOF_LABELS = [c.label for c in ck.retail_checks()]
query("retail_proof", "select unnest(" + q.array(PROOF_LABELS) + ') as "check", 0::bigint as violations, true as passed')(
    lambda t: ck.prove(retail(t), packs.pack("retail")["checks"]()).drop("error"))


# --- price_orders over the given tables: orders priced from their own lines --------------------------

@query("price_orders", f"""with i as (select l_orderkey, cast(round_even(cast(cast(l_extendedprice as varchar) as decimal(30,8))*100,0) as bigint) as line_total from lineitem),
 s as (select l_orderkey, sum(line_total)::bigint as subtotal from i group by 1),
 h as (select o_orderkey as order_id, case when o_custkey % 20 = 0 then 'vip' when o_custkey % 4 = 0 then 'loyal' else 'regular' end as segment, coalesce(subtotal,0) as subtotal
   from orders left join s on o_orderkey = l_orderkey),
 d as (select *, case segment when 'vip' then {q.pct('subtotal', "'0.10'")} when 'loyal' then {q.pct('subtotal', "'0.05'")} else 0 end as discount from h),
 t as (select *, {q.pct('subtotal-discount', "'0.18'")} as tax from d)
 select order_id, subtotal, discount, tax, subtotal-discount+tax as total from t""")
def _(t):
    from facsimile.functions import money
    heads = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                            F.expr("case when o_custkey % 20 = 0 then 'vip' when o_custkey % 4 = 0 then 'loyal' else 'regular' end")
                            .alias("segment"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"))
    items = t.lineitem.select(F.col("l_orderkey").alias("order_id"), money.to_minor("l_extendedprice").alias("line_total"))
    return rt.price_orders(heads, items).select("order_id", "subtotal", "discount", "tax", "total")


# --- fintech -----------------------------------------------------------------------------------------

ANO = "account_no"
ACCOUNTS = f"""acct as (select account_no, 'ACCT-' || lpad(account_no::varchar,6,'0') as account_id,
   {q.weighted(u('accounts', 'traits', key=ANO), ft.ACCOUNT_TYPES)} as account_type, {q.choice(u('accounts', 'traits', key=ANO, lane=1), ft.INSTITUTIONS)} as institution,
   date '2024-01-01' + floor({u('accounts', 'traits', key=ANO, lane=2)}*547.0::double)::int as open_date,
   opening_balance, holder_name,
   'holder' || account_no || '@example.com' as holder_email, {q.weighted(u('accounts', 'traits', key=ANO, lane=3), ft.ACCOUNT_STATUS)} as status
  from (select s_suppkey as account_no, s_name as holder_name, {MINOR.format('s_acctbal')} as opening_balance from supplier))"""
CNO = "card_no"
CARDS = f"""card as (select card_no, 'CARD-' || lpad(card_no::varchar,6,'0') as card_id, owner as account_no, 'ACCT-' || lpad(owner::varchar,6,'0') as account_id,
   'XXXX-XXXX-XXXX-' || (1000+floor({u('cards', 'owner', key=CNO, lane=1)}*8999.0::double)::bigint) as card_number,
   {q.choice(u('cards', 'traits', key=CNO), ft.CARD_NETWORKS)} as network,
   strftime(date '2025-06-30' + (30+floor({u('cards', 'traits', key=CNO, lane=1)}*700.0::double)::int), '%m/%Y') as expiry,
   {q.weighted(u('cards', 'traits', key=CNO, lane=2), ft.CARD_STATUS)} as status, {q.weighted(u('cards', 'traits', key=CNO, lane=3), ft.CARD_LIMITS)}::bigint as daily_limit
  from (select s_suppkey as card_no, s_suppkey as owner from supplier where s_acctbal > 0))"""
MNO = "merchant_no"
MERCHANTS = f"""merch as (select merchant_no, 'MERCH-' || lpad(merchant_no::varchar,greatest(4,length(merchant_no::varchar))::int,'0') as merchant_id,
   c_name as name,
   {q.choice(u('merchants', key=MNO), list(ft.TX_CATEGORIES))} as category, (1000+floor({u('merchants', key=MNO, lane=1)}*8999.0::double))::int as mcc_code
  from (select row_number() over (order by c_custkey) as merchant_no, c_name from customer)),
 mw as (select merchant_no, greatest(round_even(4294967296.0/pow(merchant_no,0.6),0),1.0)::bigint as weight from merch),
 ms as (select merchant_no as mno, sum(weight) over (order by merchant_no)::bigint - weight as lo, sum(weight) over ()::bigint as total from mw)"""
TNO = "tx_no"
MU = "case category " + " ".join(f"when '{c}' then {m}.0" for c, (m, _) in ft.AMOUNTS.items()) + " end::double"
SD = "case category " + " ".join(f"when '{c}' then {s}.0" for c, (_, s) in ft.AMOUNTS.items()) + " end::double"
AMT = q.normal(u('transactions', 'amount', key=TNO), u('transactions', 'amount', key=TNO, lane=1), f"({MU})", f"({SD})")
TX = f"""nc as (select account_no, count(*) as n_cards from card group by 1),
 tc as (select *, {q.bucket_of(u('transactions', 'count', key=ANO), keyed.negbin_cdf(25.0, 1.5))}::bigint as n from acct left join nc using (account_no)),
 tp as (select *, sum(n) over (order by account_no)::bigint as upto from tc),
 t1 as (select *, upto-n+seq as tx_no from (select *, unnest(range(1, n+1)) as seq from tp)),
 t2 as (select account_no, account_id, opening_balance, tx_no, case when n_cards > 0 and {u('transactions', 'pick', key=TNO)} < 0.85 then
    1+floor({u('transactions', 'pick', key=TNO, lane=1)}*n_cards::double)::bigint end as card_seq,
   open_date + floor({u('transactions', 'pick', key=TNO, lane=2)}*(greatest(date '2025-06-30'-open_date,0)+1)::double)::int as tx_date,
   {q.weighted(u('transactions', 'pick', key=TNO, lane=3), ft.TX_TYPES)} as tx_type,
   mno as merchant_no from (select *, floor({u('transactions', 'amount', key=TNO, lane=2)}*(select max(total) from ms)::double)::bigint as spot from t1) asof join ms on spot >= lo),
 cs as (select account_no, card_id, row_number() over (partition by account_no order by card_no) as card_seq from card),
 t3 as (select t2.*, merchant_id, name, category, card_id from t2 join merch using (merchant_no) left join cs using (account_no, card_seq)),
 t4 as (select *, trunc(least(greatest({AMT},100.0),100000.0))::bigint as amount from t3),
 tx as (select 'TX-' || lpad(tx_no::varchar,8,'0') as tx_id, account_id, card_id, merchant_id, strftime(tx_date,'%Y-%m-%d') as tx_date, tx_type, category, amount,
   opening_balance + sum(case when tx_type in ('credit','reversal','interest') then amount else -amount end) over (partition by account_no order by tx_date, tx_no)::bigint as balance_after,
   name || ' - ' || upper(tx_type[1]) || tx_type[2:] as description from t4)"""


def owners(t):
    from facsimile.functions import money
    return t.supplier.select(F.col("s_suppkey").alias("account_no"), F.col("s_name").alias("holder_name"),
                             money.to_minor("s_acctbal").alias("opening_balance"))


def owned(t):
    return t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("card_no"), F.col("s_suppkey").alias("account_no"))


def shops(t):
    return ordered.dense_ids(t.customer.select("c_custkey", F.col("c_name").alias("name")), ["c_custkey"], name="merchant_no").drop("c_custkey")


def bank(t):
    return ft.generate_fintech(t.spark, SEED, owners=owners(t), owned=owned(t), shops=shops(t))


query("fintech_accounts", f"with {ACCOUNTS} select * exclude (account_no) replace (strftime(open_date,'%Y-%m-%d') as open_date) from acct")(
    lambda t: day(ft.accounts(t.spark, 0, SEED, owners=owners(t)).drop("account_no"), "open_date"))
query("fintech_cards", f"with {CARDS} select * exclude (card_no, account_no) from card")(
    lambda t: ft.cards(t.spark, 0, 0, SEED, owned=owned(t)).drop("card_no", "account_no"))
query("fintech_merchants", f"with {MERCHANTS} select merchant_no, merchant_id, name, category, mcc_code from merch")(
    lambda t: ft.merchants(t.spark, seed=SEED, shops=shops(t)))
query("fintech_transactions", f"with {ACCOUNTS}, {CARDS}, {MERCHANTS}, {TX} select * from tx")(
    lambda t: day(bank(t)["transactions"], "tx_date"))
query("fintech_proof", "select unnest(" + q.array([c.label for c in ck.fintech_checks()]) + ') as "check", 0::bigint as violations, true as passed')(
    lambda t: ck.prove(bank(t), packs.pack("fintech")["checks"]()).drop("error"))

EVENT_MINOR = "cast(round_even(cast(cast(value as varchar) as decimal(30,8))*100,0) as bigint)"


@query("running_balance", f"""select event_id, user_id, 100000 + sum(case when event_type in ('purchase','signup') then {EVENT_MINOR} else -{EVENT_MINOR} end)
 over (partition by user_id order by ts, event_id)::bigint as balance_after from events""")
def _(t):
    from facsimile.functions import money
    amount = money.to_minor("value")
    ev = t.events.select("event_id", "user_id", "ts", F.lit(100_000).alias("opening"),
                         F.when(F.col("event_type").isin("purchase", "signup"), amount).otherwise(-amount).alias("signed"))
    return ft.running_balance(ev, "user_id", ["ts", "event_id"], "signed", "opening", "balance_after").select(
        "event_id", "user_id", "balance_after")


# --- contract-driven ----------------------------------------------------------------------------------

TICKETS = ct.Table("tickets", (
    ct.Column("ticket_id", "id"), ct.Column("channel", "cat", weights={"web": 5, "phone": 3, "shop": 2}),
    ct.Column("urgent", "bool", true_rate=0.2), ct.Column("rating", "int", null_rate=0.1),
    ct.Column("fare_amount", "num"), ct.Column("cost", "money", minimum=10, maximum=90),
    ct.Column("opened", "date", start="2024-01-01", end="2024-12-31"), ct.Column("gender", "text"),
    ct.Column("website", "url")), primary_key="ticket_id")


def cu(col, lane=0):
    return u("contract", "tickets", col, key="row_no", lane=lane)


@query("synthesize_from_contract", f"""with r as (select c_custkey as row_no, lower(c_mktsegment) as channel from customer),
 cal as (select unnest(generate_series(date '2024-01-01', date '2024-12-31', interval 1 day))::date as d),
 w as (select d, {day_weight_sql('d')} as weight from cal), s as (select d, weight, sum(weight) over (order by d)::bigint as hi from w),
 od as (select row_no, d from (select row_no, floor({cu('opened')}*(select max(hi) from s)::double)::bigint as spot from r) o
   asof join (select hi-weight as lo, d from s) x on o.spot >= x.lo)
 select row_no + 10001 as ticket_id, channel, {cu('urgent')} < 0.2::double as urgent,
  case when {u('contract', 'tickets', 'rating', 'null', key='row_no')} >= 0.1::double then {q.rint(f"1.0::double+{cu('rating')}*4.0::double")}::bigint end as rating,
  round(5.0::double+{cu('fare_amount')}*145.0::double, 6) as fare_amount, {q.rint(f"10.0::double+{cu('cost')}*80.0::double")}::bigint as cost,
  strftime(d,'%Y-%m-%d') as opened, {q.choice(u('fictional', 'gender', key='row_no'), ['Male', 'Female', 'Other'])} as gender,
  'https://example.com/' || lpad(row_no::varchar,5,'0') as website from r join od using (row_no)""")
def _(t):
    given = t.customer.select(F.col("c_custkey").alias("row_no"), F.lower("c_mktsegment").alias("channel"))
    out = gen.synthesize_from_contract(t.spark, TICKETS, seed=SEED, given=given)
    return day(out, "opened").withColumn("fare_amount", F.round("fare_amount", 6))


SHOP = ct.Contract("shop", (
    ct.Table("visits", (ct.Column("visit_id", "id", start=1), ct.Column("store_id", "fk"), ct.Column("spend", "money", minimum=1, maximum=500)),
             primary_key="visit_id"),
    ct.Table("stores", (ct.Column("store_id", "id", start=101), ct.Column("city", "text"),
                        ct.Column("takings", "money", strategy={"kind": "rollup", "source_table": "visits", "source_column": "spend",
                                                                "group_by": "store_id", "operation": "sum"})),
             primary_key="store_id")))


def shop_rows(t):
    from facsimile.functions import money
    return {"stores": t.supplier.select(F.col("s_suppkey").alias("row_no")),
            "visits": t.orders.select(F.col("o_orderkey").alias("row_no"), money.to_minor("o_totalprice").alias("spend"))}


@query("generate_from_contract", f"""with st as (select s_suppkey as row_no, row_number() over (order by s_suppkey) - 1 as place from supplier),
 vv as (select floor({u('fk', 'visits', 'store_id', key='o_orderkey')}*(select count(*) from supplier)::double)::bigint as place,
   {MINOR.format('o_totalprice')} as spend from orders)
 select s.row_no + 101 as store_id, {q.weighted(u('fictional', 'city', key='row_no'), locales.CITIES['us'])} as city,
  coalesce((select sum(spend) from vv where vv.place = s.place),0)::bigint as takings from st s""")
def _(t):
    return gen.generate_from_contract(t.spark, SHOP, seed=SEED, given=shop_rows(t))["stores"]


@query("contract_link_proof", f"""select unnest({q.array(['visits.store_id has no matching stores.store_id', 'visits.visit_id primary_key',
  'visits.visit_id not_null', 'stores.store_id primary_key', 'stores.store_id not_null'])}) as "check", 0::bigint as violations, true as passed""")
def _(t):
    tables = gen.generate_from_contract(t.spark, SHOP, seed=SEED, given=shop_rows(t))
    return ck.prove(tables, ck.link_checks(SHOP.links()) + ck.contract_checks(SHOP.constraints())).drop("error")


@query("preview", f"""select c_custkey + 10001 as ticket_id, lower(c_mktsegment) as channel from customer order by c_custkey limit 50""")
def _(t):
    table = ct.Table("tickets", TICKETS.columns[:2], primary_key="ticket_id")
    given = t.customer.select(F.col("c_custkey").alias("row_no"), F.lower("c_mktsegment").alias("channel"))
    return gen.preview(t.spark, ct.Contract("p", (table,)), 50, SEED, {"tickets": given})["tickets"]


HINTS = {"gender": fic.CLOSED[0][1], "order_status": fic.CLOSED[1][1], "visit_reason": fic.CLOSED[2][1],
         "specialty": fic.CLOSED[3][1], "job": fic.JOBS, "color": fic.COLORS, "vehicle": fic.VEHICLES,
         "home_country": fic.COUNTRIES, "state": fic.STATES, "remark": fic.WORDS,
         "first_name": locales.NAMES["us"]["male"] + locales.NAMES["us"]["female"], "last_name": locales.NAMES["us"]["family"],
         "company": locales.pack("us")["companies"]}


@query("fictional_values", "select c_custkey, " + ", ".join(
    f"{q.choice(u('fictional', h, key='c_custkey'), words)} as {h}" for h, words in HINTS.items())
    + f""", '+00-000-' || (1000000+floor({u('fictional', 'phone', key='c_custkey')}*9000000.0::double)::bigint) as phone,
 'XXX-XX-' || lpad(c_custkey::varchar,4,'0') as passport, 'ZZ-' || (1000+floor({u('fictional', 'plate', key='c_custkey')}*9000.0::double)::bigint) as plate
 from customer""")
def _(t):
    cols = [*HINTS, "phone", "passport", "plate"]
    return t.customer.select("c_custkey", *[fic.fictional(h, "c_custkey", SEED).alias(h) for h in cols])
