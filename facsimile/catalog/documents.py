"""Invoice and statement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.registry import query
from facsimile.functions import keyed, money
from facsimile.operators import domains, invoices, scale, statements
from facsimile.sources import locales

SEED = 42
CENTS = "cast(round_even(cast(cast({} as varchar) as decimal(30,8))*100,0) as bigint)"


def items(t):
    return t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("int").alias("quantity"),
                             money.to_minor("l_extendedprice").alias("unit_price"),
                             (F.col("l_discount") + 0.0).cast("decimal(12,8)").alias("discount_pct"))


ITEMS = f"select l_orderkey as order_id, l_quantity::int as quantity, {CENTS.format('l_extendedprice')} as unit_price, cast(l_discount as decimal(12,8)) as discount_pct from lineitem"
LINES = f"select *, unit_price*quantity - line_discount as line_total from (select *, {q.pct('unit_price*quantity', 'discount_pct')} as line_discount from ({ITEMS}))"


def totals_sql(lines: str, key: str, rules: list[dict], discount: str, shipping: int) -> str:
    taxes = [q.pct("net_amount", f"'{r['rate']}'") for r in rules]
    return f"""select *, net_amount + tax_total + shipping as grand_total from (select {key}, subtotal, n_lines, discount_total, net_amount, {' + '.join(taxes)} as tax_total,
 {shipping}::bigint as shipping, {taxes[0]} as first_tax from (select *, subtotal - discount_total as net_amount from (select *, {q.pct('subtotal', f"'{discount}'")} as discount_total
  from (select {key}, sum(line_total)::bigint as subtotal, count(*) as n_lines from ({lines}) group by 1))))"""


@query("price_invoice_lines", f"select order_id, quantity, unit_price, sum(line_discount)::bigint as line_discount, sum(line_total)::bigint as line_total from ({LINES}) group by 1,2,3")
def _(t):
    return invoices.price_lines(items(t)).groupBy("order_id", "quantity", "unit_price").agg(
        F.sum("line_discount").alias("line_discount"), F.sum("line_total").alias("line_total"))


@query("price_invoices", totals_sql(LINES, "order_id", locales.TAX_RULES["in"], "0.03", 500))
def _(t):
    inv = invoices.price_invoices(invoices.price_lines(items(t)), "order_id", locales.TAX_RULES["in"], "0.03", 500)
    return inv.withColumn("first_tax", F.col("taxes")[0]["amount"]).drop("taxes", "amount_paid", "balance_due")


RECIP = q.choice(q.u(SEED, "invoice_recipient", key="order_id"), invoices.RECIPIENTS)


@query("invoices_from_orders", f"""select order_id, 'INV-' || order_id as invoice_number, strftime(o_orderdate,'%Y-%m-%d') as issue_date,
 strftime(o_orderdate::date + 30,'%Y-%m-%d') as due_date, {RECIP} as recipient, 'PKR' as currency, subtotal, tax_total, grand_total
 from ({totals_sql(f"select order_id, unit_price*quantity as line_total from ({ITEMS})", "order_id", locales.TAX_RULES["pk"], "0", 0)}) join orders on o_orderkey = order_id""")
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"))
    inv, _ = invoices.invoices_from_orders(orders, items(t))
    return inv.select("order_id", "invoice_number", F.col("issue_date").cast("string").alias("issue_date"),
                      F.col("due_date").cast("string").alias("due_date"), "recipient", "currency", "subtotal", "tax_total",
                      "grand_total")


NO = "invoice_no"
PROD = list(invoices.PRODUCTS)
GEN = f"""heads as (select c_custkey as invoice_no from customer),
 draws as (""" + " union all ".join(
    f"select invoice_no, {i} as p, {q.u(SEED, 'invoice_product', i, key=NO)} as u from heads" for i in range(1, len(PROD) + 1)) + f"""),
 first_round as (select invoice_no, p, row_number() over (partition by invoice_no order by u, p) as line_no from draws),
 -- beyond the catalogue's length the same order comes again, with draws of its own
 picked as (select invoice_no, p, line_no, '' as again from first_round union all
            select invoice_no, p, line_no + {len(PROD)}, '/1' as again from first_round),
 all_lines as (select invoice_no, line_no, ({q.array(PROD)})[p] as description,
   (1+floor({q.u(SEED, 'invoice_qty', key="(invoice_no::varchar || '/' || p::varchar || again)")}*4.0::double))::int as quantity,
   ({q.array(list(invoices.PRODUCTS.values()))})[p]::bigint as unit_price from picked),
 lines as (select * from all_lines where line_no <= 3)"""


def invoice_numbers(t):
    return t.customer.select(F.col("c_custkey").alias("invoice_no"))


@query("generate_invoices", f"""with {GEN}, tot as ({totals_sql("select invoice_no, unit_price*quantity as line_total from lines", "invoice_no", locales.TAX_RULES["pk"], "0.05", 0)})
 select invoice_no, 'INV-' || (10000+floor({q.u(SEED, 'invoices', key=NO)}*89999.0::double)::bigint) as invoice_number,
  strftime(date '2025-06-30' - (1+floor({q.u(SEED, 'invoices', key=NO, lane=1)}*89.0::double))::int,'%Y-%m-%d') as issue_date,
  {q.choice(q.u(SEED, 'invoices', key=NO, lane=2), invoices.ISSUERS)} as issuer, {q.choice(q.u(SEED, 'invoices', key=NO, lane=3), invoices.RECIPIENTS)} as recipient,
  subtotal, discount_total, tax_total, grand_total from heads join tot using (invoice_no)""")
def _(t):
    inv, _ = invoices.generate_invoices(t.spark, 0, 3, "2025-06-30", SEED, discount_pct="0.05", numbers=invoice_numbers(t))
    return inv.select("invoice_no", "invoice_number", F.col("issue_date").cast("string").alias("issue_date"), "issuer",
                      "recipient", "subtotal", "discount_total", "tax_total", "grand_total")


@query("generate_invoice_lines", f"with {GEN} select *, unit_price*quantity as line_total from all_lines where line_no <= 27")
def _(t):
    heads = invoices.invoice_heads(t.spark, 0, "2025-06-30", SEED, numbers=invoice_numbers(t))
    return invoices.price_lines(invoices.invoice_lines(heads, 27, SEED), None).drop("line_discount")  # more than the catalogue has


LABELS = ["subtotal equals sum of lines", "net equals subtotal - discount", "grand total equals net + tax + shipping"]


@query("reconcile_invoices", f"""with i as (select count(distinct l_orderkey) as n, count(*) as l from lineitem)
 select unnest({q.array(LABELS)}) as "check", n as checked, 0::bigint as failed from i union all select 'line equals quantity x price - discount', l, 0 from i""")
def _(t):
    lines = invoices.price_lines(items(t))
    inv = invoices.price_invoices(lines, "order_id", locales.TAX_RULES["us"], "0.1")
    return invoices.reconcile_invoices(inv, lines, "order_id")


# a wrong total on every tenth order, so the check has something to find
@query("reconcile_invoices_broken", """with i as (select distinct l_orderkey as k from lineitem)
 select 'grand total equals net + tax + shipping' as "check", count(*) as checked, count(*) filter (where k % 10 = 0) as failed from i""")
def _(t):
    lines = invoices.price_lines(items(t))
    inv = invoices.price_invoices(lines, "order_id", locales.TAX_RULES["us"])
    bad = inv.withColumn("grand_total", F.col("grand_total") + F.when(F.col("order_id") % 10 == 0, 1).otherwise(0))
    return invoices.reconcile_invoices(bad, lines, "order_id").filter("check like 'grand%'")


# --- statements over the events table: a user is an account, an event an entry ---------------------------

IN_TYPES = "('purchase','signup')"
EV = f"""(select user_id as account_id, ts::date as date, event_id as seq, case when event_type in {IN_TYPES} then 0 else {CENTS.format('value')} end as debit,
 case when event_type in {IN_TYPES} then {CENTS.format('value')} else 0 end as credit from events)"""
BAL = f"(select *, 100000 + sum(credit-debit) over (partition by account_id order by date, seq)::bigint as balance from {EV})"
FLOOR = 50_000


def entries(t):
    amount = money.to_minor("value")
    credit = F.col("event_type").isin("purchase", "signup")
    zero = F.lit(0).cast("bigint")
    return t.events.select(
        F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("date"), F.col("event_id").alias("seq"),
        F.lit(1).alias("step"), F.col("event_type").alias("description"), F.col("event_type").alias("category"),
        F.lit("").alias("merchant"), F.when(credit, zero).otherwise(amount).alias("debit"),
        F.when(credit, amount).otherwise(zero).alias("credit"), (F.col("event_type") == "error").alias("is_recurring"))


def event_fleet(t, target=None):
    users = t.events.select("user_id").distinct()
    return statements.fleet(users, "user_id", "2024-02-15", 60, 100_000, FLOOR, target)


@query("statement_balance", f"select account_id, strftime(date,'%Y-%m-%d') as date, seq, balance from {BAL}")
def _(t):
    return statements.with_balance(entries(t), event_fleet(t)).select("account_id", F.col("date").cast("string").alias("date"), "seq", "balance")


NEED = f"""(select *, max(greatest(0, {FLOOR}-balance)) over (partition by account_id order by date, seq) as need,
 coalesce(max(greatest(0, {FLOOR}-balance)) over (partition by account_id order by date, seq rows between unbounded preceding and 1 preceding),0) as had from {BAL})"""
TOPPED = f"""(select account_id, date, seq, 1 as step, debit, credit, balance+need as balance from {NEED}
 union all select account_id, date, seq, 0, 0, need-had, balance-credit+debit+need from {NEED} where need > had)"""


def slim(df):
    return df.select("account_id", F.col("date").cast("string").alias("date"), "seq", "step", "debit", "credit", "balance")


@query("topup_floor", f"select account_id, strftime(date,'%Y-%m-%d') as date, seq, step, debit, credit, balance from {TOPPED}")
def _(t):
    return slim(statements.enforce_min_balance(entries(t), event_fleet(t)))


@query("reduce_to_floor", f"""with n as (select b.*, event_type = 'error' as rec, need - had as lack from {NEED} b join events on event_id = seq),
 c as (select *, case when rec then 0 else least(lack, debit) end as cut from n)
 select account_id, strftime(date,'%Y-%m-%d') as date, seq, 1 as step, debit-cut as debit, credit, balance+need as balance from c
 union all select account_id, strftime(date,'%Y-%m-%d'), seq, 0, 0, lack-cut, balance-credit+debit+had+lack-cut from c where lack-cut > 0""")
def _(t):
    return slim(statements.enforce_min_balance(entries(t), event_fleet(t), "reduce"))


@query("closing_target", f"""with c as (select account_id, max(seq) as last_seq, 100000+sum(credit-debit)::bigint as closing from {TOPPED} group by 1),
 f as (select account_id, date '2024-02-15' as date, last_seq+1 as seq, 2 as step, case when 200000 > closing then 0 else closing-200000 end as debit,
   case when 200000 > closing then 200000-closing else 0 end as credit, 200000::bigint as balance from c where abs(200000-closing) > 5000)
 select account_id, strftime(date,'%Y-%m-%d') as date, seq, step, debit, credit, balance from (select * from {TOPPED} union all select * from f)""")
def _(t):
    fleet = event_fleet(t, 200_000)
    return slim(statements.hit_closing_target(statements.enforce_min_balance(entries(t), fleet), fleet))


@query("statement_totals", f"""with b as (select *, balance from {BAL}), d as (select account_id, unnest(generate_series(date '2023-12-17', date '2024-02-15', interval 1 day))::date as day from (select distinct account_id from b)),
 e as (select d.account_id, day, 100000+coalesce((select sum(credit-debit) from b where b.account_id=d.account_id and b.date<=day),0) as eod from d),
 a as (select account_id, trunc(avg(eod))::bigint as avg_daily_balance from e group by 1),
 s as (select account_id, sum(debit)::bigint as total_debits, sum(credit)::bigint as total_credits, count(*) as n_transactions, min(balance) >= {FLOOR} as floor_met,
  100000+sum(credit-debit)::bigint as closing_balance from b group by 1)
 select *, null::boolean as target_met from s join a using (account_id)""")
def _(t):
    fleet = event_fleet(t)
    return statements.statement_totals(statements.with_balance(entries(t), fleet), fleet)


@query("reconcile_statements", f"""select 'running balance' as "check", count(*) as checked, 0::bigint as failed from {TOPPED}
 union all select unnest(['closing balance','opening + credits - debits']), count(distinct user_id), 0 from events""")
def _(t):
    fleet = event_fleet(t)
    bal = scale.cut(statements.enforce_min_balance(entries(t), fleet))  # read once for each check and for the totals
    return statements.reconcile_statements(bal, fleet, statements.statement_totals(bal, fleet))


# --- generated statements: one account per supplier -------------------------------------------------------

RULES = ({"type": "salary", "day": 1, "amount": 180_000, "description": "Monthly Salary"},
         {"type": "utilities", "day": 10, "amount": 8_000, "description": "Utility Bill"})
REC = f"""(with r(rule, type, day, amount, description) as (values (0,'salary',1,180000,'Monthly Salary'),(1,'utilities',10,8000,'Utility Bill')),
 d as (select s_suppkey as account_id, unnest(generate_series(date '2025-04-01', date '2025-06-30', interval 1 day))::date as date from supplier)
 select account_id, date, date_diff('day', date '2025-04-01', date)*2+rule as seq, type as category, description, case when rule=0 then 0 else amount end as debit, case when rule=0 then amount else 0 end as credit
 from d join r on day(date) = r.day)"""


def sup_fleet(t, **kw):
    return statements.fleet(t.supplier, "s_suppkey", "2025-06-30", 90, **kw)


@query("recurring_entries", f"select account_id, strftime(date,'%Y-%m-%d') as date, seq::bigint as seq, category, description, debit::bigint as debit, credit::bigint as credit from {REC}")
def _(t):
    return statements.recurring_entries(sup_fleet(t), RULES, SEED).select(
        "account_id", F.col("date").cast("string").alias("date"), "seq", "category", "description", "debit", "credit")


DK = "(account_id::varchar || '/' || seq::varchar)"


def du(path, lane):
    return q.u(SEED, "statement", path, key=DK, lane=lane)


def amt(i):
    return "(case category " + " ".join(f"when '{c}' then {p[i]}.0" for c, p in statements.AMOUNTS.items()) + " end::double)"


DISC = f"""(select account_id, date, seq+1000000 as seq, category, trunc(least(greatest({q.normal(du('amount', 0), du('amount', 1), amt(0), amt(1))},{amt(2)}),{amt(3)}))::bigint as debit,
  {q.choice(du('amount', 2), domains.FIRST_WORDS)} || ' ' || (case category {" ".join(f"when '{c}' then '{x}'" for c, x in statements.MERCHANT_TAILS.items())} end) as merchant
 from (select account_id, seq, DAYEXPR as date, {q.weighted(du('pick', 0), statements.SPEND_MIX)} as category
 from (select s_suppkey as account_id, unnest(range(1, 1+greatest(0, 30*3 - (select count(*) from {REC} r where r.account_id = s_suppkey))))::bigint as seq from supplier)))"""
UNIFORM_DAY = f"date '2025-04-01' + floor({du('pick', 1)}*91.0::double)::int"
WANT = q.bucket_of(du("pick", 1), keyed.cumulative(statements.WEEKDAY_WEIGHTS)[:-1])
# 2025-04-01 is a Tuesday (weekday 1)
FIRST = f"((({WANT}) - 1 + 7) % 7)"
WEEKDAY_DAY = f"date '2025-04-01' + ({FIRST} + 7*floor({du('pick', 2)}*(floor((90.0-{FIRST})/7.0)+1)))::int"


def shown_disc(df):
    return df.select("account_id", F.col("date").cast("string").alias("date"), "seq", "category", "debit", "merchant")


query("discretionary_entries", f"select account_id, strftime(date,'%Y-%m-%d') as date, seq, category, debit, merchant from {DISC.replace('DAYEXPR', UNIFORM_DAY)}")(
    lambda t: shown_disc(statements.discretionary_entries(sup_fleet(t), RULES, seed=SEED)))
query("discretionary_entries_weekday", f"select account_id, strftime(date,'%Y-%m-%d') as date, seq, category, debit, merchant from {DISC.replace('DAYEXPR', WEEKDAY_DAY)}")(
    lambda t: shown_disc(statements.discretionary_entries(sup_fleet(t), RULES, seed=SEED, weekday_weights=True)))


@query("statement_fleet", """select count(*) as accounts, count(*) as floors_met, count(*) as targets_met, 0::bigint as failed from supplier""")
def _(t):
    fleet = sup_fleet(t, opening=120_000, min_balance=50_000, target_closing=150_000)
    bal, totals = statements.statement_fleet(fleet, RULES, seed=SEED, mode="reduce")
    failed = statements.reconcile_statements(bal, fleet, totals).agg(F.sum("failed")).scalar()
    return totals.agg(F.count("*").alias("accounts"), F.count_if("floor_met").alias("floors_met"),
                      F.count_if("target_met").alias("targets_met"), F.max(failed).alias("failed"))
