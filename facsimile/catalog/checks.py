"""Integrity queries over the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.catalog.registry import Tables, query
from facsimile.operators import checks as ck
from facsimile.plans import contract as ct


def _line_total():
    return F.bround((F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
                    .cast("decimal(18,6)"), 2)


LINE_SQL = "round_even(cast(l_extendedprice*(1-l_discount)*(1+l_tax) as decimal(18,6)),2)"
PRICE_SQL = ("cast(round_even(cast(l_quantity as decimal(18,6))*cast(p_retailprice as decimal(18,6)),2)"
             " as decimal(18,2))")


def check_sql(parts: list[tuple[str, str]]) -> str:
    rows = [f"select '{label}' as \"check\", ({sql})::bigint as v" for label, sql in parts]
    return f"select \"check\", v as violations, v = 0 as passed from ({' union all '.join(rows)})"


ORPHAN_PARTS = [
    ("orders: customer unknown",
     "select count(*) from orders left join customer on o_custkey=c_custkey where c_custkey is null"),
    ("lines: order unknown",
     "select count(*) from lineitem left join orders on l_orderkey=o_orderkey where o_orderkey is null"),
    ("lines: part unknown",
     "select count(*) from lineitem left join part on l_partkey=p_partkey where p_partkey is null"),
    ("lines: supplier unknown",
     "select count(*) from lineitem left join supplier on l_suppkey=s_suppkey where s_suppkey is null"),
]
ROLLUP_PART = ("orders: total is not what the lines add up to",
               f"select count(*) from orders join (select l_orderkey, sum({LINE_SQL}) s from lineitem "
               "group by l_orderkey) x on o_orderkey=l_orderkey where cast(o_totalprice as decimal(18,2)) <> s")
CHILDLESS_PART = ("orders: no lines",
                  "select count(*) from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey)")


def order_checks() -> list[ck.Check]:
    return [
        ck.fk_check("orders", "o_custkey", "customer", "c_custkey", True, "orders: customer unknown"),
        ck.fk_check("lineitem", "l_orderkey", "orders", "o_orderkey", True, "lines: order unknown"),
        ck.fk_check("lineitem", "l_partkey", "part", "p_partkey", True, "lines: part unknown"),
        ck.fk_check("lineitem", "l_suppkey", "supplier", "s_suppkey", True, "lines: supplier unknown"),
        ck.Check("orders: total is not what the lines add up to", ("orders", "lineitem"),
                 lambda t: ck.rollup_mismatch(t["orders"], "o_orderkey",
                                              F.col("o_totalprice").cast("decimal(18,2)"),
                                              t["lineitem"], "l_orderkey", _line_total())),
        ck.Check("orders: no lines", ("orders", "lineitem"),
                 lambda t: ck.childless(t["orders"], "o_orderkey", t["lineitem"], "l_orderkey")),
    ]


def dataset(t: Tables, *names: str) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in names}


@query("prove_orders", check_sql([*ORPHAN_PARTS, ROLLUP_PART, CHILDLESS_PART]))
def prove_orders(t: Tables) -> DataFrame:
    ds = dataset(t, "orders", "lineitem", "customer", "part", "supplier")
    return ck.prove(ds, order_checks()).drop("error")


@query("check_orders_without_customer", check_sql(ORPHAN_PARTS[:1]))
def _(t):
    return ck.prove(dataset(t, "orders", "customer"), order_checks()).drop("error")


@query("check_items_without_order", check_sql(ORPHAN_PARTS[1:2]))
def _(t):
    return ck.prove(dataset(t, "orders", "lineitem"), order_checks()[1:2]).drop("error")


@query("check_items_without_product", check_sql(ORPHAN_PARTS[2:3]))
def _(t):
    return ck.prove(dataset(t, "part", "lineitem"), order_checks()[2:3]).drop("error")


@query("check_rollup_mismatch", check_sql([ROLLUP_PART]))
def _(t):
    return ck.prove(dataset(t, "orders", "lineitem"), order_checks()[4:5]).drop("error")


@query("check_orders_without_items", check_sql([CHILDLESS_PART]))
def _(t):
    return ck.prove(dataset(t, "orders", "lineitem"), order_checks()[5:6]).drop("error")


# net identity per line: gross - discount + tax against the half-even decimal total
@query("check_total_identity", check_sql([(
    "total identity",
    "select count(*) from lineitem where round_even(cast(l_extendedprice as decimal(18,2)) - "
    "cast(l_extendedprice*l_discount as decimal(18,6)) + cast(l_extendedprice*(1-l_discount)*l_tax as decimal(18,6)),2) "
    f"<> {LINE_SQL}")]))
def _(t):
    price = F.col("l_extendedprice")
    net = (price.cast("decimal(18,2)") - (price * F.col("l_discount")).cast("decimal(18,6)")
           + (price * (1 - F.col("l_discount")) * F.col("l_tax")).cast("decimal(18,6)"))
    chk = ck.Check("total identity", ("lineitem",),
                   lambda d: ck.count_where(d["lineitem"], F.bround(net, 2) != _line_total()))
    return ck.prove(dataset(t, "lineitem"), [chk]).drop("error")


@query("check_line_amount", check_sql([(
    "line amount differs from quantity x price",
    "select count(*) from lineitem join part on l_partkey=p_partkey "
    f"where cast(l_extendedprice as decimal(18,2)) <> {PRICE_SQL}")]))
def _(t):
    def count(d):
        # many lines share (part, quantity, price): collapse them before the join
        lines = d["lineitem"].groupBy("l_partkey", "l_quantity", "l_extendedprice").agg(F.count("*").alias("n"))
        want = F.bround(F.col("l_quantity").cast("decimal(18,6)") * F.col("p_retailprice").cast("decimal(18,6)"), 2)
        bad = (lines.join(d["part"].select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
               .filter(F.col("l_extendedprice").cast("decimal(18,2)") != want.cast("decimal(18,2)")))
        return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))

    chk = ck.Check("line amount differs from quantity x price", ("lineitem", "part"), count)
    return ck.prove(dataset(t, "lineitem", "part"), [chk]).drop("error")


@query("check_ship_before_order", check_sql([(
    "items shipped before order date",
    "select count(*) from lineitem join orders on l_orderkey=o_orderkey where l_shipdate < o_orderdate")]))
def _(t):
    chk = ck.Check("items shipped before order date", ("lineitem", "orders"),
                   lambda d: ck.out_of_order(d["lineitem"], "l_orderkey", "l_shipdate", d["orders"],
                                             "o_orderkey", "o_orderdate"))
    return ck.prove(dataset(t, "lineitem", "orders"), [chk]).drop("error")


DUP_PARTS = [("customers: key occurs again", "select count(*)-count(distinct c_custkey) from customer"),
             ("orders: key occurs again", "select count(*)-count(distinct o_orderkey) from orders"),
             ("lines: number occurs again", "select count(*)-count(distinct l_linenumber) from lineitem"),
             ("orders: key occurs again, nulls too",
              "select count(*)-count(distinct nullif(o_custkey,0)) from orders")]


@query("check_duplicates", check_sql(DUP_PARTS))
def _(t):
    keyed = t.orders.withColumn("k", F.expr("nullif(o_custkey, 0)"))
    checks = [ck.Check(label, (), lambda d, df=df, k=k: ck.duplicate_keys(df, k))
              for (label, _), df, k in zip(DUP_PARTS, (t.customer, t.orders, t.lineitem, keyed),
                                           ("c_custkey", "o_orderkey", "l_linenumber", "k"), strict=True)]
    return ck.prove({"customer": t.customer}, checks).drop("error")


@query("check_negative", check_sql([
    ("orders: total below zero", "select count(*) from orders where o_totalprice < 0"),
    ("customers: balance below zero", "select count(*) from customer where c_acctbal < 0")]))
def _(t):
    checks = [ck.Check("orders: total below zero", ("orders",),
                       lambda d: ck.count_where(d["orders"], F.col("o_totalprice") < 0)),
              ck.Check("customers: balance below zero", ("customer",),
                       lambda d: ck.count_where(d["customer"], F.col("c_acctbal") < 0))]
    return ck.prove(dataset(t, "orders", "customer"), checks).drop("error")


DECLARED = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
            ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]


@query("check_declared_fks", check_sql([
    (f"{c}.{f} has no matching {p}.{k}",
     f"select count(*) from {c} where {f} is not null and {f} not in (select {k} from {p})")
    for c, f, p, k in DECLARED]))
def _(t):
    names = {n for c, _, p, _ in DECLARED for n in (c, p)}
    return ck.prove(dataset(t, *sorted(names)), ck.link_checks(DECLARED)).drop("error")


# every seventh key is blanked and every eleventh points nowhere, so both flavours have work to do
@query("check_orphans_nullable_and_strict", """
with o as (select case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then -o_custkey-1
                       else o_custkey end as fk from orders)
select 'nullable' as flavour, (select count(*) from o where fk is not null
         and fk not in (select c_custkey from customer)) as violations
union all
select 'strict', (select count(*) from o left join customer on fk=c_custkey where c_custkey is null)""")
def _(t):
    fk = (F.when(F.col("o_orderkey") % 7 == 0, F.lit(None))
          .when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")))
    o = t.orders.select(fk.alias("fk"))
    parts = [ck.orphans(o, "fk", t.customer, "c_custkey", strict)
             .select(F.lit("strict" if strict else "nullable").alias("flavour"), "violations")
             for strict in (False, True)]
    return reduce(DataFrame.unionByName, parts)


@query("orphan_rows", """
select o_orderkey, fk from (select o_orderkey, case when o_orderkey % 11 = 0 then -o_custkey-1
  else o_custkey end as fk from orders) where fk not in (select c_custkey from customer)""")
def _(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey") - 1)
                        .otherwise(F.col("o_custkey")).alias("fk"))
    return ck.orphan_rows(o, "fk", t.customer, "c_custkey")


CONSTRAINTS = [("orders", "o_orderkey", "primary_key"), ("customer", "c_custkey", "primary_key"),
               ("customer", "c_name", "unique"), ("part", "p_name", "unique"),
               ("orders", "o_custkey", "not_null"), ("lineitem", "l_shipdate", "not_null")]


def _constraint_sql(table: str, col: str, rule: str) -> str:
    if rule == "not_null":
        return f"select count(*) from {table} where {col} is null"
    rows = "*" if rule == "primary_key" else col
    return f"select count({rows})-count(distinct {col}) from {table}"


@query("check_contract_constraints", check_sql([
    (f"{t} {c} {r}".replace(" ", ".", 1), _constraint_sql(t, c, r)) for t, c, r in CONSTRAINTS]))
def _(t):
    names = sorted({c[0] for c in CONSTRAINTS})
    return ck.prove(dataset(t, *names), ck.contract_checks(CONSTRAINTS)).drop("error")


ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_stats", " union all ".join(f"select '{n}' as \"table\", count(*) as rows from {n}" for n in ALL_TABLES))
def _(t):
    return ck.table_stats(dataset(t, *ALL_TABLES))


RULES_SQL = f"""
select 'price_positive' as "check", count(*) filter (where not coalesce(o_totalprice > 0, false)) as violations,
  count(*) filter (where not coalesce(o_totalprice > 0, false)) = 0 as passed, 'warn' as severity from orders
union all select 'customer_known', v, v = 0, 'error' from (select count(*) v from orders
  where o_custkey not in (select c_custkey from customer))
union all select 'items_roll_up', v, v = 0, 'error' from ({ROLLUP_PART[1].replace('count(*)', 'count(*) v', 1)
   .replace('round_even', 'round_even')})"""


@query("business_rules", RULES_SQL)
def _(t):
    ds = {"orders": t.orders.withColumn("total", F.col("o_totalprice").cast("decimal(18,2)")),
          "customer": t.customer, "lineitem": t.lineitem.withColumn("line_total", _line_total())}
    rules = [ck.row_rule("price_positive", "orders", "o_totalprice > 0", "warn"),
             ck.ref_rule("customer_known", "orders", "o_custkey", "customer", "c_custkey"),
             ck.rollup_rule("items_roll_up", "orders", "o_orderkey", "total", "lineitem", "l_orderkey", "line_total")]
    return ck.run_rules(ds, rules).drop("error")


# a contract's own rules over given rows in which violations are planted: a row condition, a condition
# that comes out null, a stored roll-up and a reference
@query("declared_rules", f"""with line as (select *, case when l_orderkey % 97 = 0 then null else l_tax end as tax, l_suppkey + case when l_orderkey % 89 = 0 then 1000000 else 0 end as supp from lineitem),
 o as (select o_orderkey, coalesce(n, 0) + case when o_orderkey % 101 = 0 then 1 else 0 end as stored, coalesce(n, 0) as n
   from orders left join (select l_orderkey, count(l_quantity) as n from lineitem group by 1) on o_orderkey = l_orderkey),
 r as (select 'cheap' as "check", count(*) as v, 'warn' as severity from line where not coalesce(l_extendedprice < 50000 or l_quantity > 40, false)
  union all select 'taxed', count(*), 'error' from line where not coalesce(tax <= 0.08, false)
  union all select 'lines counted', count(*), 'error' from o where n > 0 and stored <> n
  union all select 'supplier known', count(*), 'info' from line left join supplier on supp = s_suppkey where s_suppkey is null)
 select "check", v as violations, v = 0 as passed, severity from r""")
def _(t):
    rules = [ct.Rule("cheap", "line.l_extendedprice < 50000 or line.l_quantity > 40", "warn"), ct.Rule("taxed", "line.tax <= 0.08"),
             ct.Rule("lines counted", "orders.stored == count(line.l_quantity by l_orderkey)"),
             ct.Rule("supplier known", "line.supp in supplier.s_suppkey", "info")]
    line = t.lineitem.withColumns({"tax": F.expr("case when l_orderkey % 97 <> 0 then l_tax end"),
                                   "supp": F.expr("l_suppkey + case when l_orderkey % 89 = 0 then 1000000 else 0 end")})
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("l_quantity").alias("n"))
    orders = t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.expr("coalesce(n, 0) + case when o_orderkey % 101 = 0 then 1 else 0 end").alias("stored"))
    keys = {"orders": "o_orderkey", "line": "l_orderkey", "supplier": "s_suppkey"}
    found = ck.run_rules({"line": line, "orders": orders, "supplier": t.supplier}, ck.declared_rules(rules, keys))
    return found.select("check", "violations", "passed", "severity")
