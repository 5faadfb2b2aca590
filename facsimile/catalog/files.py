"""Source, sink and declared-strategy queries.

Round trips write the given table to the shared folder, read it back and return what was read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.registry import query
from facsimile.functions import keyed, money
from facsimile.operators import scale, strategies
from facsimile.plans import contract as ct
from facsimile.plans import retail, run
from facsimile.sources import blocks, json_arrays, readers, writers

SEED = 42


def scratch(t, name: str) -> str:
    return f"{scale.shared_folder(t.spark)}/facsimile-{name}-{uuid.uuid4().hex[:8]}"


GUARDED = "case when substr({0},1,1) in ('=','+','-','@',chr(9),chr(13)) then chr(9) || {0} else {0} end"
RISKY = ("case c_custkey % 8 when 0 then concat('=', c_name) when 1 then concat('+', c_name) when 2 then concat('-', c_name) "
         "when 3 then concat('@', c_name) when 4 then concat(chr(9), c_name) when 5 then null when 6 then '' else c_name end")


@query("guard_formula", f"select c_custkey, {GUARDED.format('x')} as cell, c_mktsegment from (select c_custkey, {RISKY} as x, c_mktsegment from customer)")
def _(t):
    return writers.guard_formula(t.customer.selectExpr("c_custkey", f"{RISKY} as cell", "c_mktsegment"))


# texts that mean "no value" come back as nulls, numbers and booleans come back typed
@query("csv_round_trip", """select c_custkey, case when c_custkey % 4 in (1,2) then null when c_custkey % 4 = 3 then chr(9) || '=' || c_name else c_name end as label,
 c_acctbal, c_custkey % 2 = 0 as even, case when c_custkey % 3 = 0 then null else c_nationkey::bigint end as nation from customer""")
def _(t):
    path = scratch(t, "csv")
    src = t.customer.selectExpr("c_custkey", "case c_custkey % 4 when 1 then 'NULL' when 2 then 'N/A' when 3 then concat('=', c_name) else c_name end as label",
                                "c_acctbal", "c_custkey % 2 = 0 as even", "case when c_custkey % 3 <> 0 then c_nationkey end as nation")
    writers.write_csv(src, path)
    return readers.read_csv(t.spark, path)


@query("json_round_trip", "select o_orderkey, o_orderstatus, o_totalprice, case when o_orderkey % 3 = 0 then null else o_orderpriority end as o_orderpriority from orders")
def _(t):
    path = scratch(t, "json")
    src = t.orders.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "case when o_orderkey % 3 <> 0 then o_orderpriority end as o_orderpriority")
    writers.write_json(src, path)
    return readers.read_json(t.spark, path, lines=True)


@query("jsonl_explicit_nulls", "select count(*) as lines, count(*) filter (where o_orderkey % 3 = 0) as nulls from orders")
def _(t):
    path = scratch(t, "jsonl")
    writers.write_jsonl(t.orders.selectExpr("o_orderkey", "case when o_orderkey % 3 <> 0 then o_orderpriority end as p"), path)
    return t.spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains('"p":null')).alias("nulls"))


#: Rows of an array file.
ARRAY_ROWS = 1_000_000


def as_array(batches):
    """The texts of a task as the lines of one JSON array."""
    mark = "["
    for batch in batches:
        if texts := batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"value": [mark + texts[0], *("," + text for text in texts[1:])]})
            mark = ","
    yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})


def array_files(t, df) -> str:
    """All rows of ``df`` as array files of about ``ARRAY_ROWS`` rows, one if there are no more: each is written by a task."""
    path = scratch(t, "array")
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    df.select(text).repartition(max(1, -(-df.count() // ARRAY_ROWS))).mapInArrow(as_array, "value string").write.text(path)
    return path


# texts with every sign that a parser could stumble over
TRICKY = ("case o_orderkey % 7 when 0 then concat('}{', o_orderstatus) when 1 then concat(chr(92), '\"},{\"x\":[') when 2 then '' "
          "when 3 then concat('ends in ', chr(92)) when 4 then null when 5 then concat('line', chr(10), chr(9), ']') else o_orderpriority end")


@query("json_array_by_ranges", f"""select o_orderkey, {TRICKY} as note, o_custkey as customer, o_orderkey % 7 as first_part, o_totalprice as price
 from orders""")
def _(t):
    src = t.orders.selectExpr("o_orderkey", f"{TRICKY} as note", "named_struct('customer', o_custkey, 'parts', array(o_orderkey % 7, 2)) as who",
                              "array(named_struct('price', o_totalprice)) as prices")
    got = json_arrays.read_json_array(t.spark, array_files(t, src), range_bytes=1 << 16)
    return got.select("o_orderkey", "note", F.col("who.customer").alias("customer"), F.col("who.parts")[0].alias("first_part"),
                      F.col("prices")[0]["price"].alias("price"))


@query("json_flatten", """select event_id, event_type as "head.type", user_id as "head.who.user", json_extract(props, '$.k')::bigint as "props.k" from events""")
def _(t):
    src = t.events.select("event_id", F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("who")).alias("head"),
                          F.from_json("props", "k bigint").alias("props"))
    return readers.flatten(src)


@query("parquet_round_trip", "select p_partkey, p_name, p_retailprice from part")
def _(t):
    path = scratch(t, "parquet")
    writers.write_parquet(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return t.spark.read.parquet(path)


@query("sql_inserts", """select 'INSERT INTO part VALUES (' || p_partkey || ', ' || case when p_partkey % 5 = 0 then 'NULL' else '''' || p_name || '''''s''' end || ', ' || p_size || ');' as statement from part""")
def _(t):
    src = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.concat(F.col("p_name"), F.lit("'s"))).alias("label"), "p_size")
    return writers.sql_inserts(src, "part")


@query("export_and_manifest", """select unnest(['nation','region']) as name, unnest(['parquet','parquet']) as format, unnest([(select count(*) from nation),(select count(*) from region)]) as rows, true as hashed""")
def _(t):
    folder = scratch(t, "export")
    rows = writers.export_all({"nation": t.nation, "region": t.region}, folder, ["parquet"])
    listed = writers.artifact_manifest(t.spark, [f"{folder}/{n}.parquet" for n in rows])
    names = listed.groupBy(F.split("name", "\\.")[0].alias("name"), "format").agg(F.bool_and(F.length("sha256") == 71).alias("hashed"))
    counts = t.spark.createDataFrame(list(rows.items()), "name string, rows bigint")
    return names.join(F.broadcast(counts), "name")  # one row per table


# one file of known bytes, many small ranges and blocks: every block's hash, and the tree's root as block -1
@query("file_block_hashes", """with recursive content as (
  select string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment || chr(10), '' order by c_custkey) as x from customer),
 cut as (select x, unnest(range(0, greatest(1, (length(x) + 1499) // 1500))) as block from content),
 leaves as (select block, length(substr(x, block * 1500 + 1, 1500)) as bytes, sha256(substr(x, block * 1500 + 1, 1500)) as sha256 from cut),
 tree as (
  select list(sha256 order by block) as level from leaves
  union all select list_transform(range(0, (len(level) + 6) // 7), lambda k: sha256(array_to_string(level[k * 7 + 1 : k * 7 + 7], ''))) from tree where len(level) > 1)
 select block, bytes, sha256 from leaves union all select -1, (select length(x) from content), level[1] from tree where len(level) = 1""")
def _(t):
    path = scratch(t, "lines")
    t.customer.select("c_custkey", F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value")) \
        .repartition(1).sortWithinPartitions("c_custkey").select("value").write.text(path)
    digests = blocks.block_digests(t.spark, [path], 1500, "part-*", range_bytes=4000)
    roots = blocks.merkle_roots(digests, 7)
    return digests.select("block", "bytes", "sha256").unionByName(
        roots.select(F.lit(-1).cast("long").alias("block"), F.col("size").alias("bytes"), F.col("root").alias("sha256")))


@query("run_manifest", """select 'customers' as "table", (select count(*) from supplier) as rows, 6 as columns, true as proved union all select 'products', 60, 4, true""")
def _(t):
    n = t.supplier.count()
    done = run.execute_run(t.spark, retail.retail_contract(), run.RunConfig(SEED, "pk", pack="retail", pack_args={"n_customers": n}))
    ok = run.all_passed(done.checks)
    rows = [(k, v["rows"], v["columns"], ok) for k, v in done.manifest["tables"].items() if k in ("customers", "products")]
    return t.spark.createDataFrame(rows, '`table` string, rows bigint, columns int, proved boolean')


@query("replay", """select unnest(['customers','products','orders','order_items']) as "table", true as same from (select count(*) from supplier)""")
def _(t):
    contract = retail.retail_contract()
    done = run.execute_run(t.spark, contract, run.RunConfig(SEED, "pk", pack="retail", pack_args={"n_customers": t.supplier.count()}))
    return run.replay(t.spark, contract, done.manifest).select("table", "same")


@query("table_fingerprint_order_free", "select count(*) as rows, true as same, true as differs from orders")
def _(t):
    a = writers.fingerprint(t.orders)
    b = writers.fingerprint(t.orders.repartition(13, "o_custkey")).toDF("rows_b", "b")
    c = writers.fingerprint(t.orders.withColumn("o_custkey", F.col("o_custkey") + 1)).toDF("rows_c", "c")
    return a.select("rows", (F.col("fingerprint") == b.select("b").scalar()).alias("same"),
                    (F.col("fingerprint") != c.select("c").scalar()).alias("differs"))


@query("contract_schema", """select unnest(['order_id','customer_id','order_date','status','subtotal','discount','tax','total']) as field,
 unnest(['bigint','bigint','date','string','bigint','bigint','bigint','bigint']) as type, unnest([false,false,false,false,false,false,false,false]) as nullable from (select count(*) from orders)""")
def _(t):
    struct = ct.to_struct(retail.retail_contract().table("orders"))
    frame = t.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in struct.fields],
                                    "field string, type string, nullable boolean")
    return frame.filter(F.lit(t.orders.count() > 0))


# --- declared strategies ------------------------------------------------------------------------------

@query("strategy_sequence", "select c_custkey, c_custkey + 5 as plain, 'C-' || lpad((c_custkey+1)::varchar, 7, '0') as padded from customer")
def _(t):
    return t.customer.select("c_custkey", strategies.sequence(F.col("c_custkey"), 5).alias("plain"),
                             strategies.sequence(F.col("c_custkey"), 1, "C-", 7).alias("padded"))


def su(c, lane=0):
    return q.u(SEED, "strategy", c, key="p_partkey", lane=lane)


def SU(c, lane=0):
    return keyed.uniform(SEED, "strategy", c, key="p_partkey", lane=lane)


GAMMA = strategies.gamma_grid(2.0)


@query("strategy_numeric", f"""with u as (select p_partkey, {su('g')} as g, {su('e')} as e from part), x as (select *, [{','.join(map(repr, GAMMA))}]::double[] as gg, [1.0,2.0,10.0]::double[] as ee,
   least(floor(g*1000.0::double),999)::int as gi, least(floor(e*2.0::double),1)::int as ei from u)
 select p_partkey, round({q.normal(su('n'), su('n', 1), 10.0, 2.0)},6) as normal, round(exp({q.normal(su('l'), su('l', 1), 1.0, 0.5)}),6) as lognormal,
  round(3.0::double+{su('u')}*4.0::double,6) as uniform, round((gg[gi+1]+(gg[gi+2]-gg[gi+1])*(g*1000.0::double-gi))*(6.0::double/2.0),6) as gamma,
  round(ee[ei+1]+(ee[ei+2]-ee[ei+1])*(e*2.0::double-ei),6) as empirical from x""")
def _(t):
    n = strategies.numeric
    cols = {"normal": n(SU("n"), SU("n", 1), "normal", 10.0, 2.0), "lognormal": n(SU("l"), SU("l", 1), "lognormal", 1.0, 0.5),
            "uniform": n(SU("u"), SU("u", 1), "uniform", low=3.0, high=7.0), "gamma": n(SU("g"), SU("g", 1), "gamma", mean=6.0, shape=2.0),
            "empirical": n(SU("e"), SU("e", 1), "empirical", grid=[1.0, 2.0, 10.0])}
    return t.part.select("p_partkey", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@query("strategy_derived", "select c_custkey, lower(replace(c_name,'#','.')) as nick, lower(replace(c_name,'#','.')) || '@mail.example.org' as email from customer")
def _(t):
    src = t.customer.select("c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("."))).alias("nick"))
    return src.withColumn("email", strategies.derived("nick", "{value}@{domain}", "mail.example.org"))


@query("strategy_formula", "select l_orderkey, l_linenumber, round(sum(l_extendedprice*(1-l_discount)+l_tax),4) as net from lineitem group by 1,2")
def _(t):
    out = t.lineitem.withColumn("net", strategies.formula(t.lineitem, "l_extendedprice * (1 - l_discount) + l_tax"))
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("net"), 4).alias("net"))


@query("strategy_rollup", """select o_orderkey, coalesce(round(sum(l_quantity),4),0) as total_qty, count(l_quantity) as n, min(l_quantity) as least_qty, max(l_quantity) as most_qty, round(avg(l_quantity),6) as mean_qty
 from orders left join lineitem on l_orderkey=o_orderkey group by 1""")
def _(t):
    out = t.orders.select("o_orderkey")
    for op, name in (("sum", "total_qty"), ("count", "n"), ("min", "least_qty"), ("max", "most_qty"), ("avg", "mean_qty")):
        out = strategies.rollup(out, "o_orderkey", t.lineitem, "l_orderkey", "l_quantity", name, op)
    return out.withColumn("total_qty", F.round("total_qty", 4)).withColumn("mean_qty", F.round("mean_qty", 6))


M = "cast(round_even(cast(cast(o_totalprice as varchar) as decimal(30,8))*100,0) as bigint)"


@query("strategy_tax", f"""select o_orderkey, {q.pct(M, "'0.0825'")} as us, {q.pct(M, "'0.09'")} + {q.pct(M, "'0.09'")} as india,
 {M} - round_even(cast({M} as decimal(20,0))::double/1.2::double,0)::bigint as uk from orders""")
def _(t):
    o = t.orders.select("o_orderkey", money.to_minor("o_totalprice").alias("m"))
    for code, name in (("us", "us"), ("in", "india"), ("uk", "uk")):
        o = strategies.locale_tax(o, "m", name, code)
    return o.drop("m")


@query("strategy_conditional", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as state from orders")
def _(t):
    return t.orders.select("o_orderkey", strategies.conditional("o_orderstatus", {"F": "done", "O": "open"}, "other").alias("state"))


@query("many_to_many", f"""with c as (select count(*)::bigint as r from part),
 d as (select s_suppkey, least({q.bucket_of(q.u(SEED, 'degree', 's_suppkey', key='s_suppkey'), keyed.poisson_cdf(4.0, 20))}, r) as n, r,
   floor({q.u(SEED, 'start', key='s_suppkey')}*r::double)::bigint as s, {q.u(SEED, 'stride', key='s_suppkey')} as v from supplier, c),
 -- numbers without a common factor with the count, spread over it
 step as (select greatest(1, r // 64) as w, r from c),
 cand as (select (select min(x) from unnest(range(k, k + 1000)) t(x) where gcd(x, step.r) = 1) % r as x from step, unnest(range(1, r + 1, w)) u(k)),
 st0 as (select list(distinct x order by x)[1:64] as xs from cand),
 st as (select s_suppkey, unnest(range(0, n)) as seq, s, r, v from d), p as (select p_partkey, row_number() over (order by p_partkey) - 1 as pid from part)
 select s_suppkey, p_partkey from (select s_suppkey, (s + seq * xs[1+floor(v*len(xs)::double)::int]) % r as pid from st, st0) join p using (pid)""")
def _(t):
    return strategies.many_to_many(t.supplier, "s_suppkey", t.part, "p_partkey", SEED, keyed.poisson_cdf(4.0, 20))
