"""Privacy queries: scan, protect, measure risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.catalog import sqltext as q
from facsimile.catalog.people import CONTACTS, CONTACTS_SQL, contacts
from facsimile.catalog.profiles import rx
from facsimile.catalog.registry import query
from facsimile.functions import keyed
from facsimile.operators import domains, privacy, risk
from facsimile.operators import scan as sc
from facsimile.sources import locales

SEED = 42


def scan_sql(table: str, fams: dict[str, str], order: str) -> str:
    parts = []
    for i, (c, fam) in enumerate(fams.items()):
        s = f"cast({c} as varchar)"
        rates = ", ".join(f"coalesce(avg(regexp_matches({s}, {rx(p)})::int::double),0) as {k}_rate"
                          for k, p in sc.PATTERNS.items())
        head = sc.header_verdict(c)
        h = ", ".join("null" if x is None else f"'{x}'" for x in (head or (None,) * 5))
        parts.append(f"select {i} as position, '{c}' as col, '{fam}' as family, [{h}]::varchar[] as header, count({c}) as n, {rates}, "
                     f"avg(length({s}) - length(replace({s}, ' ', ''))) as spaces, bool_or(regexp_matches({s}, '[0-9]')) as digits, "
                     f"count(distinct {c}) as n_unique from {table}")
    whens = []
    for kind in sc.ORDERS[order]:
        rule = sc.RULES[kind]
        if kind == "phone" and order == "specific_first":
            rule += " and family = 'string' and iso_date_rate <= 0.9"
        whens.append(f"when {rule} then {q.array(sc.BY_VALUE[kind])}")
    return f"""select col as "column", position, v[1] as pii_level, v[2] as pii_type, v[3] as detected_by, v[4] as suggested_action, v[5] as confidence
 from (select *, case {' '.join(whens)} when header[1] is not null then header
  when family = 'string' and n > 20 and n_unique > 0.8*n and spaces > 0.5 and spaces < 3 and not digits then {q.array(sc.PROBABLE_NAME)}
  else ['none', null, null, 'keep', 'high'] end as v from ({q.union_all(parts)}))"""


FAMS = {c: "numeric" if c in ("customer_id", "age", "salary") else "string" for c in CONTACTS}
SCAN = scan_sql(CONTACTS_SQL, FAMS, "specific_first")

query("pii_scan", SCAN)(lambda t: sc.scan(contacts(t)))
query("pii_scan_reference_order", scan_sql(CONTACTS_SQL, FAMS, "reference"))(
    lambda t: sc.scan(contacts(t), order="reference"))
DOC_FAMS = {"doc_id": "numeric", "text": "string", "lang": "string", "source": "string", "n_chars": "numeric"}
query("pii_scan_documents", scan_sql("documents", DOC_FAMS, "specific_first"))(lambda t: sc.scan(t.documents))
QUASI = [c for c in CONTACTS if (sc.header_verdict(c) or ("",))[0] == "quasi"]
GROUPS = ", ".join(QUASI)
RISK = f"""select case when min_k <= 1 then 'high' when min_k <= 3 or pct > 0.2 then 'moderate' else 'low' end as risk, min_k,
 round(pct,3) as pct_groups_below_5, '{",".join(QUASI)}' as columns_checked
 from (select min(n) as min_k, avg((n < 5)::int::double) as pct from (select count(*) n from {CONTACTS_SQL} group by {GROUPS}))"""
query("combination_risk", RISK)(lambda t: sc.combination_risk(contacts(t), QUASI))
query("pii_scan_table", f"""select s.*, r.* from ({SCAN}) s left join ({RISK}) r on pii_level = 'quasi'""")(
    lambda t: sc.scan_table(contacts(t)))
query("pii_scan_summary", f"""select count(*) as total_columns, count(*) filter (where pii_level='direct') as direct_pii,
 count(*) filter (where pii_level='quasi') as quasi_identifiers, count(*) filter (where pii_level='none') as safe_columns from ({SCAN})""")(
    lambda t: sc.scan_summary(sc.scan(contacts(t))))


@query("epsilon_suggestions", f"""select "column", pii_level, eps as suggested_epsilon,
 case when eps < 1 then 'heavy' when eps < 3 then 'moderate' else 'light' end as noise_level from (select "column", pii_level,
 case pii_level when 'direct' then 0.1::double when 'quasi' then case when (select count(*) from customer) < 1000 then 1.0 else 2.0 end else 5.0 end as eps
 from ({SCAN}) where pii_level <> 'none')""")
def _(t):
    return sc.suggest_epsilon(sc.scan(contacts(t)), t.customer.count())


# --- actions ---------------------------------------------------------------------------------------

def mask_sql(c: str, k: int = 2) -> str:
    return f"case when length({c}) <= {k} then repeat('*', length({c})) else repeat('*', length({c})-{k}) || right({c}, {k}) end"


@query("mask", f"""select customer_id, {mask_sql('email')} as email, {mask_sql('gender')} as gender, {mask_sql('segment')} as segment,
 {mask_sql('contact', 4)} as contact from {CONTACTS_SQL}""")
def _(t):
    return contacts(t).select("customer_id", *[privacy.mask(F.col(c)).alias(c) for c in ("email", "gender", "segment")],
                              privacy.mask(F.col("contact"), 4).alias("contact"))


@query("pseudonymize", f"""select customer_id, substr(sha256('project-salt'||email),1,12) as email,
 substr(sha256('s2'||segment),1,16) as segment from {CONTACTS_SQL}""")
def _(t):
    return contacts(t).select("customer_id", privacy.pseudonymize(F.col("email")).alias("email"),
                              privacy.pseudonymize(F.col("segment"), "s2", 16).alias("segment"))


# pseudonyms keep joins alive: order counts per hashed customer key
@query("pseudonymize_join", """select substr(sha256('project-salt'||c_custkey::varchar),1,12) as customer, count(*) as orders
 from customer join orders on c_custkey=o_custkey group by 1""")
def _(t):
    cust = t.customer.select(privacy.pseudonymize(F.col("c_custkey")).alias("customer"))
    per = t.orders.groupBy(privacy.pseudonymize(F.col("o_custkey")).alias("customer")).agg(F.count("*").alias("orders"))
    return cust.join(per, "customer").select("customer", "orders")


def full_name_sql(code: str, path: str, key: str) -> str:
    n = locales.NAMES[code]
    k = [q.u(SEED, path, code, key=key, lane=i) for i in range(3)]
    return (f"case when {k[0]} < 0.5 then {q.choice(k[1], n['male'])} else {q.choice(k[1], n['female'])} end"
            f" || ' ' || {q.choice(k[2], n['family'])}")


@query("synthetic_replace", f"""select c_custkey, 'user' || lpad(c_custkey::varchar,5,'0') || '@example.com' as email,
 '+00-000-' || lpad(c_custkey::varchar,7,'0') as phone, {full_name_sql('us', 'synthetic/full_name', 'c_custkey')} as full_name,
 {q.choice(q.u(SEED, 'synthetic', 'company', key='c_custkey'), locales.pack('us')['companies'])} as company,
 {q.weighted(q.u(SEED, 'synthetic', 'city', key='c_custkey'), locales.CITIES['us'])} as city,
 'XXX-XX-' || lpad(c_custkey::varchar,4,'0') as ssn, 'XXXX-XXXX-XXXX-' || lpad(c_custkey::varchar,4,'0') as card,
 '10.0.' || (c_custkey // 256)::varchar || '.' || (c_custkey % 256)::varchar as ip, 'note-' || lpad(c_custkey::varchar,6,'0') as note,
 (floor({q.u(SEED, 'synthetic', 'street', key='c_custkey', lane=2)}*900.0::double)::bigint+1)::varchar || ' ' ||
  {q.choice(q.u(SEED, 'synthetic', 'street', key='c_custkey'), domains.FIRST_WORDS)} || ' ' ||
  {q.choice(q.u(SEED, 'synthetic', 'street', key='c_custkey', lane=1), domains.SECOND_WORDS)} || ' Street' as street from customer""")
def _(t):
    return t.customer.select("c_custkey", *[privacy.synthetic_replace(c, F.col("c_custkey"), SEED).alias(c) for c in (
        "email", "phone", "full_name", "company", "city", "ssn", "card", "ip", "note", "street")])


NOISE = f"""least(greatest(x + {q.laplace(q.u(SEED, 'dp_noise', 'c_acctbal', key='c_custkey'), 'greatest(hi-lo,1.0)/2.0::double')}, lo), hi)"""


@query("dp_noise", f"""with r as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
 select c_custkey, case when x is not null then round({NOISE}, 4) end as c_acctbal, {q.rint(f'''least(greatest(c_nationkey + {q.laplace(
     q.u(SEED, 'dp_noise', 'c_nationkey', key='c_custkey'), '25.0::double/1.0')}, 0.0), 25.0)''')}::bigint as c_nationkey
 from (select c_custkey, c_nationkey, case when c_custkey % 5 = 0 then null else c_acctbal end as x from customer), r""")
def _(t):
    src = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    lo, hi = privacy.value_range(t.customer, ["c_acctbal"])["c_acctbal"]
    out = privacy.apply_privacy(src, {"c_acctbal": "dp_noise", "c_nationkey": "dp_noise"}, "c_custkey", noise={
        "c_acctbal": privacy.Noise(2.0, lo, hi), "c_nationkey": privacy.Noise(1.0, 0.0, 25.0)}, seed=SEED)
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_nationkey")


ACTIONS = {"email": "hash", "contact": "mask", "phone_line": "synthetic", "salary": "dp_noise", "plastic": "exclude",
           "absent": "mask"}


@query("apply_privacy", f"""with r as (select min(salary)::double as lo, max(salary)::double as hi from {CONTACTS_SQL})
 select customer_id, substr(sha256('project-salt'||email),1,12) as email, {mask_sql('contact')} as contact,
 '+00-000-' || lpad(customer_id::varchar,7,'0') as phone_line,
 {q.rint(f"least(greatest(salary::double + {q.laplace(q.u(SEED, 'dp_noise', 'salary', key='customer_id'), 'greatest(hi-lo,1.0)/0.5::double')}, lo), hi)")}::bigint as salary,
 city from {CONTACTS_SQL}, r""")
def _(t):
    src = contacts(t).select("customer_id", "email", "contact", "phone_line", "salary", "plastic", "city")
    return privacy.apply_privacy(src, ACTIONS, "customer_id", seed=SEED, noise={"salary": 0.5})


@query("exclude_columns", "select c_custkey, c_nationkey from customer")
def _(t):
    return privacy.exclude(t.customer, ["c_name", "c_acctbal", "c_mktsegment", "missing"])


# --- risk ------------------------------------------------------------------------------------------

def k_sql(table: str, cols: list[str]) -> str:
    g = ", ".join(cols)
    return f"""select k, total_groups, round(p5,4) as pct_groups_below_5, round(p10,4) as pct_groups_below_10,
 case when k <= 1 then 'high' when k <= 4 then 'moderate' else 'low' end as risk from (select min(n) as k, count(*) as total_groups,
 avg((n<5)::int::double) as p5, avg((n<10)::int::double) as p10 from (select count(*) as n from {table} group by {g}))"""


query("k_anonymity", k_sql("customer", ["c_nationkey", "c_mktsegment"]))(
    lambda t: risk.k_anonymity(t.customer, ["c_nationkey", "c_mktsegment"]))
query("k_anonymity_with_nulls", k_sql(CONTACTS_SQL, ["city", "gender", "segment"]))(
    lambda t: risk.k_anonymity(contacts(t), ["city", "gender", "segment"]))
query("k_anonymity_lineitem", k_sql("lineitem", ["l_suppkey", "l_returnflag", "l_linestatus"]))(
    lambda t: risk.k_anonymity(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"]))


@query("l_diversity", """select l, total_groups, case when l <= 1 then 'high' when l <= 2 then 'moderate' else 'low' end as risk
 from (select min(d) as l, count(*) as total_groups from (select count(distinct c_mktsegment) as d from customer group by c_nationkey))""")
def _(t):
    return risk.l_diversity(t.customer, ["c_nationkey"], "c_mktsegment")


@query("l_diversity_with_nulls", f"""select l, total_groups, case when l <= 1 then 'high' when l <= 2 then 'moderate' else 'low' end as risk
 from (select min(d) as l, count(*) as total_groups from (select count(distinct segment) as d from {CONTACTS_SQL} group by city, age))""")
def _(t):
    return risk.l_diversity(contacts(t), ["city", "age"], "segment")


# stands in for a synthetic table: part of the customers is altered, the rest is copied
FAKE = "case when c_custkey % 10 = 0 then c_acctbal else c_acctbal + 1 + c_custkey % 13 end"


@query("exact_match_rate", f"""select round(count(*) filter (where exists (select 1 from customer c where c.c_nationkey = s.c_nationkey
 and c.c_mktsegment = s.c_mktsegment and c.c_acctbal = s.c_acctbal))::double / count(*), 6) as exact_match_rate
 from (select c_nationkey, c_mktsegment, {FAKE} as c_acctbal from customer) s""")
def _(t):
    train = t.customer.select("c_nationkey", "c_mktsegment", "c_acctbal")
    synth = t.customer.selectExpr("c_nationkey", "c_mktsegment", f"{FAKE} as c_acctbal")
    return risk.exact_match_rate(train, synth).select(F.round("exact_match_rate", 6).alias("exact_match_rate"))


HOLD = f"""h as (select *, row_number() over (order by {q.u(SEED, 'hold', key='p_partkey')}, p_partkey) <= (select floor(count(*)*0.2) from part) as held from part)"""
DCR = f"""{HOLD}, tr as (select p_size::double as a, p_retailprice as b from h where not held),
 st as (select avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb from tr),
 pr as (select 's' as side, p_partkey as id, (p_size + p_partkey % 3)::double as a, p_retailprice + 0.25 as b from part),
 al as (select * from pr union all select 'h', p_partkey, p_size::double, p_retailprice from h where held),
 d as (select side, id, min(sqrt(pow((al.a-tr.a)/sa,2)+pow((al.b-tr.b)/sb,2))) as dist from al, tr, st group by 1, 2),
 ra as (select quantile_cont(dist, 0.5) filter (where side='s') / greatest(quantile_cont(dist, 0.5) filter (where side='h'), 1e-9) as ratio from d)"""


def dcr_sides(t):
    train, hold = domains.split_holdout(t.part, keyed.uniform(SEED, "hold", key="p_partkey"), "p_partkey")
    synth = t.part.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 3).alias("p_size"),
                          (F.col("p_retailprice") + 0.25).alias("p_retailprice"))
    return train, hold, synth


@query("dcr_ratio", f"with {DCR} select round(ratio, 6) as dcr_ratio from ra")
def _(t):
    train, hold, synth = dcr_sides(t)
    ratio = risk.dcr_ratio(train, hold, synth, ["p_size", "p_retailprice"])
    return t.spark.createDataFrame([(round(ratio, 6),)], "dcr_ratio double")


@query("nearest_record_distance", f"""with {HOLD} select a.p_partkey, round(min(sqrt(pow(a.p_size-b.p_size,2)+pow(a.p_retailprice-b.p_retailprice,2))),6) as distance
 from h a, h b where a.held and not b.held group by 1""")
def _(t):
    train, hold, _ = dcr_sides(t)
    cols = [F.col(c).cast("double").alias(c) for c in ("p_size", "p_retailprice")]
    dist = risk.nearest_distance(hold.select(*cols), train.select(*cols), ["p_size", "p_retailprice"], cell_rows=64)
    out = hold.select("p_partkey", *cols).join(dist, ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("distance", 6).alias("distance"))


MATCH = """em as (select count(*) filter (where exists (select 1 from h x where not held and x.p_size = s.p_size and x.p_retailprice = s.p_retailprice))::double/count(*) as e
  from (select (p_size + p_partkey % 3) as p_size, p_retailprice + 0.25 as p_retailprice from part) s)"""
LEVEL = "case when e > 0.01 or ratio < 0.5 then 'Elevated' when e > 0 or ratio < 0.8 then 'Moderate' else 'Low' end"


@query("privacy_indicators", f"with {DCR}, {MATCH} select round(e,4) as exact_match_rate, round(ratio,3) as dcr_ratio, {LEVEL} as level from em, ra")
def _(t):
    train, hold, synth = dcr_sides(t)
    nums = ["p_size", "p_retailprice"]
    exact = risk.exact_match_rate(train.select(*nums), synth.select(*nums)).first()[0]
    ratio = risk.dcr_ratio(train, hold, synth, nums)
    ind = risk.privacy_indicators(exact, ratio)
    return t.spark.createDataFrame([tuple(ind.values())], "exact_match_rate double, dcr_ratio double, level string")


@query("privacy_report", f"""with {DCR}, {MATCH}, k as ({k_sql("(select p_size + p_partkey % 3 as p_size from part)", ["p_size"])})
 select 'exact_match_rate' as metric, round(e,4) as value, {LEVEL} as risk from em, ra
 union all select 'dcr_ratio', round(ratio,3), {LEVEL} from em, ra union all select 'k_anonymity', k::double, risk from k
 union all select 'l_diversity_p_retailprice', l::double, case when l <= 1 then 'high' when l <= 2 then 'moderate' else 'low' end from
 (select min(d) as l from (select count(distinct p_retailprice) as d from part group by p_size + p_partkey % 3))""")
def _(t):
    train, hold, synth = dcr_sides(t)
    nums = ["p_size", "p_retailprice"]
    return risk.privacy_report(train, synth, hold, nums, ["p_size"], ["p_retailprice"], nums)
