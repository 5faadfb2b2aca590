"""Packs, contracts, damage, documents, copula and scoring as properties."""

import pytest
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import (checks, copula, degrade, domains, edge, invoices, ordered, scale, score,
                                 statements, strategies)
from facsimile.plans import contract as ct
from facsimile.plans import fintech, generate, packs, retail, run
from facsimile.plans.synthesize import synthesize
from facsimile.sources import locales, readers, writers


def prints(tables):
    return {n: writers.fingerprint(d).first()["fingerprint"] for n, d in tables.items()}


def failed(tables, todo):
    return [r["check"] for r in checks.prove(tables, todo).collect() if not r["passed"]]


def test_retail_is_consistent_and_repeatable(spark):
    t = retail.generate_retail(spark, 7, n_customers=300)
    assert failed(t, checks.retail_checks()) == []
    contract = retail.retail_contract()
    assert failed(t, checks.link_checks(contract.links()) + checks.contract_checks(contract.constraints())) == []
    a = prints(t)
    spark.conf.set("facsimile.rowsPerBucket", "100")
    try:
        b = prints(retail.generate_retail(spark, 7, n_customers=300))
    finally:
        spark.conf.set("facsimile.rowsPerBucket", "500000")
    assert a == b and a != prints(retail.generate_retail(spark, 8, n_customers=300))


def test_retail_without_orders_and_with_many_products(spark):
    none = retail.generate_retail(spark, 1, n_customers=5, mean_orders=1e-9)
    assert none["orders"].count() == 0 and none["order_items"].count() == 0
    many = retail.generate_retail(spark, 1, n_customers=60, n_products=400)
    assert failed(many, checks.retail_checks()) == []


def test_fintech_balances(spark):
    t = fintech.generate_fintech(spark, 3, n_accounts=60, n_cards=50)
    contract = fintech.fintech_contract()
    todo = checks.fintech_checks() + checks.link_checks(contract.links()) + checks.contract_checks(contract.constraints())
    assert failed(t, todo) == []
    rows = t["transactions"].join(t["accounts"].select("account_id", "opening_balance", "open_date"), "account_id").collect()
    run_ = {}
    for r in sorted(rows, key=lambda r: (r["account_id"], r["tx_date"], r["tx_id"])):
        bal = run_.get(r["account_id"], r["opening_balance"])
        bal += r["amount"] if r["tx_type"] in fintech.MONEY_IN else -r["amount"]
        run_[r["account_id"]] = bal
        assert r["balance_after"] == bal and r["tx_date"] >= r["open_date"] and 100 <= r["amount"] <= 100_000
    owner = {r["card_id"]: r["account_id"] for r in t["cards"].collect()}
    assert all(r["card_id"] is None or owner[r["card_id"]] == r["account_id"] for r in rows)


def test_packs_registry():
    assert sorted(packs.PACKS) == ["fintech", "retail"]
    with pytest.raises(KeyError):
        packs.pack("nope")


def test_contract_links_order_and_hash(tmp_path):
    c = retail.retail_contract()
    assert c.links() == [("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id"),
                         ("order_items", "sku", "products", "sku")]
    order = c.dependency_order()
    assert order.index("customers") < order.index("orders") < order.index("order_items")
    c.save(tmp_path / "c.json")
    again = ct.Contract.load(tmp_path / "c.json")
    assert again.fingerprint() == c.fingerprint() and again.links() == c.links()
    by_name = ct.Contract("n", (ct.Table("cities", (ct.Column("id", "id"),)), ct.Table("shops", (ct.Column("shop_id", "id"), ct.Column("city_id")))))
    assert by_name.links() == [("shops", "city_id", "cities", "id")]
    loop = ct.Contract("l", (ct.Table("a", (ct.Column("a_id", "id"),)), ct.Table("b", (ct.Column("b_id", "id"),))),
                       (ct.Relationship("a", "b"), ct.Relationship("b", "a")))
    with pytest.raises(ValueError):
        loop.dependency_order()
    with pytest.raises(ValueError):
        ct.Column("x", "colour")


def test_proof_reports_broken_checks(spark):
    t = {"orders": spark.range(3).selectExpr("id as order_id", "-1 as total")}
    out = {r["check"]: r for r in checks.prove(t, checks.retail_checks()).collect()}
    assert out["orders: total below zero"]["violations"] == 3 and out["orders: repeated id"]["passed"]
    assert out["orders: total is not subtotal less discount plus tax"]["violations"] == -1
    assert "order_items: order unknown" not in out


def test_weighted_dates(spark):
    d = domains.weighted_dates(spark.range(5000), keyed.uniform(1, "d", key="id"), "2024-01-01", "2024-12-31", "d")
    week, q4, n = d.agg(F.avg((F.weekday("d") < 5).cast("double")), F.avg((F.month("d") >= 10).cast("double")), F.count("*")).first()
    assert n == 5000 and week > 0.55 and q4 > 0.25


def test_contract_generation(spark):
    c = ct.Contract("x", (
        ct.Table("lines", (ct.Column("line_id", "id"), ct.Column("doc_id", "fk", null_rate=0.2), ct.Column("amount", "money"),
                           ct.Column("code", strategy={"kind": "sequence", "start": 5, "prefix": "L-", "zero_pad": 4})), 400),
        ct.Table("docs", (ct.Column("doc_id", "id"), ct.Column("n", "int", strategy={
            "kind": "rollup", "source_table": "lines", "source_column": "amount", "group_by": "doc_id", "operation": "count"}),
            ct.Column("double_n", "int", strategy={"kind": "formula", "expr": "n * 2"}),
            ct.Column("when", "datetime", start="2024-01-01", end="2024-01-31")), 20)))
    t = generate.generate_from_contract(spark, c)
    assert failed(t, checks.link_checks(c.links())) == []
    filled = t["lines"].filter("doc_id is not null").count()
    assert 280 < filled < 360 and t["docs"].agg(F.sum("n"), F.sum("double_n")).first() == (filled, 2 * filled)
    assert t["lines"].agg(F.min("code"), F.max("code")).first() == ("L-0005", "L-0404")


def test_formula_refuses_other_names(spark):
    df = spark.range(1)
    for bad in ("id + secret", "id; drop", "upper(id)"):
        with pytest.raises(ValueError):
            strategies.formula(df, bad)


def test_damage_counts(spark):
    df = spark.range(2000).selectExpr("id", "cast(id as double) as x", "id % 7 as y", "'c' || (id % 3) as c", "date'2024-05-05' as d")
    kinds = {"id": "id", "x": "num", "y": "int", "c": "cat", "d": "date"}
    out, hits = degrade.inject_outliers(df, kinds, 0.01, "id")
    assert hits == 20 and out.join(df.withColumnRenamed("x", "x0"), "id").filter("x <> x0").count() == 10
    same, none = degrade.inject_outliers(df, kinds, 0.01, "id", "unheard_of")
    assert none == 0 and same is df
    rare, log = edge.edge_rare_category(df, kinds, "id")
    assert rare.filter("c = 'RARE_C'").count() == 2 and log[0]["count"] == 2
    dup, _ = edge.edge_duplicates(df, "id")
    assert dup.count() == 2000 and dup.select("x").distinct().count() < 2000
    lab, _ = edge.label_anomalies(df, kinds, "id", 0.05)
    assert lab.filter("is_anomaly").count() == 100 and lab.filter("anomaly_type is not null").count() == 100
    assert lab.filter("d = '2099-13-45'").count() == lab.filter("anomaly_type = 'impossible_date'").count() > 0
    a, b = (prints({"t": edge.label_anomalies(df.repartition(k), kinds, "id", 0.05)[0]}) for k in (1, 9))
    assert a == b


def test_repair_unique(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 6, None), (4, 5, "a_1"), (5, None, None)], "id int, n int, s string")
    out, warn = degrade.enforce_constraints(df, [{"type": "unique", "column": "n"}, {"type": "unique", "column": "s"}], "id")
    rows = [tuple(r) for r in out.orderBy("id").collect()]
    assert rows == [(1, 5, "a"), (2, 7, "a_2"), (3, 6, None), (4, 8, "a_1"), (5, None, None)]
    assert not warn


def test_invoices_reconcile(spark):
    inv, lines = invoices.generate_invoices(spark, 50, 4, locale="in", discount_pct="0.1")
    assert lines.count() == 200 and lines.select("invoice_no", "description").distinct().count() == 200
    assert {r["failed"] for r in invoices.reconcile_invoices(inv, lines, "invoice_no").collect()} == {0}
    assert inv.select(F.size("taxes")).distinct().collect()[0][0] == 2


@pytest.mark.parametrize("mode", ["topup", "reduce"])
def test_statements_meet_floor_and_target(spark, mode):
    fleet = statements.fleet(spark.range(25), "id", "2025-06-30", 90, 20_000, 5_000, F.when(F.col("id") % 2 == 0, 90_000))
    rules = [{"type": "salary", "day": 1, "amount": 50_000}, {"type": "rent", "day": 3, "amount": 60_000}]
    bal, totals = statements.statement_fleet(fleet, rules, mode=mode)
    rows = bal.orderBy("account_id", "date", "seq", "step").collect()
    run_ = {}
    for r in rows:
        run_[r["account_id"]] = run_.get(r["account_id"], 20_000) + r["credit"] - r["debit"]
        assert r["balance"] == run_[r["account_id"]] and r["debit"] >= 0 and r["credit"] >= 0
        assert r["step"] == 2 or r["balance"] >= 5_000
    t = {r["account_id"]: r for r in totals.collect()}
    assert all(r["target_met"] for a, r in t.items() if a % 2 == 0) and t[1]["target_met"] is None
    assert all(t[a]["closing_balance"] == b for a, b in run_.items())
    assert {r["failed"] for r in statements.reconcile_statements(bal, fleet, totals).collect()} == {0}


def test_busy_account_is_scanned_in_pieces(small_buckets):
    spark = small_buckets
    entries = spark.range(900).selectExpr(
        "case when id % 3 = 0 then 0 else id % 40 end as account_id", "date_add(date'2025-01-01', cast(id % 20 as int)) as date",
        "id as seq", "1 as step", "'' as description", "'' as category", "'' as merchant", "id % 90 as debit",
        "id % 70 as credit", "id % 5 = 0 as is_recurring")
    fleet = statements.fleet(spark.range(40), "id", "2025-01-31", 30, 100, 50)
    small = prints({"t": statements.enforce_min_balance(entries, fleet)})
    spark.conf.set("facsimile.rowsPerBucket", "500000")
    spark.conf.set("facsimile.boundedRows", "20000")
    assert small == prints({"t": statements.enforce_min_balance(entries, fleet)})


def shaped(spark, n):
    df = spark.range(n).select(
        "id", keyed.normal(keyed.uniform(1, "a", key="id"), keyed.uniform(1, "a", key="id", lane=1), 100, 10).alias("a"))
    noise = keyed.normal(keyed.uniform(1, "b", key="id"), keyed.uniform(1, "b", key="id", lane=1), 0, 5)
    df = df.withColumn("b", F.col("a") * 2 + noise).withColumn("c", F.when(F.col("a") > 105, "hi").otherwise("lo"))
    return df.withColumn("e", F.col("id") % 4 == 0)


@pytest.mark.parametrize("method", ["exact", "grid"])
def test_copula_keeps_shape(spark, method):
    n, kinds = 3000, {"a": "num", "b": "num", "c": "cat", "e": "bool"}
    df = scale.cut(shaped(spark, n))
    model = copula.fit(df, kinds, "id", method=method)
    out = scale.cut(copula.sample(spark, model, n, 5))
    card = score.fidelity(df, out, kinds)
    assert out.count() == n and card["score"] > 93, card
    again = copula.CopulaModel.from_json(model.to_json())
    assert prints({"t": copula.sample(spark, again, n, 5).repartition(3)}) == prints({"t": out})


def test_copula_dates_and_nulls(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 10 != 0, F.date_add(
        F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int"))).alias("d"))
    out = copula.sample(spark, copula.fit(df, {"d": "date"}, "id"), 2000)
    lo, hi, gone = out.agg(F.min("d"), F.max("d"), F.avg(F.col("d").isNull().cast("double"))).first()
    assert dict(out.dtypes)["d"] == "date" and abs(gone - 0.1) < 0.03
    assert str(lo) >= "2024-01-01" and str(hi) <= "2024-10-27"


def test_copula_edge_columns(spark):
    df = spark.range(30).selectExpr("id", "cast(null as double) as gone", "false as never", "5 as same", "'x' as one")
    kinds = {"gone": "num", "never": "bool", "same": "int", "one": "cat"}
    out = copula.sample(spark, copula.fit(df, kinds, "id"), 40)
    assert out.filter("never or same <> 5 or one <> 'x' or gone is not null").count() == 0
    assert copula.fit(df.limit(0), kinds, "id").cols == []


def test_dp_marginals_differ_but_stay_in_range(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 100 as double) as x", "'c' || (id % 4) as c")
    model = copula.fit(df, {"x": "num", "c": "cat"}, "id", dp={"x": (0.5, 0.0, 99.0), "c": 0.5})
    out = copula.sample(spark, model, 500)
    assert out.agg(F.min("x"), F.max("x")).first()[0] >= 0 and out.agg(F.max("x")).first()[0] <= 99
    assert abs(model.marginals["c"]["cum"][-1] - 1.0) < 1e-9


def test_large_category_domain_uses_a_join(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('v', id % 700) end as c", "id as x")
    model = copula.fit(df, {"c": "cat", "x": "int"}, "id")
    assert "c" in model.domains
    out = copula.sample(spark, model, 3000)
    share = out.agg(F.avg((F.col("c") == "hot").cast("double"))).first()[0]
    assert out.count() == 3000 and abs(share - 1 / 3) < 0.03


def test_synthesize_end_to_end(spark):
    df = spark.range(200).selectExpr("id + 1 as customer_id", "concat('p', id, '@x.org') as email", "id % 50 as visits", "'t' || (id % 3) as tier")
    s = synthesize(df, 150, "customer_id", null_config={"visits": 0.2}, outlier_rate=0.05,
                   constraints=[{"type": "range", "column": "visits", "min": 0, "max": 60}], actions={"tier": "mask"})
    rows = s.rows.collect()
    assert len(rows) == 150 and {r["customer_id"] for r in rows} == set(range(201, 351))
    assert all(r["email"].endswith("@example.com") for r in rows) and all(r["visits"] is None or 0 <= r["visits"] <= 60 for r in rows)
    assert {r["tier"] for r in rows} <= {"**"} and s.outliers > 0 and s.holdout.count() == 40


def test_scores_on_equal_and_disjoint_tables(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) as x", "id % 3 as y", "'c' || (id % 5) as c", "id % 2 = 0 as f")
    kinds = {"x": "num", "y": "int", "c": "cat", "f": "bool"}
    same = score.fidelity(df, df, kinds)
    assert same["score"] == 100.0 and set(same["columns"].values()) == {1.0}
    far = df.selectExpr("id", "x + 1000 as x", "y + 100 as y", "concat(c, 'z') as c", "true as f")
    other = score.fidelity(df, far, kinds)
    assert other["columns"]["x"] == 0 and other["columns"]["c"] == 0 and other["columns"]["f"] == 0.5
    empty = score.ks_scores(df, df.filter("id < 0"), kinds, ["x"]).first()
    assert empty["score"] == 0.0
    assert score.scorecard(None, df, kinds, "schema_only")["fidelity"] is None


def test_tstr_skips(spark):
    df = spark.range(30).selectExpr("id as x", "'a' as t")
    assert score.tstr(df, df, df.limit(3), "t", {"x": "int", "t": "cat"})["skipped"]
    assert score.tstr(df, df, df, "x", {"x": "date"})["skipped"]
    assert score.tstr(df, df, df, "x", {"x": "int"})["reason"] == "no usable feature columns"


def test_csv_and_json(spark, tmp_path):
    p = tmp_path / "messy.csv"
    p.write_text("﻿id,qty,price,ok,when\n1,2,4.5,True,2024-01-01\n2,,NULL,False,bad-date\n3,NULL,,True,\n", encoding="utf-8")
    df = readers.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "qty": "bigint", "price": "double", "ok": "boolean", "when": "string"}
    assert df.agg(F.count("qty"), F.count("price"), F.count("when")).first() == (1, 1, 2)
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": 2}}, {"a": 3}]')
    (tmp_path / "o.json").write_text(' {"a": 1, "b": {"c": {"d": 2}}}')
    assert readers.read_json(spark, str(tmp_path / "a.json")).columns == ["a", "b"]
    assert readers.read_json(spark, str(tmp_path / "o.json")).columns == ["a", "b.c.d"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, None), (3, "it's")], "id int, s string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert {r["s"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"\t=x", None, "it's"}
    assert [r[0] for r in writers.sql_inserts(df, "t").collect()] == [
        "INSERT INTO t VALUES (1, '=x');", "INSERT INTO t VALUES (2, NULL);", "INSERT INTO t VALUES (3, 'it''s');"]
    with pytest.raises(ValueError):
        writers.export_all({"t": df}, str(tmp_path), ["xlsx"])
    rows = writers.export_all({"t": df}, str(tmp_path / "e"), ["parquet", "jsonl", "sql"])
    assert rows == {"t": 3}
    arts = writers.artifact_manifest(spark, [str(tmp_path / "e" / f"t.{f}") for f in ("parquet", "jsonl", "sql")]).collect()
    assert {a["format"] for a in arts} == {"parquet", "jsonl", "sql"} and all(a["sha256"].startswith("sha256:") for a in arts)


def test_run_and_replay(spark, tmp_path):
    c = ct.Contract("mini", (ct.Table("a", (ct.Column("a_id", "id"), ct.Column("v", "num")), 30),
                             ct.Table("b", (ct.Column("b_id", "id"), ct.Column("a_id", "fk")), 50)))
    done = run.execute_run(spark, c, run.RunConfig(5, formats=("parquet", "csv")), str(tmp_path / "out"))
    assert run.all_passed(done.checks) and done.manifest["tables"]["b"]["rows"] == 50
    assert len(done.manifest["artifacts"]) == 4 and done.manifest_frame(spark).count() == 1
    assert all(r["same"] for r in run.replay(spark, c, done.manifest).collect())
    changed = {**done.manifest, "config": {**done.manifest["config"], "seed": 6}}
    assert not all(r["same"] for r in run.replay(spark, c, changed).collect())


def test_locales(spark):
    assert locales.available() == ["ae", "eu", "in", "pk", "uk", "us"]
    assert locales.pack("??")["locale"] == "us" and len(locales.pack("in")["tax_rules"]) == 2
    for code in locales.available():
        assert abs(sum(locales.CITIES[code].values()) - 1) < 0.011
    assert domains.vocab_bank(spark, "city", 700).select("word").distinct().count() == 700


def test_contract_does_what_it_declares(spark):
    """Relationship counts, N:N pairs, missing values, outliers and rules."""
    c = ct.Contract("club", (
        ct.Table("members", (ct.Column("member_id", "id", start=1), ct.Column("age", "int", minimum=18, maximum=60)), rows=200,
                       primary_key="member_id"),
        ct.Table("courses", (ct.Column("course_id", "id", start=1), ct.Column("title", "text")), rows=7, primary_key="course_id"),
        ct.Table("bookings", (ct.Column("booking_id", "id", start=1), ct.Column("member_id", "fk", False),
                                    ct.Column("course_id", "fk", False)), primary_key="booking_id"),
        ct.Table("visits", (ct.Column("visit_id", "id", start=1), ct.Column("member_id", "fk", False),
                                  ct.Column("minutes", "int", minimum=10, maximum=90), ct.Column("note", "text")), primary_key="visit_id",
                       missing=ct.Missingness(per_column={"note": 0.4}, mechanism="MAR", driver="minutes"),
                       outliers=ct.Outliers(rate=0.05, factor=10.0))),
        (ct.Relationship("members", "bookings", cardinality="N:N", dist="fixed", mean_children=5, max_children=5),
         ct.Relationship("members", "visits", mean_children=4, min_children=1, max_children=30)),
        (ct.Rule("member known", "visits.member_id in members.member_id"), ct.Rule("adult", "members.age >= 18"),
         ct.Rule("short", "visits.minutes <= 90", "warn")))
    t = generate.generate_from_contract(spark, c, seed=5)
    booked = t["bookings"].groupBy("member_id").agg(F.count("*").alias("n"), F.count_distinct("course_id").alias("d")).collect()
    assert len(booked) == 200 and all(r["n"] == 5 and r["d"] == 5 for r in booked)
    visits = t["visits"].groupBy("member_id").count().collect()
    assert len(visits) == 200 and 1 <= min(r["count"] for r in visits) and 3 < sum(r["count"] for r in visits) / 200 < 5
    half = t["visits"].groupBy((F.col("minutes") > 50).alias("long")).agg(F.avg(F.col("note").isNull().cast("double")).alias("gone")).collect()
    gone = {r["long"]: r["gone"] for r in half}
    assert 0.05 < gone[False] < gone[True] < 0.95
    rules = checks.declared_rules(c.rules, {x.name: x.key for x in c.tables})
    out = {r["check"]: r for r in checks.run_rules(t, rules).collect()}
    assert out["member known"]["passed"] and out["adult"]["passed"] and out["short"]["violations"] > 0 and out["short"]["severity"] == "warn"
    broken = {**t, "members": t["members"].filter("member_id > 3")}
    assert checks.run_rules(broken, rules).filter("check = 'member known'").first()["violations"] > 0


def test_given_rows_are_taken_over(spark):
    t = ct.Table("t", (ct.Column("t_id", "id", start=1), ct.Column("city", "text"), ct.Column("n", "int")))
    given = spark.createDataFrame([(3, "Ghent"), (9, None)], "row_no long, city string")
    got = sorted(tuple(r)[:2] for r in generate.synthesize_from_contract(spark, t, given=given).collect())
    assert got == [(4, "Ghent"), (10, None)]


def test_run_time_errors_stay_with_their_check(spark):
    t = {"a": spark.createDataFrame([("1",), ("x",)], "v string")}
    out = {r["check"]: r for r in checks.prove(t, [
        checks.row_check("fails", "a", lambda: F.col("v").cast("int") < 0), checks.row_check("fine", "a", lambda: F.col("v") == "x")], spark).collect()}
    assert out["fails"]["violations"] == -1 and out["fails"]["error"] and out["fine"]["violations"] == 1


def test_repairs_meet_no_existing_value(spark):
    text = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, None), (5, "a_1"), (6, "b_7")], "k int, v string")
    got = [r["v"] for r in degrade.repair_unique(text, "v", "k").collect() if r["v"]]
    assert len(got) == len(set(got)) == 5
    top = spark.createDataFrame([(1, 127), (2, 127), (3, 5)], "k int, v tinyint")
    got = [r["v"] for r in degrade.repair_unique(top, "v", "k").collect()]
    assert len(set(got)) == 3


def test_invoices_with_more_lines_than_products(spark):
    heads = invoices.invoice_heads(spark, 4, "2025-06-30")
    lines = invoices.invoice_lines(heads, 50)
    assert lines.groupBy("invoice_no").count().filter("count <> 50").count() == 0
    first = lines.filter(F.col("line_no") <= len(invoices.PRODUCTS)).groupBy("invoice_no").agg(F.count_distinct("description").alias("d"))
    assert all(r["d"] == len(invoices.PRODUCTS) for r in first.collect())


def test_models_with_long_category_lists_are_saved(spark, tmp_path):
    df = spark.range(900).selectExpr("id", "concat('c', id % 300) as c", "id % 7 as n")
    model = copula.fit(df, {"c": "cat", "n": "int"}, "id")
    assert "c" in model.domains
    model.save(spark, str(tmp_path))
    again = copula.CopulaModel.load(spark, str(tmp_path))
    a, b = (sorted(map(tuple, copula.sample(spark, m, 200).collect())) for m in (model, again))
    assert a == b and len({r[1] for r in a}) > 50


def test_make_psd_mends_a_matrix_that_is_not_positive():
    import numpy as np
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(bad).min() < 0
    good = copula.make_psd(bad)
    assert np.linalg.eigvalsh(good).min() > -1e-9 and np.allclose(np.diag(good), 1) and np.allclose(good, good.T)
    same = copula.make_psd(np.array([[1.0, 0.3], [0.3, 1.0]]))
    assert np.allclose(same, [[1, 0.3], [0.3, 1]]) and np.isfinite(copula.make_psd(np.array([[1.0, np.nan], [np.nan, 1.0]]))).all()


def test_booleans_in_all_spellings(spark):
    df = spark.createDataFrame([("y",), ("n",), ("T",), ("f",), ("yes",), ("0",), (None,)], "v string")
    got = [r[0] for r in df.select(copula.to_numeric(F.col("v"), "bool", df.schema["v"].dataType)).collect()]
    assert got == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, None]


def test_null_groups_stay_apart_from_text(spark):
    from facsimile.operators import risk
    df = spark.createDataFrame([(None, 1), ("<null>", 2)], "q string, s int")
    assert risk.k_anonymity(df, ["q"]).first()["total_groups"] == 2


def test_repeated_keys_do_not_stop_exact_draws(spark):
    df = spark.range(30_000).selectExpr("0.25D as u", "id % 3 as k")
    assert ordered.rank_cutoffs(df, "u", "k", [5, 15_000, 29_999]) == [(0.25, 0), (0.25, 1), (0.25, 2)]


def test_key_scores_take_neighbours_in_order(spark):
    from facsimile.operators import keys
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 1.7), (4, 2.5), (5, 3.5)], "a long, b double")
    got = {r["column"]: round(r["sequential_rate"], 6) for r in keys.key_scores(df).collect()}
    assert got == {"a": 0.75, "b": 0.5}


def test_cards_are_the_same_by_broadcast_and_by_salted_join(spark):
    def made():
        found = fintech.generate_fintech(spark, 7, 12, 9)["transactions"]
        return sorted(map(tuple, found.select("tx_id", "account_id", "card_id", "balance_after").collect()))

    plain = made()
    keep = spark.conf.get("facsimile.boundedRows", "20000")
    spark.conf.set("facsimile.boundedRows", "3")
    try:
        assert made() == plain and any(r[2] for r in plain) and not all(r[2] for r in plain)
    finally:
        spark.conf.set("facsimile.boundedRows", keep)


def test_small_accounts_move_once_to_their_balances(small_buckets):
    spark = small_buckets
    entries = spark.range(900).selectExpr(
        "id % 60 as account_id", "date_add(date'2025-01-01', cast(id % 20 as int)) as date", "id as seq", "1 as step",
        "'' as description", "'' as category", "'' as merchant", "id % 90 as debit", "id % 70 as credit", "id % 5 = 0 as is_recurring")
    fleet = statements.fleet(spark.range(60), "id", "2025-01-31", 30, 100, 50)
    bal = statements.enforce_min_balance(entries, fleet)
    plan = bal._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" not in plan and plan.count("Window [") == 2
    assert {r["failed"] for r in statements.reconcile_statements(bal, fleet, statements.statement_totals(bal, fleet)).collect()} == {0}


def places(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_entries_of_a_fleet_read_by_one_task_are_made_by_many(small_buckets):
    accounts = small_buckets.range(0, 400, 1, 1)
    fleet = statements.fleet(accounts, "id", "2025-06-30", 90, 20_000, 5_000)
    made = {n: f(fleet) for n, f in (("r", statements.recurring_entries), ("d", statements.discretionary_entries))}
    assert all(places(df) > 4 for df in made.values())
    shown = prints(made)
    small_buckets.conf.set("facsimile.boundedRows", "20000")  # too few to be dealt
    again = {n: f(fleet) for n, f in (("r", statements.recurring_entries), ("d", statements.discretionary_entries))}
    assert all(places(df) == 1 for df in again.values()) and prints(again) == shown


def test_synthesize_deals_a_table_read_by_one_task(small_buckets):
    df = small_buckets.range(0, 300, 1, 1).selectExpr("id + 1 as customer_id", "id % 50 as visits", "'t' || (id % 3) as tier")
    s = synthesize(df, 50, "customer_id")
    assert places(s.train) > 4 and s.train.count() + s.holdout.count() == 300 and s.rows.count() == 50


def test_anomalies_are_drawn_for_picked_rows(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr("id", "cast(id % 90 as double) as x", "date_add(date'2024-01-01', cast(id % 9 as int)) as d")
    out, log = edge.label_anomalies(df, {"id": "id", "x": "num", "d": "date"}, "id", 0.01)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edge/anomaly/pick") <= 3 and log[0]["count"] == 300
    rows = out.collect()
    assert sum(r["is_anomaly"] for r in rows) == 300 and all((r["anomaly_type"] is None) != r["is_anomaly"] for r in rows)
