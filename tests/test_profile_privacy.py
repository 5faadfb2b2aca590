"""Profiling, key detection, scan, actions and risk, with their documented quirks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import domains, keys, privacy, quantiles, risk, scale
from facsimile.operators import profile as pf
from facsimile.operators import scan as sc
from facsimile.streaming.protect import protect_stream, write_protected


def people(spark, n=100):
    return spark.range(1, n + 1).selectExpr(
        "id", "'Test' as name", "42.5D as price", "true as active", "concat('u', id, '@x.org') as contact",
        "case when id % 2 = 0 then 'yes' else 'no' end as flag", "cast(id % 4 as string) as code_text",
        "concat('0', id % 9 + 1, '/02/2024') as d1", "date_format(date_add(date'2024-01-01', cast(id as int)), 'MMM dd, yyyy') as d2",
        "concat('2024-01-0', id % 9 + 1, ' 10:00:00') as d3", "cast(null as string) as nothing",
        "case when id % 3 = 0 then 'a' end as cat", "repeat('word ', cast(id as int)) as body")


def test_kinds(spark):
    got = {r["column"]: r["kind"] for r in pf.infer_kinds(people(spark)).collect()}
    assert got == {"id": "int", "name": "cat", "price": "money", "active": "bool", "contact": "email", "flag": "bool",
                   "code_text": "num", "d1": "date", "d2": "date", "d3": "datetime", "nothing": "text", "cat": "cat",
                   "body": "text"}


def test_zero_one_column_is_boolean(spark):
    df = spark.range(10).selectExpr("id % 2 as b", "cast(id % 2 as double) as d", "1 as one")
    assert {r["column"]: r["kind"] for r in pf.infer_kinds(df).collect()} == {"b": "bool", "d": "int", "one": "bool"}


def test_profile_values(spark):
    rows = {r["column"]: r for r in pf.profile(people(spark)).collect()}
    assert rows["id"]["kind"] == "id" and rows["id"]["is_primary_key"]
    assert rows["price"]["mean"] == 42.5 and rows["price"]["std"] == 0.0
    assert rows["active"]["true_rate"] == 1.0 and rows["flag"]["true_rate"] == 0.5
    assert rows["cat"]["null_rate"] == 0.67 and rows["nothing"]["null_rate"] == 1.0
    assert str(rows["d2"]["min_date"]) == "2024-01-02" and rows["d2"]["date_range_days"] == 99
    assert rows["body"]["max_length"] == 500 and rows["body"]["min_length"] == 5
    assert rows["contact"]["pii"] == "direct" and rows["name"]["pii"] == "direct" and rows["id"]["pii"] == "none"


def test_profile_of_empty_and_single_row(spark):
    empty = pf.profile(people(spark).limit(0)).collect()
    assert {r["kind"] for r in empty} == {"text"} and all(r["null_rate"] == 0 for r in empty)
    single = {r["column"]: r for r in pf.profile(people(spark, 1)).collect()}
    assert single["price"]["skewness"] == 0.0 and single["price"]["kurtosis"] == 0.0


def test_approximate_quantiles_say_so(spark):
    r = pf.profile(spark.range(1000), primary_key=None, exact=False).first()
    assert r["method"] == "approx" and abs(r["median"] - 499.5) < 5


def test_sequential_key_beats_unique_float(spark):
    df = spark.range(200).selectExpr("rand(3) as x", "id + 5 as k", "concat('n', id) as name_id")
    scores = {r["column"]: r for r in keys.key_scores(df).collect()}
    assert scores["k"]["sequential_rate"] == 1.0 and keys.detect_primary_key(df) == "name_id"
    assert keys.detect_primary_key(df.drop("name_id")) == "k"
    assert keys.detect_primary_key(df.selectExpr("1 as a")) is None


def test_foreign_keys(spark):
    tables = {"customers": spark.range(100).toDF("customer_id"),
              "orders": spark.range(1000, 1400).selectExpr("id as order_id", "id % 100 as customer_id")}
    got = [tuple(r) for r in keys.detect_foreign_keys(tables).collect()]
    assert got == [("orders", "customer_id", "customers", "customer_id", 1.0, True, "high")]


def test_leak_check_and_safe_profile(spark):
    df = spark.createDataFrame([("Margaret", "x"), ("Ann", "yy")], "name string, other string")
    assert [tuple(r) for r in pf.leak_check("sent Margaret and Ann", df).collect()] == [("name", "Margaret")]
    prof = pf.profile(people(spark))
    safe = {r["column"]: r for r in pf.safe_profile(prof, pf.category_profile(people(spark), ["cat"]), ["price"]).collect()}
    assert safe["price"]["is_pii"] and safe["price"]["mean"] is None
    assert safe["cat"]["categories"] == ["a"]


def test_scan_orders(spark):
    df = spark.range(60).selectExpr(
        "concat('2024-01-', lpad(id % 28 + 1, 2, '0')) as day", "concat(id + 100, '-', id % 80 + 10, '-', id + 1000) as taxpayer",
        "concat('4000 1234 5678 ', id + 1000) as plastic", "id + 10000000 as long_no",
        "concat('Ann', translate(cast(id as string), '0123456789', 'abcdefghij'), ' Lee') as who", "id as salary", "id as password")
    new = {r["column"]: r for r in sc.scan(df).collect()}
    old = {r["column"]: r for r in sc.scan(df, order="reference").collect()}
    assert new["day"]["pii_level"] == "none" and old["day"]["pii_type"] == "phone"
    assert new["taxpayer"]["pii_type"] == "national_id" and old["taxpayer"]["pii_type"] == "phone"
    assert new["plastic"]["pii_type"] == "credit_card" and old["plastic"]["pii_type"] == "phone"
    assert new["long_no"]["pii_level"] == "none" and old["long_no"]["pii_type"] == "phone"
    assert new["who"]["pii_type"] == "probable_name" and new["salary"]["pii_type"] == "financial"
    assert new["password"]["pii_type"] == "sensitive"


def test_mask_lengths_and_nulls(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("čšž",), (None,)], "v string")
    assert [r[0] for r in df.select(privacy.mask(F.col("v"))).collect()] == ["", "*", "**", "*bc", "*šž", None]
    assert [r[0] for r in df.select(privacy.pseudonymize(F.col("v"))).collect()][-1] is None


def test_noise_stays_in_range_and_keeps_nulls(spark):
    df = spark.range(500).selectExpr("id", "case when id % 10 = 0 then null else cast(id as int) end as v")
    out = privacy.apply_privacy(df, {"v": "dp_noise"}, "id", noise={"v": 0.5})
    r = out.agg(F.min("v"), F.max("v"), F.count_if(F.col("v").isNull())).first()
    assert r[0] >= 1 and r[1] <= 499 and r[2] == 50
    same = privacy.apply_privacy(df, {"v": "dp_noise"}, "id", noise={"v": 0.0})
    assert same.exceptAll(df).count() == 0


def test_unknown_action_is_refused(spark):
    with pytest.raises(ValueError):
        privacy.apply_privacy(spark.range(1), {"id": "shred"}, "id")


def test_streaming_protection_equals_batch(spark, tmp_path):
    src = spark.range(50).selectExpr("id", "concat('p', id) as secret", "cast(id as double) as v", "'x' as gone")
    src.write.parquet(str(tmp_path / "in"))
    actions = {"secret": "hash", "v": "dp_noise", "gone": "exclude"}
    noise = {"v": privacy.Noise(1.0, 0.0, 49.0)}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = write_protected(protect_stream(stream, actions, "id", noise=noise), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = privacy.apply_privacy(src, actions, "id", noise=noise)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and got.exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        protect_stream(stream, {"v": "dp_noise"}, "id")


def test_nulls_form_a_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), (None, 2), ("a", 1)], "q string, s int")
    assert risk.k_anonymity(df, ["q"]).first()["k"] == 2
    assert risk.l_diversity(df, ["q"], "s").first()["l"] == 1
    with pytest.raises(ValueError):
        risk.k_anonymity(df, ["missing"])


def test_exact_match_with_nulls_and_bars(spark):
    train = spark.createDataFrame([("a|b", "c"), (None, "d")], "x string, y string")
    synth = spark.createDataFrame([("a", "b|c"), (None, "d"), ("a|b", "c"), ("z", "z")], "x string, y string")
    assert risk.exact_match_rate(train, synth).first()[0] == 0.5


@pytest.mark.parametrize("dims,rows", [(1, 300), (3, 800)])
def test_nearest_distance_is_exact(spark, dims, rows):
    rnd = np.random.default_rng(4)
    pts = np.round(np.concatenate([rnd.normal(size=(rows, dims)), np.zeros((rows // 3, dims))]), 3)
    probe = np.round(np.concatenate([rnd.normal(size=(60, dims)) * 3, np.zeros((40, dims)), np.full((1, dims), 50.0)]), 3)
    names = [f"d{i}" for i in range(dims)]
    spec = ", ".join(f"{n} double" for n in names)
    got = risk.nearest_distance(spark.createDataFrame(probe.tolist(), spec), spark.createDataFrame(pts.tolist(), spec),
                                names, cell_rows=20)
    found = {tuple(r[n] for n in names): r["distance"] for r in got.collect()}
    assert len(found) == len({tuple(p) for p in probe.tolist()})
    for p, d in found.items():
        assert abs(d - np.sqrt(((pts - np.array(p)) ** 2).sum(axis=1)).min()) < 1e-9


def test_distance_ratio_flags_copies(spark):
    base = spark.range(400).selectExpr("id", "cast((id * 7919) % 1000 as double) as a", "cast((id * 104729) % 997 as double) as b")
    train, hold = domains.split_holdout(base, keyed.uniform(1, "h", key="id"), "id")
    copied = risk.dcr_ratio(train, hold, train, ["a", "b"])
    assert copied == 0.0
    assert risk.privacy_indicators(0.0, copied)["level"] == "Elevated"
    assert risk.privacy_indicators(0.001, 0.9)["level"] == "Moderate" and risk.privacy_indicators(0.0, None)["level"] == "Low"
    assert risk.dcr_ratio(train, None, train, ["a"]) is None


def test_small_tables_have_no_holdout(spark):
    df, hold = domains.split_holdout(spark.range(19), keyed.uniform(1, "h", key="id"), "id")
    assert hold is None and df.count() == 19
    train, hold = domains.split_holdout(spark.range(21), keyed.uniform(1, "h", key="id"), "id")
    assert (train.count(), hold.count()) == (17, 4)


@pytest.mark.parametrize("dims", [2, 6, 12])
def test_nearest_search_visits_few_cells_a_round(spark, dims, monkeypatch):
    rnd = np.random.default_rng(9)
    pts, probe = np.round(rnd.normal(size=(900, dims)), 3), np.round(rnd.normal(size=(70, dims)) * 2, 3)
    names = [f"d{i}" for i in range(dims)]
    spec = ", ".join(f"{n} double" for n in names)
    visits = []

    def watched(df, cut=scale.cut):
        out = cut(df)
        if out.columns == [*names, "best", "cell"]:
            visits.append(out.groupBy(*names).count().agg(F.count("*"), F.max("count"), F.sum("count")).first())
        return out

    monkeypatch.setattr(scale, "cut", watched)
    got = risk.nearest_distance(spark.createDataFrame(probe.tolist(), spec), spark.createDataFrame(pts.tolist(), spec), names, cell_rows=15)
    for r in got.collect():
        p = np.array([r[n] for n in names])
        assert abs(r["distance"] - np.sqrt(((pts - p) ** 2).sum(axis=1)).min()) < 1e-9
    assert visits[-1][0] == 0 and visits[0][0] == 70
    for turn, (open_probes, most, _) in enumerate(visits[:-1]):
        assert most <= risk.fan_out(turn)
        assert turn == 0 or open_probes <= visits[turn - 1][0]
    if dims == 2:  # in few columns the bound shuts nearly all cells out
        assert sum(v[2] or 0 for v in visits) <= 8 * 70


def test_quantiles_of_all_columns_at_once(spark, small_buckets):
    rnd = np.random.default_rng(2)
    n = 5000
    columns = {"flat": rnd.normal(size=n), "ties": rnd.integers(0, 3, n).astype(float), "one": np.full(n, 7.0),
               "wide": rnd.lognormal(3, 4, n), "sorted": np.arange(n, dtype=float), "few": np.where(np.arange(n) < 4, np.arange(n) * 1.5, np.nan)}
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*columns.values())]
    df = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"`{c}` double" for c in columns) + ", none double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles_of(df, {c: F.col(c) for c in df.columns}, qs)
    for c, values in columns.items():
        assert np.allclose(got[c], np.quantile(values[~np.isnan(values)], qs), rtol=1e-12, atol=0), c
    assert got["none"] is None


def test_quantiles_hold_when_a_sketch_misses(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "ERROR", 1e-5)  # a claim that so small a sketch can't keep
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("v"))
    values = np.array([r.v for r in df.collect()])
    qs = [0.1, 0.37, 0.5, 0.9]
    assert quantiles.exact_quantiles_of(df, {"v": F.col("v")}, qs)["v"] == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12)


def test_jobs_of_quantiles_do_not_grow_with_columns(spark):
    def jobs(k):
        group = f"quantile-jobs-{k}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.range(2000).select(*[(F.col("id") * (7919 + i) % 2003).cast("double").alias(f"c{i}") for i in range(k)])
        quantiles.exact_quantiles_of(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20) <= jobs(4) + 2


@pytest.mark.parametrize("sampled", [200, 65_536])
def test_sampled_pairs_keep_every_foreign_key(spark, sampled):
    tables = {"member": spark.range(3000).selectExpr("id as member_id", "concat('m', id) as label"),
              "visit": spark.range(9000).selectExpr("id + 1000000 as visit_id", "id % 3000 as member_id", "id % 3750 as mostly_member_id",
                                                    "id * 7 as far", "cast(null as bigint) as nothing", "id % 2 as flag")}
    pairs = keys.possible_pairs([(t, c) for t, df in tables.items() for c in pf.scalar_columns(df)],
                                {"member": "member_id", "visit": "visit_id"}, tables, sampled)
    # what has many values of its own is ruled out by the sample; few values are left to the exact count
    assert ("visit", "far", "member") not in pairs and ("member", "label", "visit") not in pairs
    assert ("visit", "member_id", "member") in pairs and ("visit", "flag", "member") in pairs
    got = {(r["child_column"], r["parent_table"]): (r["containment"], r["confidence"]) for r in
           keys.detect_foreign_keys(tables, {"member": "member_id", "visit": "visit_id"}, sampled).collect()}
    assert got == {("member_id", "member"): (1.0, "high"), ("mostly_member_id", "member"): (0.8, "review"), ("flag", "member"): (1.0, "review")}


def test_facts_of_a_table_read_by_one_task_are_found_by_many(spark, small_buckets):
    df = spark.range(0, 400, 1, 1).selectExpr(
        "id", "concat('u', id, if(id % 5 = 0, '', '@x.org')) as mail", "concat(if(id % 4 = 0, 'HTTPS', 'http'), '://x.org/', id) as site",
        "case id % 6 when 0 then '1/2/2024' when 1 then '3-4-2024' when 2 then '2024/5/6' when 3 then '7 Feb 2024' when 4 then 'Mar 8, 2024' "
        "else '2024-01-09' end as day")
    facts = pf.column_facts(df)
    assert "RoundRobinPartitioning" in facts._jdf.queryExecution().toString()
    got = {r["column"]: r for r in facts.collect()}
    assert (got["mail"]["email_hits"], got["site"]["url_hits"], got["day"]["time_hits"], got["day"]["iso_date_hits"]) == (320, 400, 400, 66)
    assert scale.spread(df).count() == 400 and scale.spread(df.repartition(8)).rdd.getNumPartitions() == 8


def odd_rows(spark):
    """Few and many values, whole and broken numbers, texts of numbers, dates and words, nulls, no values at all."""
    return spark.range(0, 3000, 1, 3).selectExpr(
        "id * 7 - 9000 as order_key", "cast(id % 5 as int) as line", "cast(id % 2 as tinyint) as bit", "id % 2 = 0 as open", "id % 11 / 100.0D as tax",
        "sqrt(id * 1.0D) as root", "if(id % 3 = 0, null, id % 50 - 20.5D) as price", "if(id % 4 = 0, 'A', if(id % 4 = 1, 'N', null)) as flag",
        "concat(id % 9, if(id % 2 = 0, '.0', '')) as text_number", "concat('word ', id) as words", "concat('0', id % 9 + 1, '/02/2024') as day_text",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 30 as int)) as shipped",
        "timestamp_ntz'2024-01-01 00:00:01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as stamped", "cast(id % 7 as decimal(9,2)) as dec", "cast(id % 2 as decimal(9,0)) as code",
        "7.1D as same", "cast(null as double) as nothing", "cast(null as string) as no_text", "if(id % 1000 = 3, double('NaN'), id % 4 * 1.0D) as holes",
        "date_add(date'9999-12-30', cast(id % 3 as int)) as far")


def test_facts_of_few_values_are_the_facts_of_all_rows(spark):
    df = odd_rows(spark).drop("far")

    def found(bounded):
        spark.conf.set("facsimile.boundedRows", bounded)
        try:
            return {r["column"]: r.asDict() for r in pf.profile(df).collect()}
        finally:
            spark.conf.set("facsimile.boundedRows", "20000")

    rows, values = found("0"), found("20000")
    assert [*sorted(rows)] == [*sorted(values)] and {r["position"] for r in rows.values()} == {*range(len(df.columns))}
    for c, was in rows.items():
        for fact, v in was.items():
            assert str(values[c][fact]) == str(v) or values[c][fact] == pytest.approx(v, abs=1.1e-4), (c, fact)
    assert (values["bit"]["kind"], values["open"]["kind"], values["code"]["kind"], values["tax"]["kind"]) == ("bool", "bool", "bool", "money")
    assert values["same"]["std"] == 0.0 and values["same"]["skewness"] is None and values["words"]["n_unique"] == 3000
    far = {r["column"]: r for r in pf.profile(odd_rows(spark).select("far")).selectExpr("column", "cast(max_date as string) as last").collect()}
    assert far["far"]["last"] == "+10000-01-01"


def test_whole_numbers_are_counted_by_words_of_neighbours(spark):
    df = spark.createDataFrame([(v, v % 100 if v is not None else None) for v in (*range(-200, 200), 63, 64, -1, -64, -65, 2 ** 63 - 1, -2 ** 63, None, None)],
                               "big long, small int")
    got = {r["column"]: r["n_unique"] for r in pf.distinct_profile(df.union(df)).collect()}
    assert got == {"big": 402, "small": 100}
    assert [r["n_unique"] for r in pf.distinct_profile(df.limit(0)).collect()] == [0, 0]
    # a group for 64 neighbours, not one for each number
    plan = pf.distinct_profile(spark.range(64_000).repartition(3))
    assert "shiftright" in plan._jdf.queryExecution().toString() and plan.first()["n_unique"] == 64_000


def test_facts_are_compiled(spark):
    # with more fields than this an aggregate runs uncompiled
    most, widths = int(spark.conf.get("spark.sql.codegen.maxFields")), []
    todo = [pf.column_facts(odd_rows(spark))._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if "HashAggregate" in node.nodeName():
            widths.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert widths and max(widths) <= most


def test_few_values_are_parsed_once(spark, monkeypatch):
    seen, parse = spark.sparkContext.accumulator(0), pf.parse_time

    @F.udf("string")
    def told(v):
        seen.add(1)
        return v

    monkeypatch.setattr(pf, "parse_time", lambda c, fam: parse(told(c) if fam == "string" else c, fam))
    r = pf.profile(odd_rows(spark).select("flag")).first()
    assert (r["kind"], r["n_unique"], r["null_count"]) == ("cat", 2, 1500) and seen.value <= 30
