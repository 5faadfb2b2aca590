"""Ordered scans: same answer for any bucket size, partitioning and group skew."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import ordered, scale


def skewed(spark, n=600):
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string")))
    return spark.range(n).select("id", g.alias("g"), (F.col("id") % 11 - 4).alias("x"))


def expected(rows):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r["g"], r["id"])):
        s, m, n = state.get(r["g"], (0, None, 0))
        prior = m
        s, m, n = s + r["x"], r["x"] if m is None else max(m, r["x"]), n + 1
        state[r["g"]] = (s, m, n)
        out[r["id"]] = (s, m, prior, n)
    return out


@pytest.mark.parametrize("per_bucket", ["1000000", "100", "7"])
def test_running_matches_brute_force(spark, per_bucket):
    spark.conf.set("facsimile.rowsPerBucket", per_bucket)
    try:
        df = skewed(spark)
        want = expected(df.collect())
        got = ordered.running(df.repartition(5), ["id"], {"s": "x"}, {"m": "x"}, ["g"], "n", prior_maxes={"p": "x"})
        assert set(got.columns) == {"id", "g", "x", "s", "m", "p", "n"}
        assert {r["id"]: (r["s"], r["m"], r["p"], r["n"]) for r in got.collect()} == want
    finally:
        spark.conf.set("facsimile.rowsPerBucket", "500000")


def test_hot_group_is_split_into_buckets(small_buckets):
    df = skewed(small_buckets)
    bounds = ordered._bounds(df, ["g", "id"], 600, 15)
    sizes = df.withColumn("b", ordered._bucket(df, ["g", "id"], bounds)).filter("g = 'hot'").groupBy("b").count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 200


def test_dense_ids_do_not_depend_on_partitioning(small_buckets):
    df = skewed(small_buckets)
    a, b = (ordered.dense_ids(df.repartition(k), ["g", "id"]).orderBy("row_id").collect() for k in (3, 13))
    assert a == b and [r["row_id"] for r in a] == list(range(1, 601))


def test_bounds_keep_types(small_buckets):
    df = small_buckets.range(300).selectExpr(
        "id", "date_add(date'2024-01-01', cast(id % 50 as int)) as d", "cast(id / 7.0 as double) as x",
        "concat('k''\\\\', id % 9) as s", "timestamp_ntz'2024-01-01 00:00:00.5' + make_interval(0,0,0,0,0,cast(id as int)) as t")
    for cols in (["d", "id"], ["x"], ["s", "id"], ["t"]):
        got = [r["id"] for r in ordered.dense_ids(df, cols).orderBy("row_id").collect()]
        assert got == [r["id"] for r in df.orderBy(*cols).collect()], cols


def test_rank_cutoffs_and_exact_sample(spark):
    df = spark.range(5000).withColumn("u", keyed.uniform(1, "t", key="id"))
    rows = sorted((r["u"], r["id"]) for r in df.collect())
    got = ordered.rank_cutoffs(df, "u", "id", [1, 2, 77, 5000, 5001, 0])
    assert got == [rows[0], rows[1], rows[76], rows[-1], None, None]
    picked = ordered.sample_exact(spark.range(5000), 77, keyed.uniform(1, "t", key="id"), "id")
    assert sorted(r["id"] for r in picked.collect()) == sorted(i for _, i in rows[:77])
    assert ordered.sample_exact(spark.range(10), 0, keyed.uniform(1, "t", key="id"), "id").count() == 0
    assert ordered.sample_exact(spark.range(10), 50, keyed.uniform(1, "t", key="id"), "id").count() == 10


def test_rank_cutoffs_with_equal_draws(spark):
    df = spark.range(3000).withColumn("u", F.lit(0.25))
    assert ordered.rank_cutoffs(df, "u", "id", [1500]) == [(0.25, 1499)]


def test_average_ranks(small_buckets):
    df = small_buckets.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, None, 3.0] * 30], "v double")
    got = {r["v"]: r["r"] for r in ordered.with_ranks(df, "v", "r").distinct().collect()}
    assert got == {1.0: 15.5, 2.0: 45.5, 3.0: 105.5, None: None}


def test_quantile_paths_agree(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([rnd.random() * 9, 2.0, None]) for _ in range(500)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "v double, w int")
    qs = [0, 0.01, 0.25, 0.5, 0.333, 0.99, 1]
    fast, fast_w = ordered.exact_quantiles(df, "v", qs), ordered.exact_quantiles(df, "v", qs, weight="w")
    spark.conf.set("facsimile.exactPercentileRows", "10")
    try:
        slow, slow_w = ordered.exact_quantiles(df, "v", qs), ordered.exact_quantiles(df, "v", qs, weight="w")
    finally:
        spark.conf.set("facsimile.exactPercentileRows", "5000000")
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(fast + fast_w, slow + slow_w, strict=True))
    assert ordered.exact_quantiles(df.filter("v is null"), "v", [0.5]) == [None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=60))
def test_running_property(small_buckets, pairs):
    df = small_buckets.createDataFrame([(i, g, x) for i, (g, x) in enumerate(pairs)], "id bigint, g int, x bigint")
    got = {r["id"]: r["s"] for r in ordered.running(df, ["id"], {"s": "x"}, by=["g"]).collect()}
    run: dict = {}
    for i, (g, x) in enumerate(pairs):
        run[g] = run.get(g, 0) + x
        assert got[i] == run[g]


def test_salts_follow_a_keys_share(spark, small_buckets):
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, "big").when(F.col("id") < 2400, "some").when(F.col("id") < 3000, None)
                                    .otherwise(F.col("id").cast("string")).alias("k"), "id")
    dim = spark.createDataFrame([("big", 1), ("some", 2), ("absent", 3)] + [(str(i), i) for i in range(3000, 3900)], "k string, v int")
    counts = rows.groupBy("k").count()
    hot = ordered.hot_values(counts.filter("k is not null"), "k", "count", 4000)
    assert ("big", 0.5) in hot and ("some", 0.1) in hot
    assert [scale.salts_of(s, 200) for s in (0.5, 0.1, 0.001, 0.0)] == [200, 40, 1, 1]
    for how in ("left", "inner"):
        got = scale.lookup(rows, dim, "k", how, lambda: hot)
        want = rows.join(dim, "k", how)
        assert got.columns == ["k", "id", "v"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = scale.lookup(rows, dim, "k", "left", lambda: hot).withColumn("p", F.spark_partition_id())
        spread = {r["k"]: r["n"] for r in joined.groupBy("k").agg(F.count_distinct("p").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spread["big"] >= 4 and spread[None] >= 4  # of eight tasks


def test_ranks_of_many_columns_at_once(small_buckets):
    spark = small_buckets
    rnd = random.Random(8)
    rows = [(k, rnd.choice([None, 1.0, 1.0, 2.0, rnd.random()]), float(rnd.randrange(5)), None, -0.0 if k % 2 else 0.0) for k in range(700)]
    df = spark.createDataFrame(rows, "id int, a double, b double, none double, zero double").repartition(5)
    got, sizes = ordered.ranks_of_all(df, {"id": F.col("id"), "a": F.col("a"), "b": F.col("b"), "none": F.col("none"), "zero": F.col("zero")})
    assert sizes == {"id": 700, "a": sum(r[1] is not None for r in rows), "b": 700, "none": 0, "zero": 700}

    def average(values):
        return {v: (sum(x < v for x in values) + 1 + sum(x <= v for x in values)) / 2 for v in set(values)}

    ranks = {name: average([r[i] for r in rows if r[i] is not None]) for name, i in (("a", 1), ("b", 2))}
    for r in got.collect():
        own = rows[int(r["id"]) - 1]
        assert r["a"] == (None if own[1] is None else ranks["a"][own[1]]) and r["b"] == ranks["b"][own[2]]
        assert r["none"] is None and r["zero"] == 350.5


def test_groups_that_fit_a_bucket_are_scanned_whole(small_buckets):
    df = small_buckets.range(600).selectExpr("id", "id % 30 as g", "id % 11 - 4 as x")
    out = ordered.running(df, ["id"], {"s": "x"}, by=["g"], row_number="n")
    assert "__bucket" not in out._jdf.queryExecution().analyzed().toString()
    assert ordered.sizes(df, ["g"]) == (600, 20) and ordered.sizes(df.limit(0), ["g"]) == (0, 0)
    sums, want = {}, {}
    for i in range(600):
        s, n = sums.get(i % 30, (0, 0))
        want[i] = sums[i % 30] = (s + i % 11 - 4, n + 1)
    assert {r["id"]: (r["s"], r["n"]) for r in out.collect()} == want


@pytest.mark.parametrize("even", [True, False])
def test_cutoffs_of_a_known_number_of_rows(spark, even):
    u = keyed.uniform(1, "t", key="id")
    df = scale.cut(spark.range(20_000).select("id", (u if even else u * u * 0.5).alias("u"), (u * 0 + 0.25).alias("same")))
    rows = sorted((r["u"], r["id"]) for r in df.collect())
    ranks = [1, 40, 400, 20_000, 20_001, 0]
    want = [rows[0], rows[39], rows[399], rows[-1], None, None]
    assert ordered.rank_cutoffs(df, "u", "id", ranks, 20_000) == want
    assert ordered.rank_cutoffs_of(df, {"u": [40], "same": [7]}, "id", 20_000) == {"u": {40: rows[39]}, "same": {7: (0.25, 6)}}
    assert ordered.rank_cutoffs(df.limit(0), "u", "id", [1], 0) == [None]


def test_even_draws_need_one_pass(spark):
    df = scale.cut(spark.range(20_000).withColumn("u", keyed.uniform(1, "t", key="id")))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        reads.add(1)
        return x

    got = ordered.rank_cutoffs(df.withColumn("u", counted("u")), "u", "id", [40, 400], 20_000)
    assert all(got) and reads.value <= 21_000
