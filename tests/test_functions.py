"""Money, keyed draws and normal functions."""

import math
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facsimile.functions import keyed, mathx, money
from facsimile.functions.fictional import fictional


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,digits,want", [
    ("12.34", 2, 1234), ("12.345", 2, 1234), ("12.355", 2, 1236), ("-0.005", 2, 0), ("0.015", 2, 2), ("100", 0, 100),
    ("2.5", 0, 2), ("-2.5", 0, -2), ("1.2345", 3, 1234)])
def test_to_minor_is_half_even(spark, text, digits, want):
    assert one(spark, money.to_minor(F.lit(text), digits)) == want


def test_from_minor_and_arithmetic(spark):
    assert one(spark, money.from_minor(F.lit(1234))) == Decimal("12.34")
    assert one(spark, money.add(F.lit(1), F.lit(2), F.lit(3))) == 6
    assert one(spark, money.sub(F.lit(1), F.lit(5))) == -4
    assert one(spark, money.mul(F.lit(250), F.lit(4))) == 1000


@pytest.mark.parametrize("amount,rate", [(10000, "0.18"), (1099, "0.05"), (50, "0.05"), (150, "0.05"), (-50, "0.05"), (-150, "0.05")])
def test_pct_of(spark, amount, rate):
    want = int((Decimal(amount) * Decimal(rate)).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
    assert one(spark, money.pct_of(F.lit(amount), rate)) == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-(10**15), 10**15), st.integers(1, 9))
def test_split_amount_sums(spark, total, parts):
    got = one(spark, money.split_amount(F.lit(total), parts))
    assert sum(got) == total and len(got) == parts
    assert max(got) - min(got) <= 1 and got == sorted(got, reverse=True)


def test_split_amount_refuses_no_parts():
    with pytest.raises(ValueError):
        money.split_amount("x", 0)


@pytest.mark.parametrize("minor,code,show,want", [
    (123456, "USD", False, "$1,234.56"), (-5099, "PKR", False, "-Rs.50.99"), (100, "JPY", False, "¥100"),
    (1234567, "BHD", True, "BHD1,234.567 BHD"), (5, "EUR", False, "€0.05"), (5, "ZZZ", False, "ZZZ0.05"),
    (2**53 + 1, "USD", False, "$90,071,992,547,409.93")])
def test_fmt(spark, minor, code, show, want):
    assert one(spark, money.fmt(F.lit(minor), code, show)) == want
    assert one(spark, money.fmt(F.lit(minor), F.lit(code), show)) == want


def test_reconcile(spark):
    r = one(spark, money.reconcile(F.lit(5), F.lit(7), "tax"))
    assert (r["check"], r["diff"], r["passed"]) == ("tax reconciliation", 2, False)


def test_uniform_is_a_function_of_seed_path_and_key(spark):
    df = spark.range(2000)
    cols = [keyed.uniform(1, "a", key="id"), keyed.uniform(1, "b", key="id"), keyed.uniform(2, "a", key="id")]
    a = df.select(*cols).collect()
    assert a == df.repartition(7).sort("id").select(*cols).collect()
    for i in range(3):
        vals = [r[i] for r in a]
        assert 0 <= min(vals) and max(vals) < 1 and abs(sum(vals) / 2000 - 0.5) < 0.03
    assert len({r[0] for r in a} | {r[1] for r in a} | {r[2] for r in a}) == 6000
    fast = [r[0] for r in df.select(keyed.uniform(1, "a", key="id", fast=True)).collect()]
    assert 0 <= min(fast) and max(fast) < 1 and abs(sum(fast) / 2000 - 0.5) < 0.03


def test_weighted_choice_frequencies(spark):
    w = {"a": 0.7, "b": 0.25, "c": 0.05, "never": -3}
    df = spark.range(20000).select(keyed.weighted_choice(keyed.uniform(5, "w", key="id"), w).alias("v"))
    got = {r["v"]: r["count"] / 20000 for r in df.groupBy("v").count().collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert abs(got[k] - w[k]) < 3 * math.sqrt(w[k] * (1 - w[k]) / 20000)


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        keyed.cumulative([0, -1])


@pytest.mark.parametrize("dist,kw,mean", [("negbin", dict(mean=3.2, dispersion=1.4, top=60), 3.2),
                                          ("poisson", dict(mean=3.0, top=40), 3.0), ("uniform", dict(low=1, top=5), 3.0),
                                          ("fixed", dict(mean=4), 4.0)])
def test_count_distributions(spark, dist, kw, mean):
    cuts = keyed.count_cuts(dist, **kw)
    got = spark.range(20000).agg(F.avg(keyed.draw_count(keyed.uniform(9, dist, key="id"), cuts))).first()[0]
    assert abs(got - mean) < 0.12


def test_normal_and_laplace(spark):
    df = spark.range(20000)
    z = keyed.normal(keyed.uniform(1, "z", key="id"), keyed.uniform(1, "z", key="id", lane=1), 10, 2)
    m, s = df.agg(F.avg(z), F.stddev_samp(z)).first()
    assert abs(m - 10) < 0.06 and abs(s - 2) < 0.05
    lap = keyed.laplace(keyed.uniform(1, "l", key="id"), 3.0)
    m, a = df.agg(F.avg(lap), F.avg(F.abs(lap))).first()
    assert abs(m) < 0.12 and abs(a - 3.0) < 0.1
    assert one(spark, keyed.laplace(F.lit(0.0), 1.0)) < -20


def test_norm_functions(spark):
    pts = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in pts], "p double")
    for p, z, back in df.select("p", mathx.norm_ppf(F.col("p")), mathx.norm_cdf(mathx.norm_ppf(F.col("p")))).collect():
        exact = 0.5 * math.erfc(-z / math.sqrt(2))
        assert abs(exact - p) < 1e-8 and abs(back - p) < 1e-6


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(keyed.clip(F.col("x"), 0.0, 10.0)).collect()] == [None, 0.0, 10.0]


@pytest.mark.parametrize("name,pattern", [
    ("gender", "^(Male|Female|Other)$"), ("email", "@example.com$"), ("phone", r"^\+00-000-\d{7}$"), ("ssn", r"^XXX-XX-\d{4}"),
    ("card_no", r"^XXXX-XXXX-XXXX-\d{4}"), ("homepage_url", "^https://example.com/"), ("pickup_time", r"^\d\d:\d\d [AP]M$"),
    ("full_name", "^[A-Z]"), ("street", " Street$"), ("anything", "^[A-Z]")])
def test_fictional(spark, name, pattern):
    df = spark.range(200).select(fictional(name, "id").alias("v"))
    assert df.filter(~F.col("v").rlike(pattern)).count() == 0
