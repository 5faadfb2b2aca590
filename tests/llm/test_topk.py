import math
import random

import pytest

import compare
from facsimile.llm import topk

SMALL = "/root/testdata/sf0.001"
rnd = random.Random(2)


def plain(rows, k, every):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    queries = {}
    for i, v in sorted(good):
        if i % every == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [7, 1024])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(topk, "CELL_QUERIES", 3 if blocks == 7 else 2048)
    common = [0.5, 0.25, -1.0, 0.0]
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(i, common) for i in range(300, 420)] + [(500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (None, common),
             (650, [float("inf"), 0.0, 0.0, 0.0]), (700, [2.0, 1.0]), (701, []), (750, [0.0] * 4), (10, [3.0, 0.0, 0.0, 1.0]), (50, common)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as id", "1 as block", "2 as score")
    rounded = [(i, v and [None if x is None else float(f"{x!r}") for x in v]) for i, v in ((r.vec_id, r.embedding) for r in df.collect())]
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect())
    assert got == plain(rounded, 5, 50)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-2.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, -512 * 256)]


def test_large_components(spark):
    rows = [(i, [rnd.uniform(-9e4, 9e4) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == plain(rows, 5, 50)
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(huge).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -2**63)]


def test_oracle(spark):
    ok, note = compare.compare(spark, compare.connect(SMALL), "op5_top_k", SMALL)
    assert ok, note


def test_blocks_of_many_batches_in_a_task(spark):
    """One vec_id row stands so often that its task packs many Arrow batches: no vector may count twice."""
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(307, [0.01, 0.0, 0.0, 0.0])] * 500
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(tuple(r) for r in topk.top_k(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain(rows, 5, 50)
