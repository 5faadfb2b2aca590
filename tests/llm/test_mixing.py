from collections import defaultdict

import pytest

from facsimile.llm import store
from facsimile.llm.mixing import documents_with_size, mix, mixed, targets

WEIGHTS = (3.0, 1.0, 2.0)


def fill(sizes, share=1.5, most=2.0):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= most * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("kind", ["mixed", "one hot", "empty texts"])
def test_targets_and_taken(documents, kind):
    rows = [(k, "w " * (k % 37 + 1), f"s{k % 7}" if kind == "mixed" else "hot" if k % 3 else f"s{k % 5}") for k in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "a b c", None), (5, "w w", "s5"), (5, "w w", "s5")]
    if kind == "empty texts":
        rows = [(1, None, "a"), (2, "", "b"), (3, None, None)]
    got = mix(documents(rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = fill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.times)
        assert [u.time for u in r.times] == sorted(u.time for u in r.times) and all(0 <= u.time < 1 + 1e-9 for u in r.times)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)


def test_reruns_agree(documents):
    rows = [(k, "w " * (k % 11 + 1), f"s{k % 4}") for k in range(300)]
    assert rows_of(mix(documents(rows))) == rows_of(mix(documents(rows[::-1]).repartition(7)))


def test_schedule_bends_the_order(documents):
    """The second source of a mix is drawn more often at the start, the third at the end."""
    rows = [(k, "w w", f"s{k % 3}") for k in range(900)]
    times = defaultdict(list)
    for r in mix(documents(rows)).collect():
        times[r.source] += [u.time for u in r.times]
    middle = {s: sum(t < 0.5 for t in ts) / len(ts) for s, ts in times.items()}
    assert abs(middle["s0"] - 0.5) < 0.02 and abs(middle["s1"] - 0.625) < 0.02 and abs(middle["s2"] - 0.375) < 0.02


def test_mixed_rows_keep_their_columns(documents):
    docs = documents([(k, "w " * 5, f"s{k % 2}") for k in range(60)] + [(None, "x y", "s0"), (70, None, "s1")])
    out = mixed(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert max(counts.values()) <= 2 and 70 not in counts


def test_empty(documents):
    assert mix(documents([])).count() == 0 and mixed(documents([])).count() == 0


def test_many_sources_in_many_buckets(spark, documents, monkeypatch):
    rows = [(k, "w " * (k % 37 + 1), f"s{k % 130}" if k % 130 else None) for k in range(400)]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    spark.conf.set("facsimile.rowsPerBucket", "10")
    try:
        goals = targets(documents_with_size(documents(rows)), WEIGHTS, 1.5, 2.0)
        assert "Window" not in goals._jdf.queryExecution().toString()  # no window over the whole table of sources
        got = {r.source: r.target for r in goals.collect()}
        plan = mix(documents(rows))
        assert plan.count() == len(rows) and {r.source: r.target for r in plan.collect()} == got
    finally:
        spark.conf.unset("facsimile.rowsPerBucket")
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
