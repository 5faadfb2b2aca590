"""Exact dedup against plain grouping, for any choice of the historical rows."""

import hashlib
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm.exact import BYTES, PerfectHash, exact_duplicates
from facsimile.llm.hot import heavy_from, lookup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [(1, "Same TEXT"), (2, "same text"), (3, "SAME text "), (4, None), (5, ""), (None, "same text"), (None, "alone"), (7, "ÄÖ"), (8, "äö"),
        (9, "x" * 300_000), (10, "X" * 300_000), (11, "twice"), (11, "twice"), (11, "TWICE"), (None, "nobody"), (None, "nobody"), (-3, "Neg"), (-9, "neg"),
        (2**62 + 1, "big"), (2**62, "BIG")] + [(100 + i, "copy") for i in range(50)]


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(hashlib.sha256((text or "").translate(FOLD).encode()).hexdigest(), []).append(i)
    out = []
    for sha, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), sha) for i in ids]
    return groups, sorted(out, key=repr)


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id % 3 = 0", "doc_id > 10"])
def test_equal_texts(documents, history):
    groups, want = expected(ROWS)
    got = exact_duplicates(documents(ROWS), history and F.expr(history)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(groups)  # exactly one row of each group
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(documents):
    assert exact_duplicates(documents([])).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_perfect_hash_is_minimal_and_slots_tell_members(n):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    found = PerfectHash.of(b"".join(keys))
    slots = found.slots(b"".join(keys))
    assert sorted(slots) == list(range(n))
    others = [hashlib.sha256(f"other {i}".encode()).digest() for i in range(500)]
    at = found.slots(b"".join(others))
    assert at.max(initial=-1) < max(n, 1)
    held = np.empty(n, dtype=f"S{BYTES}")
    held[slots] = np.array(keys, dtype=f"S{BYTES}") if n else []
    assert not any(s >= 0 and bytes(held[s]) == k for s, k in zip(at, others))


def test_heavy_keys_and_lookup(spark):
    table = spark.createDataFrame([(k, 1 << k) for k in range(12)] + [(None, 1)], "key int, weight long")
    assert [heavy_from(table, "weight", n) for n in (0, 1, 5, 100)] == [1 << 62, 1 << 11, 1 << 7, 1]
    rows = spark.createDataFrame([(k % 20 if k % 7 else None, k) for k in range(400)], "key int, v int")
    for most in (0, 3, 100):
        got = lookup(rows, table, "key", "weight", at_most=most)
        want = [(v, 1 << k if k is not None and k < 12 else None) for k, v in rows.collect()]
        assert sorted(((r.v, r.weight) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert lookup(rows, table, "key", "weight", "inner", most).count() == sum(w is not None for _, w in want)
