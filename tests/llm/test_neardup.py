import random
import re

import numpy as np
import pytest

from facsimile.llm import neardup
from facsimile.llm.graph import components

rnd = random.Random(4)
WORDS = [f"w{k}" for k in range(4000)]


def plain(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return words


def corpus():
    rows, i = [], 0
    base = rnd.choices(WORDS, k=200)
    texts = [" ".join(edited(base, rnd.randrange(9))) for _ in range(60)]  # near copies around the limit
    texts += [" ".join(base)] * 5
    chain = rnd.choices(WORDS, k=120)
    for _ in range(12):  # each near the one before, the ends far apart
        texts.append(" ".join(chain))
        chain = edited(chain, 3)
    passage = rnd.choices(WORDS, k=100)
    texts += [" ".join(passage + rnd.choices(WORDS, k=75)) for _ in range(50)]  # a shared passage, no links
    texts += [" ".join(rnd.choices(WORDS, k=rnd.randrange(1, 80))) for _ in range(60)]
    texts += ["", " \n", None, "one two", "One TWO", "one two three four", "a b c d e", "a b c d e", "É b c d e", "é b c d e", "a\x1cb c d e f"]
    rnd.shuffle(texts)
    for t in texts:
        rows.append((i, t))
        i += rnd.randrange(1, 3)
    return rows


@pytest.mark.parametrize("block_members", [1024, 16])
def test_against_all_pairs(documents, monkeypatch, block_members):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block_members)
    rows = corpus()
    want = plain(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_repeated_rows_and_null_ids(documents):
    text = " ".join(rnd.choices(WORDS, k=50))
    rows = [(3, text), (3, text), (1, text), (None, text), (None, "x"), (7, ""), (7, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect())
    assert got == sorted([(3, 46, 1, False), (3, 46, 1, False), (1, 46, 1, True), (-1, 46, None, True), (-1, 1, None, True), (7, 0, 7, True), (7, 0, 7, True)],
                         key=lambda r: r[:2])
    docs = documents(rows)
    left = neardup.representatives(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, -1, 1, 7]


def test_empty(documents):
    assert neardup.near_duplicates(documents([])).count() == 0
    assert neardup.near_duplicates(documents([(1, None), (2, "")])).count() == 2
    assert neardup.representatives(documents([])).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)] + [(200, k) for k in range(201, 260)]
    rnd.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90, **{k: 200 for k in range(200, 260)}}


def test_thresholds_follow_from_percent(documents):
    assert neardup.thresholds(75) == (53, 339) and neardup.thresholds(100) == (96, 512)
    with pytest.raises(ValueError):
        neardup.thresholds(5)
    # pairs that share 50 of 94 shingles, about 53 percent: all must be linked at 50 percent
    rows = []
    for k in range(60):
        a = [f"w{k}x{j}" for j in range(100)]
        rows += [(2 * k, " ".join(a[:76])), (2 * k + 1, " ".join(a[22:98]))]
    shingles = [{tuple(t.split()[j:j + 5]) for j in range(72)} for _, t in rows]
    want = {2 * k + 1 for k in range(60) if 100 * len(shingles[2 * k] & shingles[2 * k + 1]) >= 50 * len(shingles[2 * k] | shingles[2 * k + 1])}
    got = {r.doc_id for r in neardup.near_duplicates(documents(rows), percent=50).collect() if not r.kept}
    assert len(want) == 60 and got == want


def test_forests_take_every_pair_in_the_end():
    a, b = np.array([1, 1, 1, 2, 2, 3]), np.array([2, 3, 4, 3, 4, 4])
    agree = np.array([5, 4, 9, 3, 2, 1])
    group = {k: k for k in range(1, 5)}
    chosen, left = neardup.forests(a, b, agree, group, 1)
    assert sorted(chosen) == [0, 1, 2] and left
    assert sorted(neardup.forests(a, b, agree, group, 3)[0]) == list(range(6)) and not neardup.forests(a, b, agree, group, 3)[1]


def test_near_misses_are_not_handed_on_as_pairs(documents, monkeypatch):
    """All pairs of a group are just below the limit: what is kept between passes grows with the members."""
    passage = rnd.choices(WORDS, k=200)
    rows = [(k, " ".join(passage + rnd.choices(WORDS, k=40))) for k in range(80)]  # 196 of 276 shingles are shared
    kept = []

    def counting(df, name, keep=neardup.keep):
        out = keep(df, name)
        if name in ("chosen", "remaining", "confirmed"):
            kept.append(out.count())
        return out

    monkeypatch.setattr(neardup, "keep", counting)
    assert all(r.component_id == r.doc_id for r in neardup.near_duplicates(documents(rows)).collect())
    assert sum(kept) <= 5 * len(rows)
