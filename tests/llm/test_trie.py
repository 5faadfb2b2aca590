"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

import facsimile.llm.trie as trie
from facsimile.llm.trie import NODE, ends_digests, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, prior int, level int, node string, t1 string"


def expected(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, int(sha[:15], 16), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(first, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids.get(path, [])) or 1
        own_saved = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own_saved + sum(saved[k] for k in kids.get(path, []))
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", 1, 2, "n", "t") for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=repr)


ODD = [(None, 0, "user", "nobody"), (5, 0, None, "a"), (5, 1, "", "a"), (5, None, "user", None), (5, None, "user", ""), (5, 3, "user", "é🙂"),
       (5, 3, "user", "é🙂"), (-7, 0, "user", "neg"), (-7, 1, "user", "x"), (-107, 4, "u", "v"), (-100, 1, "u", "w"), (-100, 2, "u", "ww")]


def talk(c, n, say):
    return [(c, k, "user" if k % 2 == 0 else "assistant", say(k)) for k in range(n)]


def mixed(seed):
    rnd = random.Random(seed)
    rows = list(ODD)
    for c in range(100, 340):
        if c != 200:  # its hundred has no first conversation
            rows += talk(c, rnd.randrange(1, 9), lambda k: rnd.choice(["yes", "no", "maybe"][: 1 + k % 3]))
    long = [f"turn {k}" for k in range(70)]
    rows += talk(400, 70, long.__getitem__) + talk(401, 70, long.__getitem__) + talk(402, 41, long.__getitem__)
    rows += talk(403, 70, lambda k: long[k] if k < 37 else "other") + talk(404, 90, lambda k: f"own {k}")
    return rows


@pytest.mark.parametrize("widths", [(8, 32), (2, 3)])
def test_trie(spark, widths):
    rows = mixed(1)
    assert found(prefix_trie(table(spark, rows), *widths)) == expected(rows)


def test_long_conversations_go_in_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    rows = mixed(2) + talk(500, 200, lambda k: f"w{k}" * 50) + talk(501, 3, lambda k: "x" * 200_000)
    assert found(prefix_trie(table(spark, rows))) == expected(rows)


def test_positions_over_many_buckets(spark, small_buckets):
    rows = talk(600, 300, lambda k: f"w{k}") + talk(601, 5, lambda k: f"w{k}")
    assert found(prefix_trie(table(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert prefix_trie(table(spark, [])).columns == NODE
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_many_ends_of_one_node(spark):
    ids = {b"a": list(range(-500, 3000)), b"b": [7], b"c": list(range(10, 10 + trie.PIECE))}
    ends = spark.createDataFrame([(bytearray(k), i) for k, own in ids.items() for i in own], "key binary, conv_id long").repartition(7)
    got = {bytes(r.key): r.ends_sha256 for r in ends_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for k, own in ids.items()}
