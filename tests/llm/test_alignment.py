"""Alignment of two tokenizers against a plain merge of one document at a time."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest

from facsimile.llm.alignment import LANE_BYTES, alignments, loaded, lockstep_cuts

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def tokens(text):
    both = loaded(*NAMES)
    ids_a = both.first.encode(" " + text, add_special_tokens=False).ids
    ids_b = both.second.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if both.second.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, both.second.id_to_piece(i)) for i in ids_b)]
    bytes_a = [both.a.bytes_of(np.array([i])).tobytes() for i in ids_a]
    want = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == want == b"".join(bytes_b) else None


def expected(rows):
    docs = []
    for doc_id, text in rows:
        found = tokens(text or "")
        groups = []
        if found:
            ids_a, bytes_a, ids_b, bytes_b = found
            a = b = at_a = at_b = from_a = from_b = 0
            while a < len(ids_a) or b < len(ids_b):
                if at_a <= at_b:
                    at_a += len(bytes_a[a])
                    a += 1
                else:
                    at_b += len(bytes_b[b])
                    b += 1
                if at_a == at_b:
                    groups.append((ids_a[from_a:a], ids_b[from_b:b]))
                    from_a, from_b = a, b
        docs.append((doc_id, groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    held = Counter(pair for _, _, links in docs for pair in links)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = ["", " ", "  a", "a  b   c ", "\n\n a\n", "▁a▁▁", "<s> x </s><unk><|endoftext|>", "<0x0A>", "a\u0000b", "日本語 テスト", "🙂🙂 é", "ﬁne ﬁ", "é",
       "x" * 3000, "ab" * 3000, " " * 801, "=" * 4099, "\r\n\t", "don't. can't..", "İstanbul ΑΣ", "a\x1cb \x85c\xa0d", "１２", "🙂" * 700]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common", [500_000, 20])
def test_alignment(documents, small, common):
    rnd = random.Random(3)
    rows = [(r.doc_id, r.text) for r in small.limit(120).collect()] + list(enumerate(ODD, 10_000))
    rows += [(20_000 + k, "".join(rnd.choice("ab \n▁'stSé.,1\xa0Σ<|>=🙂") for _ in range(rnd.randrange(60)))) for k in range(300)]
    rows += [(None, "a b"), (None, None), (7, "a b"), (7, "a b")]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignments(documents(rows), common=common).collect()), key=repr)
    assert got == expected(rows)
    assert ZERO in {g[1:] for g in got}


def test_long_text(documents, small):
    """Longer than a batch and many lanes, with runs in which the tokenizers never meet."""
    text = " ".join(r.text for r in small.limit(40).collect())
    text = " ".join([text] * (1 + 1_500_000 // len(text))) + " " * 5001 + "=" * 9999
    rows = [(1, text), (2, "short")]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignments(documents(rows)).collect()), key=repr)
    assert got == expected(rows)


def test_quick_identifiers_are_the_vocabularys():
    both = loaded(*NAMES)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" {c} a{c}b {c}{c}1{c}'s{c}" for c in chars[k:k + 500]) for k in range(0, len(chars), 500)]
    texts += [" " * 9_999, "\n" * 9_999, " " * 1_000_000, "\n" * 1_000_000 + "x", " \n" * 400_000, "x" * 500_000, "=" * 500_000, "的" * 300_000, *ODD]
    for k in range(0, len(texts), 100):
        want = both.first.encode_batch_fast([" " + t for t in texts[k:k + 100]], add_special_tokens=False)
        assert both.both(texts[k:k + 100])[0] == [w.ids for w in want]


def test_empty_table(documents):
    assert alignments(documents([])).columns == COLUMNS
    assert alignments(documents([])).count() == 0


def test_lanes_find_all_common_ends():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        size = rnd.integers(1, 5 * LANE_BYTES, 6)
        bounds = np.cumsum(size)
        ends = [np.unique(np.append(rnd.integers(1, bounds[-1], rnd.integers(1, 4000)), bounds)) for _ in range(2)]
        a, b = lockstep_cuts(*ends, size)
        common = np.intersect1d(*ends)
        assert (ends[0][a] == common).all() and (ends[1][b] == common).all() and len(a) == len(common)
