import hashlib
import random

import pytest

from facsimile.llm import suffix
from facsimile.llm.gsaca import suffix_array
from facsimile.llm.suffix import remove_repeats

rnd = random.Random(8)


def test_suffix_arrays():
    for turn in range(3000):
        n, letters = rnd.randrange(40), rnd.choice([1, 2, 3, 26])
        text = [rnd.randrange(1, letters + 1) for _ in range(n)]
        if turn % 3 == 0:
            text = (text[:4] * 10)[:n]
        text.append(0)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def plain(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(text))
        for s in range(len(text) - window + 1):
            w = text[s:s + window]
            if w in seen:
                gone[s:s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def noise(n):
    return "".join(rnd.choice("abcdefghij klmnopqé") for _ in range(n))


def corpus():
    passage, line, near = noise(400), noise(100), noise(900)
    texts = [noise(rnd.randrange(50, 400)) for _ in range(30)]
    texts += [noise(rnd.randrange(0, 150)) + passage[rnd.randrange(60):400 - rnd.randrange(60)] + noise(rnd.randrange(0, 150)) for _ in range(60)]
    texts += [noise(rnd.randrange(1, 9)) + line[:98 + k % 3] + rnd.choice("xyz") * 2 + noise(5) for k in range(40)]
    texts += [noise(50) + rnd.choice("..!") + line + rnd.choice("..!") + noise(50) for _ in range(50)]  # contexts that agree for a byte
    for _ in range(30):
        copy = list(near)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    texts += [near] * 6 + ["ab" * 300, "ab" * 200, "a" * 500, "a" * 99, "a" * 100, "", None, "x" + "a" * 100 + "y", line * 4]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket_strings", [4096, 6])
def test_against_all_windows(documents, bucket_strings):
    """With tiny buckets, busy cores are halved down to single windows."""
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           remove_repeats(documents(rows), bucket_strings=bucket_strings).collect()}
    assert got == plain(rows)


def test_spans_and_kept_bytes_agree(documents):
    rows = corpus()
    texts = dict(rows)
    for r in remove_repeats(documents(rows)).collect():
        raw, at, rest = (texts[r.doc_id] or "").encode(), 0, b""
        for s in r.spans:
            assert s.start < s.end
            rest += raw[at:s.start]
            at = s.end
        assert rest + raw[at:] == bytes(r.kept)


def test_repeated_rows_and_null_ids(documents):
    text = noise(300)
    rows = [(2, text), (2, text), (1, text[:200]), (None, text), (None, text)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(documents(rows)).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (2, len(text[:200].encode())), (2, len(text[:200].encode()))]


def test_empty(documents):
    assert remove_repeats(documents([])).count() == 0
    assert [tuple(r) for r in remove_repeats(documents([(1, None), (2, "")])).select("doc_id", "n_removed").collect()] in ([(1, 0), (2, 0)], [(2, 0), (1, 0)])


def test_windows_of_more_than_287_bytes(documents):
    passage = noise(1200)
    rows = [(k, noise(rnd.randrange(300)) + passage[rnd.randrange(400):1200 - rnd.randrange(400)] + noise(rnd.randrange(300))) for k in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(rows), window=300).collect()}
    assert got == plain(rows, 300)


def test_a_text_meets_its_runs_once(documents, monkeypatch):
    """A text of many repeated runs is not handed to the workers once for each run."""
    seen = []

    def counting(docs, wanted, window, plain=suffix.part_strings):
        out = plain(docs, wanted, window)
        seen.append((wanted.count(), wanted.select("doc_id").distinct().count(), out._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(suffix, "part_strings", counting)
    passage = noise(3000)
    rows = [(k, passage[:1000 + 300 * k] + noise(200) + passage[1000 + 300 * k:]) for k in range(5)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(rows)).collect()}
    assert got == plain(rows)
    runs, texts, handed = seen[0]
    assert runs > texts and "collect_list" in handed
