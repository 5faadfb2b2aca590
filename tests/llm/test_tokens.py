"""Token counts and packing against the libraries themselves."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers

import facsimile.llm.token_counts as token_counts_module
from facsimile.llm.packing import WordIds, pack
from facsimile.llm.token_counts import MergeTable, token_counts

ODD = ["", " ", "  a", "a  b   c ", "\n", "\n\n a\n", " \n ", "▁a▁▁", "<s> x </s><unk>", "<0x0A>", "a\u0000b", "日本語 テスト", "🙂🙂 é",
       "x" * 5000, "ab" * 3000, "\r\n\t", "don't. can't.. I'LL.", "İstanbul ΑΣ. ΑΣ", "x<|endoftext|>y. <|ENDOFTEXT|>", "a\x1cb \x85c\xa0d", "3.14, 2."]
rnd = random.Random(5)
ODD += ["".join(rnd.choice("ab \n▁'stSé.,1\x1d\xa0Σ<|>") for _ in range(rnd.randrange(60))) for _ in range(1500)]


def test_merging_counts_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = MergeTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ODD:
        assert table.count(text) == len(library.encode(text)), text[:60]


def test_long_runs_of_every_lone_character():
    """Pieces of one character that don't touch themselves part a run at every place."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = MergeTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    lone = [c for c in table.rank if len(c) == 1 and c + c not in table.touching and table.model.normalize(c) == "▁" + c]
    assert len(lone) > 3000
    for c in lone:
        assert table.count(c * 5000) == len(library.encode(c * 5000)), c
    for text in ("0" * 1_000_000, "█" * 1_000_000, "1." * 300_000, "a@" * 200_000, "的一" * 200_000, " " * 300_000, "ab" * 300_000):
        assert table.count(text) == len(library.encode(text)), text[:4]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts_module, "REMEMBERED_BYTES", 2000)
    table = MergeTable(public_tokenizers.path("piece_bpe_32k.model"))
    library = table.model
    for k in range(500):
        text = f"word{k}, and {'long' * 30}{k}"
        assert table.count(text) == len(library.encode(text))
        assert len(table.words) <= 15 and table.held <= 2300


def test_every_letter_before_a_stop_or_comma():
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    texts = ["\n".join(f"{c}{t} a{c}{t}" for c in letters[k:k + 400] for t in ("", ".", ",")) for k in range(0, len(letters), 400)]
    for k in range(0, len(texts), 64):
        some = texts[k:k + 64]
        for text, ids, want in zip(some, words.ids(some), library.encode_batch_fast(some, add_special_tokens=False)):
            assert np.frombuffer(ids, words.dtype).tolist() == want.ids, text[:9]


def test_token_counts(spark, documents, small):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(900_000, None), (900_001, ""), (None, "a b"), (7, "a b"), (7, "a b")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents(rows)).collect())
    sizes = [(i if i is not None else -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert got == sorted((i or -1, b, n, n > 4096) for i, b, n in sizes)
    assert token_counts(documents([])).count() == 0


def test_words_encode_like_the_library():
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text, ids in zip(ODD, words.ids(ODD)):
        assert np.frombuffer(ids, words.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_merging_side_by_side_encodes_like_the_library():
    """Plain words, in any case and with marks behind them, never go through the library's whole chain."""
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    library, handed = words.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **how)

    words.tokenizer = Counting()
    parts = ["th", "in", "er", "É", "ñ", "ß", "ø", "a", "x", "zz", "ing", "ſ", "ation"]
    texts = [" ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 16))).capitalize() + rnd.choice(["", ",", ".", "..", ",%%%", "-"])
                      for _ in range(60)) for _ in range(60)]
    for text, ids in zip(texts, words.ids(texts)):
        assert np.frombuffer(ids, words.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
    assert not [w for w in handed if any(c.isalpha() for c in w) and len(w) < 20]


def test_long_words_are_forgotten():
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"), remembered=50)
    library = words.tokenizer
    for k in range(40):
        text = f"A{'b' * 50}{k}. {'Long' * 30}, a{k}. B{k} {'x' * 60}. Word, {'Ü' * 50}."
        assert np.frombuffer(words.ids([text])[0], words.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, words.known)) <= 41 and len(words.known) < 80


def test_pack_round_trip(spark, documents, small):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(900_000, None), (900_001, ""), (900_002, "a b " * 9000), (900_003, "x"), (900_003, "x")]
    pieces = pack(documents(rows)).collect()
    stream: dict[int, list] = {}
    for p in pieces:
        stream.setdefault(p.sequence_id, []).append(p)
    lengths = []
    for s in sorted(stream):
        at = 0
        for p in sorted(stream[s], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        lengths.append(at)
    assert all(n == 4096 for n in lengths[:-1]) and lengths[-1] <= 4096 and sorted(stream) == list(range(len(stream)))
    by_doc: dict[int, list] = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc_id, text in rows:
        want = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        if doc_id == 900_003:
            assert [(p.start, p.length) for p in by_doc[doc_id]] == [(0, 2), (0, 2)]
            continue
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            piece = want[at:at + p.length].tobytes()
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(piece) and bytes(p.ids) == piece
            at += p.length
        assert at == len(want)
    assert pack(documents([])).count() == 0
