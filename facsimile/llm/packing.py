"""Packing by concatenate and cut.

Pass one tokenizes every document once and keeps its identifiers together with the task that held
it and the document's offset in that task.  The tasks' token totals, summed up in order, turn these
into global offsets.  Pass two cuts the one long stream into windows of ``length`` tokens; a document
that crosses a window's end yields boundary records, one piece on each side.  All windows but the
last are full, so nothing but the last one is ever padded.  No text or identifier is shuffled.

Null and empty texts are documents of the separator alone.  Repeated rows are packed as often as
they occur; the order of documents is the order in which the kept table holds them.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.merging import PairMerger
from facsimile.llm.store import keep, typed

# Words remembered by a worker, twice at most (about 200 bytes each): a full table becomes the old one,
# from which words in use come back.
REMEMBERED = 500_000
# Longer words are not remembered.
LONGEST = 40
# Task totals summed up in one window; more tasks are summed in blocks of this many.
BLOCK = 4096
#: Texts with these, or with the start of a special token (found before case is dropped), keep their
#: case: capitals whose lower case depends on their neighbours or takes several characters.
AS_IS = ("<|", "Σ", "İ")
#: Control characters at which ``str.split`` parts, but the tokenizer doesn't.
CONTROLS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile("[^ \t\n\r]+")
#: Letters that the normalizer leaves alone once case is dropped (no marks, no compositions), and
#: ASCII marks behind them: these are two runs of the pre-tokenizer.
LETTERS = "a-zªµºß-öø-ɏ"
PLAIN = re.compile(f"[{LETTERS}]+")
MARKED = re.compile(f"([{LETTERS}]+)([!-/:-@[-`{{-~]+)")
#: The vocabulary's character for each byte; a blank stays, to part words.
SYMBOLS = "".join(chr(b) if b in (*range(32, 127), *range(161, 173), *range(174, 256)) else "\0" for b in range(256))
for k, b in enumerate([b for b in range(256) if b == 32 or SYMBOLS[b] == "\0"]):
    SYMBOLS = SYMBOLS if b == 32 else SYMBOLS[:b] + chr(256 + k) + SYMBOLS[b + 1:]


class WordIds:
    """Identifiers of texts, word by word: the tokenizer drops white space and never joins across
    it, so the identifiers of a text are those of its words, which a worker remembers.  Lower-case
    letters alone are one run that no normalizer changes: only merges are to be done (see ``merging``)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merger = PairMerger(self.tokenizer)

    def _encode(self, words: list[str], plain: bool) -> dict[str, bytes]:
        """Plain words are one run each, so that only their merges are to be done; what the merger leaves
        out, and words that are not plain, are left to the library."""
        made: dict[str, bytes] = {}
        if plain:
            symbols = codecs.charmap_decode(" ".join(words).encode(), "strict", SYMBOLS)[0].split(" ")
            made = {word: ids for word, ids in zip(words, self.merger.ids(symbols, self.dtype)) if ids is not None} if words else {}
            words = [word for word in words if word not in made]
        for word, coded in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            made[word] = np.array(coded.ids, dtype=self.dtype).tobytes()
        return made

    def _recall(self, words: set[str]) -> set[str]:
        """Takes what the old table knows of ``words`` into the new one; returns the others."""
        back = words & self.old.keys()
        self.known.update(zip(back, map(self.old.__getitem__, back)))
        return words - back if back else words

    def _learn(self, words: set[str]) -> None:
        """Remember ``words``; marks behind plain letters are a run of their own."""
        known = self.known
        new = self._recall(words)
        plain = {word for word in new if word.islower() and word.isalpha() and (word.isascii() or PLAIN.fullmatch(word))}
        marked: list[tuple[str, str, str]] = []
        rest: set[str] = set()
        stems: set[str] = set()
        for word in new - plain:
            parted = MARKED.fullmatch(word)
            if parted and (stem := parted[1]).islower():
                marked.append((word, stem, parted[2]))
                stems.add(stem)
                rest.add(parted[2])
            else:
                rest.add(word)
        stems = self._recall(stems.difference(known, plain))
        known.update(self._encode(list(plain | stems), True))
        known.update(self._encode(list(self._recall(rest.difference(known))), False))
        for word, stem, tail in marked:
            known[word] = known[stem] + known[tail]
        for word in stems.union(rest) - new:
            if len(word) > LONGEST:
                known.pop(word)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text.  Long words are forgotten again, so that the bytes of the two
        tables follow from the number of words."""
        if len(self.known) > self.remembered:
            self.old, self.known = self.known, {}
        known = self.known
        texts = [text if any(c in text for c in AS_IS) else text.lower() for text in texts]
        words = [BLANKS.findall(text) if CONTROLS.search(text) else text.split() for text in texts]
        missing = set().union(*words).difference(known)
        if missing:
            self._learn(missing)
        find = known.__getitem__
        out = [b"".join(map(find, text)) for text in words]
        for word in missing:
            if len(word) > LONGEST:
                known.pop(word)
        return out


_CODERS: dict[tuple[str, int], WordIds] = {}


def coder(path: str, remembered: int) -> WordIds:
    if (path, remembered) not in _CODERS:
        _CODERS[path, remembered] = WordIds(path, remembered)
    return _CODERS[path, remembered]


def tokenized(docs: DataFrame, vocabulary: str, separator: int, remembered: int) -> DataFrame:
    """Pass one, kept: doc_id, ids (little-endian, separator included), tokens, and the place of the
    document: part (the writing task) and before (tokens ahead of it in that task)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = coder(public_tokenizers.path(vocabulary), remembered)
        end = np.array([separator], dtype=words.dtype).tobytes()
        ahead = 0
        for rows in batches:
            for k in range(0, len(rows), 256):
                some = rows.iloc[k:k + 256]
                coded = [ids + end for ids in words.ids(some.text.tolist())]
                tokens = np.array([len(ids) for ids in coded], dtype=np.int64) // np.dtype(words.dtype).itemsize
                yield pd.DataFrame({"doc_id": some.doc_id, "ids": coded, "tokens": tokens, "part": some.part,
                                    "before": ahead + np.cumsum(tokens) - tokens})
                ahead += int(tokens.sum())

    rows = typed(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return keep(rows.mapInPandas(encode, "doc_id long, ids binary, tokens long, part int, before long"), "token-ids")


def part_offsets(coded: DataFrame) -> DataFrame:
    """Tokens ahead of each writing task: a prefix sum over one row per task, in blocks."""
    totals = coded.groupBy("part").agg(F.sum("tokens").alias("total")) \
        .withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("block_total"))
    ahead = blocks.select("block", (F.sum("block_total").over(Window.orderBy("block")) - F.col("block_total")).alias("ahead"))
    inside = F.sum("total").over(Window.partitionBy("block").orderBy("part")) - F.col("total")
    return totals.withColumn("inside", inside).join(F.broadcast(ahead), "block") \
        .select("part", (F.col("ahead") + F.col("inside")).alias("base"))


def pack(docs: DataFrame, length: int = 4096, vocabulary: str = "word_bpe_49k.json", separator: int = 2,
         remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start (identifiers of the document ahead of the
    piece), length, ids (the identifiers), ids_crc32, doc_tokens, sequence_id, offset.  ``remembered`` trades a worker's memory for time."""
    coded = tokenized(docs, vocabulary, separator, remembered)
    tasks = part_offsets(coded)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = coder(public_tokenizers.path(vocabulary), remembered).dtype
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for rows in batches:
            out = []
            for doc_id, raw, tokens, at in zip(rows.doc_id, rows.ids, rows.tokens, rows["at"]):
                ids = np.frombuffer(raw, dtype=dtype).astype("<u4")
                start = 0
                while start < tokens:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, tokens - start)
                    piece = ids[start:start + size].tobytes()
                    out.append((doc_id, start, size, piece, zlib.crc32(piece), tokens, sequence, offset))
                    start += size
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = made.doc_id.astype("Int64")
            yield made

    placed = coded.join(F.broadcast(tasks), "part") \
        .select(F.col("doc_id"), "ids", "tokens", (F.col("base") + F.col("before")).alias("at"))
    return placed.mapInPandas(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
                                   "sequence_id long, offset long")
