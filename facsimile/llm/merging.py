"""Byte-pair merging of many short words side by side.

Words of about one length make a matrix, one word a column.  In every turn each word merges its
best-ranked pair, the leftmost of equal ones, as the library does; words without a pair that merges
are done.  Rows that a merge empties are skipped by links to the rows before and after.
"""

from __future__ import annotations

import json

import numpy as np
import tokenizers

NONE = np.int32(np.iinfo(np.int32).max)
_SLOTS = 18  # bits of a slot's number: some five times as many slots as pairs
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Longest words, so that a row's number fits beside a rank; and words merged at once.
LONGEST, AT_ONCE = 48, 4096


class PairMerger:
    """Identifiers of words given as symbols of a byte-pair model whose words end in ``suffix``."""

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("not a plain byte-pair model")
        vocab, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], dtype=np.int32)
        self.first, self.last = np.full(1 << 10, -1, dtype=np.int32), np.full(1 << 10, -1, dtype=np.int32)
        for code in range(1 << 10):
            self.first[code], self.last[code] = vocab.get(chr(code), -1), vocab.get(chr(code) + suffix, -1)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.keys, self.ranks = np.full(1 << _SLOTS, -1, dtype=np.int64), np.full(1 << _SLOTS, NONE, dtype=np.int32)
        if 2 * len(keys) > len(self.keys):  # which also leaves room for a row's number beside a rank
            raise ValueError("more pairs than the table is made for")
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.ranks[slot] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLY) >> np.uint64(64 - _SLOTS)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        held = self.keys[slots]
        ranks = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.keys)
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            ranks[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return ranks

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        """``symbols`` (rows, words), from row 1 on and -1 below a word's last: what is left of them
        once all merges are done, -1 in rows that a merge emptied."""
        rows, words = symbols.shape
        # row 0 and the last row stand for what is before and after a word
        place = np.arange(rows, dtype=np.int32)[:, None]
        best = np.full(symbols.shape, NONE, dtype=np.int32)
        both = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        ranks = np.full(both.shape, NONE, dtype=np.int32)
        ranks[both] = self._rank(symbols[:-1][both], symbols[1:][both])
        best[:-1] = np.where(ranks < NONE, ranks << 6 | place[:-1], NONE)
        after, before = np.repeat(place + 1, words, axis=1), np.repeat(place - 1, words, axis=1)
        out, cols = symbols.copy(), np.arange(words)
        flat_symbols = out.reshape(-1)
        best, after, before = best.reshape(-1), after.reshape(-1), before.reshape(-1)
        while True:
            least = best.reshape(rows, -1)[:, cols].min(axis=0) if len(cols) < words else best.reshape(rows, -1).min(axis=0)
            more = least < NONE
            cols, least = cols[more], least[more]
            if not len(cols):
                return out
            at = (least & 63) * words + cols
            gone = after[at] * words + cols
            follow, lead = after[gone], before[at]
            to, back = follow * words + cols, lead * words + cols
            symbol = self.made[least >> 6]
            flat_symbols[at], flat_symbols[gone] = symbol, -1
            after[at], before[to], best[gone] = follow, least & 63, NONE
            for left, here, other in ((flat_symbols[back], back, symbol), (symbol, at, flat_symbols[to])):
                rank = self._rank(left, other)
                best[here] = np.where((left >= 0) & (other >= 0) & (rank < NONE), rank << 6 | (here // words).astype(np.int32), NONE)

    def ids(self, words: list[str], dtype: type) -> list[bytes | None]:
        """The identifiers of each word; None if it is too long or has a symbol that the model lacks."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[bytes | None] = [None] * len(words)
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= LONGEST)]
        for k in range(0, len(order), AT_ONCE):
            some = order[k:k + AT_ONCE].tolist()
            sizes = lengths[some]
            codes = np.frombuffer("".join([words[j] for j in some]).encode("utf-32-le"), dtype=np.uint32)
            low = np.minimum(codes, len(self.first) - 1)
            ends = np.cumsum(sizes)
            symbols = self.first[low]
            symbols[ends - 1] = self.last[low[ends - 1]]
            symbols[codes >= len(self.first)] = -1
            known = np.minimum.reduceat(symbols, ends - sizes) >= 0
            matrix = np.full((int(sizes.max()) + 2, len(some)), -1, dtype=np.int32)
            matrix[np.arange(len(codes)) - np.repeat(ends - sizes, sizes) + 1, np.repeat(np.arange(len(some)), sizes)] = symbols
            merged = self._merged(matrix).T
            left = merged >= 0
            raw, stops = merged[left].astype(dtype).tobytes(), (np.cumsum(left.sum(axis=1)) * np.dtype(dtype).itemsize).tolist()
            for j, start, stop, fine in zip(some, [0, *stops], stops, known.tolist()):
                if fine:
                    out[j] = raw[start:stop]
        return out
