"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the white-space marks, which no piece holds in its inside, and between characters
that stand side by side in no piece, so that every part can be merged alone.  In such a part the symbols form a linked list and a
heap holds the adjacent pairs that are pieces; the best-ranked leftmost pair is merged until none is
left.  The count is the number of initial symbols (a character outside the vocabulary stands for its
UTF-8 bytes) minus the number of merges.  No identifiers are made.

Null and empty texts have 0 tokens.  Rows are counted one by one: repeated rows stay, null ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from sys import getsizeof

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.store import typed

MARK = "▁"
# Words of at most so many characters are remembered by a worker, in so many bytes; a full table is emptied.
LONGEST = 40
REMEMBERED_BYTES = 1 << 27
ENTRY_BYTES = 110


class MergeTable:
    """Ranks of a byte-pair model's pieces, and the merging that uses them."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(self.model.get_piece_size())
                 if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.rank = {self.model.id_to_piece(i): -self.model.get_score(i) for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece spans white space: segments can't be merged alone")
        # two characters that stand side by side in no piece can be parted without changing a count
        self.touching = {piece[i:i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.words: dict[str, int] = {}
        self.held = 0

    def merged(self, text: str) -> int:
        """Tokens of one segment: its symbols minus its merges."""
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        if n == 1:
            return 1 if text in rank else len(text.encode("utf-8", "surrogatepass"))
        count = n
        for c in symbols:
            if c not in rank:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in rank]
        heapify(heap)
        while heap:
            _, left, pair = heappop(heap)
            right = after[left]
            if not symbols[left] or right >= n or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            count -= 1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                grown = pair + symbols[follow]
                if grown in rank:
                    heappush(heap, (rank[grown], left, grown))
            lead = before[left]
            if lead >= 0:
                grown = symbols[lead] + pair
                if grown in rank:
                    heappush(heap, (rank[grown], lead, grown))
        return count

    def parts(self, text: str) -> list[str]:
        """``text`` parted wherever two neighbours touch in no piece."""
        cuts = [k for k, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in self.touching]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def _parted(self, text: str) -> int:
        return sum(map(self.merged, self.parts(text))) if text else 0

    def _remember(self, word: str, tokens: int) -> None:
        if len(word) <= LONGEST:
            if self.held > REMEMBERED_BYTES:
                self.words.clear()
                self.held = 0
            self.words[word] = tokens
            self.held += getsizeof(word) + ENTRY_BYTES

    def _word(self, rest: str) -> int:
        """Tokens of a mark followed by ``rest``; short words are remembered, and so is what is left of
        them without the parts that stand alone."""
        first, *others = self.parts(MARK + rest)
        got = self.words.get(first[1:])
        if got is None:
            got = self.merged(first)
            self._remember(first[1:], got)
        if others:
            got += sum(map(self.merged, others))
            self._remember(rest, got)
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        head, *pieces = self.model.normalize(text).split(MARK)
        known, total, marks = self.words, self._parted(head), 0
        for rest in pieces:
            if not rest:
                marks += 1
            elif marks:
                total += self._parted(MARK * (marks + 1) + rest)
                marks = 0
            else:
                total += known.get(rest) or self._word(rest)
        return total + self._parted(MARK * marks)


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit (more than
    ``limit`` tokens).  One scan, no shuffle; a text is counted whole in one task."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = merge_table(public_tokenizers.path(model))
        for texts in batches:
            yield texts.map(table.count).astype("int64")

    rows = typed(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
