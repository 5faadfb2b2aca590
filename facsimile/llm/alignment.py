"""Alignment of two tokenizers' tokens by merging in lockstep.

Both tokenizers cut the same bytes, so their tokens are two rising lists of end offsets.  A merge
walks both with a pointer each: the token that ends first lets its pointer go on, and where both end
on one byte the text is cut into groups.  The merges of all documents of a batch go in lockstep: the
pointers are vectors, one step moves every one of them, and documents that are done leave the
vectors.  A long text takes several lanes, each of which starts at the first tokens that end after
its own byte offset; the cut before a lane's first one was found by the lane ahead of it.

A token of A and one of B are linked if their byte ranges share a group.  A group's links are counted
per pair of identifiers, so a long group of few identifiers stays small.  How many documents hold a
pair is counted over the whole corpus; the most common pairs go to every task, the rest is joined.

Texts that are null or empty, or whose joined tokens are not the text's own bytes, have no tokens:
zeros and an empty ``groups_sha256``.  Every row is a document, repeated rows and null ids too.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.hot import lookup
from facsimile.llm.store import keep, typed

MARK = "▁"
#: White space in a row, from which on texts are left to the slower library.
BLANKS = 10_000
ENDLESS = re.compile(rf"\s{{{BLANKS}}}")
#: Bytes of text merged together, and the bytes of a lane.
BATCH_BYTES = 1 << 20
LANE_BYTES = 1 << 10
#: Links of a group that are laid out one by one; beyond, they are counted by identifier first.
LAID_OUT = 64
#: Pairs sent to every task, at most; they are the ones that most documents hold.
COMMON_PAIRS = 500_000

SCHEMA = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<long>")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others by the characters from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def padded(names: list[bytes]) -> np.ndarray:
    width = max(map(len, names))
    return np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), dtype=np.uint8).reshape(len(names), width)


class Pieces:
    """The bytes of a tokenizer's pieces, joined, and where each one lies."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.names = padded([str(i).encode() for i in range(len(pieces))])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.joined[at]


class Tokenizers:
    """A: byte-level pieces of a space and the text; B: pieces of the text, to which B adds the space."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = tokenizers.Tokenizer.from_file(public_tokenizers.path(first))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        letters = byte_letters()
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size(with_added_tokens=True))]
        self.a = Pieces([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        special = self.first.get_added_tokens_decoder()
        self.quick = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
            bytes(letters[c] for c in n): i for i, n in enumerate(names) if i not in special})
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b = Pieces([bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])

    def both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Identifiers of A and of B.  The byte-level vocabulary is in the order of its merges, so the
        quicker library gives A's identifiers too; its pattern overflows on endless white space."""
        coded = [self.first.encode(" " + t, add_special_tokens=False).ids if len(t) > BLANKS and ENDLESS.search(t)
                 else self.quick.encode_ordinary(" " + t) for t in texts]
        return coded, self.second.encode(texts, num_threads=1)


def lockstep_cuts(end_a: np.ndarray, end_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens (indices into A and into B) of every group, in order.

    The documents, of ``size`` bytes each, lie one after the other; ``end_a`` and ``end_b`` are the
    offsets there at which the tokens end."""
    end_a, end_b = (np.append(end, np.iinfo(np.int64).max) for end in (end_a, end_b))
    lanes = -(-size // LANE_BYTES)
    doc_end = np.cumsum(size)
    begin = spans(np.zeros(len(size), dtype=np.int64), lanes) * LANE_BYTES + np.repeat(doc_end - size, lanes)
    stop = np.minimum(begin + LANE_BYTES, np.repeat(doc_end, lanes))
    # a lane finds the cuts after its begin up to its stop
    a, b = np.searchsorted(end_a, begin, side="right"), np.searchsorted(end_b, begin, side="right")
    cuts_a: list[np.ndarray] = []
    cuts_b: list[np.ndarray] = []
    while len(a):
        at_a, at_b = end_a[a], end_b[b]
        going = np.maximum(at_a, at_b) <= stop
        if not going.all():
            a, b, stop, at_a, at_b = a[going], b[going], stop[going], at_a[going], at_b[going]
        cut = at_a == at_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
    last_a, last_b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(last_a)
    return last_a[order], last_b[order]


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def link_counts(ids_a, ids_b, from_a, from_b, n_a, n_b, doc_of_group, pair_base) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of all groups; a pair may come up several times."""
    few = n_a * n_b <= LAID_OUT
    rows_a = np.repeat(spans(from_a[few], n_a[few]), np.repeat(n_b[few], n_a[few]))
    rows_b = spans(np.repeat(from_b[few], n_a[few]), np.repeat(n_b[few], n_a[few]))
    docs = [np.repeat(doc_of_group[few], n_a[few] * n_b[few])]
    pairs = [ids_a[rows_a] * pair_base + ids_b[rows_b]]
    times = [np.ones(len(rows_a), dtype=np.int64)]
    for g in np.flatnonzero(~few):
        own_a, held_a = np.unique(ids_a[from_a[g]:from_a[g] + n_a[g]], return_counts=True)
        own_b, held_b = np.unique(ids_b[from_b[g]:from_b[g] + n_b[g]], return_counts=True)
        pairs.append((own_a[:, None] * pair_base + own_b).ravel())
        times.append((held_a[:, None] * held_b).ravel())
        docs.append(np.full(len(pairs[-1]), doc_of_group[g]))
    return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)


def written(names_a, names_b, ids_a, ids_b, from_a, from_b, n_a, n_b, last_of_doc) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all groups as bytes, each followed by a separator, and each group's end."""
    width = max(names_a.shape[1], names_b.shape[1])
    out = np.zeros((len(ids_a) + len(ids_b), width + 1), dtype=np.uint8)
    group_start = from_a - from_a[0] + from_b - from_b[0]
    at_a, at_b = spans(group_start, n_a), spans(group_start + n_a, n_b)
    out[at_a, :names_a.shape[1]] = names_a[ids_a]
    out[at_b, :names_b.shape[1]] = names_b[ids_b]
    out[:, width] = ord(",")
    out[group_start + n_a - 1, width] = ord("|")
    out[group_start + n_a + n_b - 1, width] = np.where(last_of_doc, 0, ord(";"))
    used = out != 0
    return out[used], np.cumsum(used.sum(axis=1))[group_start + n_a + n_b - 1]


def align(texts: list[str], both: Tokenizers) -> pd.DataFrame:
    """n_a, n_b, n_groups, n_links, groups_sha256 and the pairs with their links, of each text."""
    all_a, all_b = both.both(texts)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 if t else 0 for t in texts], dtype=np.int64)
    counts = [np.array([len(x) for x in ids], dtype=np.int64) for ids in (all_a, all_b)]
    ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in zip((all_a, all_b), counts))
    good = same_bytes(texts, sizes, ids_a, ids_b, counts, both)
    ids_a, ids_b = ids_a[np.repeat(good, counts[0])], ids_b[np.repeat(good, counts[1])]
    n_a, n_b, size = (np.where(good, x, 0) for x in (*counts, sizes))
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(texts), dtype=np.int64), "n_links": np.zeros(len(texts), dtype=np.int64),
           "groups_sha256": [""] * len(texts), "pairs": [[] for _ in texts], "times": [[] for _ in texts]}
    docs = np.flatnonzero(good)
    if len(docs):
        end_a, end_b = np.cumsum(both.a.size[ids_a]), np.cumsum(both.b.size[ids_b])
        last_a, last_b = lockstep_cuts(end_a, end_b, size[docs])
        from_a, from_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        in_a, in_b = last_a - from_a + 1, last_b - from_b + 1
        doc = docs[np.searchsorted(np.cumsum(size[docs]), end_a[last_a])]
        out["n_groups"] = np.bincount(doc, minlength=len(texts))
        final = np.append(doc[1:] != doc[:-1], True)
        raw, ends = written(both.a.names, both.b.names, ids_a, ids_b, from_a, from_b, in_a, in_b, final)
        begin = 0
        for d, end in zip(docs.tolist(), ends[final].tolist()):
            out["groups_sha256"][d] = hashlib.sha256(raw[begin:end]).hexdigest()
            begin = end
        at, pairs, times = link_counts(ids_a, ids_b, from_a, from_b, in_a, in_b, doc, len(both.b.size))
        space = len(both.a.size) * len(both.b.size)
        own, where = np.unique(at * space + pairs, return_inverse=True)
        links = np.bincount(where, weights=times, minlength=len(own)).astype(np.int64)
        bounds = np.searchsorted(own // space, np.arange(len(texts) + 1))
        for d in docs.tolist():
            out["pairs"][d], out["times"][d] = own[bounds[d]:bounds[d + 1]] % space, links[bounds[d]:bounds[d + 1]]
            out["n_links"][d] = out["times"][d].sum()
    return pd.DataFrame(out)


def same_bytes(texts, sizes, ids_a, ids_b, counts, both: Tokenizers) -> np.ndarray:
    """Which texts are the joined bytes of their tokens, with a space ahead, in both tokenizers."""
    raw = "".join(" " + t for t in texts if t).encode("utf-8", "surrogatepass")
    want = np.frombuffer(raw, dtype=np.uint8)
    good = sizes > 0
    begin = np.cumsum(sizes) - sizes
    for pieces, ids, n in ((both.a, ids_a, counts[0]), (both.b, ids_b, counts[1])):
        ends = np.concatenate([[0], np.cumsum(pieces.size[ids])])
        till = np.cumsum(n)
        made = ends[till] - ends[till - n]
        good &= made == sizes
        if (made == sizes).all():
            different = np.concatenate([[0], np.cumsum(pieces.bytes_of(ids) != want)])
            good &= different[begin + sizes] == different[begin]
            continue
        for d in np.flatnonzero(good):
            good[d] = bool((pieces.bytes_of(ids[till[d] - n[d]:till[d]]) == want[begin[d]:begin[d] + sizes[d]]).all())
    return good


@functools.cache
def loaded(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row per document, kept: the counts, the digest of its groups and its pairs of identifiers
    (``a * vocabulary of B + b``) with their links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = loaded(first, second)
        for rows in batches:
            texts = rows.text.tolist()
            ends = np.cumsum([len(t) for t in texts])
            k = 0
            while k < len(texts):
                upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH_BYTES, side="right")))
                found = align(texts[k:upto], both)
                found.insert(0, "doc_id", rows.doc_id.iloc[k:upto].to_numpy())
                yield found
                k = upto

    rows = typed(docs, doc_id="string", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return keep(rows.mapInPandas(run, SCHEMA).withColumn("place", F.monotonically_increasing_id()), "aligned") \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def alignments(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", common: int = COMMON_PAIRS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256."""
    rows = aligned(docs, first, second)
    base = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second)).get_piece_size()
    counts = keep(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")), "pair-counts")
    # a token of A has at most as many partners as B has pieces
    best = counts.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("held").alias("most"))
    judged = counts.withColumn("a", F.expr(f"pair div {base}")).join(F.broadcast(best), "a")
    table = keep(judged.select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "pairs")
    links = rows.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("link")) \
        .select("place", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = lookup(links, table, "pair", "held", "inner", common).groupBy("place").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
