"""Exact dedup against an index of what is known already.

The distinct digests of the known (historical) documents are dealt to buckets, and each bucket gets a
minimal perfect hash: level by level, keys that fall alone on a bit of the level's array own that bit,
the others go on to the next level, and the slot of a key is the rank of its bit.  A slot holds the
whole digest, the number of documents and the locator of the winner (doc_id and place in the kept
table).  Documents that arrive are reduced to distinct digests and looked up: a digest is a repeat
only if the bytes in its slot are its own.  Nonmembers are groups of their own.

Texts are equal if they are identical after lower-casing A-Z.  A null text counts as empty.  Of equal
texts the row with the largest doc_id stays, a null doc_id being the smallest; of repeated rows with
that doc_id exactly one stays.  Each row gets a result, so repeated rows come out as often as they
came in.  Long texts are hashed whole in the scan, and no text is shuffled.  An empty table, or one
without historical rows, gives no members.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.hot import lookup
from facsimile.llm.store import keep

#: Digests of a bucket, about; and the fewest buckets.
PER_BUCKET = 4096
LEAST_BUCKETS = 64
#: Bits of a level's array for each key that is left.
SPREAD = 2
BYTES = 32

GROUP = "digest binary, known boolean, keep_id long, keep_place long, group_size long"
INDEX = "bucket long, sizes array<int>, bits binary, digests binary, known binary, ids binary, places binary, counts binary"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype="<u8").reshape(-1, BYTES // 8)


def level_bits(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall in a level's array: another mix of all their words on each level."""
    mixed = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for column in words.T:
        mixed = (mixed ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return (mixed % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: ``sizes`` of the levels and all their bits."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, digests: bytes) -> PerfectHash:
        words, sizes, levels = words_of(digests), [], []
        while len(words):
            size = SPREAD * len(words) + 1
            at = level_bits(words, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            words = words[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def slots(self, digests: bytes) -> np.ndarray:
        """The slot of each key; a nonmember gets any slot, or -1."""
        words = words_of(digests)
        out, left, base = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + level_bits(words[left], level, size)
            owned = self.bits[at]
            out[left[owned]] = self.rank[at[owned]]
            left, base = left[~owned], base + size
        return out


def joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def numbers(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy() for c in ("known", "keep_id", "keep_place", "group_size"))


def build(groups: pa.Table) -> pa.Table:
    """The index of one bucket: the hash, and the slots in its order."""
    digests = joined(groups.column("digest"))
    found = PerfectHash.of(digests)
    slot = found.slots(digests)
    order = np.argsort(slot)
    known, ids, places, counts = (x[order] for x in numbers(groups))
    held = np.frombuffer(digests, dtype=f"S{BYTES}")[order] if len(slot) else np.zeros(0, dtype=f"S{BYTES}")
    return pa.table({"bucket": [groups.column("bucket")[0].as_py()], "sizes": pa.array([found.sizes], pa.list_(pa.int32())),
                     "bits": [np.packbits(found.bits).tobytes()], "digests": [held.tobytes()],
                     "known": [known.astype(bool).tobytes()], "ids": [ids.astype("<i8").tobytes()],
                     "places": [places.astype("<i8").tobytes()], "counts": [counts.astype("<i8").tobytes()]})


def meet(index: pa.Table, arrived: pa.Table) -> pa.Table:
    """All groups of one bucket: slots with the members' rows added, then the nonmembers."""
    digests = joined(arrived.column("digest"))
    known, ids, places, counts = numbers(arrived)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(-1, BYTES)
    if index.num_rows:
        row = index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=sum(row["sizes"])).astype(bool)
        held = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, BYTES)
        slot_known = np.frombuffer(row["known"], dtype=bool).copy()
        slot_id, slot_place, slot_count = (np.frombuffer(row[c], dtype="<i8").copy() for c in ("ids", "places", "counts"))
        slot = PerfectHash(row["sizes"], bits).slots(digests)
        member = slot >= 0
        member[member] = (held[slot[member]] == raw[member]).all(axis=1)
    else:
        held = np.zeros((0, BYTES), dtype=np.uint8)
        slot_known, slot_id, slot_place, slot_count = (np.zeros(0, dtype=t) for t in (bool, "i8", "i8", "i8"))
        slot, member = np.full(len(raw), -1), np.zeros(len(raw), dtype=bool)
    at = slot[member]
    mine = known[member], ids[member], places[member]
    wins = (mine[0] > slot_known[at]) | ((mine[0] == slot_known[at]) & (
        (mine[1] > slot_id[at]) | ((mine[1] == slot_id[at]) & (mine[2] > slot_place[at]))))
    for target, values in zip((slot_known, slot_id, slot_place), mine):
        target[at[wins]] = values[wins]
    slot_count[at] += counts[member]
    new = ~member
    return pa.table({
        "digest": pa.array([x.tobytes() for x in held] + [x.tobytes() for x in raw[new]], pa.binary()),
        "known": np.concatenate([slot_known, known[new]]).astype(bool), "keep_id": np.concatenate([slot_id, ids[new]]),
        "keep_place": np.concatenate([slot_place, places[new]]), "group_size": np.concatenate([slot_count, counts[new]])})


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests with their winner and number of rows, reduced before the shuffle."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "place"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", F.col("best.known").alias("known"),
        F.col("best.id").alias("keep_id"), F.col("best.place").alias("keep_place"), "group_size")


def history_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The index of historical ``rows(digest, doc_id, place)``, one row per bucket, kept."""
    return keep(grouped(rows, buckets).groupBy("bucket").applyInArrow(build, INDEX), "digest-index")


def exact_duplicates(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` says which rows are known already; without it, those up to the middle doc_id.  The
    result is the same for any choice: only the work is parted otherwise."""
    if history is None:
        middle = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), 0.5)).first()[0]
        history = F.col("doc_id").cast("long") <= F.lit(middle)
    digest = F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"),
                            F.coalesce(history, F.lit(False)).alias("historical"),
                            F.monotonically_increasing_id().alias("place")), "digests")
    buckets = max(LEAST_BUCKETS, rows.count() // PER_BUCKET)
    index = history_index(rows.filter("historical"), buckets)
    arrived = grouped(rows.filter("not historical"), buckets)
    groups = index.groupBy("bucket").cogroup(arrived.groupBy("bucket")).applyInArrow(meet, GROUP)
    groups = keep(groups.filter("group_size > 1"), "digest-groups")
    single = F.col("group_size").isNull()
    return lookup(rows.select("doc_id", "digest", "place"), groups, "digest", "group_size").select(
        "doc_id", F.when(single, F.col("doc_id")).when(F.col("known"), F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("place") == F.col("keep_place"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
with n as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from n"""
