"""Exact substring dedup by suffix arrays over everything that can repeat.

A byte goes if a window of ``window`` bytes that covers it also starts earlier.  Sorting all suffixes
of all texts in one place is out of reach, so candidates are gathered first, exactly:

1. Every window has an anchor (see ``anchors``); equal windows have equal anchors.  Runs of windows
   whose anchor occurs once in all texts can't repeat and go no further.
2. Runs with the same bytes form a class; all but its earliest run repeat as a whole.
3. The earliest runs of different classes under one anchor may share a part of their windows.  Each is
   cut into parts by the anchor's distance; the windows of a part share a core of most of their bytes,
   and equal windows lie in parts of equal cores.  A part is then a short string: the bytes ahead of
   the core, the core as one symbol, the bytes behind it.
4. The part strings are dealt into buckets by core.  Each bucket's strings are concatenated and
   suffix-sorted by linear grouping (see ``gsaca``); windows that are neighbours in suffix order and
   equal form one class, of which all but the earliest go.  A core with more strings than a bucket
   holds is halved, and halved again, down to single windows, whose classes need no sorting.

Each document's marked windows are merged and cut out of its text.

Null texts count as empty; texts shorter than the window lose nothing.  Rows with a null id are never
marked and mark nothing.  Rows that repeat a document are one document, and all get its result.  If
one id has several texts, windows of all of them are judged together, at their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.anchors import GRAM, stretch_hashes, window_runs
from facsimile.llm.gsaca import suffix_array
from facsimile.llm.store import BROADCAST_ROWS, checked, keep, typed

PARTS = 4
# Part strings in a bucket (about), and under one core at most, before the core is halved.
BUCKET_STRINGS = 4096
CORE, SEPARATOR, END = 300, 256, -1  # symbols from CORE on are cores; bytes stand for themselves

PART = "key long, low int, high int, core long, left binary, right binary, doc_id long, at long"


def texts(docs: DataFrame) -> DataFrame:
    return typed(docs, doc_id="long", text="binary").withColumn("text", F.coalesce("text", F.lit(b"")))


def anchor_keys(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 512):
                found = [window_runs(t, window)[0] for t in rows.text.iloc[k:k + 512]]
                yield pd.DataFrame({"key": np.concatenate(found)})

    return docs.select("text").mapInPandas(scan, "key long")


def shape_bits(window: int) -> int:
    """The low bits of a run's shape, for the anchor's distance; above it is the number of further windows.
    Both are at most window - GRAM, so a shape of 16 bits each is an int, else it is a long."""
    return 16 if window - GRAM < 1 << 15 else 32


def runs(docs: DataFrame, window: int) -> DataFrame:
    """key (anchor hash), doc_id, first (window) and shape (further windows, and the anchor's distance
    from the first), and the hash of the bytes covered."""
    bits = shape_bits(window)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 256):
                some = rows.text.iloc[k:k + 256].tolist()
                found = [window_runs(text, window) for text in some]
                keys, places, firsts, lasts = map(np.concatenate, zip(*found))
                hashes = [stretch_hashes(text, begin, end, window) for text, (_, _, begin, end) in zip(some, found)]
                yield pd.DataFrame({"key": keys, "doc_id": np.repeat(rows.doc_id.iloc[k:k + 256].to_numpy(), [len(f[0]) for f in found]),
                                    "first": firsts, "shape": ((lasts - firsts) << bits | (places - firsts)).astype("int32" if bits == 16 else "int64"),
                                    "hash": np.concatenate(hashes)})

    return docs.mapInPandas(scan, f"key long, doc_id long, first long, shape {'int' if bits == 16 else 'long'}, hash long")


def split_core(core: int, low: int, high: int, left: bytes, right: bytes, half_low: int, half_high: int) -> tuple[int, bytes, bytes] | None:
    """The part for anchor distances half_low..half_high out of one for low..high: its core takes in
    the bytes that all its windows now share.  None if the string holds no window of that range."""
    width = high - low  # bytes beside the core in a window
    a, b = high - len(right), low + len(left)  # the distances this string has windows for
    a, b = max(a, half_low), min(b, half_high)
    if a > b:
        return None
    take_left, take_right = half_low - low, high - half_high
    # distance d: the window takes d - low bytes on the left and high - d on the right
    near_left = left[len(left) - take_left:] if take_left else b""
    near_right = right[:take_right]
    assert len(near_left) == take_left and len(near_right) == take_right and width >= 0
    name = xxhash.xxh3_64_intdigest(near_left + b"|" + near_right, seed=core & ((1 << 64) - 1)) - (1 << 63)
    return name, left[len(left) - (b - low):len(left) - take_left], right[take_right:high - a]


def parts_of(text: bytes, key: int, first: int, shape: int, window: int) -> Iterator[tuple]:
    """The parts of a run: (key, low, high, core, left, right, place of the anchor)."""
    bits = shape_bits(window)
    at = first + (shape & (1 << bits) - 1)
    reach = window - GRAM
    least, most = at - (first + (shape >> bits)), at - first  # anchor distances of its windows
    for k in range(PARTS):
        low, high = k * (reach + 1) // PARTS, (k + 1) * (reach + 1) // PARTS - 1
        a, b = max(low, least), min(high, most)
        if a <= b:
            core = text[at - low:at - high + window]
            yield (key, low, high, xxhash.xxh3_64_intdigest(core) - (1 << 63), text[at - b:at - low],
                   text[at - high + window:at - a + window], at)


def part_strings(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The parts of the runs ``wanted(key, doc_id, first, shape)``.  A text meets all its runs at once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PART.split(", ")]
        for rows in batches:
            for k in range(0, len(rows), 256):
                some = rows.iloc[k:k + 256]
                out = []
                for doc_id, text, keys, firsts, shapes in zip(some.doc_id.tolist(), some.text, some.key, some["first"], some["shape"]):
                    for key, first, shape in zip(keys.tolist(), firsts.tolist(), shapes.tolist()):
                        # of several texts under one id only those that reach so far can hold the run
                        if first + (shape >> shape_bits(window)) + window <= len(text):
                            out += [(*p[:6], doc_id, p[6]) for p in parts_of(text, key, first, shape, window)]
                yield pd.DataFrame(out, columns=names)

    gathered = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "shape")).alias("runs")) \
        .select("doc_id", F.col("runs.key").alias("key"), F.col("runs.first").alias("first"), F.col("runs.shape").alias("shape"))
    if wanted.count() <= BROADCAST_ROWS:
        gathered = F.broadcast(gathered)
    return docs.join(gathered, "doc_id").select("doc_id", "text", "key", "first", "shape").mapInPandas(cut, PART)


def halved(parts: DataFrame) -> DataFrame:
    """Every part cut in two by the anchor's distance."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PART.split(", ")]
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                middle = (r.low + r.high) // 2
                for low, high in ((r.low, middle), (middle + 1, r.high)):
                    got = split_core(r.core, r.low, r.high, r.left, r.right, low, high)
                    if got:
                        out.append((r.key, low, high, *got, r.doc_id, r.at))
            yield pd.DataFrame(out, columns=names)

    return parts.mapInPandas(cut, PART)


CLASS = ["key", "low", "high", "core"]


def repeated_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of equal part strings, spans of all but the earliest; and the earliest ones of cores that have
    several strings, with their number."""
    whole = [*CLASS, "left", "right"]
    earliest = parts.groupBy(*whole).agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("copies"))
    later = parts.join(earliest.where("copies > 1"), whole) \
        .where("doc_id <> head.doc_id or at <> head.at") \
        .select("doc_id", (F.col("at") - F.col("low") - F.length("left")).alias("start"),
                (F.col("at") - F.col("high") + F.length("right")).alias("last"))
    several = earliest.groupBy(*CLASS).agg(F.count("*").alias("strings")).where("strings > 1")
    return later, earliest.join(several, CLASS).select(*whole, "head.doc_id", "head.at", "strings")


def sorted_repeats(strings: DataFrame, buckets: int) -> DataFrame:
    """Suffix-sorts the part strings bucket by bucket: doc_id and place of every repeated window."""

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*CLASS, "doc_id", "at"])
        fresh = rows[CLASS].ne(rows[CLASS].shift()).any(axis=1).cumsum()  # equal cores are neighbours
        wide = (rows.high - rows.low + 1).tolist()
        symbols: list[int] = []
        owner: list[int] = []  # the row of each symbol that may start a window, else -1
        begin: list[int] = []  # the window's place in its document, less its place among the symbols
        for k, (left, right, core, width, doc_at, low) in enumerate(zip(rows.left, rows.right, fresh.tolist(), wide, rows["at"].tolist(), rows.low.tolist())):
            begin.append(doc_at - low - len(left) - len(symbols))
            starts = min(len(left) + 1, len(left) + len(right) + 2 - width)
            owner += [k] * starts
            owner += [-1] * (len(left) + len(right) + 2 - starts)
            symbols += left
            symbols.append(CORE + core)
            symbols += right
            symbols.append(SEPARATOR)
        order = suffix_array([*symbols, END])
        owner.append(-1)
        docs, written = rows.doc_id.tolist(), "".join(map(chr, symbols))
        out: list[tuple[int, int]] = []
        group: list[tuple[int, int]] = []
        last = ""
        for s in order:
            k = owner[s]
            if k < 0:
                continue
            content = written[s:s + wide[k]]
            if content != last:
                if len(group) > 1:
                    out += sorted(group)[1:]
                group, last = [], content
            group.append((docs[k], begin[k] + s))
        out += sorted(group)[1:]
        return pd.DataFrame(out, columns=["doc_id", "start"], dtype="int64")

    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64(*CLASS), F.lit(buckets)))
    # buckets are small in bytes but take long: they must not be put together by size
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(sort, "doc_id long, start long") \
        .select("doc_id", "start", F.col("start").alias("last"))


def repeated_windows(docs: DataFrame, window: int, bucket_strings: int) -> DataFrame:
    """doc_id, start and last: stretches of window starts that also start earlier."""
    some = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= window))
    shared = keep(anchor_keys(some, window).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchors")
    found = keep(runs(some, window).join(shared, "key"), "runs")
    place = F.struct("doc_id", "first", "shape")
    classes = keep(found.groupBy("key", "hash").agg(F.min(place).alias("head"), F.count("*").alias("copies")), "run-classes")
    again = found.join(classes.where("copies > 1"), ["key", "hash"]) \
        .where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("first") != F.col("head.first"))) \
        .select("doc_id", F.col("first").alias("start"), (F.col("first") + F.shiftright("shape", shape_bits(window))).alias("last"))
    several = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_runs = classes.join(several, "key").select("key", "head.*")
    spans = keep(again, "repeats")
    parts = keep(part_strings(some, keep(open_runs, "open-runs"), window), "parts")
    while True:
        later, strings = repeated_parts(parts)
        strings = keep(strings, "part-strings")
        # a part of one window is its class: equal strings are all that can repeat
        small = strings.where((F.col("strings") <= bucket_strings) & (F.col("low") < F.col("high")))
        buckets = -(-small.count() // bucket_strings) or 1
        spans = spans.unionByName(keep(later.unionByName(sorted_repeats(small, buckets)), "repeats"))
        large = strings.where((F.col("strings") > bucket_strings) & (F.col("low") < F.col("high")))
        if large.isEmpty():
            return spans
        parts = keep(halved(large.drop("strings")), "parts")


def merged_spans(spans: DataFrame, window: int) -> DataFrame:
    """One row per document: doc_id and its removed spans (start, end), disjoint and in order."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for places in rows.places:
                got: list[list[int]] = []
                for start, end in sorted((p["start"], p["last"] + window) for p in places):
                    if got and start <= got[-1][1]:
                        got[-1][1] = max(got[-1][1], end)
                    else:
                        got.append([start, end])
                out.append([{"start": s, "end": e} for s, e in got])
            yield pd.DataFrame({"doc_id": rows.doc_id, "spans": out})

    # stretches that touch are joined before they are gathered, a document's runs being neighbours
    order = Window.partitionBy("doc_id").orderBy("start", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + window), 1).otherwise(0)
    joined = spans.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("last").alias("last"))
    gathered = joined.groupBy("doc_id").agg(F.collect_list(F.struct("start", "last")).alias("places"))
    return gathered.mapInPandas(merge, "doc_id long, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, window: int = 100, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, spans (removed
    byte ranges), kept (the remaining bytes) and kept_sha256."""
    rows = texts(docs)
    spans = keep(merged_spans(repeated_windows(rows, window, bucket_strings), window), "removed")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, spans in zip(rows.text, rows.spans):
                inside = [(s["start"], min(s["end"], len(text))) for s in (spans if spans is not None else []) if s["start"] < len(text)]
                kept, at = [], 0
                for s, e in inside:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), len(inside), [{"start": s, "end": e} for s, e in inside], rest,
                            hashlib.sha256(rest).hexdigest()))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])
            made.insert(0, "doc_id", rows.doc_id.astype("Int64").to_numpy())
            yield made

    return rows.join(checked(spans), "doc_id", "left").mapInPandas(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
