"""JSON array files read by many tasks.

The text source cuts a file at its closing braces, so that a file is dealt out by byte ranges like any
other text.  What a fragment means depends on the parser's state where it begins: inside a string or
not, and how deep.  Pass one sums up every range for both cases (the state it ends in, and the change
of depth); running sums over the ranges, a row each, compose these into the state in which each range
begins.  Pass two walks the ranges again, now knowing: objects that begin and end in a range come out
at once, and what lies across ranges, two pieces a range at most, is put together afterwards.

The objects become lines of one JSON text in the shared folder, from which Spark infers the schema and
reads.  Files may be many; each holds one array of objects.  An array of anything else is an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.ordered import running
from facsimile.operators.scale import cut, shared_folder

ESCAPED = re.compile(r"\\.", re.DOTALL)
BETWEEN = re.compile(r"[\s,\[\]﻿]*")
#: Records of one Arrow batch that a range gives out, and fragments summed up at once.
ROWS = 2_000
#: Bytes of ranges, where those are small, that one task reads one after the other.
TASK_BYTES = 32 << 20
RANGE_BYTES = "spark.sql.files.maxPartitionBytes"
UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def outside(fragment: str, inside: int) -> tuple[str, int]:
    """The characters of a fragment that stand outside strings, and whether it ends inside one."""
    parts = ESCAPED.sub("", fragment).split('"')
    return "".join(parts[inside::2]), (inside + len(parts) - 1) % 2


def deeper(bare: str, inside: int) -> int:
    """The change of depth over a fragment and the brace that closes it, which counts outside strings."""
    return bare.count("{") + bare.count("[") - bare.count("]") - (1 - inside)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


@contextmanager
def cut_into(spark: SparkSession, range_bytes: int | None) -> Iterator[None]:
    """Files that jobs inside read are cut into ranges of so many bytes."""
    before = spark.conf.get(RANGE_BYTES)
    if range_bytes:
        spark.conf.set(RANGE_BYTES, str(range_bytes))
    try:
        yield
    finally:
        spark.conf.set(RANGE_BYTES, before)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows read from files, with many small ranges to a task, each of them whole: tasks, and the part
    files that they write, grow with the bytes and not with the number of ranges."""
    spark = rows.sparkSession
    size, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(RANGE_BYTES).lower()).groups()
    ranges = rows.rdd.getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-ranges * (int(size) << UNITS[unit]) // TASK_BYTES))
    return rows.coalesce(tasks) if tasks < ranges else rows


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Each byte range of a task with its fragments; the columns before the last name the range."""

    def runs() -> Iterator[tuple[tuple, list]]:
        for batch in batches:
            *names, values = batch.columns
            new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
            for c in names if len(new) else []:
                new |= pc.not_equal(c.slice(1), c.slice(0, len(new))).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(at, at[1:]):
                if a < b:
                    yield tuple(c[a].as_py() for c in names), values.slice(a, b - a).to_pylist()

    rest = runs()
    run = next(rest, None)
    while run is not None:
        own = run[0]

        def values() -> Iterator[str]:
            nonlocal run
            while run is not None and run[0] == own:
                yield from run[1]
                run = next(rest, None)

        yield own, values()


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its quotes' parity, and the change of depth for a begin outside and inside a string."""
    for (file, start), values in by_range(batches):
        states, depths = [0, 1], [0, 0]
        while some := list(islice(values, ROWS)):
            text = "}".join(some) + "}"
            for k in (0, 1):
                bare, states[k] = outside(text, states[k])
                depths[k] += bare.count("{") + bare.count("[") - bare.count("]") - bare.count("}")
        yield pa.RecordBatch.from_pylist([{"file": file, "range": start, "odd": states[0], "plain": depths[0], "quoted": depths[1]}])


def begins(summary: DataFrame) -> DataFrame:
    """The state in which each range begins: inside (a string) and depth."""
    known = running(summary, ["range"], sums={"quotes": "odd"}, by=["file"]) \
        .withColumn("inside", F.pmod(F.col("quotes") - F.col("odd"), F.lit(2)).cast("int")) \
        .withColumn("change", F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted")))
    return running(known, ["range"], sums={"depth_after": "change"}, by=["file"]) \
        .select("file", "range", "inside", (F.col("depth_after") - F.col("change")).alias("depth"))


OBJECTS = "file string, range long, place int, ends boolean, whole boolean, object string"


def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of every range, and the pieces of those that lie across its begin (place 0) or end (place 1)."""
    schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("place", pa.int32()), ("ends", pa.bool_()),
                        ("whole", pa.bool_()), ("object", pa.string())])
    for (file, start, inside, depth), values in by_range(batches):
        out: list[tuple] = []
        pieces: list[str] = []
        place = 0 if inside or depth > 1 else 1
        for value in values:
            if not pieces and place and not inside and depth < 2:  # between objects
                lead = BETWEEN.match(value).end()
                if value[lead:lead + 1] not in ("{", ""):
                    raise ValueError(f"{file}: an array of objects is wanted, found {value[lead:lead + 40]!r}")
                depth += value.count("[", 0, lead) - value.count("]", 0, lead)
                if depth > 1:
                    raise ValueError(f"{file}: an array of objects is wanted, found an array in an array")
                value = value[lead:]
                if not value:
                    continue
            bare, inside = outside(value, inside)
            depth += deeper(bare, inside)
            pieces.append(value)
            if not inside and depth == 1:
                out.append((file, start, place, True, place == 1, "}".join(pieces) + "}"))
                pieces, place = [], 1
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if pieces:
            out.append((file, start, place, False, False, "}".join(pieces) + "}"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def stitched(pieces: DataFrame) -> DataFrame:
    """Objects put together from the pieces that follow one another up to one that ends an object."""
    placed = pieces.withColumn("at", F.col("range") * 2 + F.col("place")).withColumn("end", F.col("ends").cast("long"))
    numbered = running(placed, ["at"], sums={"ended": "end"}, by=["file"])
    together = F.array_sort(F.collect_list(F.struct("at", "object")))
    return numbered.groupBy("file", (F.col("ended") - F.col("end")).alias("number")) \
        .agg(F.array_join(F.transform(together, lambda p: p["object"]), "").alias("object")).select("object")


def array_objects(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """One row per object of the array files at ``path``: its JSON text.  ``range_bytes`` sets the bytes
    of a range for this call."""
    folder = f"{shared_folder(spark).rstrip('/')}/json-array-{uuid.uuid4().hex}"
    with cut_into(spark, range_bytes):
        dealt(fragments(spark, path)).mapInArrow(summaries, "file string, range long, odd long, plain long, quoted long") \
            .write.parquet(f"{folder}/ranges")
    # one narrow row per byte range, of spark.sql.files.maxPartitionBytes: under a million for 100 TB
    states = F.broadcast(cut(begins(spark.read.parquet(f"{folder}/ranges"))))
    with cut_into(spark, range_bytes):
        dealt(fragments(spark, path)).join(states, ["file", "range"]).select("file", "range", "inside", "depth", "value") \
            .mapInArrow(objects, OBJECTS).write.parquet(f"{folder}/objects")
    found = spark.read.parquet(f"{folder}/objects")
    return found.filter("whole").select("object").unionByName(stitched(found.filter("not whole")))


def read_json_array(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """One row per object of the array files at ``path``, with inferred types.  ``range_bytes`` sets the
    bytes of the ranges that the files are cut into for this call."""
    lines = f"{shared_folder(spark).rstrip('/')}/json-lines-{uuid.uuid4().hex}"
    array_objects(spark, path, range_bytes).select(F.regexp_replace("object", "[\r\n]", " ").alias("value")).write.text(lines)
    return spark.read.json(lines)
