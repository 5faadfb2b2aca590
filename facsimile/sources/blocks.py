"""Hashes of large files, block by block.

A file is read as byte ranges by many tasks: the text source cuts it at its newline bytes, whatever
they mean in it, and the lines with their newlines are its bytes again.  Pass one adds up the bytes of
each range; running sums give the offset at which a range's first line stands.  Pass two lays the lines
into blocks of fixed size: blocks that lie inside a range are hashed where they are, and those that lie
across ranges are put together from two or more pieces, none of them larger than a block.  The digests
of the blocks are the leaves of a Merkle tree.

The root of a file of one block is its plain SHA-256.  Digests and
roots depend on the bytes, the block size and the fan-out alone, never on how the ranges were cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.ordered import running
from facsimile.operators.scale import cut, shared_folder
from facsimile.sources.json_arrays import by_range, cut_into, dealt

BLOCK_BYTES = 1 << 20
FAN_OUT = 256
#: A byte-order mark at the start of a file, which the text source leaves out.
MARK = b"\xef\xbb\xbf"

DEALT = "file string, block long, at int, bytes long, digest string, piece binary"


def lines(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def offsets(totals: DataFrame) -> DataFrame:
    """Where each range's first line stands in its file: (file, range, begin, marked)."""
    placed = running(totals, ["range"], sums={"upto": "bytes"}, by=["file"])
    whole = totals.groupBy("file").agg(F.sum("bytes").alias("all"))
    marked = F.col("all") < F.col("size") - 1  # the newline that the last line may lack adds one byte, a mark left out takes three
    return placed.join(whole, "file").select(
        "file", "range", (F.col("upto") - F.col("bytes") + F.when(marked, len(MARK)).otherwise(0)).alias("begin"), marked.alias("marked"))


def laid(block_bytes: int):
    """The lines of ranges as digests of whole blocks and pieces of others."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("bytes", pa.int64()),
                        ("digest", pa.string()), ("piece", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, size, _, begin, marked), own in by_range(batches):
            held, at = bytearray(), begin
            if marked and begin == len(MARK):
                held, at = bytearray(MARK), 0

            def dealt(last: bool) -> pa.RecordBatch:
                nonlocal held, at
                out, begun = [], 0
                if last:
                    del held[max(0, size - at):]
                while begun < len(held):
                    block, inside = divmod(at + begun, block_bytes)
                    wanted = min(block_bytes - inside, size - at - begun)
                    piece = bytes(memoryview(held)[begun:begun + wanted])
                    if wanted <= 0 or (len(piece) < wanted and not last):
                        break
                    whole = inside == 0 and (len(piece) == block_bytes or at + begun + len(piece) == size)
                    digest = hashlib.sha256(piece).hexdigest() if whole else None
                    out.append((file, block, inside, len(piece), digest, None if whole else piece))
                    begun += len(piece)
                del held[:begun]
                at += begun
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

            for line in own:
                held += line
                held += b"\n"
                if len(held) >= 4 * block_bytes:
                    yield dealt(False)
            yield dealt(True)

    return deal


def block_digests(spark: SparkSession, paths: Sequence[str], block_bytes: int = BLOCK_BYTES, glob: str = "*",
                  range_bytes: int | None = None) -> DataFrame:
    """(file, size, block, bytes, sha256) of every block of the files, kept; Spark's sources don't list
    files without a byte.  ``range_bytes`` sets the bytes of a range for this call."""
    folder = f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    with cut_into(spark, range_bytes):
        dealt(lines(spark, paths, glob)).groupBy("file", "size", "range").agg(F.sum(F.octet_length("line") + 1).alias("bytes")) \
            .write.parquet(f"{folder}/ranges")
    # one narrow row per byte range, of spark.sql.files.maxPartitionBytes: under a million for 100 TB
    begins = F.broadcast(cut(offsets(spark.read.parquet(f"{folder}/ranges"))))
    with cut_into(spark, range_bytes):
        dealt(lines(spark, paths, glob)).join(begins, ["file", "range"]).select("file", "size", "range", "begin", "marked", "line") \
            .mapInArrow(laid(block_bytes), DEALT).write.parquet(f"{folder}/dealt")
    found = spark.read.parquet(f"{folder}/dealt")
    pieces = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined: Column = F.aggregate(pieces, F.lit("").cast("binary"), lambda all_, p: F.concat(all_, p["piece"]))
    across = found.filter("digest is null").groupBy("file", "block").agg(F.sum("bytes").alias("bytes"), F.sha2(joined, 256).alias("sha256"))
    digests = found.filter("digest is not null").select("file", "block", "bytes", F.col("digest").alias("sha256")).unionByName(across)
    sizes = spark.read.parquet(f"{folder}/ranges").select("file", "size").distinct()
    digests.join(sizes, "file").select("file", "size", "block", "bytes", "sha256").write.parquet(f"{folder}/digests")
    return spark.read.parquet(f"{folder}/digests")


def merkle_roots(digests: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, size, n_blocks, root): the digests of ``fan_out`` neighbours, joined as text, are hashed
    until one is left.  Each round leaves one row in ``fan_out``."""
    counts = digests.groupBy("file").agg(F.count("*").alias("n_blocks"))
    level = digests.join(counts, "file").select("file", "size", "n_blocks", F.col("n_blocks").alias("left"), "block", "sha256")
    left = counts.agg(F.max("n_blocks")).first()[0] or 0
    while left > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda c: c["sha256"])
        above = F.when(F.col("left") > 1, F.sha2(F.encode(F.array_join(children, ""), "UTF-8"), 256)).otherwise(F.get(children, F.lit(0)))
        level = level.groupBy("file", "size", "n_blocks", "left", F.floor(F.col("block") / fan_out).alias("above")) \
            .agg(above.alias("sha256")) \
            .select("file", "size", "n_blocks", F.ceil(F.col("left") / fan_out).alias("left"), F.col("above").alias("block"), "sha256")
        left = -(-left // fan_out)
    return level.select("file", "size", "n_blocks", F.col("sha256").alias("root"))
