"""Session-level helpers for large inputs: settings, reliable lineage cuts, checked broadcasts."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a single ordered task may take before an ordered scan is split into more buckets.
ROWS_PER_BUCKET = 500_000
# Upper bound on rows that this library ever broadcasts or pulls to the driver.
BOUNDED_ROWS = 20_000


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"facsimile.{name}", str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.  Only where the
    driver does all the work itself (local runs and tests) a temporary folder may stand in."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="facsimile-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later passes read the same rows even after
    executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` dealt over all tasks where a few hold most of its rows: a small or tightly packed file is read
    by a task or two, however long each row takes.  ``keep`` cuts what was dealt, for many passes."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"))  # a row per task
    rows, most = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if rows <= setting(spark, "boundedRows", BOUNDED_ROWS) or most * min(tasks, spark.sparkContext.defaultParallelism) <= 2 * rows:
        return df
    dealt = df.repartition(tasks)
    return cut(dealt) if keep else dealt


def lookup(df: DataFrame, dim: DataFrame, on: str, how: str = "left",
           hot: Callable[[], list[tuple]] | None = None, size: int | None = None) -> DataFrame:
    """Join rows to a table that is unique on ``on``.

    A table known (``size``) or proven to hold at most ``BOUNDED_ROWS`` rows is broadcast.  Beyond
    that it is a shuffle join in which the ``hot`` keys (a function giving a bounded list of values and
    their share of the rows) are salted by their counts: a key is spread over as many tasks as its rows
    would fill, by replicating only those few rows of ``dim``.  Rows without a key meet nothing and are
    spread over all tasks.
    """
    limit = setting(df.sparkSession, "boundedRows", BOUNDED_ROWS)
    if size is None:
        size = dim.limit(limit + 1).count()
    if size <= limit:
        return df.join(F.broadcast(dim), on, how)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = [(value, salts) for value, share in (hot() if hot else []) if value is not None and (salts := salts_of(share, tasks)) > 1]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    if not salted and how == "inner":  # rows without a key go, and rows that lie by key need not move
        return df.join(dim, on, how)
    if not salted:
        left = df.withColumn("__salt", F.when(F.col(on).isNull(), F.pmod(row_hash, F.lit(tasks))).otherwise(F.lit(0)))
        return left.join(dim.withColumn("__salt", F.lit(0).cast("long")), [on, "__salt"], how).drop("__salt")
    # at most a row per thousandth of all rows
    known = F.broadcast(df.sparkSession.createDataFrame(salted, f"`{on}` {dict(dim.dtypes)[on]}, __salts long"))
    own = F.when(F.col(on).isNull(), F.lit(tasks)).otherwise(F.coalesce("__salts", F.lit(1)))
    left = df.join(known, on, "left").withColumn("__salt", F.pmod(row_hash, own)).drop("__salts")
    right = dim.join(known, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def salts_of(share: float, tasks: int) -> int:
    """Salts that cut a key with this share of all rows into pieces of half a task's rows."""
    return max(1, math.ceil(2 * share * tasks))
