"""Tables kept between the passes of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.scale import shared_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: the lineage is cut and the
    rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of at most so many narrow records are broadcast to meet texts; beyond, a shuffle join is used.
BROADCAST_ROWS = 1_500_000


def checked(side: DataFrame) -> DataFrame:
    """The narrow side of a join, marked for broadcast if its counted size allows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; other columns can therefore never clash with working ones."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
