"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
Rejected documents and near copies go, secrets are blanked out, documents are repeated or left out as
the mix asks, and what is left is packed.  The pieces are kept in the shared folder with their
identifiers (``ids``); the rows returned name them and are read from there (``inputFiles``).  Null, empty and repeated rows are treated as the operators
say; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facsimile.llm.mixing import mixed
from facsimile.llm.neardup import representatives
from facsimile.llm.packing import pack
from facsimile.llm.quality import passing
from facsimile.llm.queries import ready
from facsimile.llm.secret_scan import redacted
from facsimile.llm.store import keep, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return passing(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    # executors hold what earlier stages left in memory, so the workers remember fewer words
    return keep(pack(docs, remembered=150_000), "packed-sequences").drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("MinHash near-dedup", near_dedup), ("secret scans", secrets),
    ("mixing", mixing), ("packing", packing)]

# Learned rules, hashes and a tokenizer decide on the rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage-{name.replace(' ', '-')}")
    return docs
