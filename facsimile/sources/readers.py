"""Readers: CSV and JSON into typed DataFrames, the way spreadsheet-minded users expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.sources import json_arrays

# Texts that mean "no value".
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INTEGER = r"^[+-]?\d{1,18}$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the narrowest of bigint, double, boolean and string; one pass."""
    names = df.columns
    aggs = []
    for i, n in enumerate(names):
        c = F.trim(F.col(f"`{n}`"))
        aggs += [F.count(F.col(f"`{n}`")).alias(f"n{i}"), F.count_if(c.rlike(INTEGER)).alias(f"i{i}"),
                 F.count_if(c.rlike(FLOAT)).alias(f"f{i}"), F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false"))
                 .alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, n in enumerate(names):
        c, total = F.col(f"`{n}`"), row[f"n{i}"]
        if total and row[f"i{i}"] == total:
            c = F.trim(c).cast("bigint")
        elif total and row[f"f{i}"] == total:
            c = F.trim(c).cast("double")
        elif total and row[f"b{i}"] == total:
            c = F.trim(c).cast("boolean")
        out.append(c.alias(n))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", infer: bool = True,
             multiline: bool = False) -> DataFrame:
    """Header row, NA texts as nulls, inferred types.

    ``multiline`` allows line breaks inside quoted cells at the price of one task per file.
    """
    raw = (spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
           .option("multiLine", multiline).csv(path))
    if encoding.upper().startswith("UTF") and raw.columns and raw.columns[0].startswith("﻿"):
        raw = raw.withColumnRenamed(raw.columns[0], raw.columns[0].lstrip("﻿"))
    clean = raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_types(clean) if infer else clean


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns, at any depth."""
    out, nested = [], False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            nested = True
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    flat = df.select(*out)
    return flatten(flat) if nested else flat


def read_json(spark: SparkSession, path: str, flat: bool | None = None, lines: bool = False) -> DataFrame:
    """An array of objects gives one row each, read by many tasks; a single object gives one flattened row.

    ``lines``: one object per line, of which a large file is read by many tasks."""
    if lines:
        df = spark.read.json(path)
        return flatten(df) if flat else df
    text = F.ltrim(F.regexp_replace(F.col("value"), "^\ufeff", ""))
    head = spark.read.text(path).select(F.left(F.regexp_replace(text, r"^\s+", ""), F.lit(1)).alias("c")).filter("c <> ''").first()
    single = head is not None and head["c"] == "{"
    df = spark.read.option("multiLine", True).json(path) if single else json_arrays.read_json_array(spark, path)
    return flatten(df) if flat or (flat is None and single) else df
