"""Guarded writers and the artifact list of what they wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.sources import blocks

# First characters that a spreadsheet takes for a formula.
FORMULA_CHARS = ["=", "+", "-", "@", "\t", "\r"]
FORMATS = ("csv", "json", "jsonl", "parquet", "sql")


def guard_cell(c: Column) -> Column:
    return F.when(F.substring(c, 1, 1).isin(FORMULA_CHARS), F.concat(F.lit("\t"), c)).otherwise(c)


def guard_formula(df: DataFrame) -> DataFrame:
    """Prefix dangerous text cells with a tab; nulls stay null (written empty)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: guard_cell(F.col(f"`{c}`")) for c in text}) if text else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of UTF-8 part files with headers.  No byte-order mark: it has no place in part files."""
    (guard_formula(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line; nulls are left out."""
    df.write.mode(mode).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line with explicit nulls."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def sql_inserts(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row: NULL, bare numbers, quoted text."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        if not isinstance(f.dataType, T.NumericType):
            text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        cells.append(F.coalesce(text, F.lit("NULL")))
    body = F.concat(F.lit(f"INSERT INTO {table} VALUES ("), F.concat_ws(", ", *cells), F.lit(");"))
    return df.select(body.alias("statement"))


def write_sql(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    sql_inserts(df, table).write.mode(mode).text(path)


def export_all(tables: Mapping[str, DataFrame], folder: str, formats: Sequence[str] = ("csv", "json")) -> dict[str, int]:
    """Write every table in every format; row counts are observed while writing, not by extra jobs."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown format(s) {sorted(unknown)}; known: {FORMATS}")
    rows: dict[str, int] = {}
    for name, df in tables.items():
        for fmt in formats:
            seen = Observation(f"{name}_{fmt}")
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            path = f"{folder}/{name}.{fmt}"
            if fmt == "sql":
                write_sql(watched, path, name)
            else:
                {"csv": write_csv, "json": write_json, "jsonl": write_jsonl, "parquet": write_parquet}[fmt](watched, path)
            rows[name] = seen.get["rows"]
    return rows


def artifact_manifest(spark: SparkSession, paths: Sequence[str], block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(path, name, format, size_bytes, n_blocks, sha256) of every written part file.  The hash of a file
    of several blocks is the root over its blocks' digests; no file is read by one task or held in a row."""
    roots = blocks.merkle_roots(blocks.block_digests(spark, paths, block_bytes, "part-*"))
    parent = F.element_at(F.split("file", "/"), -2)
    return roots.select(F.col("file").alias("path"), parent.alias("name"), F.element_at(F.split(parent, "\\."), -1).alias("format"),
                        F.col("size").alias("size_bytes"), "n_blocks", F.concat(F.lit("sha256:"), F.col("root")).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): equal for equal row multisets, in whatever order or partitioning."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))
