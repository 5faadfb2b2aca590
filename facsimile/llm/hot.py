"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys broadcast at most, where a caller names no other bound.
HEAVY_KEYS = 2_000


def heavy_from(table: DataFrame, weight: str, at_most: int) -> int:
    """The least power of two that at most ``at_most`` rows of ``table`` reach with their ``weight``:
    one row per power comes to the driver."""
    powers = table.filter(F.col(weight) > 0).groupBy(F.floor(F.log2(F.col(weight).cast("double"))).cast("int").alias("power")) \
        .count().orderBy(F.desc("power")).collect()
    reached, least = 0, 62
    for power, rows in powers:
        if (reached := reached + rows) > at_most:
            break
        least = power
    return 1 << least


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "left", at_most: int = HEAVY_KEYS) -> DataFrame:
    """``rows`` with the columns of ``table``, which is unique on ``key`` and says in ``weight`` how many
    rows bear it (or a bound).  The heaviest keys, ``at_most`` of them by count, are broadcast; the rest
    is a shuffle join in which no key is heavy.  ``how`` is "left" or "inner"; a null key meets nothing
    and its rows stay where they are.  A row's weight is at least 1; others meet nothing.  Both tables are read twice: keep them first."""
    least = heavy_from(table, weight, at_most)
    if least == 1:
        return rows.join(F.broadcast(table.filter(F.col(weight) > 0)), key, how)
    heavy, light = table.filter(F.col(weight) >= least), table.filter(F.col(weight).between(1, least - 1))
    found = rows.join(F.broadcast(heavy), key)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    if how == "left":
        unmatched = others.filter(F.col(key).isNull()).select(
            *rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key])
        others = others.filter(F.col(key).isNotNull())
        return found.unionByName(others.join(light, key, "left")).unionByName(unmatched)
    return found.unionByName(others.join(light, key))
