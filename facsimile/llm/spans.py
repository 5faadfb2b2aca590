"""Spans of texts: found as (kind, start, end) in code points, digested alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,end:int>"


def joined(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span by start, then kind in the order of ``names``, comma-joined."""
    labels = F.array(*[F.lit(n) for n in names])
    text = lambda s: F.concat_ws(":", F.get(labels, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
