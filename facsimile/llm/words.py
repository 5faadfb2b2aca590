"""Words and digests of texts, as functions of whole columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this package (fixed values).
SPACE = " \t\n\u000b\f\r"


def word_counts(texts: pd.Series) -> pd.Series:
    """Runs of characters that are not ASCII white space, of texts given as bytes; null: 0.
    ``bytes.split`` parts at exactly these characters."""
    return pd.Series([0 if t is None else len(t.split()) for t in texts], dtype="int64")


def count_words(column: str) -> Column:
    return F.pandas_udf(word_counts, "long")(column)
