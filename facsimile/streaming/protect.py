"""Column protection on a stream: the per-row actions need no state, so they run unchanged."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from facsimile.operators import privacy


def protect_stream(stream: DataFrame, actions: Mapping[str, str], key: str, salt: str = privacy.DEFAULT_SALT,
                   seed: int = 42, noise: Mapping[str, privacy.Noise] | None = None) -> DataFrame:
    """``apply_privacy`` for a streaming frame.  Noise needs explicit bounds: a stream has no final range."""
    for col, action in actions.items():
        n = (noise or {}).get(col)
        if action == "dp_noise" and (n is None or n.low is None or n.high is None):
            raise ValueError(f"dp_noise on stream column {col!r} needs low and high")
    return privacy.apply_privacy(stream, actions, key, salt=salt, seed=seed, noise=noise)


def write_protected(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
