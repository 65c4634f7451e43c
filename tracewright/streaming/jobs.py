"""Structured Streaming: windows, sessions, deduplication with a watermark, enrolment, incremental caches.

Every function works on a batch frame as well, which is how its results are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def counts_by_window(df: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start, kind, n, value`` of each event-time window; null times are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _late(df.where(F.col(ts).isNotNull()), ts, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), kind, "n", "value")


def sessions(df: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user, start, stop, n``: a user's events up to a gap; null users and times are left out."""
    rows = _late(df.where(F.col(ts).isNotNull() & F.col(user).isNotNull()), ts, late)
    return rows.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def dedup(df: DataFrame, *keys: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return _late(df, ts, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def enrol(df: DataFrame, author: str = "author_id", vec: str = "vec") -> DataFrame:
    """``author, n, vec``: running mean vector of each author, kept as state; one row for each author in each micro-batch."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, [])
        for f in frames:
            for v in f[vec]:
                total = [float(x) for x in v] if not total else [a + float(b) for a, b in zip(total, v)]
                n += 1
        state.update((n, total))
        yield pd.DataFrame({"author": [key[0]], "n": [n], "vec": [[x / n for x in total]]})

    kind = df.schema[author].dataType.simpleString()
    return df.groupBy(author).applyInPandasWithState(update, f"author {kind}, n long, vec array<double>", "n long, total array<double>", "update", "NoTimeout")


def compute_new(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a stream that computes and appends what the cache at ``path`` lacks; a replayed batch adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        from ..sources.sinks import cached

        cached(rows.sparkSession, rows, key, compute, path)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
