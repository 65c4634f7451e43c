"""Positions in a total order and slices of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in a total order.

    Rows are range-partitioned and numbered within their partition; only the partitions' sizes, one number for each, are
    summed up. No task sees more than one range. Nulls come first, as in the reference's undated-first order.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_row", F.row_number().over(within) - 1).join(before, "_part").withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums along a total order of rows: ``sums`` maps new columns to the columns they add up.

    As with :func:`positions`, a task sums one range; only the ranges' totals are added up one after the other.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(up), F.lit(0)).alias(f"_t_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()]).join(before, "_part")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_t_{n}")).alias(n) for n in sums])


def split_known(df: DataFrame, *order: str, start: float = 0.0, end: float = 0.75, test_start: float = 0.75) -> DataFrame:
    """``df`` with ``pos`` and ``side``: ``known`` in [start, end) of the rows, ``unknown`` from test_start on, else null.

    Bounds are rounded half to even.
    """
    placed = positions(df, *order)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    b = lambda x: F.bround(F.lit(x) * F.col("_n"))
    side = F.when((F.col("pos") >= b(start)) & (F.col("pos") < b(end)), "known").when(F.col("pos") >= b(test_start), "unknown")
    return placed.crossJoin(F.broadcast(n)).withColumn("side", side).drop("_n")  # one row


def unseen_share(df: DataFrame, author: str, *order: str, known: float = 0.75, window: float = 0.25) -> DataFrame:
    """``docs, unseen, share``: later known documents whose author hasn't been seen before the cut."""
    placed = positions(df, *order)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    first = placed.groupBy(author).agg(F.min("pos").alias("_first"))
    cut_at = F.bround(F.lit(known * (1 - window)) * F.col("_n"))
    end = F.bround(F.lit(known) * F.col("_n"))
    late = placed.join(first, author).crossJoin(F.broadcast(n)).where((F.col("pos") >= cut_at) & (F.col("pos") < end))
    unseen = F.sum((F.col("_first") >= cut_at).cast("bigint"))
    return late.agg(F.count(F.lit(1)).alias("docs"), unseen.alias("unseen"), (unseen / F.count(F.lit(1))).alias("share"))


def gap_weeks(df: DataFrame, ts: str) -> DataFrame:
    """``gap_weeks`` between the last known and the first unknown time of a frame with ``side``; nulls don't count."""
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.agg(((F.min(F.when(F.col("side") == "unknown", s)) - F.max(F.when(F.col("side") == "known", s))) / 604800.0).alias("gap_weeks"))
