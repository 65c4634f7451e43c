"""Sinks: splits, turn exports, upserts, caches. Every write is one committed Spark job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Parquet with small row groups for pruning; the commit is atomic."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", 16 << 20).parquet(path)


def merge_shards(shards: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """The shards' rows if their keys are exactly the expected ones; else an error with the counts."""
    missing = expected.select(key).exceptAll(shards.select(key)).count()
    extra = shards.select(key).exceptAll(expected.select(key)).count()
    if missing or extra:
        raise ValueError(f"{missing} rows are missing and {extra} are extra")
    return shards


def turn_export(original: DataFrame, defended: DataFrame) -> DataFrame:
    """``doc_id, turn_no, original, defended``: one row for each turn, line breaks escaped."""
    a = original.select("doc_id", F.posexplode("turns").alias("turn_no", "original"))
    b = defended.select("doc_id", F.posexplode("turns").alias("turn_no", "defended"))
    esc = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return a.join(b, ["doc_id", "turn_no"], "full").select("doc_id", "turn_no", esc(F.col("original")).alias("original"), esc(F.col("defended")).alias("defended"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a column's new value counts where it isn't null."""
    cols = list(dict.fromkeys([*existing.columns, *new.columns]))
    e, n = existing.alias("e"), new.alias("n")
    j = e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c: F.coalesce(*[F.col(f"{t}.{c}") for t, d in (("n", new), ("e", existing)) if c in d.columns]).alias(c)
    return j.select(*[pick(c) for c in cols])


def cached(spark: SparkSession, items: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``items`` with computed columns; only keys that the cache at ``path`` lacks are computed and appended."""
    try:
        have = spark.read.parquet(path)
    except Exception:  # no cache yet
        have = None
    todo = items.dropDuplicates([key]) if have is None else items.dropDuplicates([key]).join(have, key, "left_anti")
    compute(todo).write.mode("append").parquet(path)
    return items.join(spark.read.parquet(path).dropDuplicates([key]), key)
