"""Queries that run as streams over ``events`` until what is there is read; results are written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_folder
from ..streaming import jobs as J
from .registry import query


def _stream(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events*.parquet")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The whole result of a stream: micro-batches until the input is read; each writes its own part, a complete result replaces the last."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


@query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM g GROUP BY user_id, s"""
)
def stream_sessions(spark, d):
    return drained(J.sessions(_stream(spark, d), late="3650 days"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    return drained(J.counts_by_window(_stream(spark, d), late="3650 days"), "complete").withColumn("value", F.round("value", 4))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return drained(J.dedup(_stream(spark, d).select("user_id", "event_type", "ts"), "user_id", "event_type", late="3650 days")).select("user_id", "event_type")


@query("SELECT user_id AS author, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_enrolment(spark, d):
    v = _stream(spark, d).where("user_id is not null").select(F.col("user_id").alias("author_id"), F.array("value").alias("vec"))
    got = drained(J.enrol(v), "update")
    last = got.groupBy("author").agg(F.max(F.struct("n", "vec")).alias("x"))  # of an author's updates the last one counts
    return last.select("author", "x.n", F.round(F.get("x.vec", F.lit(0)), 6).alias("mean"))


@query("SELECT DISTINCT event_type AS k, length(event_type) AS n FROM events WHERE event_type IS NOT NULL")
def stream_cache(spark, d):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    k = _stream(spark, d).where("event_type is not null").select(F.col("event_type").alias("k"))
    J.compute_new(k, "k", lambda df: df.select("k", F.length("k").alias("n")), f"{folder}/cache", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/cache")
