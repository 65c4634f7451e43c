import pytest
from pyspark.sql import functions as F

from tracewright.operators import attacks  # noqa: F401
from tracewright.sources import readers as R
from tracewright.sources import sinks as S
from tracewright.streaming import jobs as J


def test_messages(spark, tmp_path):
    p = tmp_path / "alpha.csv"
    p.write_text('url,role,content,model,language,created_at,message_index\nhttps://x/a1,user,"hi ""there""\nyou <REDACTED>",,english,2024-01-02,0\nhttps://x/a1,assistant,yes,gpt-4,,2024-01-02,1\nhttps://x/a1,user,bye,,english,2024-01-03,2\n')
    got = R.message_documents(R.read_messages(spark, str(p))).collect()
    assert len(got) == 1 and got[0].doc_id == "sharechat-a1" and got[0].turns == ['hi "there"\nyou ', "bye"] and got[0].model_owner == "OpenAI" and got[0].author_id is None
    assert got[0].started_at.startswith("2024-01-02") and got[0].ended_at.startswith("2024-01-03")
    assert R.require(R.message_documents(R.read_messages(spark, str(p)))).columns == R.DOCUMENT.names


def test_wide_and_array(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, features array<float>")
    wide = R.array_to_wide(df, 2, "doc_id")
    assert wide.columns == ["doc_id", "f0000", "f0001"] and R.wide_to_array(wide, "doc_id").first().features == [1.0, 2.0]
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert R.with_features(docs.where("doc_id = 'a'"), df).count() == 1
    with pytest.raises(Exception, match="not one vector"):
        R.with_features(docs, df).collect()


def test_split_and_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("doc_id"))
    S.write_split(df, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert S.merge_shards(back, df).count() == 100
    with pytest.raises(ValueError):
        S.merge_shards(back.limit(9), df)
    parts = [R.shard(df, "doc_id", i, 3) for i in range(3)]
    assert sum(p.count() for p in parts) == 100
    assert R.sample_by_hash(df, "doc_id", 7).collect() == R.sample_by_hash(df.repartition(5), "doc_id", 7).collect()


def test_cache_computes_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("k", F.length("k").alias("n"))

    a = spark.createDataFrame([("x",), ("yy",), ("x",)], "k string")
    assert S.cached(spark, a, "k", compute, str(tmp_path / "c")).count() == 3
    b = spark.createDataFrame([("x",), ("zzz",)], "k string")
    assert {r.k: r.n for r in S.cached(spark, b, "k", compute, str(tmp_path / "c")).collect()} == {"x": 1, "zzz": 3}
    assert seen == [2, 1] and calls.value == 0


def test_upsert_and_export(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "k string, u int, v int")
    b = spark.createDataFrame([("y", 9), ("z", 3)], "k string, u int")
    assert {r.k: (r.u, r.v) for r in S.upsert(a, b, "k").collect()} == {"x": (1, 1), "y": (9, 2), "z": (3, None)}
    d = spark.createDataFrame([("d", ["a\nb", "c"])], "doc_id string, turns array<string>")
    got = S.turn_export(d, d.withColumn("turns", F.slice("turns", 1, 1))).orderBy("turn_no").collect()
    assert [(r.original, r.defended) for r in got] == [("a\\nb", "a\\nb"), ("c", None)]


def test_streams(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    e.repartition(2).write.parquet(str(src))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = J.sessions(stream, late="60 days").writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.user_id, r.start, r.stop, r.n)
    assert sorted(map(key, spark.table("sess").collect())) == sorted(map(key, J.sessions(e).collect()))
    v = stream.select(F.col("user_id").alias("author_id"), F.array("value").alias("vec"))
    q = J.enrol(v).writeStream.format("memory").queryName("enrolled").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("enrolled").groupBy("author").agg(F.max("n").alias("n"))
    assert {r.author: r.n for r in last.collect()} == {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}
    q = J.compute_new(stream.select(F.col("event_type").alias("k")), "k", lambda df: df.select("k", F.length("k").alias("n")), str(tmp_path / "cache"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == e.select("event_type").distinct().count()
