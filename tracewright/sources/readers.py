"""Sources: canonical splits, message tables, nested conversations, turn logs, sidecars, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T
from ..runtime import cut

#: Canonical document table; the order is part of the contract.
DOCUMENT = P.StructType(
    [P.StructField("doc_id", P.StringType(), False), P.StructField("source", P.StringType()), P.StructField("author_id", P.StringType()), P.StructField("turns", P.ArrayType(P.StringType()))]
    + [P.StructField("num_turns", P.IntegerType())]
    + [P.StructField(c, P.StringType()) for c in ("language_primary", "language_secondary", "model", "model_owner", "agent", "started_at", "ended_at")]
)
MESSAGE = P.StructType([P.StructField(c, P.StringType()) for c in ("url", "role", "content", "model", "language", "created_at")] + [P.StructField("message_index", P.IntegerType())])


def read_documents(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A split; only the columns asked for are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def require(df: DataFrame, schema: P.StructType = DOCUMENT) -> DataFrame:
    """``df`` in the order of the schema; an error names missing columns and other types."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("not the canonical schema: " + "; ".join(wrong))
    return df.select(*schema.names)


def with_features(docs: DataFrame, features: DataFrame, vec: str = "features") -> DataFrame:
    """Documents with exactly one vector each; repeated keys and documents without a vector are an error when it runs."""
    one = features.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.first(vec).alias(vec))
    out = docs.join(one, "doc_id", "left")
    bad = F.coalesce(F.col("_n") != 1, F.lit(True))
    return out.withColumn(vec, F.when(bad, F.raise_error(F.concat(F.lit("not one vector for "), "doc_id")).cast(out.schema[vec].dataType)).otherwise(F.col(vec))).drop("_n")


def wide_to_array(df: DataFrame, *keys: str, name: str = "features") -> DataFrame:
    """One float column for each dimension to one array; columns in the order of their names."""
    cols = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.array(*[F.col(c).cast("float") for c in cols]).alias(name))


def array_to_wide(df: DataFrame, dim: int, *keys: str, vec: str = "features") -> DataFrame:
    return df.select(*keys, *[F.get(vec, F.lit(i)).alias(f"f{i:04d}") for i in range(dim)])


def read_messages(spark: SparkSession, *paths: str) -> DataFrame:
    """Message exports (CSV, multi-line cells), one row for each message; platforms in one table."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, multiLine=True, escape='"', schema=MESSAGE, enforceSchema=False).withColumn("platform", F.lit(p.rsplit("/", 1)[-1].removesuffix(".csv")))
        out = df if out is None else out.unionByName(df)
    return out


def message_documents(messages: DataFrame, source: str = "sharechat") -> DataFrame:
    """Conversations of message exports: user turns in order, the model by vote over all messages, no author."""
    user = messages.where((F.col("role") == "user") & F.col("content").isNotNull())
    t = T.to_utc("created_at")
    real = messages.where(F.col("model").isNotNull() & ~F.lower("model").isin("", "none", "nan")).groupBy("url", "model").count()
    model = real.groupBy("url").agg(F.max_by("model", F.struct("count", "model")).alias("model"))
    docs = user.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("message_index", T.strip_redactions("content").alias("c")))).alias("m"), F.min(t).alias("a"), F.max(t).alias("b"), F.mode(T.normalize_language("language"), True).alias("language_primary"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    docs = docs.join(model, "url", "left")
    none = F.lit(None).cast("string")
    turns = F.transform("m", lambda x: x["c"])
    return docs.select(
        F.concat(F.lit(f"{source}-"), T.last_segment("url")).alias("doc_id"), F.lit(source).alias("source"), none.alias("author_id"), turns.alias("turns"), F.size("m").alias("num_turns"),
        "language_primary", none.alias("language_secondary"), "model", T.model_owner("model").alias("model_owner"), none.alias("agent"), iso("a").alias("started_at"), iso("b").alias("ended_at"),
    )


def nested_documents(df: DataFrame, source: str = "wildchat") -> DataFrame:
    """Conversations kept as arrays of ``role, content, timestamp`` with a ``header``: user turns, times of the assistant's turns."""
    users = F.transform(F.filter("conversation", lambda t: (t["role"] == "user") & (T.strip(t["content"]) != "")), lambda t: t["content"])
    times = F.transform(F.filter("conversation", lambda t: t["role"] == "assistant"), lambda t: t["timestamp"])
    ident = T.identity_key("hashed_ip", F.col("header")["accept-language"], F.col("header")["user-agent"])
    return df.select(F.col("conversation_id").alias("doc_id"), F.lit(source).alias("source"), T.hash_author_id(F.lit(source), ident).alias("author_id"), users.alias("turns"), F.array_min(times).alias("started_at"), F.array_max(times).alias("ended_at"), "model").where(F.size("turns") > 0)


def attach_labels(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Documents with columns of a sidecar and ``usable``: labelled, with none of the columns blank. A repeated sidecar row counts once."""
    one = labels.groupBy("doc_id").agg(F.min(F.struct("label_status", *columns)).alias("_l"))
    out = docs.join(one, "doc_id", "left").select(*[docs[c] for c in docs.columns], F.col("_l.label_status").alias("label_status"), *[F.col(f"_l.{c}").alias(c) for c in columns])
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in columns]
    usable = F.coalesce(F.col("label_status") == "labeled", F.lit(False))
    for f in filled:
        usable = usable & f
    return out.withColumn("usable", usable)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows, the same at any partitioning: the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shard(df: DataFrame, key: str, index: int, shards: int) -> DataFrame:
    """One of several disjoint parts; an author's rows stay together where the key is the author."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(shards)) == index)


def two_passes(spark, path: str, id_col: str, small: list[str], wide: list[str], choose) -> DataFrame:
    """Rows of a wide table that a choice on its small columns keeps: the first pass reads only those, the second the rest.

    ``choose`` maps the small columns to a frame with ``id_col`` and what else is to be kept of them. The text columns of
    rows that aren't chosen are read, but never leave their scan.
    """
    kept = choose(spark.read.parquet(path).select(id_col, *small))
    return spark.read.parquet(path).select(id_col, *[c for c in wide if c not in kept.columns]).join(kept, id_col)


#: Categories of image conversations, as flags of the document table.
CATEGORIES = ("captioning", "code", "creative_writing", "diagram", "entity_recognition", "homework", "humor", "is_code", "ocr")


def image_documents(spark, path: str, source: str = "vision-arena", least_docs: int = 2, merge: bool = True, window: float = 600.0) -> DataFrame:
    """Image conversations as documents: preset images dropped, split identities merged, authors with too few documents left out.

    Small columns decide in a first pass; the texts of what is kept are read in a second one. The table has ``conversation_id,
    user_id, image_name, tstamp, is_preset, conversation (array of role, content), model, language, categories (map of flags)``.
    Identities that share an image, at most three of them and within ``window`` seconds, are one; a chain of more than five
    stays apart.
    """
    from ..operators import build as B
    from ..operators.graph import components

    def choose(small: DataFrame) -> DataFrame:
        rows = cut(small.where(~F.coalesce("is_preset", F.lit(False)) & F.col("user_id").isNotNull()))
        ids = rows.select(F.col("user_id").alias("id")).distinct()
        if merge:
            pairs = B.nearest_time_pairs(rows, "image_name", "user_id", "tstamp", window)
            c = components(ids, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            n = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            c = c.join(n, "component").select(F.col("id").alias("user_id"), F.when(F.col("n") <= 5, F.col("component")).otherwise(F.col("id")).alias("identity_id"))
        else:
            c = ids.select(F.col("id").alias("user_id"), F.col("id").alias("identity_id"))
        rows = rows.join(c, "user_id")
        per = rows.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").cast("int").alias("n_upstream_ids")).where(F.col("n") >= max(1, least_docs))
        return rows.join(per.drop("n"), "identity_id").select("conversation_id", "identity_id", "n_upstream_ids", "image_name", "tstamp")

    got = two_passes(spark, path, "conversation_id", ["user_id", "image_name", "tstamp", "is_preset"], ["conversation", "model", "language", "categories"], choose)
    users = F.transform(F.filter("conversation", lambda t: (t["role"] == "user") & (T.strip(t["content"]) != "")), lambda t: t["content"])
    iso = F.date_format("tstamp", "yyyy-MM-dd'T'HH:mm:ssXXX")
    flags = [F.coalesce(F.col("categories")[c], F.lit(False)).alias(c) for c in CATEGORIES]
    out = got.select(
        F.concat(F.lit("va-"), "conversation_id").alias("doc_id"), F.lit(source).alias("source"), T.hash_author_id(F.lit(source), F.concat(F.lit("user:"), F.col("identity_id").cast("string"))).alias("author_id"), users.alias("turns"),
        F.when(F.lower("language") != "unknown", T.normalize_language("language")).alias("language_primary"), "model", T.model_owner("model").alias("model_owner"), iso.alias("started_at"), iso.alias("ended_at"), "image_name", "n_upstream_ids", *flags,
    )
    return out.where(F.size("turns") > 0).withColumn("num_turns", F.size("turns"))


def rows_at(df: DataFrame, places: DataFrame, *order: str) -> DataFrame:
    """Rows at given places (``pos``) of a total order, by a join on the place; places beyond the table give none."""
    from ..operators.timeline import positions

    return positions(df, *order).join(places.select("pos").distinct(), "pos", "left_semi")
