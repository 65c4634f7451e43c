"""Text features: character n-grams, TF-IDF by the known side, cosines in blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import spread


def _counted(df: DataFrame, id_col: str, text_col: str, n: int, by_id: bool) -> DataFrame:
    """Counts of n-grams of texts, added up within a batch before anything is shuffled."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.where(F.length(text_col) >= n).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if by_id:
                ids, grams, tf = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    c = Counter(t[k : k + n] for k in range(len(t) - n + 1))
                    ids += [i] * len(c)
                    grams += c.keys()
                    tf += c.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(grams, pa.string()), pa.array(tf, pa.int64())], ["id", "gram", "tf"])
            else:
                c = Counter()
                for t in b.column(1).to_pylist():
                    c.update(t[k : k + n] for k in range(len(t) - n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], ["gram", "tf"])

    return rows.mapInArrow(run, f"id {kind}, gram string, tf bigint" if by_id else "gram string, tf bigint")


def char_ngrams(df: DataFrame, id_col: str, text_col: str, n: int = 4) -> DataFrame:
    """``id, gram, tf`` of every text; null texts and texts shorter than n have none. Rows of one id are added up."""
    return _counted(df, id_col, text_col, n, True).groupBy("id", "gram").agg(F.sum("tf").alias("tf"))


def gram_totals(df: DataFrame, text_col: str, n: int = 4) -> DataFrame:
    """``gram, n``: how often each n-gram occurs in all texts; the texts' ids are never carried."""
    return _counted(df.select(F.xxhash64(text_col).alias("_h"), text_col), "_h", text_col, n, False).groupBy("gram").agg(F.sum("tf").alias("n"))


def vocabulary(counts: DataFrame, most: int = 2000, ids: DataFrame | None = None) -> DataFrame:
    """``gram, df, idf``: the most frequent grams (ties by gram), smooth inverse document frequency over the ids of ``counts``.

    ``ids`` (one column, ``id``) saves counting them from the n-grams.
    """
    n = (counts if ids is None else ids).select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    g = counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    top = g.orderBy(F.desc("total"), "gram").limit(most)  # the size of the vocabulary is the feature
    return top.crossJoin(F.broadcast(n)).select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def sublinear(counts: DataFrame) -> DataFrame:
    """Counts with ``1 + ln tf`` in their place."""
    return counts.withColumn("tf", 1 + F.log("tf"))


def word_bounded(text, least: int = 3, most: int = 5):
    """n-grams of several lengths within words, each word between blanks; an array."""
    w = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    grams = lambda x, n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(w, lambda x: F.flatten(F.array(*[grams(x, n) for n in range(least, most + 1)]))))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``id, gram, w`` with weights of length one for each id."""
    t = counts.join(vocab, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    n = t.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return t.join(n, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_of_texts(df: DataFrame, id_col: str, text_col: str, n: int = 4, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """``id, gram, w`` as :func:`tfidf` gives it, and the vocabulary, for a table with one row for each id.

    Two passes over the texts: the first adds up totals and document counts in each batch, so that only counts are
    shuffled; the vocabulary (``most`` rows, the feature's size) goes to all tasks, and the second makes each text's
    weights where the text is. No row is made for a gram outside the vocabulary.
    """
    docs = spread(df.where(F.length(text_col) >= n).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id")
    kind = docs.schema["id"].dataType.simpleString()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tf, dfs = Counter(), Counter()
            for t in b.column(1).to_pylist():
                c = Counter(t[k : k + n] for k in range(len(t) - n + 1))
                tf.update(c)
                dfs.update(c.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array(list(tf.values()), pa.int64()), pa.array([dfs[g] for g in tf], pa.int64())], ["gram", "tf", "df"])

    n_docs = docs.count()
    g = docs.mapInArrow(totals, "gram string, tf bigint, df bigint").groupBy("gram").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    vocab = g.orderBy(F.desc("total"), "gram").limit(most).select("gram", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = vocab.collect()
    given = df.sparkSession.sparkContext.broadcast({r.gram: r.idf for r in rows})

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = given.value
        for b in batches:
            ids, grams, w = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Counter(x for x in (t[k : k + n] for k in range(len(t) - n + 1)) if x in idf)
                v = [m * idf[x] for x, m in c.items()]
                norm = sum(x * x for x in v) ** 0.5
                ids += [i] * len(c)
                grams += c.keys()
                w += [x / norm for x in v]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(grams, pa.string()), pa.array(w, pa.float64())], ["id", "gram", "w"])

    known = df.sparkSession.createDataFrame([(r.gram, r.df, r.idf) for r in rows], "gram string, df bigint, idf double")
    return docs.mapInArrow(weights, f"id {kind}, gram string, w double"), known


def cosines(queries: DataFrame, docs: DataFrame, vocab: DataFrame, k: int = 5, most: int = 100_000) -> DataFrame:
    """``q, id, cosine, rank``: the k most similar documents of each query (both ``id, gram, w``), equal ones by the smaller id.

    Vectors are short lists of places in the vocabulary; a task fills a block of queries and a block of documents and
    multiplies them, so that no row is made for a gram that two texts share. Only similar documents (cosine above 0) count.
    """
    from .blocks import _cells

    place = vocab.select("gram").orderBy("gram").limit(most)
    place = place.select("gram", (F.row_number().over(Window.orderBy("gram")) - 1).alias("p"))  # a vocabulary is small, see ``vocabulary``
    dims = vocab.count()
    kind = docs.schema["id"].dataType.simpleString()

    def packed(d: DataFrame, name: str) -> DataFrame:
        g = d.join(F.broadcast(place), "gram").groupBy("id").agg(F.collect_list(F.struct(F.col("p").cast("double").alias("p"), "w")).alias("x"))
        return g.select(F.col("id").alias(name), F.concat(F.transform("x", lambda y: y["p"]), F.transform("x", lambda y: y["w"])).alias("vec"))

    def fill(vecs) -> np.ndarray:
        out = np.zeros((len(vecs), dims))
        for i, v in enumerate(vecs):
            v = np.asarray(v)
            m = len(v) // 2
            out[i, v[:m].astype(int)] = v[m:]
        return out

    def run(f: pd.DataFrame) -> pd.DataFrame:
        q, g = f[f["side"] == 0], f[f["side"] == 1]
        if not len(q) or not len(g):
            return pd.DataFrame({"q": [], "id": [], "cosine": []})
        g = g.sort_values("id", ignore_index=True)
        s = np.round(fill(q["vec"]) @ fill(g["vec"]).T, 9)
        qi, gi = q["id"].to_numpy(), g["id"].to_numpy()
        s[qi[:, None] == gi[None, :]] = -1
        pick = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"q": np.repeat(qi, pick.shape[1]), "id": gi[pick.ravel()], "cosine": np.take_along_axis(s, pick, 1).ravel()})
        return out[out["cosine"] > 0]

    cells = _cells(packed(queries, "q"), packed(docs, "g").withColumn("label", F.lit(0)), 2048)
    best = cells.groupBy("i", "j").applyInPandas(run, f"q {kind}, id {kind}, cosine double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= k)


def author_lift(pairs: DataFrame, profiles: DataFrame, null_authors: int = 40, seed: int = 0) -> DataFrame:
    """``a, b, sim, null_sim, lift``: cosine of two authors' profiles against their mean cosine to a fixed number of authors.

    ``profiles`` has ``id, gram, w``. The null authors are the first by a hash of their id.
    """
    null = profiles.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed))).limit(null_authors)
    base = profiles.join(null, "id", "left_semi").groupBy("gram").agg(F.sum("w").alias("wn"))
    n = null.agg(F.count(F.lit(1)).alias("n"))
    each = profiles.join(base, "gram").groupBy("id").agg(F.sum(F.col("w") * F.col("wn")).alias("s")).crossJoin(F.broadcast(n)).select("id", (F.col("s") / F.col("n")).alias("null"))
    x, y = profiles.toDF("a", "gram", "wa"), profiles.toDF("b", "gram", "wb")
    sim = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    out = pairs.select("a", "b").distinct().join(sim, ["a", "b"], "left").join(each.toDF("a", "na"), "a", "left").join(each.toDF("b", "nb"), "b", "left")
    s, z = F.coalesce("sim", F.lit(0.0)), (F.coalesce("na", F.lit(0.0)) + F.coalesce("nb", F.lit(0.0))) / 2
    return out.select("a", "b", F.round(s, 4).alias("sim"), F.round(z, 4).alias("null_sim"), F.round(s / F.greatest(z, F.lit(1e-9)), 2).alias("lift"))
