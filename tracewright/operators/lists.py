"""Lists for judges and rerankers, excerpts and windows for embedders, and the slots models are plugged into."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import cut
from . import ranking as K


def present(short: DataFrame, seed: int = 1, shuffle: bool = True) -> DataFrame:
    """A shortlist ``q, label, slot`` with ``shown``, the place at which a judge sees each candidate: a keyed shuffle."""
    by = [F.xxhash64(F.lit(seed), "q", "label"), F.col("slot")] if shuffle else [F.col("slot")]
    return short.withColumn("shown", F.row_number().over(Window.partitionBy("q").orderBy(*by)) - 1)


def detail(shown: DataFrame, orders: DataFrame, truth: DataFrame) -> DataFrame:
    """``q, label, slot, shown, given, is_true``: one row for each document and candidate; ``given`` is the judge's place.

    ``orders`` has ``q, ranking``, places as they were shown; those it leaves out come last, nearest first.
    """
    got = shown.join(orders, "q", "left").withColumn("_at", F.array_position(F.coalesce("ranking", F.array().cast("array<int>")), F.col("shown")))
    by = Window.partitionBy("q").orderBy(F.when(F.col("_at") > 0, F.col("_at")).otherwise(1 << 30), "slot")
    return got.withColumn("given", F.row_number().over(by) - 1).join(truth, "q", "left").select("q", "label", "slot", "shown", "given", F.coalesce(F.col("label") == F.col("author"), F.lit(False)).alias("is_true"))


def rerank(scores: DataFrame, evidence: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series], k: int = 5, seed: int = 1) -> DataFrame:
    """Scores with the first k candidates of each document in the judge's order; a slot.

    ``evidence`` has ``q, label, query_text, known_text``; ``judge`` gives a higher number for a likelier pair. Who is among the
    first k doesn't change.
    """
    slot = F.pandas_udf(judge, "double")
    shown = present(K.shortlist(scores, k).select("q", "label", "slot"), seed)
    rated = shown.join(evidence, ["q", "label"], "left").withColumn("_s", F.when(F.col("known_text").isNotNull(), slot(F.coalesce("query_text", F.lit("")), F.coalesce("known_text", F.lit("")))))
    orders = rated.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("_s", F.lit(float("-inf")))).alias("s"), "slot"))), lambda x: x["slot"]).alias("ranking"))
    return K.fold(scores, K.shortlist(scores, k), orders)


def projected_evidence(base: DataFrame, dots: DataFrame, k: int = 5) -> DataFrame:
    """``q, label, slot, doc``: the first k authors by their scores, each with its own document of the greatest projected product.

    ``dots`` has ``q, label, doc, dot``, of a query set that is chosen beforehand.
    """
    short = K.shortlist(base, k).select("q", "label", "slot")
    best = short.select("q", "label").join(dots, ["q", "label"]).groupBy("q", "label").agg(F.min(F.struct((-F.round("dot", 12)).alias("d"), "doc")).alias("b"))
    return short.join(best.select("q", "label", F.col("b.doc").alias("doc")), ["q", "label"], "left")


def top_k_in_pool(pairs: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """``accuracy, n``: documents of the pool's authors with a document of their own among the k nearest of the pool's.

    ``pairs`` has ``q, author, doc, label, score``; ``members`` the authors of the pool.
    """
    m = members.select("author").distinct()
    own = pairs.join(m, "author", "left_semi").join(m.withColumnRenamed("author", "label"), "label", "left_semi")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    top = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("q").agg(F.max((F.col("label") == F.col("author")).cast("double")).alias("hit"))
    return top.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# --- texts for embedders ------------------------------------------------------------------------------------------------
def windows(docs: DataFrame, most: int = 512, id_col: str = "doc_id", turns: str = "turns") -> DataFrame:
    """``doc_id, window, text``: paragraphs gathered in order into windows of at most ``most`` words, all of them.

    A paragraph that is longer is a window of its own, cut into pieces of ``most`` words.
    """
    p = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.array_join(turns, "\n\n"), r"\n\s*\n")).alias("no", "p"))
    p = p.withColumn("w", T.words("p")).where(F.size("w") > 0)
    cuts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / most).cast("int"))
    p = p.select("doc_id", "no", F.posexplode(F.transform(cuts, lambda i: F.slice("w", i * most + 1, most))).alias("piece", "w")).withColumn("n", F.size("w"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("no", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a piece belongs to the window its middle falls into, so that a window never holds more than 2 * most words
    p = p.withColumn("window", F.floor((before + F.col("n") / 2) / most).cast("int"))
    g = p.groupBy("doc_id", "window").agg(F.array_sort(F.collect_list(F.struct("no", "piece", F.array_join("w", " ").alias("t")))).alias("x"))
    return g.select("doc_id", "window", F.array_join(F.transform("x", lambda y: y["t"]), "\n").alias("text"))


def excerpts(wins: DataFrame, docs: DataFrame, most: int = 16) -> DataFrame:
    """``author_id, place, doc_id, window, text``: an author's windows in turns over its documents, newest first, up to ``most``.

    First the first window of every document, then the second of each, and so on.
    """
    d = docs.where(F.col("author_id").isNotNull()).select("doc_id", "author_id", "ended_at").dropDuplicates(["doc_id"])
    w = Window.partitionBy("author_id").orderBy("window", F.desc_nulls_last("ended_at"), "doc_id")
    return wins.join(d, "doc_id").withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < most).select("author_id", "place", "doc_id", "window", "text")


def embedded(texts: DataFrame, model: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """``texts`` with ``vec``: a slot for an embedder, called once for each distinct text; null and blank texts have none."""
    slot = F.pandas_udf(model, "array<float>")
    made = texts.where(T.strip(text) != "").select(text).distinct().withColumn("vec", slot(text))
    return texts.join(made, text, "left")


def pooled(vectors: DataFrame, key: str = "author_id") -> DataFrame:
    """``key, vec``: the unit mean of a group's unit vectors."""
    from ..functions import vectors as V

    x = vectors.where(F.col("vec").isNotNull()).select(key, F.posexplode(V.unit("vec")).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    g = x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("vec"))
    return g.withColumn("vec", V.unit("vec"))


def label_vectors(docs: DataFrame, labels: DataFrame, dim: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, vec`` of every document: its label's vector (``doc_id, vec``), or NaN throughout where it has none."""
    one = labels.where(F.col("vec").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.first("vec").alias("vec"))
    nan = F.array_repeat(F.lit(float("nan")), dim)
    return docs.select(F.col(id_col).alias("doc_id")).distinct().join(one, "doc_id", "left").select("doc_id", F.coalesce(F.col("vec").cast("array<double>"), nan).alias("vec"))


def labelled(docs: DataFrame, model: Callable[[pd.Series], pd.Series], allowed: list[str], text: str = "text") -> DataFrame:
    """``doc_id, label, label_status``: a slot for a labeller; ``labeled``, ``empty`` without a text, ``invalid`` for other labels, ``failed`` for none."""
    slot = F.pandas_udf(model, "string")
    made = docs.where(T.strip(text) != "").select(text).distinct().withColumn("_l", slot(text))
    got = docs.join(made, text, "left")
    ok = F.lower("_l").isin([a.lower() for a in allowed])
    status = F.when(F.coalesce(T.strip(text), F.lit("")) == "", "empty").when(F.col("_l").isNull(), "failed").when(ok, "labeled").otherwise("invalid")
    return got.select("doc_id", F.when(ok, F.lower("_l")).alias("label"), status.alias("label_status"))


def image_items(docs: DataFrame, image: str = "image_name", text: str | None = "text") -> DataFrame:
    """``doc_id, item``: the key under which a document's image and text are embedded once; null images have no item."""
    key = F.col(image) if text is None else F.concat_ws("|", F.col(image), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return docs.where(F.col(image).isNotNull()).select("doc_id", key.alias("item"))


# --- parts of speech ----------------------------------------------------------------------------------------------------
#: Frequent words of closed classes, for the rule tagger.
_CLASSES = {
    "DET": "the a an this that these those my your his her its our their some any no every each", "PRON": "i you he she it we they me him us them who what which", "ADP": "in on at of for from with by to into over under about between",
    "CONJ": "and or but because if when while although so than", "AUX": "is are was were be been am do does did have has had can could will would shall should may might must", "ADV": "not very too also just now then here there", "NUM": "one two three four five six seven eight nine ten",
}


def rule_tags(words: Column) -> Column:
    """Coarse parts of speech by closed classes and endings; a tagger is a function of such an array, so another one fits as well."""

    def tag(w: Column) -> Column:
        out = None
        for name, listed in _CLASSES.items():
            hit = w.isin(listed.split())
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.when(w.rlike(r"^\d"), "NUM").when(w.rlike(r"ly$"), "ADV").when(w.rlike(r"(?:ing|ed|ize|ise|ify)$"), "VERB").when(w.rlike(r"(?:ous|ful|able|ible|ive|al|ic|less)$"), "ADJ").otherwise("NOUN")

    return F.transform(words, tag)


def pos_features(docs: DataFrame, n: int = 3, size: int = 1024, k: int = 16, tagger: Callable[[Column], Column] = rule_tags, text: str = "text") -> DataFrame:
    """``doc_id, vec``: weighted counts of runs of parts of speech, reduced to the k strongest directions; null texts have none.

    Hashed counts and inverse document frequencies are MLlib's; the products of counts are summed in parts, ``size * size``
    numbers each, and only their sum reaches the driver.
    """
    import numpy as np
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    w = docs.where(F.col(text).isNotNull()).select("doc_id", tagger(T.tokens(text)).alias("t"))
    run = lambda m: F.when(F.size("t") >= m, F.transform(F.sequence(F.lit(1), F.size("t") - m + 1), lambda i: F.array_join(F.slice("t", i, m), "_"))).otherwise(F.array().cast("array<string>"))
    tf = HashingTF(numFeatures=size, inputCol="g", outputCol="tf").transform(w.select("doc_id", F.flatten(F.array(*[run(m) for m in range(1, n + 1)])).alias("g")))
    x = cut(IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf).select("doc_id", vector_to_array("x", "float32").alias("x")))

    def products(frames):
        total = np.zeros((size, size))
        for f in frames:
            if len(f):
                a = np.stack(f["x"].to_numpy()).astype(float)
                total += a.T @ a
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    rows = x.select("x").mapInPandas(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).where("v <> 0").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((size, size))
    gram[rows["i"], rows["j"]] = rows["v"]
    _, v = np.linalg.eigh(gram)
    top = v[:, ::-1][:, :k]
    shared = docs.sparkSession.sparkContext.broadcast(top * np.where(top[np.abs(top).argmax(0), np.arange(top.shape[1])] < 0, -1, 1))

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()) @ shared.value)) if len(rows) else rows

    return x.select("doc_id", project("x").alias("vec"))
