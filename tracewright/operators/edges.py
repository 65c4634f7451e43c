"""Edge models: features of candidate links, a same-author classifier, budgets, verification curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from . import graph as G
from . import partitions as Z


def moments(df: DataFrame, id_col: str, vec_col: str, sample: int = 4096, seed: int = 7) -> DataFrame:
    """``id, mean, std`` of the distance of every row to a fixed sample of rows, the first by a hash of their id."""
    from .blocks import author_scores

    some = df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample)
    q = df.select(F.col(id_col).alias("q"), F.col(vec_col).alias("vec"))
    s = author_scores(q, some.select(F.col(id_col).alias("g"), F.col(id_col).alias("label"), F.col(vec_col).alias("vec")))
    return s.where(F.col("q") != F.col("label")).groupBy(F.col("q").alias("id")).agg(F.avg(1 - F.col("score")).alias("mean"), F.stddev_pop(1 - F.col("score")).alias("std"))


def zscore_distances(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Edges by the larger of their ends' z-scores; a deviation of 0 counts as 1."""
    a, b = stats.toDF("src", "m1", "s1"), stats.toDF("dst", "m2", "s2")
    z = lambda m, s: (F.col("distance") - F.col(m)) / F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.round(F.greatest(z("m1", "s1"), z("m2", "s2")), 9).alias("distance"))


def pair_features(knn: DataFrame, docs: DataFrame, locality: int = 10) -> DataFrame:
    """Features of undirected edges: distance, log gap in time, shared neighbours, both ranks, same language, both radii, both margins.

    ``docs`` has ``id, seconds, lang``.
    """
    e = G.undirected(knn)
    shared = G.undirected(G.shared_neighbours(knn, locality)).withColumnRenamed("distance", "shared")
    r = G.radius(knn, locality)
    near = knn.groupBy(F.col("src").alias("id")).agg(F.min("distance").alias("nearest"))
    rank = lambda a, b, n: knn.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("rank").alias(n))
    e = e.join(shared, ["src", "dst"], "left").join(rank("src", "dst", "rank_ab"), ["src", "dst"], "left").join(rank("dst", "src", "rank_ba"), ["src", "dst"], "left")
    for end, n in (("src", "1"), ("dst", "2")):
        e = e.join(r.toDF(end, f"radius{n}"), end).join(near.toDF(end, f"nearest{n}"), end).join(docs.select(F.col("id").alias(end), F.col("seconds").alias(f"t{n}"), F.col("lang").alias(f"l{n}")), end)
    gap = F.coalesce(F.log1p(F.abs(F.col("t1") - F.col("t2")) / 3600.0), F.lit(20.0))
    far = F.lit(10_000)
    return e.select(
        "src", "dst", "distance", gap.alias("log_gap"), F.coalesce("shared", F.lit(0.0)).alias("shared"), F.coalesce("rank_ab", far).alias("rank_ab"), F.coalesce("rank_ba", far).alias("rank_ba"),
        F.coalesce((F.col("l1") == F.col("l2")).cast("double"), F.lit(0.5)).alias("same_language"), "radius1", "radius2", (F.col("distance") - F.col("nearest1")).alias("margin1"), (F.col("distance") - F.col("nearest2")).alias("margin2"),
    )


def edge_model(train: DataFrame, score: DataFrame, trees: int = 10) -> DataFrame:
    """``src, dst, distance``: minus the evidence of a gradient-boosted same-author model; ``train`` has ``label``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = [c for c in score.columns if c not in ("src", "dst", "label")]
    v = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    model = GBTClassifier(maxIter=trees, maxDepth=3, seed=47).fit(v.transform(train))
    return model.transform(v.transform(score)).select("src", "dst", F.round(-F.get(vector_to_array("rawPrediction"), F.lit(1)), 9).alias("distance"))


def budget_frontier(nodes: DataFrame, edges: DataFrame, truth: DataFrame, budgets: list[int]) -> DataFrame:
    """``budget, precision, recall, f1``: BCubed of the components of the first B edges by distance."""
    from .timeline import positions

    ranked = cut(positions(edges, "distance", "src", "dst"))
    out = None
    for b in budgets:
        c = G.components(nodes, ranked.where(F.col("pos") < b)).select("id", F.col("component").alias("cluster"))
        row = Z.bcubed(Z.contingency(c, truth)).select(F.lit(b).alias("budget"), "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def graph_diagnostics(knn: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``k, hit, recall, purity``: share of documents with a neighbour of their author among k, share of its others found, share of right edges.

    Documents whose author has no other are left out of hit and recall.
    """
    a, b = truth.toDF("src", "a1"), truth.toDF("dst", "a2")
    n = truth.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("author")) - 1).select(F.col("id").alias("src"), "others")
    e = knn.join(a, "src").join(b, "dst").join(n, "src").withColumn("same", (F.col("a1") == F.col("a2")).cast("bigint")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    per = e.groupBy("k", "src", "others").agg(F.sum("same").alias("s"), F.count(F.lit(1)).alias("c"))
    some = F.col("others") > 0
    return per.groupBy("k").agg(F.avg(F.when(some, (F.col("s") > 0).cast("double"))).alias("hit"), F.avg(F.when(some, F.col("s") / F.least("others", "k"))).alias("recall"), (F.sum("s") / F.sum("c")).alias("purity"))


def random_hit(truth: DataFrame, k: int) -> DataFrame:
    """``k, hit``: chance that one of k random others is of the same author, averaged over documents that have one."""
    n = truth.agg(F.count(F.lit(1)).alias("n"))
    c = truth.groupBy("author").agg(F.count(F.lit(1)).alias("c")).where("c > 1").crossJoin(F.broadcast(n))  # one row
    pool = F.col("n") - 1
    miss = F.exp(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda a, i: a + F.log(F.greatest((pool - (F.col("c") - 1) - i) / (pool - i), F.lit(1e-300)))))
    return c.agg((F.sum(F.col("c") * (1 - miss)) / F.sum("c")).alias("hit")).select(F.lit(k).alias("k"), "hit")


def signal_auroc(edges: DataFrame, truth: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """``signal, same, different, auroc``: medians of edge signals and how well each tells same-author edges (low values are alike)."""
    from .detection import auroc

    a, b = truth.toDF("src", "a1"), truth.toDF("dst", "a2")
    e = cut(edges.join(a, "src").join(b, "dst").withColumn("same", F.col("a1") == F.col("a2")))
    out = None
    for s in signals:
        m = e.agg(F.percentile(F.when(F.col("same"), F.col(s)), F.lit(0.5)).alias("same"), F.percentile(F.when(~F.col("same"), F.col(s)), F.lit(0.5)).alias("different"))
        row = m.crossJoin(auroc(e.select((-F.col(s)).alias("score"), F.col("same").alias("is_out")))).select(F.lit(s).alias("signal"), "same", "different", "auroc")  # single rows
        out = row if out is None else out.unionByName(row)
    return out


def within_and_between(df: DataFrame, id_col: str, author: str, vec_col: str, seed: int = 47) -> DataFrame:
    """``within, between``: mean cosine distance of documents of an author, and of documents of different authors.

    In closed form from sums of unit vectors: the mean of all pairs' cosines is |sum|^2 less n, over n (n - 1). No pair is made.
    """
    from ..functions import vectors as V

    u = df.select(F.col(author).alias("a"), V.unit(vec_col).alias("v"))
    each = u.select("a", F.posexplode("v").alias("i", "x")).groupBy("a", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    per = each.groupBy("a").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.max("n").alias("n"))
    tot = each.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).agg(F.sum(F.col("x") * F.col("x")).alias("ts"), F.max("n").alias("tn"))
    w = per.agg(F.sum(F.col("s") - F.col("n")).alias("ws"), F.sum(F.col("n") * (F.col("n") - 1)).alias("wn"))
    return w.crossJoin(tot).select((1 - F.col("ws") / F.col("wn")).alias("within"), (1 - (F.col("ts") - F.col("tn") - F.col("ws")) / (F.col("tn") * (F.col("tn") - 1) - F.col("wn"))).alias("between"))  # single rows
