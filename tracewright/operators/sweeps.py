"""Sweeps over graphs and partitions: rescorings, sizes of lists, thresholds, caps and weights of time, each a row of metrics.

The grids are small and known beforehand, so they are loops of the driver; every row is one aggregate over the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from . import edges as X
from . import graph as G
from . import partitions as Z

#: Rescorings of neighbour lists by name.
RESCORINGS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "none": lambda knn, locality: knn, "csls": G.csls, "local_scaling": G.local_scaling, "mutual": G.mutual, "shared": G.shared_neighbours,
}
#: Clusterings by name: nodes, edges and a threshold.
ALGORITHMS: dict[str, Callable[[DataFrame, DataFrame, float], DataFrame]] = {
    "components": lambda n, e, t: G.threshold_components(n, e, t).select("id", F.col("component").alias("cluster")),
    "average": lambda n, e, t: G.agglomerative(n, e, t, "average"),
    "complete": lambda n, e, t: G.agglomerative(n, e, t, "complete"),
    "capped": lambda n, e, t: G.capped_linkage(n, e, t),
    "density": lambda n, e, t: G.density_clusters(n, e, threshold=t),
    "communities": lambda n, e, t: G.communities(n, e, threshold=t),
}


def _rows(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def scored(parts: DataFrame, truth: DataFrame, **settings) -> DataFrame:
    """One row: the settings as text columns, BCubed and the number of clusters."""
    t = cut(Z.contingency(parts, truth))
    n = t.agg(F.countDistinct("cluster").alias("clusters"))
    return Z.bcubed(t).crossJoin(n).select(*[F.lit(str(v)).alias(k) for k, v in sorted(settings.items())], "clusters", "precision", "recall", "f1")  # single rows


def sweep_graph(knn: DataFrame, nodes: DataFrame, truth: DataFrame, rescorings: tuple[str, ...] = ("none", "csls"), localities: tuple[int, ...] = (5,), ks: tuple[int, ...] = (3, 5), quantiles: tuple[float, ...] = (0.1, 0.3)) -> DataFrame:
    """``rescoring, locality, k, quantile, clusters, precision, recall, f1`` of components: every rescoring, list size and cut."""
    out = []
    for r in rescorings:
        for locality in localities:
            again = cut(RESCORINGS[r](knn, locality))
            for k in ks:
                e = cut(G.undirected(again.where(F.col("rank") <= k)))
                for q in quantiles:
                    t = G.order_statistic(e, q).first()
                    if t is not None:
                        out.append(scored(ALGORITHMS["components"](nodes, e, t.threshold), truth, rescoring=r, locality=locality, k=k, quantile=q))
    return _rows(out)


def sweep_algorithms(nodes: DataFrame, edges: DataFrame, truth: DataFrame, algorithms: tuple[str, ...] = ("components", "average", "capped"), quantiles: tuple[float, ...] = (0.1, 0.3)) -> DataFrame:
    """``algorithm, quantile, …``: every clustering cut at quantiles of the edges' distances."""
    e = cut(edges)
    cuts = {q: G.order_statistic(e, q).first().threshold for q in quantiles}
    return _rows([scored(ALGORITHMS[a](nodes, e, t), truth, algorithm=a, quantile=q) for a in algorithms for q, t in cuts.items()])


def sweep_caps(nodes: DataFrame, edges: DataFrame, truth: DataFrame, caps: tuple[int, ...] = (5, 20, 50), rules: tuple[str, ...] = ("both", "cap"), cohesions: tuple[float, ...] = (1.0,)) -> DataFrame:
    """``cap, rule, cohesion, …``: linkage that refuses large unions, on the edges up to a quantile of the distances (``cohesion``)."""
    e = cut(edges)
    out = []
    for c in cohesions:
        t = G.order_statistic(e, c).first().threshold
        out += [scored(G.capped_linkage(nodes, e, t, most, rule), truth, cap=most, rule=rule, cohesion=c) for most in caps for rule in rules]
    return _rows(out)


def best_setting(sweep: DataFrame) -> DataFrame:
    """The row of the greatest F, ties by the settings in order."""
    keys = [c for c in sweep.columns if c not in ("clusters", "precision", "recall", "f1")]
    return sweep.orderBy(F.desc(F.round("f1", 9)), *keys).limit(1)


def oracle_sweep(tune: DataFrame, test: DataFrame) -> DataFrame:
    """The best row of a sweep on the tuning documents beside the best the same sweep reaches on the test documents."""
    return best_setting(tune).select(F.lit("tuned").alias("kind"), "*").unionByName(best_setting(test).select(F.lit("oracle").alias("kind"), "*"))


# --- time ---------------------------------------------------------------------------------------------------------------
def balanced_weight(edges: DataFrame, times: DataFrame) -> DataFrame:
    """``weight`` at which distance and time spread equally: IQR(distance) / (IQR(distance) + IQR(time)) of the fused terms; 0.5 without spread."""
    a = G.temporal_fusion(edges, times, 0.0).withColumnRenamed("distance", "x")
    b = G.temporal_fusion(edges, times, 1.0).withColumnRenamed("distance", "y")
    iqr = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    s = a.join(b, ["src", "dst"]).agg(iqr("x").alias("x"), iqr("y").alias("y"))
    return s.select(F.when(F.col("x") + F.col("y") > 0, F.col("x") / (F.col("x") + F.col("y"))).otherwise(0.5).alias("weight"))


def weight_grid(balance: float, multiples: tuple[float, ...] = (0.25, 0.5, 1.0, 1.5, 2.0), most: float = 0.8) -> tuple[float, ...]:
    """0 and multiples of the balanced weight, none above ``most``."""
    return tuple(sorted({0.0, *(min(round(balance * m, 4), most) for m in multiples)}))


def tune_time_weight(nodes: DataFrame, edges: DataFrame, times: DataFrame, truth: DataFrame, quantile: float = 0.3, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``weight, clusters, precision, recall, f1`` of components of the fused edges, for each weight of time."""
    e = cut(edges)
    ws = weights or weight_grid(balanced_weight(e, times).first().weight)
    out = []
    for w in ws:
        f = cut(G.temporal_fusion(e, times, w))
        out.append(scored(ALGORITHMS["components"](nodes, f, G.order_statistic(f, quantile).first().threshold), truth, weight=w))
    return _rows(out)


# --- reports ------------------------------------------------------------------------------------------------------------
def slice_diagnostics(name: str, knn: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of a slice: its shape, how well distance tells links, and the ranking of its links."""
    e = G.undirected(knn)
    t = truth.select("id", "author")
    labelled = e.join(t.toDF("src", "a1"), "src").join(t.toDF("dst", "a2"), "dst")
    from .detection import auroc

    auc = auroc(labelled.select((-F.col("distance")).alias("score"), (F.col("a1") == F.col("a2")).alias("is_out")))
    return Z.shape_of_collection(truth).crossJoin(auc).crossJoin(Z.link_ranking(e, t)).select(F.lit(name).alias("slice"), "*")  # single rows


def seen_and_unseen(parts: DataFrame, truth: DataFrame, history: DataFrame) -> DataFrame:
    """``seen, docs, precision, recall``: BCubed of documents whose author is in the history (``author``), and of the others."""
    p = Z.per_document(parts, truth).join(truth, "id").join(history.select("author").distinct().withColumn("_h", F.lit(1)), "author", "left")
    return p.groupBy(F.col("_h").isNotNull().alias("seen")).agg(F.count(F.lit(1)).alias("docs"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def bcubed_by(parts: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, docs, precision, recall``: BCubed by a property of documents (``id, grp``), their language say; null is its own group."""
    p = Z.per_document(parts, truth).join(groups.select("id", "grp"), "id", "left")
    return p.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def pair_histogram(docs: DataFrame, bins: int = 50, width: float = 0.04, metric: str = "cosine") -> DataFrame:
    """``bin, pos, neg``: all pairs of documents (``id, author, vec``) by similarity, of one author and of two; higher bins are more alike.

    Blocks of both sides meet in tasks of their own, and each task gives no more rows than there are bins.
    """
    from .blocks import _cells, _matrix, similarities

    side = docs.select(F.col("id"), F.col("author").alias("label"), "vec")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        q, g = f[f["side"] == 0], f[f["side"] == 1]
        if not len(q) or not len(g):
            return pd.DataFrame({"bin": [], "pos": [], "neg": []})
        s = similarities(_matrix(q["vec"], metric), _matrix(g["vec"], metric), metric)
        d = np.round(1 - s if metric == "cosine" else -s, 9)
        once = q["id"].to_numpy()[:, None] < g["id"].to_numpy()[None, :]
        same = q["own"].to_numpy()[:, None] == g["own"].to_numpy()[None, :]
        b = -np.floor(d / width).astype(int)
        lo = b.min()
        pos, neg = (np.bincount((b[m] - lo).ravel(), minlength=b.max() - lo + 1) for m in (once & same, once & ~same))
        out = pd.DataFrame({"bin": np.arange(lo, b.max() + 1), "pos": pos, "neg": neg})
        return out[(out["pos"] > 0) | (out["neg"] > 0)]

    cells = _cells(side.select(F.col("id").alias("q"), "vec"), side.select(F.col("id").alias("g"), "label", "vec"), 2048)
    cells = cells.join(docs.select("id", F.col("author").alias("own")), "id")
    parts = cells.groupBy("i", "j").applyInPandas(run, "bin bigint, pos bigint, neg bigint")
    return parts.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


# --- learned edges ------------------------------------------------------------------------------------------------------
def mined_pairs(knn: DataFrame, truth: DataFrame, positives: int = 16, seed: int = 47) -> DataFrame:
    """``a, b, label``: up to ``positives`` pairs of each author by a keyed draw, and neighbours of other authors as hard negatives.

    A document meets the next few of its author in a keyed order, never all of them.
    """
    w = Window.partitionBy("author").orderBy(F.xxhash64("id", F.lit(seed)))
    t = truth.where(F.col("author").isNotNull())
    near = [t.withColumn("b", F.lead("id", s).over(w)).where(F.col("b").isNotNull()).select("author", F.col("id").alias("a"), "b") for s in (1, 2, 3)]
    pos = _rows(near).withColumn("_r", F.row_number().over(Window.partitionBy("author").orderBy(F.xxhash64("a", "b", F.lit(seed))))).where(F.col("_r") <= positives).select("a", "b", F.lit(1.0).alias("label"))
    e = G.undirected(knn).join(t.toDF("src", "a1"), "src").join(t.toDF("dst", "a2"), "dst").where("a1 <> a2")
    return pos.unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("label")))


def edge_network(pairs: DataFrame, edges: DataFrame, docs: DataFrame, hidden: int = 32, steps: int = 60, seed: int = 47) -> DataFrame:
    """``src, dst, distance``: minus the log odds of a network of one hidden layer on differences and products of vectors."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..functions import vectors as V

    v = docs.select("id", V.unit("vec").alias("vec"))
    both = lambda e, a, b: e.join(v.toDF(a, "_x"), a).join(v.toDF(b, "_y"), b).withColumn("features", array_to_vector(V.pair_features("_x", "_y"))).drop("_x", "_y")
    dim = v.select(F.size("vec").alias("n")).first().n
    train = cut(both(pairs, "a", "b").repartition("a"))
    model = MultilayerPerceptronClassifier(layers=[2 * dim, hidden, 2], maxIter=steps, seed=seed).fit(train)
    p = model.transform(both(edges, "src", "dst")).withColumn("p", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.get(vector_to_array("probability"), F.lit(1)))))
    return p.select("src", "dst", F.round(-F.log(F.col("p") / (1 - F.col("p"))), 9).alias("distance"))


def contrastive_projection(docs: DataFrame, components: int = 32, steps: int = 100, authors: int = 64, rate: float = 0.05, temperature: float = 0.1, train_rows: int = 20_000, seed: int = 47) -> np.ndarray:
    """A linear projection under which documents of an author are near each other: InfoNCE by Adam on a bounded sample.

    At most about ``train_rows`` documents, by a hash of their id, reach the driver; what is projected is every row.
    """
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, train_rows / max(n, 1)) * (1 << 20))).select("doc", "author", "vec").toPandas().sort_values("doc")
    x = np.stack(some["vec"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    groups = [g for g in some.reset_index(drop=True).groupby("author").indices.values() if len(g) > 1]
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(x.shape[1], components)) / x.shape[1] ** 0.5
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1 if groups else 1):
        pick = [rng.choice(groups[i], 2, replace=False) for i in rng.permutation(len(groups))[:authors]]
        a, b = x[[p[0] for p in pick]], x[[p[1] for p in pick]]
        za, zb = a @ w, b @ w
        na, nb = np.maximum(np.linalg.norm(za, axis=1, keepdims=True), 1e-9), np.maximum(np.linalg.norm(zb, axis=1, keepdims=True), 1e-9)
        ua, ub = za / na, zb / nb
        s = ua @ ub.T / temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(len(pick))) / temperature / len(pick)
        ga, gb = d @ ub, d.T @ ua
        back = lambda g, u, norm: (g - (g * u).sum(1, keepdims=True) * u) / norm
        grad = a.T @ back(ga, ua, na) + b.T @ back(gb, ub, nb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w
