"""Scores of a query set against all rows, in blocks of vectors, by matrix products.

The gallery is cut into blocks by a hash of its id and the queries likewise; a task holds one block of each. The number of
blocks follows from the number of rows, so a task's memory is bounded at every size, and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def _matrix(col: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype(np.float64)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
    return x


def similarities(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """Higher is nearer: cosine less one, or minus the distance."""
    if metric in ("cosine", "dot"):
        return q @ g.T
    if metric == "euclidean":
        d = (q * q).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2 * q @ g.T
        return -np.sqrt(np.maximum(d, 0))
    if metric in ("manhattan", "cityblock"):
        return -np.stack([np.abs(row - g).sum(1) for row in q])
    raise ValueError(f"no such metric: {metric}")


def _cells(queries: DataFrame, gallery: DataFrame, block: int) -> DataFrame:
    """Rows of both sides with the cell ``i, j`` they meet in; queries ``q, vec``, gallery ``g, label, vec``."""
    nq, ng = (max(1, -(-df.count() // block)) for df in (queries, gallery))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind = gallery.schema["label"].dataType.simpleString()
    left = queries.select(F.col("q").alias("id"), F.lit(None).cast(kind).alias("label"), "vec", F.lit(0).alias("side"), own("q", nq).alias("i"), upto(ng).alias("j"))
    right = gallery.select(F.col("g").alias("id"), "label", "vec", F.lit(1).alias("side"), own("g", ng).alias("j"), upto(nq).alias("i"))
    return left.unionByName(right)


def author_scores(queries: DataFrame, gallery: DataFrame, linkage: str = "max", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """``q, label, score``: nearest (``max``) or mean (``mean``) similarity of each query to each label's vectors."""
    if linkage not in ("max", "mean"):
        raise ValueError(f"no such linkage: {linkage}")
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "q"), (gallery, "label"))]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        q, g = f[f["side"] == 0], f[f["side"] == 1]
        if not len(q) or not len(g):
            return pd.DataFrame({"q": [], "label": [], "top": [], "total": [], "n": []})
        s = similarities(_matrix(q["vec"], metric), _matrix(g["vec"], metric), metric)
        labels, code = np.unique(g["label"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(labels)))
        s = s[:, order]
        return pd.DataFrame({
            "q": np.repeat(q["id"].to_numpy(), len(labels)), "label": np.tile(labels, len(q)), "top": np.maximum.reduceat(s, starts, axis=1).ravel(),
            "total": np.add.reduceat(s, starts, axis=1).ravel(), "n": np.tile(np.bincount(code), len(q)),
        })

    parts = _cells(queries, gallery, block).groupBy("i", "j").applyInPandas(run, f"q {kinds[0]}, label {kinds[1]}, top double, total double, n bigint")
    score = F.max("top") if linkage == "max" else F.sum("total") / F.sum("n")
    return parts.groupBy("q", "label").agg(score.alias("score"))


def neighbours(df: DataFrame, k: int, id_col: str, vec_col: str, metric: str = "cosine", block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """``src, dst, rank, distance``: the k nearest other rows of each query row, exactly; equal distances by the smaller id.

    ``queries`` restricts the rows that are asked for; without it every row is.
    """
    g = df.select(F.col(id_col).alias("g"), F.lit(0).alias("label"), F.col(vec_col).alias("vec"))
    q = (df if queries is None else queries).select(F.col(id_col).alias("q"), F.col(vec_col).alias("vec"))
    kind = q.schema["q"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        q, g = f[f["side"] == 0], f[f["side"] == 1]
        if not len(q) or not len(g):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        s = similarities(_matrix(q["vec"], metric), _matrix(g["vec"], metric), metric)
        d = np.round(1 - s if metric == "cosine" else -s, 9)
        qi, gi = q["id"].to_numpy(), g["id"].to_numpy()
        d[qi[:, None] == gi[None, :]] = np.inf
        by_id = np.argsort(gi, kind="stable")
        pick = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
        got = np.take_along_axis(d, pick, 1)
        out = pd.DataFrame({"src": np.repeat(qi, pick.shape[1]), "dst": gi[pick.ravel()], "distance": got.ravel()})
        return out[np.isfinite(out["distance"])]

    parts = _cells(q, g, block).groupBy("i", "j").applyInPandas(run, f"src {kind}, dst {kind}, distance double")
    from pyspark.sql.window import Window

    w = Window.partitionBy("src").orderBy("distance", "dst")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")
