"""Neighbour graphs, rescoring, components and clustering. Edges are ``src, dst, distance``."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut


def undirected(directed: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first, with its least distance."""
    return directed.where(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("distance").alias("distance"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "distance").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))


# --- rescoring of directed neighbour lists ``src, dst, rank, distance`` --------------------------------------------------
def radius(knn: DataFrame, locality: int = 10) -> DataFrame:
    """``id, radius``: mean distance to the nearest ``locality`` neighbours."""
    return knn.where(F.col("rank") <= locality).groupBy(F.col("src").alias("id")).agg(F.avg("distance").alias("radius"))


def _reranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).select("src", "dst", "rank", "distance")


def _with_radii(knn: DataFrame, locality: int) -> DataFrame:
    r = radius(knn, locality)
    return knn.join(r.toDF("src", "r1"), "src").join(r.toDF("dst", "r2"), "dst")


def csls(knn: DataFrame, locality: int = 10) -> DataFrame:
    return _reranked(_with_radii(knn, locality).withColumn("distance", F.round(F.col("distance") - (F.col("r1") + F.col("r2")) / 2, 9)))


def local_scaling(knn: DataFrame, locality: int = 10) -> DataFrame:
    return _reranked(_with_radii(knn, locality).withColumn("distance", F.round(F.col("distance") * F.col("distance") / F.greatest(F.col("r1") * F.col("r2"), F.lit(1e-12)), 9)))


def mutual(knn: DataFrame, locality: int = 10) -> DataFrame:
    """Edges whose reverse is among the first ``locality`` neighbours as well."""
    near = knn.where(F.col("rank") <= locality)
    return _reranked(near.join(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))


def shared_neighbours(knn: DataFrame, locality: int = 10) -> DataFrame:
    """Edges by the number of neighbours in common, ties by distance: ``-overlap + d / (2 (w + 1))``, w the largest distance."""
    near = knn.where(F.col("rank") <= locality).groupBy("src").agg(F.collect_set("dst").alias("near"))  # no more than ``locality``
    w = knn.agg(F.max("distance").alias("w"))
    both = knn.join(near.toDF("src", "n1"), "src").join(near.toDF("dst", "n2"), "dst").crossJoin(F.broadcast(w))  # one row
    return _reranked(both.withColumn("distance", F.round(-F.size(F.array_intersect("n1", "n2")) + F.col("distance") / (2 * (F.col("w") + 1)), 9)))


def temporal_fusion(edges: DataFrame, times: DataFrame, weight: float = 0.3, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """``(1 - w) squash(distance) + w squash(log hours)``; squashed between percentiles, an unknown time is 1. ``times`` has ``id, seconds``."""
    e = edges.join(times.toDF("src", "t1"), "src", "left").join(times.toDF("dst", "t2"), "dst", "left")
    e = e.withColumn("hours", F.log1p(F.abs(F.col("t1") - F.col("t2")) / 3600.0))
    b = e.agg(*[F.percentile(c, F.lit(q)).alias(n) for c, q, n in (("distance", low, "d0"), ("distance", high, "d1"), ("hours", low, "h0"), ("hours", high, "h1"))])
    s = lambda x, a, z: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(x) - F.col(a)) / F.when(F.col(z) > F.col(a), F.col(z) - F.col(a)).otherwise(1.0)))
    fused = (1 - weight) * s("distance", "d0", "d1") + weight * F.coalesce(s("hours", "h0", "h1"), F.lit(1.0))
    return e.crossJoin(F.broadcast(b)).select("src", "dst", F.round(F.when(F.col("hours").isNull(), (1 - weight) * s("distance", "d0", "d1") + weight).otherwise(fused), 9).alias("distance"))  # one row


def adjacent_in_time(docs: DataFrame, width: int, *order: str, id_col: str = "id") -> DataFrame:
    """``src, dst``: each document with the next ``width`` in time."""
    from .timeline import positions

    p = positions(docs.select(id_col, *[o for o in order if o != id_col]), *order).select(F.col(id_col).alias("id"), "pos")
    ahead = p.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + width)).alias("pos"))
    return ahead.join(p.select(F.col("id").alias("dst"), "pos"), "pos").select("src", "dst")


def order_statistic(edges: DataFrame, q: float) -> DataFrame:
    """``threshold``: the distance at place ``min(int(q n), n - 1)``, not interpolated."""
    from .timeline import positions

    p = positions(edges.select("distance", "src", "dst"), "distance", "src", "dst")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return p.crossJoin(F.broadcast(n)).where(F.col("pos") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)).select(F.col("distance").alias("threshold"))  # one row


# --- components ---------------------------------------------------------------------------------------------------------
def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id that a node is linked to, by alternating large and small stars.

    Every round is two aggregations and its result is written to the shared folder; the rounds grow with the logarithm of the
    longest path. Nodes without edges are components of their own.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    e = edges.select(F.col("src").cast(kind).alias("u"), F.col("dst").cast(kind).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: all larger neighbours of a node go to the least of its neighbours and itself
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return nodes.select("id").distinct().join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def threshold_components(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Components of the edges no longer than the threshold."""
    return components(nodes, edges.where(F.col("distance") <= threshold))


# --- clustering inside a component --------------------------------------------------------------------------------------
def _inside(nodes: DataFrame, edges: DataFrame, cluster, largest: int, threshold: float | None, whole: bool = False) -> DataFrame:
    """``id, cluster``: a function on one component's edge list.

    A component above ``largest`` nodes is too much for a task. It is an error, never a silent result; with ``whole`` it
    stays one cluster, with a warning that says how many there are (the rule of component-wise average linkage).
    """
    comp = components(nodes, edges if threshold is None else edges.where(F.col("distance") <= threshold))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    comp = cut(comp.join(size, "component"))
    above = comp.where(F.col("n") > largest).agg(F.countDistinct("component").alias("k"), F.max("n").alias("n")).first()
    if above.k:
        text = f"{above.k} components of more than {largest} nodes, the largest of {above.n}"
        if not whole:
            raise ValueError(f"{text}: lower the threshold or raise `largest`")
        warnings.warn(f"{text}: each stays one cluster", stacklevel=2)
    kind = nodes.schema["id"].dataType.simpleString()
    small = comp.where(F.col("n").between(2, largest))
    inside = edges.join(small.select(F.col("id").alias("src"), "component"), "src").join(small.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    done = inside.select("component", "src", "dst", "distance").groupBy("component").applyInPandas(cluster, f"id {kind}, cluster {kind}")
    rest = comp.join(done.select("id"), "id", "left_anti").select("id", F.col("component").alias("cluster"))
    return done.unionByName(rest)


def _label(ids: np.ndarray, code: np.ndarray) -> pd.DataFrame:
    """Clusters named by their smallest id."""
    f = pd.DataFrame({"id": ids, "k": code})
    return pd.DataFrame({"id": f["id"], "cluster": f.groupby("k")["id"].transform("min")})


def agglomerative(nodes: DataFrame, edges: DataFrame, threshold: float, linkage: str = "average", far: float = 2.0, largest: int = 20_000) -> DataFrame:
    """Agglomeration to a distance, absent edges are ``far``; within components of the edges below the threshold, which is exact.

    A component above ``largest`` nodes stays one cluster, with a warning.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([f["src"], f["dst"]]))
        n = len(ids)
        d = np.full((n, n), far)
        i, j = np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"])
        d[i, j] = d[j, i] = f["distance"]
        np.fill_diagonal(d, np.inf)
        size, code, alive = np.ones(n), np.arange(n), np.ones(n, bool)
        while alive.sum() > 1:
            a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
            if d[a, b] > threshold:
                break
            if linkage == "average":
                row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            else:
                row = (np.maximum if linkage == "complete" else np.minimum)(d[a], d[b])
            d[a], d[:, a] = row, row
            d[a, a] = np.inf
            d[b], d[:, b] = np.inf, np.inf
            size[a] += size[b]
            alive[b] = False
            code[code == b] = a
        return _label(ids, code)

    return _inside(nodes, edges, run, largest, threshold, whole=True)


def capped_linkage(nodes: DataFrame, edges: DataFrame, threshold: float, most: int = 20, rule: str = "both", largest: int = 20_000) -> DataFrame:
    """Single linkage in order of distance that refuses merges: ``cap`` a union above ``most``, ``both`` two clusters that each have more than half of it."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([f["src"], f["dst"]]))
        parent, size = np.arange(len(ids)), np.ones(len(ids), int)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        f = f[f["distance"] <= threshold].sort_values(["distance", "src", "dst"])
        for s, t in zip(np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"])):
            a, b = root(s), root(t)
            if a == b or (size[a] + size[b] > most if rule == "cap" else min(size[a], size[b]) > most // 2):
                continue
            a, b = min(a, b), max(a, b)
            parent[b] = a
            size[a] += size[b]
        return _label(ids, np.array([root(x) for x in range(len(ids))]))

    return _inside(nodes, edges, run, largest, threshold)


def density_clusters(nodes: DataFrame, edges: DataFrame, least: int = 3, threshold: float = 1.0, largest: int = 20_000) -> DataFrame:
    """Density clustering in each component: mutual reachability, single linkage, and the most stable clusters of at least ``least``; the rest are singletons."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([f["src"], f["dst"]]))
        i, j, d = np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"]), f["distance"].to_numpy()
        n = len(ids)
        core = np.full(n, np.inf)
        both = pd.DataFrame({"v": np.concatenate([i, j]), "d": np.concatenate([d, d])}).sort_values(["v", "d"])
        kth = both.groupby("v").nth(max(0, least - 2))
        core[kth["v"].to_numpy()] = kth["d"].to_numpy()
        reach = np.maximum(d, np.maximum(core[i], core[j]))
        order = np.argsort(reach, kind="stable")
        parent, node, tree = np.arange(n), np.arange(n), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        top, size = n, {x: 1 for x in range(n)}
        for e in order:
            if not np.isfinite(reach[e]):
                break
            a, b = root(i[e]), root(j[e])
            if a != b:
                tree.append((node[a], node[b], max(reach[e], 1e-12)))
                size[top] = size[node[a]] + size[node[b]]
                parent[b] = a
                node[a] = top
                top += 1
        kids = {n + k: t for k, t in enumerate(tree)}
        code = -np.arange(1, n + 1)

        def leaves(x: int) -> list[int]:
            stack, out = [x], []
            while stack:
                y = stack.pop()
                if y < n:
                    out.append(y)
                else:
                    stack += kids[y][:2]
            return out

        # from small to large: a node is chosen where it is more stable than the best below it
        best: dict[int, tuple[float, list[int]]] = {}
        up = {c: k for k, t in kids.items() for c in t[:2]}
        for k in range(n, top):
            a, b, dist = kids[k]
            if size[k] < least:
                best[k] = (0.0, [])
                continue
            birth = 1 / kids[up[k]][2] if k in up else 0.0
            own = size[k] * (1 / dist - birth)
            below = [best.get(c, (0.0, [])) for c in (a, b)]
            under = sum(x for x, _ in below)
            chosen = [c for _, cs in below for c in cs]
            best[k] = (own, [k]) if own >= under or not chosen else (under, chosen)
        for k in range(n, top):
            if k not in up:
                for c in best[k][1]:
                    code[leaves(c)] = c
        return _label(ids, code)

    return _inside(nodes, edges, run, largest, threshold)


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 0.5, threshold: float = 1.0, rounds: int = 10, largest: int = 20_000) -> DataFrame:
    """Local moving under the constant Potts model, weights ``max(0, 1 - d)``, then aggregation, until nothing moves; ids give the order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([f["src"], f["dst"]]))
        n = len(ids)
        adj: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, d in zip(np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"]), f["distance"]):
            w = max(0.0, 1 - d)
            adj[a][b] = adj[b][a] = max(w, adj[a].get(b, 0.0))
        member, weight = np.arange(n), np.ones(n)
        for _ in range(rounds):
            code, tot = np.arange(len(adj)), weight.copy()
            moved = True
            while moved:
                moved = False
                for v in range(len(adj)):
                    own = code[v]
                    link: dict[int, float] = {}
                    for u, w in adj[v].items():
                        if u != v:
                            link[code[u]] = link.get(code[u], 0.0) + w
                    tot[own] -= weight[v]
                    gain = {c: w - resolution * weight[v] * tot[c] for c, w in link.items()}
                    gain.setdefault(own, -resolution * weight[v] * tot[own])
                    to = max(sorted(gain), key=lambda c: (round(gain[c], 12), c == own))
                    if gain[to] < 0:
                        to = own
                    tot[to] += weight[v]
                    if to != own:
                        code[v] = to
                        moved = True
            used, new = np.unique(code, return_inverse=True)
            if len(used) == len(adj):
                break
            member = new[member]
            merged: list[dict[int, float]] = [{} for _ in used]
            for v, near in enumerate(adj):
                for u, w in near.items():
                    merged[new[v]][new[u]] = merged[new[v]].get(new[u], 0.0) + w
            weight = np.bincount(new, weights=weight)
            adj = merged
        return _label(ids, member)

    return _inside(nodes, edges, run, largest, threshold)
