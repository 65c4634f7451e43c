"""Queries of linkage: neighbour graphs, rescoring, clustering, partition metrics, on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import edges as X
from ..operators import graph as G
from ..operators import partitions as Z
from ..operators import ranking as K
from ..operators import sweeps as W
from ..operators import tuning as U
from ..operators.blocks import neighbours
from ..runtime import cut, table
from .registry import query

K_NEAR, LOCALITY, CUT = 8, 5, 0.35


def knn(spark, d):
    """Directed lists of the nearest neighbours of every row, exact, in blocks."""
    return cut(neighbours(table(spark, d, "embeddings"), K_NEAR, "vec_id", "embedding"))


def nodes(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))


def truth(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("author"))


_P = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, round(1 - list_cosine_similarity(a.x, b.x), 9) AS distance FROM v a, v b WHERE a.id <> b.id)"
_K = f"{_P}, knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p) WHERE rank <= {K_NEAR})"
_U = f"{_K}, e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(distance) AS distance FROM knn GROUP BY ALL)"
_RAD = f"{_K}, rad AS (SELECT src AS id, avg(distance) AS r FROM knn WHERE rank <= {LOCALITY} GROUP BY src)"


@query(f"WITH {_U} SELECT src, dst, round(distance, 6) AS distance FROM e")
def knn_edges(spark, d):
    return G.undirected(knn(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_K} SELECT a.src, a.dst, round(a.distance, 6) AS distance FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= {LOCALITY} AND b.rank <= {LOCALITY}")
def mutual_knn(spark, d):
    return G.mutual(knn(spark, d), LOCALITY).select("src", "dst", F.round("distance", 6).alias("distance"))


@query(f"WITH {_RAD} SELECT k.src, k.dst, round(round(k.distance - (a.r + b.r) / 2, 9), 5) AS distance FROM knn k JOIN rad a ON k.src = a.id JOIN rad b ON k.dst = b.id")
def csls(spark, d):
    return G.csls(knn(spark, d), LOCALITY).select("src", "dst", F.round("distance", 5).alias("distance"))


@query(f"WITH {_RAD} SELECT k.src, k.dst, round(round(k.distance * k.distance / greatest(a.r * b.r, 1e-12), 9), 5) AS distance FROM knn k JOIN rad a ON k.src = a.id JOIN rad b ON k.dst = b.id")
def local_scaling(spark, d):
    return G.local_scaling(knn(spark, d), LOCALITY).select("src", "dst", F.round("distance", 5).alias("distance"))


@query(
    f"""WITH {_K}, s AS (SELECT src, list(dst) AS near FROM knn WHERE rank <= {LOCALITY} GROUP BY src), w AS (SELECT max(distance) AS w FROM knn)
    SELECT k.src, k.dst, round(round(-len(list_intersect(a.near, b.near)) + k.distance / (2 * (w + 1)), 9), 5) AS distance FROM knn k JOIN s a ON k.src = a.src JOIN s b ON k.dst = b.src, w"""
)
def shared_neighbors(spark, d):
    return G.shared_neighbours(knn(spark, d), LOCALITY).select("src", "dst", F.round("distance", 5).alias("distance"))


@query(f"WITH {_U} SELECT round(distance, 6) AS threshold FROM (SELECT distance, row_number() OVER (ORDER BY distance, src, dst) - 1 AS pos, count(*) OVER () AS n FROM e) WHERE pos = least(floor(0.25 * n), n - 1)")
def edge_quantile_threshold(spark, d):
    return G.order_statistic(G.undirected(knn(spark, d)), 0.25).select(F.round("threshold", 6).alias("threshold"))


def parts(spark, d):
    return cut(G.threshold_components(nodes(spark, d), G.undirected(knn(spark, d)), CUT).select("id", F.col("component").alias("cluster")))


_REC = f"{_U}, f AS (SELECT src, dst FROM e WHERE distance <= {CUT} UNION SELECT dst, src FROM e WHERE distance <= {CUT}), reach(id, root) AS (SELECT id, id FROM v UNION SELECT f.dst, reach.root FROM reach JOIN f ON f.src = reach.id), c AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"
_T = f"{_REC}, m AS (SELECT c.cluster, l.label AS author, count(*) AS n FROM c JOIN embeddings l ON c.id = l.vec_id GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS in_cluster, sum(n) OVER (PARTITION BY author) AS by_author FROM m)"


@query(f"WITH RECURSIVE {_REC} SELECT id, cluster FROM c")
def connected_components_threshold(spark, d):
    return parts(spark, d)


def contingency(spark, d):
    return cut(Z.contingency(parts(spark, d), truth(spark, d)))


@query(f"WITH RECURSIVE {_T}, b AS (SELECT sum(n * n / in_cluster) / sum(n) AS p, sum(n * n / by_author) / sum(n) AS r FROM t) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM b")
def bcubed(spark, d):
    return Z.bcubed(contingency(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH RECURSIVE {_T}, x AS (SELECT (SELECT sum(a * (a - 1) / 2) FROM (SELECT DISTINCT author, by_author AS a FROM t)) AS true_links, (SELECT sum(c * (c - 1) / 2) FROM (SELECT DISTINCT cluster, in_cluster AS c FROM t)) AS linked, (SELECT sum(n * (n - 1) / 2) FROM t) AS hits)
    SELECT true_links::DOUBLE AS true_links, linked::DOUBLE AS linked, hits::DOUBLE AS hits, round(hits / linked, 6) AS precision, round(hits / true_links, 6) AS recall, round(2 * hits / (linked + true_links), 6) AS f1 FROM x"""
)
def pairwise_links(spark, d):
    p = Z.pairwise(contingency(spark, d))
    return p.select(*[F.col(c).cast("double").alias(c) for c in ("true_links", "linked", "hits")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH RECURSIVE {_T} SELECT author, max(by_author)::BIGINT AS n, count(*) AS clusters, round(max(n) / max(by_author), 6) AS largest_share, max(n) > 1 AS any_link, bool_or(n = by_author AND n = in_cluster) AS reassembled FROM t GROUP BY author")
def per_author_clusters(spark, d):
    return Z.per_author(contingency(spark, d)).withColumn("largest_share", F.round("largest_share", 6))


@query()
def clustering_summary(spark, d):
    return Z.summary(contingency(spark, d))


@query("SELECT 1.0::DOUBLE AS precision, round(avg(1.0 / n), 6) AS recall FROM (SELECT count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def singleton_baseline(spark, d):
    return Z.singleton_baseline(truth(spark, d)).select(F.col("precision").cast("double").alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT round(sum(c * c) / (sum(c) * sum(c)), 6) AS precision, 1.0::DOUBLE AS recall FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)")
def single_cluster_baseline(spark, d):
    return Z.single_cluster_baseline(truth(spark, d)).select(F.round("precision", 6).alias("precision"), F.col("recall").cast("double").alias("recall"))


@query(f"WITH RECURSIVE {_T}, b AS (SELECT sum(n * n / by_author) / sum(n) AS r FROM t) SELECT 1.0::DOUBLE AS precision, round(r, 6) AS recall, round(2 * r / (1 + r), 6) AS f1 FROM b")
def loss_decomposition_split(spark, d):
    return Z.oracle_split(contingency(spark, d)).select(F.col("precision").cast("double").alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(
    f"""WITH RECURSIVE {_T}, mn AS (SELECT cluster, arg_max(author, struct_pack(n := n, a := author)) AS main FROM t GROUP BY cluster), r AS (SELECT main, author, sum(n) AS n FROM t JOIN mn USING (cluster) GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY main) AS c, sum(n) OVER (PARTITION BY author) AS a FROM r), b AS (SELECT sum(n * n / c) / sum(n) AS p, sum(n * n / a) / sum(n) AS r FROM w) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM b"""
)
def loss_decomposition_merge(spark, d):
    return Z.oracle_merge(contingency(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH RECURSIVE {_T}, a AS (SELECT avg(k) AS clusters_per_author FROM (SELECT author, count(*) AS k FROM t GROUP BY author)), q AS (SELECT cluster, max(in_cluster) AS c, count(*) AS k FROM t GROUP BY cluster)
    SELECT round(clusters_per_author, 6) AS clusters_per_author, round((SELECT avg(k) FROM q), 6) AS authors_per_cluster, round((SELECT sum(CASE WHEN k = 1 THEN c ELSE 0 END) / sum(c) FROM q), 6) AS pure_share FROM a"""
)
def cluster_shape(spark, d):
    return Z.shape(contingency(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("clusters_per_author", "authors_per_cluster", "pure_share")])


@query(
    f"""WITH RECURSIVE {_T}, b AS (SELECT *, CASE WHEN by_author <= 1 THEN '1' WHEN by_author <= 2 THEN '2' WHEN by_author <= 4 THEN '3-4' WHEN by_author <= 8 THEN '5-8' WHEN by_author <= 16 THEN '9-16' ELSE '17+' END AS bin FROM t)
    SELECT bin, sum(n)::BIGINT AS docs, round(sum(n * n / in_cluster) / sum(n), 6) AS precision, round(sum(n * n / by_author) / sum(n), 6) AS recall FROM b GROUP BY bin"""
)
def error_slices(spark, d):
    return Z.error_slices(contingency(spark, d)).select("bin", "docs", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {_U}, r AS (SELECT (a.label = b.label)::INT AS rel, row_number() OVER (ORDER BY distance, src, dst) AS pos FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst), h AS (SELECT *, sum(rel) OVER (ORDER BY pos) AS hits FROM r),
    l AS (SELECT sum(c * (c - 1) / 2) AS l FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))
    SELECT round(sum(rel * hits / pos) / max(l), 6) AS average_precision, round(sum(CASE WHEN pos <= l THEN rel ELSE 0 END) / max(l), 6) AS r_precision, sum(CASE WHEN pos <= 10 THEN rel ELSE 0 END) / 10.0::DOUBLE AS precision_at FROM h, l"""
)
def link_ranking(spark, d):
    r = Z.link_ranking(G.undirected(knn(spark, d)), truth(spark, d))
    return r.select(F.round("average_precision", 6).alias("average_precision"), F.round("r_precision", 6).alias("r_precision"), F.col("precision_at").cast("double").alias("precision_at"))


def _histogram(spark, d):
    """Distances of all pairs in bins, by same and different author."""
    return W.pair_histogram(_docs(spark, d))


_HIST = f"{_P}, g AS (SELECT -floor(distance / 0.04::DOUBLE) AS bin, sum((a.label = b.label)::INT) AS pos, sum((a.label <> b.label)::INT) AS neg FROM p JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE src < dst GROUP BY 1)"


@query(f"WITH {_HIST}, w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM w")
def hist_auc(spark, d):
    return Z.auc_from_histogram(_histogram(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_HIST}, w AS (SELECT pos, sum(pos) OVER (ORDER BY bin DESC) AS tp, sum(pos + neg) OVER (ORDER BY bin DESC) AS al FROM g) SELECT round(sum(pos * tp / al) / sum(pos), 6) AS ap FROM w")
def hist_ap(spark, d):
    return Z.ap_from_histogram(_histogram(spark, d)).select(F.round("ap", 6).alias("ap"))


@query("SELECT sum(c)::BIGINT AS docs, count(*) AS authors, sum(c * (c - 1) / 2)::DOUBLE AS true_links, round(sum(c * (c - 1) / 2) / (sum(c) * (sum(c) - 1) / 2), 9) AS prevalence FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)")
def collection_shape(spark, d):
    return Z.shape_of_collection(truth(spark, d)).select("docs", "authors", F.col("true_links").cast("double").alias("true_links"), F.round("prevalence", 9).alias("prevalence"))


@query(f"WITH RECURSIVE {_T} SELECT c.id, round(n / in_cluster, 6) AS precision, round(n / by_author, 6) AS recall FROM c JOIN embeddings l ON c.id = l.vec_id JOIN t ON t.cluster = c.cluster AND t.author = l.label")
def per_document_bcubed(spark, d):
    return Z.per_document(parts(spark, d), truth(spark, d)).select("id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def pooled_cluster_argmax(spark, d):
    from .attribution import scored

    s, t = scored(spark, d)
    return K.pooled_argmax(s, parts(spark, d).select(F.col("id").alias("q"), "cluster").join(t, "q", "left_semi"))


@query(
    """WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT a.event_id AS src, b.event_id AS dst FROM e a JOIN e b ON b.pos BETWEEN a.pos + 1 AND a.pos + 3"""
)
def temporal_adjacent_edges(spark, d):
    return G.adjacent_in_time(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), 3, "ts", "id")


@query()
def temporal_fusion(spark, d):
    times = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3600.0).alias("seconds"))
    return G.temporal_fusion(G.undirected(knn(spark, d)), times)


def _clustering(name: str, f):
    @query(name=name)
    def run(spark, d):
        return f(nodes(spark, d), G.undirected(knn(spark, d)))

    return run


_clustering("agglomerative", lambda n, e: G.agglomerative(n, e, CUT))
_clustering("capped_linkage", lambda n, e: G.capped_linkage(n, e, CUT))
_clustering("hdbscan", lambda n, e: G.density_clusters(n, e))
_clustering("leiden", lambda n, e: G.communities(n, e))


@query(
    f"""WITH {_K}, n AS (SELECT vec_id AS src, label, count(*) OVER (PARTITION BY label) - 1 AS others FROM embeddings), x AS (SELECT k, knn.src, a.others, sum((a.label = b.label)::INT) AS s, count(*) AS c FROM knn JOIN n a ON knn.src = a.src JOIN n b ON knn.dst = b.src, (VALUES (1), (3), (5)) v(k) WHERE rank <= k GROUP BY ALL)
    SELECT k, round(avg(CASE WHEN others > 0 THEN (s > 0)::INT::DOUBLE END), 6) AS hit, round(avg(CASE WHEN others > 0 THEN s / least(others, k)::DOUBLE END), 6) AS recall, round(sum(s) / sum(c), 6) AS purity FROM x GROUP BY k"""
)
def graph_diagnostics(spark, d):
    g = X.graph_diagnostics(knn(spark, d), truth(spark, d))
    return g.select("k", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "purity")])


@query(
    """WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label HAVING count(*) > 1), n AS (SELECT count(*) - 1 AS pool FROM embeddings),
    m AS (SELECT label, c, exp(sum(ln((pool - (c - 1) - i) / (pool - i)::DOUBLE))) AS miss FROM c, n, range(0, 5) t(i) GROUP BY ALL) SELECT 5 AS k, round(sum(c * (1 - miss)) / sum(c), 6) AS hit FROM m"""
)
def random_neighbor_hit(spark, d):
    return X.random_hit(truth(spark, d), 5).select("k", F.round("hit", 6).alias("hit"))


@query(
    """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings) SELECT round(1 - avg(CASE WHEN a.label = b.label THEN list_cosine_similarity(a.x, b.x) END), 5) AS within,
    round(1 - avg(CASE WHEN a.label <> b.label THEN list_cosine_similarity(a.x, b.x) END), 5) AS between FROM v a JOIN v b ON a.id <> b.id"""
)
def within_between_means(spark, d):
    w = X.within_and_between(table(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return w.select(F.round("within", 5).alias("within"), F.round("between", 5).alias("between"))


@query()
def zscored_edges(spark, d):
    e = table(spark, d, "embeddings")
    return X.zscore_distances(G.undirected(knn(spark, d)), X.moments(e, "vec_id", "embedding"))


def _features(spark, d):
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3600.0).alias("seconds"), F.when(F.col("vec_id") % 3 == 0, "en").otherwise("de").alias("lang"))
    return cut(X.pair_features(knn(spark, d), docs, LOCALITY))


@query()
def pair_features(spark, d):
    return _features(spark, d)


@query()
def edge_model(spark, d):
    f, t = _features(spark, d), truth(spark, d)
    labelled = f.join(t.toDF("src", "a1"), "src").join(t.toDF("dst", "a2"), "dst").withColumn("label", (F.col("a1") == F.col("a2")).cast("double")).drop("a1", "a2")
    return X.edge_model(labelled, f)


@query()
def edge_signals(spark, d):
    return X.signal_auroc(_features(spark, d), truth(spark, d), ("distance", "log_gap", "shared"))


@query()
def budget_frontier(spark, d):
    return X.budget_frontier(nodes(spark, d), G.undirected(knn(spark, d)), truth(spark, d), [50, 200, 800])


@query(
    """WITH t AS (SELECT coalesce(source, '<missing>') || '|' || coalesce(lang, '<missing>') AS cluster, author_id AS author FROM documents WHERE author_id IS NOT NULL), m AS (SELECT cluster, author, count(*) AS n FROM t GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY author) AS a FROM m), b AS (SELECT sum(n * n / c) / sum(n) AS p, sum(n * n / a) / sum(n) AS r FROM w) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM b"""
)
def metadata_baseline(spark, d):
    docs = table(spark, d, "documents").where("author_id is not null")
    parts = U.metadata_partition(docs, "doc_id", "source", "lang")
    b = Z.bcubed(Z.contingency(parts, docs.select(F.col("doc_id").alias("id"), F.col("author_id").alias("author"))))
    return b.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def random_baseline(spark, d):
    return U.random_partition(parts(spark, d))


@query()
def fragment_chains(spark, d):
    i = table(spark, d, "identity_intervals")
    p = B.interval_pairs(i, ["accept_language", "device_info", "country"])
    block = i.groupBy("author_id").agg(F.min(F.concat_ws("|", "accept_language", "device_info", "country")).alias("block")).withColumnRenamed("author_id", "a")
    return U.temporal_chains(p.join(block, "a").select("block", "a", "b", (-F.col("gap_days")).alias("lift")), i.where("author_id is not null"))


# --- sweeps -------------------------------------------------------------------------------------------------------------
def _docs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("author"), F.col("embedding").alias("vec"))


def _times(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3600.0).alias("seconds"))


@query()
def sweep_graph(spark, d):
    return W.sweep_graph(knn(spark, d), nodes(spark, d), truth(spark, d), ks=(5,), quantiles=(0.1,))


@query()
def sweep_algorithms(spark, d):
    return W.sweep_algorithms(nodes(spark, d), G.undirected(knn(spark, d)), truth(spark, d), quantiles=(0.1,))


@query()
def sweep_caps(spark, d):
    return W.sweep_caps(nodes(spark, d), G.undirected(knn(spark, d)), truth(spark, d), caps=(5, 20), cohesions=(0.3,))


@query()
def oracle_sweep(spark, d):
    t = truth(spark, d)
    s = lambda part: W.sweep_algorithms(nodes(spark, d), G.undirected(knn(spark, d)), t.where(part), ("components",), (0.1, 0.3))
    return W.oracle_sweep(s("id % 2 = 0"), s("id % 2 = 1"))


@query()
def time_weight_sweep(spark, d):
    return W.tune_time_weight(nodes(spark, d), G.undirected(knn(spark, d)), _times(spark, d), truth(spark, d), weights=(0.0, 0.3))


@query()
def balanced_time_weight(spark, d):
    return W.balanced_weight(G.undirected(knn(spark, d)), _times(spark, d))


@query()
def slice_diagnostics(spark, d):
    return W.slice_diagnostics("all", knn(spark, d), truth(spark, d))


@query(f"WITH RECURSIVE {_T} SELECT author < 5 AS seen, sum(n)::BIGINT AS docs, round(sum(n * n / in_cluster) / sum(n), 6) AS precision, round(sum(n * n / by_author) / sum(n), 6) AS recall FROM t GROUP BY 1")
def seen_unseen_bcubed(spark, d):
    t = truth(spark, d)
    return W.seen_and_unseen(parts(spark, d), t, t.where("author < 5")).select("seen", "docs", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def bcubed_by_language(spark, d):
    g = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"))
    return W.bcubed_by(parts(spark, d), truth(spark, d), g)


@query()
def mined_pairs(spark, d):
    return W.mined_pairs(knn(spark, d), truth(spark, d))


@query()
def edge_network(spark, d):
    k, t = knn(spark, d), truth(spark, d)
    return W.edge_network(W.mined_pairs(k, t), G.undirected(k), _docs(spark, d))


@query()
def contrastive_scores(spark, d):
    from ..operators import attacks as A
    from .attribution import sides

    k, u = sides(spark, d)
    m = W.contrastive_projection(k)
    return A.centroid(A.project(k, m), A.project(u, m)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE {_T}, c2 AS (SELECT DISTINCT cluster, in_cluster FROM t), a2 AS (SELECT author, max(by_author) AS n, count(*) AS k, max(n) AS top, bool_or(n = by_author AND n = in_cluster) AS whole FROM t GROUP BY author)
    SELECT (SELECT count(*) FROM c2) AS clusters, (SELECT max(in_cluster) FROM c2)::BIGINT AS largest, (SELECT quantile_cont(in_cluster, 0.5) FROM c2)::DOUBLE AS median_size, round(avg(top / n::DOUBLE), 6) AS mean_largest_share, round(avg(CASE WHEN n > 1 THEN (top > 1)::INT END), 6) AS any_link_rate,
    round(avg(whole::INT), 6) AS reassembled_rate, round(count(*) / sum(n), 6) AS singleton_recall, round(sum(n * n) / (sum(n) * sum(n)), 6) AS single_precision FROM a2"""
)
def clustering_report(spark, d):
    r = Z.full_report(contingency(spark, d))
    return r.select("clusters", "largest", "median_size", *[F.round(c, 6).alias(c) for c in ("mean_largest_share", "any_link_rate", "reassembled_rate", "singleton_recall", "single_precision")])
