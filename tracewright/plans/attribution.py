"""Queries of attribution: scores of known authors for unknown documents, and their metrics, on ``embeddings``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import attacks as A
from ..operators import detection as E
from ..operators import ranking as K
from ..operators import resampling as M
from ..operators import timeline as L
from ..operators import tuning as U
from ..runtime import cut, table
from .registry import query

#: Label whose documents stand for strangers in open-set queries: its documents are left out of the known side.
STRANGER = 9


def sides(spark, d, strangers: bool = False):
    """Known and unknown documents of ``embeddings`` by place in time, the vector ids' order."""
    e = L.split_known(table(spark, d, "embeddings"), "vec_id").select(F.col("vec_id").alias("doc"), F.col("label").alias("author"), F.col("embedding").alias("vec"), "side", "pos")
    e = cut(e)
    known = e.where("side = 'known'")
    return (known.where(F.col("author") != STRANGER) if strangers else known), e.where("side = 'unknown'")


def truth(unknown):
    return unknown.select(F.col("doc").alias("q"), "author")


def scored(spark, d, strangers: bool = False):
    k, u = sides(spark, d, strangers)
    return cut(A.nearest(k, u).withColumn("score", F.round("score", 9))), truth(u)


_E = "e AS (SELECT vec_id AS doc, label AS author, embedding::DOUBLE[] AS vec, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)"
_SIDES = f"{_E}, k AS (SELECT * FROM e WHERE pos < round_even(0.75 * n, 0)), u AS (SELECT * FROM e WHERE pos >= round_even(0.75 * n, 0))"
_S = f"{_SIDES}, s AS (SELECT u.doc AS q, u.author AS author, k.author AS label, round(max(list_cosine_similarity(u.vec, k.vec)), 9) AS score FROM u, k GROUP BY ALL)"
_OPEN = f"{_SIDES}, s AS (SELECT u.doc AS q, u.author AS author, k.author AS label, round(max(list_cosine_similarity(u.vec, k.vec)), 9) AS score FROM u, k WHERE k.author <> {STRANGER} GROUP BY ALL)"
_R = f"{_S}, t AS (SELECT q, author, score AS ts FROM s WHERE author = label), r AS (SELECT s.q, t.author, sum((s.score > t.ts)::INT) + 1 + (sum((s.score = t.ts)::INT) - 1) / 2.0 AS rank, count(*) AS pool FROM s JOIN t ON s.q = t.q GROUP BY ALL)"
_BEST = "b AS (SELECT q, any_value(author) AS author, arg_max(label, score) AS label, max(score) AS score, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM s GROUP BY q)"
_REJ = f"{_OPEN}, {_BEST}, o AS (SELECT q, round(-(score - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 9) AS score, author = {STRANGER} AS is_out, author = label AS correct FROM b)"


@query(f"WITH {_R} SELECT round(avg((rank <= 1)::DOUBLE), 6) AS top1, round(avg((rank <= 3)::DOUBLE), 6) AS top3, count(*) AS docs FROM r")
def nn_top1(spark, d):
    s, t = scored(spark, d)
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6)
    return K.true_ranks(s, t).agg(hit(1).alias("top1"), hit(3).alias("top3"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH {_E} SELECT doc, CASE WHEN pos < round_even(0.75 * n, 0) THEN 'known' ELSE 'unknown' END AS side, pos FROM e")
def timeline_known_unknown(spark, d):
    return L.split_known(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc")), "doc")


@query(
    f"""WITH {_E}, f AS (SELECT author, min(pos) AS first FROM e GROUP BY author) SELECT count(*) AS docs, sum((first >= round_even(0.5625 * n, 0))::INT)::BIGINT AS unseen, sum((first >= round_even(0.5625 * n, 0))::INT) / count(*)::DOUBLE AS share
    FROM e JOIN f USING (author) WHERE pos >= round_even(0.5625 * n, 0) AND pos < round_even(0.75 * n, 0)"""
)
def ood_prior(spark, d):
    return L.unseen_share(table(spark, d, "embeddings"), "label", "vec_id")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT round((min(CASE WHEN pos >= round_even(0.75 * n, 0) THEN epoch_us(o_orderdate) END) - max(CASE WHEN pos < round_even(0.75 * n, 0) THEN epoch_us(o_orderdate) END)) / 1e6 / 604800.0, 9) AS gap_weeks FROM o"""
)
def gap_weeks(spark, d):
    o = L.split_known(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return L.gap_weeks(o, "o_orderdate").select(F.round("gap_weeks", 9).alias("gap_weeks"))


@query("SELECT vec_id, (i - 1)::BIGINT AS i, round(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings, range(1, 65) t(i)")
def unit_norm(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.unit("embedding")).alias("i", "x"))
    return u.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(
    f"""WITH {_SIDES}, x AS (SELECT i, avg(vec[i]) AS m, stddev_pop(vec[i]) AS s FROM k, range(1, 65) t(i) GROUP BY i)
    SELECT doc, (i - 1)::BIGINT AS i, round((vec[i] - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS x FROM u, x"""
)
def zscore_known_side(spark, d):
    k, u = sides(spark, d)
    z = A.standardise(k, u)[1].select("doc", F.posexplode("vec").alias("i", "x"))
    return z.select("doc", F.col("i").cast("bigint").alias("i"), F.round("x", 5).alias("x"))


@query(f"WITH {_SIDES} SELECT author, i - 1 AS i, round(avg(vec[i]), 6) AS mean FROM k, range(1, 65) t(i) GROUP BY ALL")
def class_means(spark, d):
    m = A.class_means(sides(spark, d)[0])
    return m.select("author", F.posexplode("vec").alias("i", "x")).select("author", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("mean"))


@query(f"WITH {_S} SELECT q, label, round(score, 6) AS score FROM s")
def nn_scores_max(spark, d):
    return scored(spark, d)[0].withColumn("score", F.round("score", 6))


@query(f"WITH {_SIDES} SELECT u.doc AS q, k.author AS label, round(avg(list_cosine_similarity(u.vec, k.vec)), 6) AS score FROM u, k GROUP BY ALL")
def nn_scores_mean(spark, d):
    return A.nearest(*sides(spark, d), linkage="mean").withColumn("score", F.round("score", 6))


@query(f"WITH {_SIDES} SELECT u.doc AS q, k.author AS label, round(-min(list_distance(u.vec, k.vec)), 5) AS score FROM u, k GROUP BY ALL")
def euclidean_nn(spark, d):
    return A.nearest(*sides(spark, d), metric="euclidean").withColumn("score", F.round("score", 5))


@query(
    f"""WITH {_SIDES}, c AS (SELECT author, list(x ORDER BY i) AS vec FROM (SELECT author, i, avg(vec[i] / sqrt(list_dot_product(vec, vec))) AS x FROM k, range(1, 65) t(i) GROUP BY ALL) GROUP BY author)
    SELECT u.doc AS q, c.author AS label, round(list_cosine_similarity(u.vec, c.vec), 6) AS score FROM u, c"""
)
def centroid_cosine(spark, d):
    return A.centroid(*sides(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_R} SELECT q, author, rank, pool FROM r")
def true_author_rank(spark, d):
    return K.true_ranks(*scored(spark, d)).select("q", "author", "rank", "pool")


@query(
    f"""WITH {_R}, x AS (SELECT k, author, sum((rank <= k)::INT) AS h, count(*) AS n FROM r, (VALUES (1), (5), (10)) v(k) GROUP BY ALL)
    SELECT k, round(sum(h) / sum(n), 6) AS conv_acc, round(avg((h > 0)::DOUBLE), 6) AS id_acc, round(avg(h / n::DOUBLE), 6) AS macro_acc FROM x GROUP BY k"""
)
def topk_conv_identity(spark, d):
    t = K.top_k(K.true_ranks(*scored(spark, d)))
    return t.select("k", *[F.round(c, 6).alias(c) for c in ("conv_acc", "id_acc", "macro_acc")])


@query(f"WITH {_R} SELECT k::BIGINT AS k, round(avg((ceil(rank) <= k)::DOUBLE), 6) AS accuracy FROM r, range(1, (SELECT max(pool) + 1 FROM r)) t(k) GROUP BY k")
def cmc_curve(spark, d):
    return K.cmc(K.true_ranks(*scored(spark, d))).withColumn("accuracy", F.round("accuracy", 6))


@query(
    f"""WITH {_R} SELECT round(avg(1 / rank), 6) AS mrr, quantile_cont(rank, 0.5) AS median_rank, round(avg(rank), 6) AS mean_rank, round(avg(CASE WHEN pool > 1 THEN 1 - (rank - 1) / (pool - 1) ELSE 1 END), 6) AS percentile_rank,
    round(avg((SELECT sum(1.0 / i) FROM range(1, 100) t(i) WHERE i <= pool) / pool), 6) AS uniform_mrr, count(*) AS n FROM r"""
)
def mrr_summary(spark, d):
    s = K.summary(K.true_ranks(*scored(spark, d)))
    return s.select(F.round("mrr", 6).alias("mrr"), "median_rank", F.round("mean_rank", 6).alias("mean_rank"), F.round("percentile_rank", 6).alias("percentile_rank"), F.round("uniform_mrr", 6).alias("uniform_mrr"), "n")


@query(
    f"""WITH {_S}, {_BEST}, g AS (SELECT author, count(*) AS n, sum((author = label)::INT) AS tp FROM b GROUP BY author), p AS (SELECT label AS author, count(*) AS m FROM b GROUP BY label)
    SELECT round(avg(2 * tp / (n + coalesce(m, 0))::DOUBLE), 6) AS macro_f1 FROM g LEFT JOIN p USING (author)"""
)
def macro_f1(spark, d):
    s, t = scored(spark, d)
    return K.macro_f1(K.best(s), t).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {_R} SELECT author, count(*) AS n, min(rank) AS best_rank, quantile_cont(rank, 0.5) AS median_rank, round(avg((rank <= 1)::DOUBLE), 6) AS top1, min(rank) <= 10 AS any10 FROM r GROUP BY author")
def per_author_ranking(spark, d):
    return K.per_author(K.true_ranks(*scored(spark, d))).select("author", "n", "best_rank", "median_rank", F.round("top1", 6).alias("top1"), "any10")


@query(
    f"""WITH {_S}, o AS (SELECT author, count(DISTINCT q) AS n_relevant FROM s GROUP BY author), z AS (SELECT s.label AS author, s.q, s.score, (s.author = s.label)::INT AS rel FROM s),
    g AS (SELECT author, score, sum(rel) AS hits, count(*) AS c FROM z GROUP BY ALL), w AS (SELECT author, hits, sum(hits) OVER (PARTITION BY author ORDER BY score DESC) / sum(c) OVER (PARTITION BY author ORDER BY score DESC) AS prec FROM g),
    p AS (SELECT author, sum(hits * prec) AS s FROM w GROUP BY author), rk AS (SELECT author, rel, row_number() OVER (PARTITION BY author ORDER BY score DESC, q) AS r FROM z),
    rp AS (SELECT rk.author, sum(rel) AS top FROM rk JOIN o ON rk.author = o.author WHERE r <= n_relevant GROUP BY rk.author)
    SELECT o.author, n_relevant, round(p.s / n_relevant, 6) AS average_precision, round(rp.top / n_relevant, 6) AS r_precision, round(n_relevant / (SELECT count(DISTINCT q) FROM s), 6) AS baseline FROM o JOIN p USING (author) JOIN rp USING (author)"""
)
def author_query_ap(spark, d):
    return K.retrieval(*scored(spark, d)).select("author", "n_relevant", *[F.round(c, 6).alias(c) for c in ("average_precision", "r_precision", "baseline")])


@query(
    f"""WITH {_S}, o AS (SELECT author, count(DISTINCT q) AS n_relevant FROM s GROUP BY author), z AS (SELECT s.label AS author, s.q, s.score, (s.author = s.label)::INT AS rel FROM s),
    g AS (SELECT author, score, sum(rel) AS hits, count(*) AS c FROM z GROUP BY ALL), w AS (SELECT author, hits, sum(hits) OVER (PARTITION BY author ORDER BY score DESC) / sum(c) OVER (PARTITION BY author ORDER BY score DESC) AS prec FROM g),
    p AS (SELECT author, sum(hits * prec) AS s FROM w GROUP BY author) SELECT round(avg(p.s / n_relevant), 6) AS map, round(avg(n_relevant / (SELECT count(DISTINCT q) FROM s)), 6) AS baseline, count(*) AS authors FROM o JOIN p USING (author)"""
)
def map_summary(spark, d):
    m = K.map_summary(K.retrieval(*scored(spark, d)))
    return m.select(F.round("map", 6).alias("map"), F.round("baseline", 6).alias("baseline"), "authors")


@query(
    f"""WITH {_SIDES}, c AS (SELECT author, count(*) AS c FROM u GROUP BY author) SELECT k, round(avg(1 - pow(1 - least(k, 10) / 10.0, c)), 6) AS accuracy FROM c, (VALUES (1), (5), (10)) v(k) GROUP BY k"""
)
def random_guessing(spark, d):
    return K.random_guessing(truth(sides(spark, d)[1]), 10).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_R}, x AS (SELECT k, author, 1 - exp(sum(ln(greatest(1 - least(k, pool) / pool::DOUBLE, 1e-300)))) AS p FROM r, (VALUES (1), (5), (10)) v(k) GROUP BY ALL) SELECT k, round(avg(p), 6) AS accuracy FROM x GROUP BY k")
def random_identity_log(spark, d):
    return K.random_identity(K.true_ranks(*scored(spark, d))).withColumn("accuracy", F.round("accuracy", 6))


# --- open set -----------------------------------------------------------------------------------------------------------
def opened(spark, d):
    s, t = scored(spark, d, strangers=True)
    b = K.best(s)
    r = E.rejection(b).withColumn("score", F.round("score", 9))
    return cut(r.join(b.select("q", "label"), "q").join(t, "q").select("q", "score", (F.col("author") == STRANGER).alias("is_out"), (F.col("author") == F.col("label")).alias("correct")))


@query(f"WITH {_S} SELECT q, label, round((score - avg(score) OVER (PARTITION BY q)) / stddev_pop(score) OVER (PARTITION BY q), 5) AS score FROM s")
def cohort_znorm(spark, d):
    return K.z_by_document(scored(spark, d)[0]).withColumn("score", F.round("score", 5))


@query(f"WITH {_REJ} SELECT q, round(score, 6) AS score, is_out, correct FROM o")
def rejection_score(spark, d):
    return opened(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_REJ}, r AS (SELECT is_out, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM o) SELECT round((sum(r) FILTER (is_out) - count(*) FILTER (is_out) * (count(*) FILTER (is_out) + 1) / 2) / (count(*) FILTER (is_out) * count(*) FILTER (NOT is_out)), 6) AS auroc FROM r")
def auroc(spark, d):
    return E.auroc(opened(spark, d)).select(F.round("auroc", 6).alias("auroc"))


@query()
def equal_error_rate(spark, d):
    return E.equal_error_rate(opened(spark, d))


@query(f"WITH {_REJ}, t AS (SELECT 0.05::DOUBLE AS far, quantile_cont(score, 0.05) AS th FROM o WHERE is_out UNION ALL SELECT 0.1::DOUBLE, quantile_cont(score, 0.1) FROM o WHERE is_out UNION ALL SELECT 0.2::DOUBLE, quantile_cont(score, 0.2) FROM o WHERE is_out) SELECT far, round(th, 6) AS threshold, round(avg((score <= th AND correct)::INT::DOUBLE), 6) AS dir FROM o, t WHERE NOT is_out GROUP BY far, th")
def dir_at_far(spark, d):
    return E.dir_at_far(opened(spark, d)).select("far", F.round("threshold", 6).alias("threshold"), F.round("dir", 6).alias("dir"))


@query(f"WITH {_REJ} SELECT round((sum((correct AND score <= -2)::INT) + sum((score > -2)::INT) * sum((correct AND score <= -2)::INT) / count(*)) / count(*), 6) AS c_at_1 FROM o")
def c_at_1(spark, d):
    o = opened(spark, d).withColumn("answered", F.col("score") <= -2)
    return E.c_at_1(o).select(F.round("c_at_1", 6).alias("c_at_1"))


_CONF = f"{_S}, {_BEST}, c AS (SELECT s.q, round(1 / sum(exp(s.score - b.score)), 9) AS confidence, any_value(b.author = b.label) AS correct FROM s JOIN b ON s.q = b.q GROUP BY s.q)"


def confident(spark, d):
    s, t = scored(spark, d)
    b = K.best(s).join(t, "q").select("q", (F.col("label") == F.col("author")).alias("correct"))
    return cut(E.max_softmax(s).withColumn("confidence", F.round("confidence", 9)).join(b, "q"))


@query(f"WITH {_CONF} SELECT q, round(confidence, 6) AS confidence FROM c")
def max_softmax(spark, d):
    return confident(spark, d).select("q", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_CONF}, r AS (SELECT correct, row_number() OVER (ORDER BY confidence DESC, q) AS r, count(*) OVER () AS n FROM c), g AS (SELECT coverage, greatest(1, round_even(coverage * n, 0))::BIGINT AS a FROM r, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(coverage) GROUP BY ALL)
    SELECT coverage, a AS n_answered, round(sum(correct::INT) / a, 6) AS precision, round(sum(correct::INT) / max(n), 6) AS recall FROM r, g WHERE r <= a GROUP BY coverage, a"""
)
def selective_curve(spark, d):
    s = E.selective(confident(spark, d))
    return s.select("coverage", "n_answered", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {_CONF}, g AS (SELECT greatest(0, least(9, ceil(confidence * 10) - 1)) AS bin, count(*) AS n, sum(confidence) AS cf, sum(correct::INT) AS ac, sum(pow(confidence - correct::INT, 2)) AS sq FROM c GROUP BY 1)
    SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(cf - ac)) / sum(n), 6) AS ece, round(max(abs(cf - ac) / n), 6) AS mce, round(sum(cf) / sum(n), 6) AS confidence, round(sum(ac) / sum(n), 6) AS accuracy FROM g"""
)
def calibration_ece(spark, d):
    return E.calibration(confident(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("brier", "ece", "mce", "confidence", "accuracy")])


@query(
    f"""WITH {_REJ}, h AS (SELECT quantile_cont(score, {[p / 100 for p in range(1, 100)]}::DOUBLE[]) AS q FROM o), g AS (SELECT p::INT AS percentile, h.q[p] AS threshold FROM h, range(1, 100) t(p))
    SELECT percentile, round(avg((score <= threshold + 1e-12)::INT), 6) AS accepted, round(avg(CASE WHEN NOT is_out THEN (score <= threshold + 1e-12 AND correct)::INT END), 6) AS dir, round(avg(CASE WHEN is_out THEN (score <= threshold + 1e-12)::INT END), 6) AS far FROM o, g GROUP BY percentile"""
)
def threshold_sweep(spark, d):
    return E.threshold_sweep(opened(spark, d)).select("percentile", *[F.round(c, 6).alias(c) for c in ("accepted", "dir", "far")])


@query()
def rejection_features(spark, d):
    return E.rejection_features(scored(spark, d)[0])


# --- reranking and fusion -----------------------------------------------------------------------------------------------
@query(f"WITH {_S} SELECT q, label, slot FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS slot FROM s) WHERE slot < 5")
def shortlist_topk(spark, d):
    return K.shortlist(scored(spark, d)[0], 5).select("q", "label", "slot")


@query(
    f"""WITH {_SIDES}, p AS (SELECT u.doc AS q, k.author AS label, k.doc AS known_doc, round(list_cosine_similarity(u.vec, k.vec), 9) AS c FROM u, k WHERE u.doc % 100 = 0)
    SELECT q, label, known_doc FROM (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY c DESC, known_doc) AS r FROM p) WHERE r = 1"""
)
def nearest_doc_per_author(spark, d):
    """Evidence for the stated query set, ids divisible by 100: of each author the known document nearest to it."""
    from ..operators.blocks import author_scores

    k, u = sides(spark, d)
    s = author_scores(u.where("doc % 100 = 0").select(F.col("doc").alias("q"), "vec"), k.select(F.col("doc").alias("g"), F.col("doc").alias("label"), "vec"))
    s = s.withColumn("c", F.round("score", 9)).join(k.select(F.col("doc").alias("label"), "author"), "label")
    return s.groupBy("q", "author").agg(F.max(F.struct("c", (-F.col("label")).alias("d"))).alias("x")).select("q", F.col("author").alias("label"), (-F.col("x.d")).alias("known_doc"))


@query(
    f"""WITH {_S}, sl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS slot, max(score) OVER (PARTITION BY q) AS mx FROM s)
    SELECT q, label, round(CASE WHEN slot < 5 THEN mx + slot + 1 ELSE score END, 6) AS score FROM sl"""
)
def listwise_fold(spark, d):
    """Every shortlist turned round, as the judge of a test would do it."""
    s = scored(spark, d)[0]
    short = K.shortlist(s, 5)
    orders = short.groupBy("q").agg(F.sort_array(F.collect_list("slot"), False).alias("ranking"))
    return K.fold(s, short, orders).withColumn("score", F.round("score", 6))


@query(f"WITH {_S}, m AS (SELECT q, max(score) AS mx FROM s GROUP BY q) SELECT s.q, s.label, round(CASE WHEN s.label = 0 THEN mx + 1 ELSE s.score END, 6) AS score FROM s JOIN m USING (q)")
def promoted_choice(spark, d):
    s = scored(spark, d)[0]
    return K.promote(s, s.where("label = 0").select("q", "label")).withColumn("score", F.round("score", 6))


@query()
def elo_round(spark, d):
    s = scored(spark, d)[0]
    r = K.shortlist(s, 6).select("q", "label", (F.lit(1500.0) - F.col("slot")).alias("rating"))
    return K.elo_round(r, lambda a, b: a < b)


@query(
    f"""WITH {_S}, sl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS slot, max(score) OVER (PARTITION BY q) AS mx FROM s), t AS (SELECT q, author, label, score AS b, CASE WHEN slot < 5 THEN mx + slot + 1 ELSE score END AS a FROM sl),
    o AS (SELECT q, b AS ob, a AS oa FROM t WHERE author = label), r AS (SELECT t.q, sum((b > ob)::INT) + 1 + (sum((b = ob)::INT) - 1) / 2.0 <= 1 AS b, sum((a > oa)::INT) + 1 + (sum((a = oa)::INT) - 1) / 2.0 <= 1 AS a FROM t JOIN o ON t.q = o.q GROUP BY t.q)
    SELECT sum((NOT b AND a)::INT)::BIGINT AS rescued, sum((b AND NOT a)::INT)::BIGINT AS damaged, (sum((NOT b AND a)::INT) - sum((b AND NOT a)::INT))::BIGINT AS net, sum((b AND a)::INT)::BIGINT AS kept_right, sum((NOT b AND NOT a)::INT)::BIGINT AS kept_wrong FROM r"""
)
def rescue_counts(spark, d):
    s, t = scored(spark, d)
    short = K.shortlist(s, 5)
    orders = short.groupBy("q").agg(F.sort_array(F.collect_list("slot"), False).alias("ranking"))
    return K.rescue_counts(K.true_ranks(s, t), K.true_ranks(K.fold(s, short, orders), t))


@query(
    f"""WITH {_S}, c AS (SELECT author, list(x ORDER BY i) AS vec FROM (SELECT author, i, avg(vec[i] / sqrt(list_dot_product(vec, vec))) AS x FROM k, range(1, 65) t(i) GROUP BY ALL) GROUP BY author),
    c2 AS (SELECT u.doc AS q, c.author AS label, list_cosine_similarity(u.vec, c.vec) AS score FROM u, c), m1 AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM s), m2 AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM c2)
    SELECT s.q, s.label, round((s.score - m1.m) / m1.d + 0.5 * (c2.score - m2.m) / m2.d, 5) AS score FROM s JOIN c2 ON s.q = c2.q AND s.label = c2.label, m1, m2"""
)
def late_fusion(spark, d):
    k, u = sides(spark, d)
    return K.late_fusion(A.nearest(k, u), A.centroid(k, u), 0.5).withColumn("score", F.round("score", 5))


@query(
    """WITH a AS (SELECT DISTINCT author_id, lang FROM documents WHERE author_id IS NOT NULL AND lang IS NOT NULL), q AS (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND doc_id % 100 = 0)
    SELECT q.doc_id AS q, a.author_id AS label FROM q JOIN a ON q.lang = a.lang"""
)
def language_filter_candidates(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), F.array("lang").alias("langs"))
    known = docs.where("author_id is not null").groupBy(F.col("author_id").alias("author")).agg(F.collect_set("lang").alias("langs"))
    return K.eligible_by_language(q, known)


# --- models -------------------------------------------------------------------------------------------------------------
def _model(name: str, attack):
    @query(name=name)
    def run(spark, d):
        return attack(*sides(spark, d)).withColumn("score", F.round("score", 6))

    return run


for _name, _attack in (
    ("wccn_scores", A.wccn), ("lda_scores", A.lda), ("lda_wccn_scores", A.lda_wccn), ("plda_scores", A.plda), ("rlsc_scores", A.ridge),
    ("logistic_scores", A.logistic), ("svm_scores", A.support_vectors), ("cross_encoder", A.verification),
):
    _model(_name, _attack)


@query()
def gbt_scores(spark, d):
    return A.boosted_trees(*sides(spark, d), rounds=2, depth=2)


@query()
def gallery_scaling(spark, d):
    return M.gallery_view(*scored(spark, d), sizes=(2, 4, 6, 8, 10))


@query()
def impostor_survival(spark, d):
    s, t = scored(spark, d)
    tails = M.impostor_tails(s, t)
    g = s.join(t, "q").where("label = author").select("q", F.col("score").alias("genuine"))
    return M.survival(tails, g, 1000.0)


@query()
def accuracy_interval(spark, d):
    r = K.true_ranks(*scored(spark, d))
    per = r.groupBy("author").agg(F.sum((F.col("rank") <= 1).cast("double")).alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    return M.ratio_interval(per)


@query("SELECT c, round(sqrt((1 - c * c) / (c * c * 3072)), 9) AS sigma, round(2 / pow(sqrt((1 - c * c) / (c * c * 3072)), 2) + 2 / sqrt((1 - c * c) / (c * c * 3072)) * sqrt(2 * ln(1e5)), 4) AS eps_closed FROM (VALUES (0.9::DOUBLE), (0.7::DOUBLE), (0.5::DOUBLE), (0.3::DOUBLE), (0.1::DOUBLE)) v(c)")
def gaussian_bound(spark, d):
    c = spark.createDataFrame(pd.DataFrame({"c": [0.9, 0.7, 0.5, 0.3, 0.1]}))
    s = M.sigma_of_c(F.col("c"), 3072)
    return c.select("c", F.round(s, 9).alias("sigma"), F.round(M.eps_closed(s), 4).alias("eps_closed"))


@query()
def gaussian_exact(spark, d):
    exact = F.pandas_udf(lambda s: M.eps_exact(s), "double")
    c = spark.createDataFrame(pd.DataFrame({"sigma": [0.5, 1.0, 2.0, math.pi]}))
    return c.select("sigma", exact("sigma").alias("eps"))


@query(f"WITH {_R} SELECT k, round(avg(least(k, pool) / pool::DOUBLE), 6) AS accuracy FROM r, (VALUES (1), (5), (10)) v(k) GROUP BY k")
def chance_cmc(spark, d):
    return K.chance_cmc(K.true_ranks(*scored(spark, d))).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_SIDES} SELECT author, round(count(*) / (SELECT count(*) FROM k)::DOUBLE, 6) AS share FROM k GROUP BY author")
def known_author_shares(spark, d):
    return K.author_shares(sides(spark, d)[0]).withColumn("share", F.round("share", 6))


@query(f"WITH {_SIDES}, p AS (SELECT author, count(*) / (SELECT count(*) FROM k)::DOUBLE AS share FROM k GROUP BY author) SELECT round(avg(coalesce(share, 0)), 6) AS accuracy FROM u LEFT JOIN p USING (author)")
def proportional_guess(spark, d):
    k, u = sides(spark, d)
    return K.proportional_guess(k, truth(u)).select(F.round("accuracy", 6).alias("accuracy"))


@query()
def cmc_replicates(spark, d):
    r = K.true_ranks(*scored(spark, d))
    return K.weighted_cmc(r, M.poisson_weights(r.select("author").distinct(), 20))


@query()
def cmc_interpolated(spark, d):
    c = K.cmc(K.true_ranks(*scored(spark, d))).select("k", F.col("accuracy").alias("value"))
    return K.interpolate(c.where("k in (1, 4, 10)"), c.select("k"))


@query(f"WITH {_REJ} SELECT round(quantile_cont(score, 0.1), 6) AS threshold FROM o WHERE is_out")
def calibrated_threshold(spark, d):
    return U.calibrate_threshold(opened(spark, d), 0.1).select(F.round("threshold", 6).alias("threshold"))


@query()
def learned_rejection(spark, d):
    s, t = scored(spark, d, strangers=True)
    f = E.rejection_features(s)
    labelled = f.join(t, "q").withColumn("is_out", F.col("author") == STRANGER).drop("author")
    return U.learned_rejector(labelled, f)


@query()
def open_set_roles(spark, d):
    return U.open_set_fold(sides(spark, d)[0], 0).select("doc", "author", "role")


@query()
def prior_inclusion(spark, d):
    return U.prior_inclusion(K.author_shares(sides(spark, d)[0]), (1, 5))
