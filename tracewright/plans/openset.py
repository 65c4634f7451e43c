"""Queries of open-set curves and growing galleries, on ``embeddings``; numbers of words are those of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gallery as G
from ..operators import openset as O
from ..operators import ranking as K
from ..operators import resampling as M
from ..runtime import cut, table
from .attribution import _BEST, _OPEN, _S, STRANGER, opened, scored, sides
from .registry import query

_T = "t AS (SELECT q, author, score AS ts FROM s WHERE author = label)"
_D = f"""{_OPEN}, {_BEST}, {_T}, r AS (SELECT s.q, sum((s.score > t.ts)::INT) + 1 + (sum((s.score = t.ts)::INT) - 1) / 2.0 AS rank, count(*) AS pool FROM s JOIN t ON s.q = t.q GROUP BY ALL),
d AS (SELECT b.q, b.author, round(-(b.score - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 9) AS score, b.author = {STRANGER} AS is_out, r.rank, r.pool FROM b LEFT JOIN r ON b.q = r.q)"""
_P = f"{_D}, p AS (SELECT author, min(rank) AS rank, min(score) AS score, max(CASE WHEN rank <= 1 THEN -score END) AS hit_score, bool_or(is_out) AS is_out, max(pool) AS pool, count(*) AS n_documents FROM d GROUP BY author)"


def documents(spark, d):
    """``q, author, rank, pool, score, is_out`` of the open-set run."""
    s, t = scored(spark, d, strangers=True)
    ranks = K.true_ranks(s, t).select("q", "rank", "pool")
    return cut(opened(spark, d).select("q", "score", "is_out").join(t, "q").join(ranks, "q", "left"))


def _curve_sql(units: str, events: str) -> str:
    return f"""WITH {units}, ev AS ({events}), nn AS (SELECT sum(o) AS n_out, sum(i) AS n_in FROM ev), g0 AS (SELECT conf, sum(o) AS o, sum(h) AS h FROM ev WHERE conf IS NOT NULL GROUP BY conf),
    c AS (SELECT sum(o) OVER (ORDER BY conf DESC) / n_out AS f, sum(h) OVER (ORDER BY conf DESC) / n_in AS r FROM g0, nn UNION ALL SELECT 0, 0), g AS (SELECT i / 100.0::DOUBLE AS far FROM range(0, 101) t(i)),
    x AS (SELECT far, max(f) FILTER (f <= far) AS pf, max(r) FILTER (f <= far) AS pr, min(f) FILTER (f > far) AS nf, min(r) FILTER (f > far) AS nr FROM g, c GROUP BY far)
    SELECT far, round(CASE WHEN nf IS NULL OR pf = far THEN pr ELSE pr + (nr - pr) * (far - pf) / (nf - pf) END, 6) AS rate FROM x"""


@query(f"WITH {_P} SELECT author, rank, round(score, 6) AS score, round(hit_score, 6) AS hit_score, is_out, n_documents FROM p")
def author_best(spark, d):
    a = O.author_table(documents(spark, d))
    return a.select("author", "rank", F.round("score", 6).alias("score"), F.round("hit_score", 6).alias("hit_score"), "is_out", "n_documents")


@query(_curve_sql(_D, "SELECT -score AS conf, is_out::INT AS o, (NOT is_out AND coalesce(ceil(rank) <= 1, false))::INT AS h, (NOT is_out)::INT AS i FROM d"))
def identification_documents(spark, d):
    return O.identification_curve(documents(spark, d)).withColumn("rate", F.round("rate", 6))


@query(_curve_sql(_P, "SELECT CASE WHEN is_out THEN -score ELSE hit_score END AS conf, is_out::INT AS o, (NOT is_out AND hit_score IS NOT NULL)::INT AS h, (NOT is_out)::INT AS i FROM p"))
def identification_authors(spark, d):
    return O.identification_curve(documents(spark, d), "author").withColumn("rate", F.round("rate", 6))


@query()
def identification_band(spark, d):
    x = documents(spark, d)
    return O.identification_band(x, M.poisson_weights(x.select("author").distinct(), 20))


@query(
    f"""WITH {_P}, kd AS (SELECT n_documents, count(*) AS c FROM p WHERE NOT is_out GROUP BY 1), m AS (SELECT max(pool) AS pool FROM p WHERE NOT is_out), g AS (SELECT i / 100.0::DOUBLE AS far FROM range(0, 101) t(i))
    SELECT far, round(max(far / pool), 6) AS document, round(sum(c * (1 - pow(1 - far / pool, n_documents))) / sum(c), 6) AS author FROM g, kd, m GROUP BY far"""
)
def identification_chance(spark, d):
    return O.chance_lines(documents(spark, d)).select("far", F.round("document", 6).alias("document"), F.round("author", 6).alias("author"))


_TH = "th AS (SELECT max(score) AS threshold FROM (SELECT score, sum(o) OVER (ORDER BY score) AS seen, sum(o) OVER () AS n FROM (SELECT score, sum(is_out::INT) AS o FROM {0} GROUP BY score)) WHERE seen <= floor(0.1 * n))"


@query(f"WITH {_D}, {_TH.format('d')} SELECT round(threshold, 6) AS threshold, round((SELECT avg((score <= threshold)::INT) FROM d WHERE is_out), 6) AS achieved FROM th")
def far_budget_threshold(spark, d):
    return O.threshold_at_far(documents(spark, d), 0.1).select(F.round("threshold", 6).alias("threshold"), F.round("achieved", 6).alias("achieved"))


@query()
def far_budget_threshold_weighted(spark, d):
    x = documents(spark, d)
    w = M.poisson_weights(x.select("author").distinct(), 1).select("author", F.col("w").cast("double").alias("w"))
    return O.threshold_at_far(x.join(w, "author"), 0.1, "w")


@query(f"WITH {_D}, {_TH.format('d')}, a AS (SELECT CASE WHEN score <= threshold AND rank IS NOT NULL THEN ceil(rank) ELSE 1e9 END AS r, pool FROM d, th WHERE NOT is_out) SELECT k::BIGINT AS k, round(avg((r <= k)::INT), 6) AS accuracy FROM a, range(1, (SELECT max(pool) + 1 FROM a)) t(k) GROUP BY k")
def accepted_cmc_documents(spark, d):
    return O.cmc_at_far(documents(spark, d)).select("k", F.round("accuracy", 6).alias("accuracy"))


@query(
    f"""WITH {_P}, {_TH.format('p')}, a AS (SELECT author, min(CASE WHEN score <= threshold AND rank IS NOT NULL THEN ceil(rank) ELSE 1e9 END) AS r, max(pool) AS pool FROM d, th WHERE NOT is_out GROUP BY author)
    SELECT k::BIGINT AS k, round(avg((r <= k)::INT), 6) AS accuracy FROM a, range(1, (SELECT max(pool) + 1 FROM a)) t(k) GROUP BY k"""
)
def accepted_cmc_authors(spark, d):
    return O.cmc_at_far(documents(spark, d), level="author").select("k", F.round("accuracy", 6).alias("accuracy"))


_WORDS = "w AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents WHERE text IS NOT NULL)"
_BIN = "CASE WHEN words >= 1000 THEN 4 WHEN words >= 200 THEN 3 WHEN words >= 50 THEN 2 WHEN words >= 20 THEN 1 ELSE 0 END"


def _with_words(spark, d):
    n = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("q"), F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("words"))
    return documents(spark, d).join(n, "q", "left")


@query(f"WITH {_D}, {_TH.format('d')}, {_WORDS} SELECT {_BIN} AS bin, round(avg((score <= threshold AND coalesce(ceil(rank) <= 1, false))::INT), 6) AS accuracy, count(*) AS n_units, count(DISTINCT author) AS n_authors FROM d JOIN w ON d.q = w.doc_id, th WHERE NOT is_out GROUP BY 1")
def identification_by_words(spark, d):
    return O.identification_by_words(_with_words(spark, d), least_authors=1).select("bin", F.round("accuracy", 6).alias("accuracy"), "n_units", "n_authors")


@query(
    f"""WITH {_P}, {_TH.format('p')}, {_WORDS}, a AS (SELECT d.author, bool_or(d.score <= threshold AND coalesce(ceil(d.rank) <= 1, false)) AS hit, avg(words) AS words FROM d JOIN w ON d.q = w.doc_id, th WHERE NOT is_out GROUP BY d.author)
    SELECT {_BIN} AS bin, round(avg(hit::INT), 6) AS accuracy, count(*) AS n_units FROM a GROUP BY 1"""
)
def identification_by_words_authors(spark, d):
    return O.identification_by_words(_with_words(spark, d), level="author", least_authors=1).select("bin", F.round("accuracy", 6).alias("accuracy"), "n_units")


@query(f"WITH {_D} SELECT round(avg(coalesce(ceil(rank) <= 1, false)::INT), 6) AS top1, (SELECT round(avg(x::INT), 6) FROM (SELECT bool_or(coalesce(ceil(rank) <= 1, false)) AS x FROM d WHERE NOT is_out GROUP BY author)) AS authors_linked FROM d WHERE NOT is_out")
def closed_rates(spark, d):
    return O.rates(documents(spark, d)).select(F.round("top1", 6).alias("top1"), F.round("authors_linked", 6).alias("authors_linked"))


@query()
def open_set_report(spark, d):
    return O.open_set_report(documents(spark, d))


@query(f"WITH {_S}, m AS (SELECT q, max(score) AS m FROM s WHERE label <> 0 GROUP BY q), l AS (SELECT s.q, max(m) + ln(sum(exp(score - m))) AS l FROM s JOIN m USING (q) WHERE label <> 0 GROUP BY s.q) SELECT s.q, round(s.score - l, 6) AS score FROM s JOIN l USING (q) WHERE label = 0")
def background_evidence(spark, d):
    return O.background_evidence(scored(spark, d)[0], "0").withColumn("score", F.round("score", 6))


@query(f"WITH {_S} SELECT q, label, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER (), 9) AS quantile FROM s")
def score_quantiles(spark, d):
    return O.quantiles(scored(spark, d)[0].select("q", "label", "score"), "score").select("q", "label", F.round("quantile", 9).alias("quantile"))


# --- galleries ----------------------------------------------------------------------------------------------------------
def placed(spark, d):
    return cut(G.placed_scores(*scored(spark, d, strangers=True)))


@query(f"WITH {_OPEN} SELECT q, author, round(max(CASE WHEN author = label THEN score END), 6) AS genuine, round(max(CASE WHEN author <> label THEN score END), 6) AS best, round(avg(score), 6) AS mean, count(*) FILTER (author <> label) AS n_impostors FROM s GROUP BY q, author")
def gallery_statistics(spark, d):
    v = G.sub_gallery(placed(spark, d), 1000)
    return v.select("q", "author", *[F.round(c, 6).alias(c) for c in ("genuine", "best", "mean")], "n_impostors")


@query()
def gallery_measured(spark, d):
    return G.measured(placed(spark, d), (2, 4, 6, 9))


@query(f"WITH {_OPEN}, k2 AS (SELECT author, count(*) AS docs FROM k WHERE author <> {STRANGER} GROUP BY author) SELECT round(avg(docs / (SELECT sum(docs) FROM k2)), 6) AS top1 FROM u JOIN k2 USING (author)")
def gallery_proportional(spark, d):
    k, _ = sides(spark, d, strangers=True)
    docs = k.groupBy(F.col("author").alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    return G.proportional_top1(placed(spark, d), docs, 1000).select(F.round("top1", 6).alias("top1"))


@query()
def gallery_tails(spark, d):
    return G.fit_tails(placed(spark, d), 9)


@query()
def gallery_extrapolated(spark, d):
    return G.scaling_table(placed(spark, d), (3, 5, 7, 9), (20, 100))


@query()
def gallery_tail_model(spark, d):
    return G.tail_model(cut(G.fit_tails(placed(spark, d), 9)), 100.0)


@query()
def gallery_backtest(spark, d):
    return G.backtest(placed(spark, d), 5, 9)


@query("SELECT round(regr_slope(ps_t, ln(n)), 6) AS slope, round(regr_intercept(ps_t, ln(n)), 6) AS intercept FROM (SELECT l_linenumber + 1 AS n, avg(l_quantity) AS ps_t FROM lineitem GROUP BY 1)")
def threshold_line(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") + 1).alias("n")).agg(F.avg("l_quantity").alias("threshold"))
    return G.threshold_line(p).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query()
def noisy_top1(spark, d):
    """Share of right first candidates when the unknown vectors carry noise, in each replicate."""
    from ..operators import attacks as A

    k, u = sides(spark, d)
    n = cut(G.noisy(u.select("doc", "author", "vec"), 0.05, 3).select((F.col("doc") * 1000 + F.col("rep")).alias("doc"), "author", "vec", "rep"))
    best = K.best(A.nearest(k, n.select("doc", "author", "vec")))
    return best.join(n.select(F.col("doc").alias("q"), "author", "rep"), "q").groupBy("rep").agg(F.avg((F.col("label") == F.col("author")).cast("double")).alias("top1"))
