"""Metrics over a score relation ``q, label, score`` and the truth ``q, author``.

Null scores are no candidates. Undefined metrics are null, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _by_doc():
    return Window.partitionBy("q")


def true_ranks(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``q, author, true_score, rank, pool``: rank of the true author, ties averaged; documents whose author is a candidate."""
    own = truth.join(scores.where(F.col("score").isNotNull()).select("q", F.col("label").alias("author"), F.col("score").alias("true_score")), ["q", "author"])
    both = scores.where(F.col("score").isNotNull()).join(own, "q")
    better = F.sum((F.col("score") > F.col("true_score")).cast("bigint"))
    tied = F.sum((F.col("score") == F.col("true_score")).cast("bigint")) - 1
    return both.groupBy("q", "author", "true_score").agg((better + 1 + tied / 2.0).alias("rank"), F.count(F.lit(1)).alias("pool"))


def best(scores: DataFrame) -> DataFrame:
    """``q, label, score, second, mean, std, n``: the first candidate (ties: smaller label) and the shape of the scores."""
    s = scores.where(F.col("score").isNotNull())
    w = _by_doc().orderBy(F.desc("score"), "label")
    top = s.withColumn("r", F.row_number().over(w)).where("r <= 2")
    shape = s.groupBy("q").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n"))
    first = top.groupBy("q").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    return first.join(shape, "q")


def top_k(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``k, conv_acc, id_acc, macro_acc``: share of documents, of authors (any document), and mean of the authors' shares."""
    each = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("hit", (F.col("rank") <= F.col("k")).cast("double"))
    per = each.groupBy("k", "author").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("k").agg((F.sum("hits") / F.sum("n")).alias("conv_acc"), F.avg((F.col("hits") > 0).cast("double")).alias("id_acc"), F.avg(F.col("hits") / F.col("n")).alias("macro_acc"))


def summary(ranks: DataFrame) -> DataFrame:
    """MRR, median and mean rank, percentile rank, and the uniform baseline of MRR."""
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("pool").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    pct = F.when(F.col("pool") > 1, 1 - (F.col("rank") - 1) / (F.col("pool") - 1)).otherwise(1.0)
    return ranks.agg(
        F.avg(1 / F.col("rank")).alias("mrr"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.avg("rank").alias("mean_rank"),
        F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pct))).alias("percentile_rank"), F.avg(harmonic / F.col("pool")).alias("uniform_mrr"), F.count(F.lit(1)).alias("n"),
    )


def cmc(ranks: DataFrame) -> DataFrame:
    """``k, accuracy`` for every rank from 1 to the largest pool."""
    n = ranks.agg(F.count(F.lit(1)).alias("n"), F.max("pool").alias("most"))
    hist = ranks.groupBy(F.ceil("rank").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    grid = n.select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("most"))).alias("k"))  # one number for each candidate
    return grid.join(hist, "k", "left").select("k", (F.coalesce(F.sum("c").over(Window.orderBy("k")), F.lit(0)) / F.col("n")).alias("accuracy"))


def per_author(ranks: DataFrame) -> DataFrame:
    """Of each author: documents, best and median rank, accuracy at 1, 5 and 10, any hit at 10."""
    at = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.groupBy("author").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("best_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"),
        at(1).alias("top1"), at(5).alias("top5"), at(10).alias("top10"), (F.min("rank") <= 10).alias("any10"),
    )


def macro_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``macro_f1`` over the true authors; an author never predicted and never right counts 0."""
    p = predicted.select("q", F.col("label").alias("predicted"))
    both = truth.join(p, "q", "left")
    support = both.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("predicted") == F.col("author")).cast("bigint"), F.lit(0))).alias("tp"))
    named = both.groupBy(F.col("predicted").alias("author")).agg(F.count(F.lit(1)).alias("m"))
    f = 2 * F.col("tp") / (F.col("n") + F.coalesce(F.col("m"), F.lit(0)))
    return support.join(named, "author", "left").agg(F.avg(f).alias("macro_f1"))


def random_guessing(truth: DataFrame, pool: int, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``k, accuracy``: chance that an author with c documents is hit once, averaged over the authors."""
    c = truth.groupBy("author").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return c.groupBy("k").agg(F.avg(1 - F.pow(1 - F.least(F.col("k"), F.lit(pool)) / F.lit(float(pool)), F.col("c"))).alias("accuracy"))


def random_identity(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``k, accuracy``: the same with each document's own pool, as a sum of logarithms."""
    each = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    miss = F.greatest(1 - F.least(F.col("k"), F.col("pool")) / F.col("pool"), F.lit(1e-300))
    return each.groupBy("k", "author").agg((1 - F.exp(F.sum(F.log(miss)))).alias("p")).groupBy("k").agg(F.avg("p").alias("accuracy"))


def first_distinct_authors(ranked: DataFrame, k: int) -> DataFrame:
    """``q, label, place``: the first k distinct labels of a ranking ``q, label, distance``."""
    m = ranked.groupBy("q", "label").agg(F.min("distance").alias("distance"))
    return m.withColumn("place", F.row_number().over(_by_doc().orderBy("distance", "label"))).where(F.col("place") <= k)


# --- retrieval: each author is a query over the documents ---------------------------------------------------------------
def retrieval(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``author, n_relevant, average_precision, r_precision, baseline`` of each author that owns a document.

    Average precision takes equal scores as one threshold; R-precision goes by document on equal scores. Documents the author
    wasn't scored for come last.
    """
    docs = truth.select("q", F.col("author").alias("owner"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    owners = docs.groupBy(F.col("owner").alias("author")).agg(F.count(F.lit(1)).alias("n_relevant"))
    s = scores.where(F.col("score").isNotNull()).select("q", F.col("label").alias("author"), "score").join(docs, "q").join(owners, "author")
    s = s.withColumn("rel", (F.col("owner") == F.col("author")).cast("bigint"))
    # thresholds first: a group of equal scores is one row, so the window runs over distinct scores
    t = s.groupBy("author", "n_relevant", "score").agg(F.sum("rel").alias("hits"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("author").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("prec", F.sum("hits").over(w) / F.sum("c").over(w))
    ap = t.groupBy("author", "n_relevant").agg((F.sum(F.col("hits") * F.col("prec")) / F.col("n_relevant")).alias("average_precision"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("score"), "q"))).where(F.col("r") <= F.col("n_relevant"))
    rp = r.groupBy("author").agg(F.sum("rel").alias("top_hits"))
    out = ap.join(rp, "author", "left").crossJoin(F.broadcast(n_docs))  # one row
    return out.select("author", "n_relevant", "average_precision", (F.coalesce("top_hits", F.lit(0)) / F.col("n_relevant")).alias("r_precision"), (F.col("n_relevant") / F.col("n_docs")).alias("baseline"))


def map_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("average_precision").alias("map"), F.avg("r_precision").alias("mean_r_precision"), F.avg("baseline").alias("baseline"), F.count(F.lit(1)).alias("authors"))


# --- reranking ----------------------------------------------------------------------------------------------------------
def shortlist(scores: DataFrame, k: int) -> DataFrame:
    """``q, label, score, slot``: the k best candidates, slots from 0; ties by label."""
    return scores.where(F.col("score").isNotNull()).withColumn("slot", F.row_number().over(_by_doc().orderBy(F.desc("score"), "label")) - 1).where(F.col("slot") < k)


def fold(scores: DataFrame, short: DataFrame, orders: DataFrame) -> DataFrame:
    """Scores with the shortlist's replaced by the row's maximum plus its place in the new order.

    ``orders`` has ``q, ranking`` (slots, best first); slots it leaves out follow in their old order. Which labels are on the
    shortlist doesn't change; documents without an order keep their scores.
    """
    k = short.groupBy("q").agg(F.max("slot").alias("last"))
    full = orders.join(k, "q").withColumn("all", F.sequence(F.lit(0), F.col("last")))
    full = full.select("q", "last", F.concat(F.array_distinct(F.filter("ranking", lambda x: x.between(0, F.col("last")))), F.array_except("all", "ranking")).alias("ranking"))
    placed = short.join(full, "q").select("q", "label", (F.col("last") + 2 - F.array_position("ranking", F.col("slot"))).alias("bonus"))
    top = scores.groupBy("q").agg(F.max("score").alias("row_max"))
    return scores.join(top, "q").join(placed, ["q", "label"], "left").select("q", "label", F.when(F.col("bonus").isNotNull(), F.col("row_max") + F.col("bonus")).otherwise(F.col("score")).alias("score"))


def promote(scores: DataFrame, picks: DataFrame) -> DataFrame:
    """Scores with the picked label of ``picks`` (``q, label``) one above the row's maximum."""
    top = scores.groupBy("q").agg(F.max("score").alias("row_max"))
    p = picks.select("q", "label", F.lit(True).alias("picked"))
    return scores.join(top, "q").join(p, ["q", "label"], "left").select("q", "label", F.when(F.col("picked"), F.col("row_max") + 1).otherwise(F.col("score")).alias("score"))


def rescue_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rescued, damaged, net, kept_right, kept_wrong`` at rank 1."""
    b, a = before.select("q", (F.col("rank") <= 1).alias("b")), after.select("q", (F.col("rank") <= 1).alias("a"))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    both = b.join(a, "q")
    res, dam = n(~F.col("b") & F.col("a")), n(F.col("b") & ~F.col("a"))
    return both.agg(res.alias("rescued"), dam.alias("damaged"), (res - dam).alias("net"), n(F.col("b") & F.col("a")).alias("kept_right"), n(~F.col("b") & ~F.col("a")).alias("kept_wrong"))


def elo_round(ratings: DataFrame, wins, k: float = 32.0, seed: int = 1) -> DataFrame:
    """One Swiss round in each document: neighbours by rating meet, the expectation rule moves both.

    ``ratings`` has ``q, label, rating``; ``wins(a, b)`` gives a column that is true where the first wins.
    """
    r = ratings.withColumn("place", F.row_number().over(_by_doc().orderBy(F.desc("rating"), F.xxhash64("label", F.lit(seed)))) - 1).withColumn("pair", F.floor(F.col("place") / 2))
    w = Window.partitionBy("q", "pair").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumn("l1", F.first("label").over(w)).withColumn("l2", F.last("label").over(w)).withColumn("r1", F.first("rating").over(w)).withColumn("r2", F.last("rating").over(w))
    expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("r2") - F.col("r1")) / 400))
    delta = k * (F.when(wins(F.col("l1"), F.col("l2")), 1.0).otherwise(0.0) - expected)
    new = F.when(F.col("l1") == F.col("l2"), F.col("rating")).when(F.col("label") == F.col("l1"), F.col("rating") + delta).otherwise(F.col("rating") - delta)
    return r.select("q", "label", new.alias("rating"))


# --- fusion and curves --------------------------------------------------------------------------------------------------
def z_by_document(scores: DataFrame) -> DataFrame:
    """Scores z-scored over a document's candidates (population deviation, 0 counts as 1)."""
    sd = F.stddev_pop("score").over(_by_doc())
    return scores.select("q", "label", ((F.col("score") - F.avg("score").over(_by_doc())) / F.when(sd > 0, sd).otherwise(1.0)).alias("score"))


def z_overall(scores: DataFrame) -> DataFrame:
    m = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return scores.crossJoin(F.broadcast(m)).select("q", "label", ((F.col("score") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("score"))  # one row


def late_fusion(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """z of the first plus ``alpha`` times z of the second; cells that one lacks are left out."""
    a, b = z_overall(first), z_overall(second).withColumnRenamed("score", "s2")
    return a.join(b, ["q", "label"]).select("q", "label", (F.col("score") + alpha * F.col("s2")).alias("score"))


def pooled_argmax(scores: DataFrame, clusters: DataFrame, most: int = 50) -> DataFrame:
    """``q, label``: the scores of a cluster's documents (``q, cluster``) added, its best label given to each; documents of larger clusters keep their own best."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sized = clusters.join(size, "cluster")
    c = sized.where(F.col("n") <= most).drop("n")
    tot = scores.join(c, "q").groupBy("cluster", "label").agg(F.sum("score").alias("s"))
    top = tot.groupBy("cluster").agg(F.max(F.struct(F.round("s", 9).alias("s"), "label")).alias("t"))
    own = best(scores.join(sized.where(F.col("n") > most).select("q"), "q", "left_semi"))
    return c.join(top, "cluster").select("q", F.col("t.label").alias("label")).unionByName(own.select("q", "label"))


def eligible_by_language(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``q, label``: authors who share a language with the document; every author where none does.

    ``docs`` has ``q, langs`` (array), ``known`` has ``author, langs``. Documents of the same languages are decided once.
    """
    authors = known.select("author", F.explode("langs").alias("lang")).distinct()
    combos = docs.select(F.array_sort(F.array_distinct("langs")).alias("langs")).distinct()
    shared = combos.select("langs", F.explode("langs").alias("lang")).join(authors, "lang").select("langs", "author").distinct()
    lonely = combos.join(shared, "langs", "left_anti")
    every = lonely.join(authors.select("author").distinct(), how="cross")  # distinct sets of languages by authors: the result itself
    table = shared.unionByName(every)
    return docs.select("q", F.array_sort(F.array_distinct("langs")).alias("langs")).join(table, "langs").select("q", F.col("author").alias("label"))


def chance_cmc(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``k, accuracy``: mean of min(k, pool) / pool."""
    each = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.groupBy("k").agg(F.avg(F.least("k", "pool") / F.col("pool")).alias("accuracy"))


def weighted_cmc(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """``rep, k, accuracy`` of bootstrap replicates: ranks rounded up, ``weights`` has ``author, rep, w``; only ranks that occur."""
    h = ranks.join(weights, "author").groupBy("rep", F.ceil("rank").alias("k")).agg(F.sum("w").alias("w"))
    tot = h.groupBy("rep").agg(F.sum("w").alias("all"))
    w = Window.partitionBy("rep").orderBy("k")
    return h.withColumn("seen", F.sum("w").over(w)).join(tot, "rep").select("rep", "k", (F.col("seen") / F.nullif(F.col("all"), F.lit(0))).alias("accuracy"))


def author_shares(known: DataFrame) -> DataFrame:
    """``author, share`` of the known documents."""
    n = known.agg(F.count(F.lit(1)).alias("n"))
    return known.groupBy("author").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("author", (F.col("c") / F.col("n")).alias("share"))  # one row


def proportional_guess(known: DataFrame, truth: DataFrame) -> DataFrame:
    """``accuracy`` of naming each author in proportion to its known documents; strangers count 0."""
    return truth.join(author_shares(known), "author", "left").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("accuracy"))


def interpolate(grid: DataFrame, at: DataFrame) -> DataFrame:
    """``k, value`` of a curve ``k, value`` at other k, linear in log k; outside the grid its ends. ``at`` has ``k``."""
    both = grid.select("k", "value", F.lit(0).alias("q")).unionByName(at.select("k", F.lit(None).cast("double").alias("value"), F.lit(1).alias("q")))
    lo, hi = Window.orderBy("k", "q").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("k", "q").rowsBetween(0, Window.unboundedFollowing)
    p = F.when(F.col("value").isNotNull(), F.struct("k", "value"))
    x = both.withColumn("a", F.last(p, True).over(lo)).withColumn("b", F.first(p, True).over(hi)).where("q = 1")
    t = F.when(F.col("b.k") > F.col("a.k"), (F.log("k") - F.log("a.k")) / (F.log("b.k") - F.log("a.k"))).otherwise(0.0)
    return x.select("k", F.coalesce(F.col("a.value") + t * (F.col("b.value") - F.col("a.value")), F.col("a.value"), F.col("b.value")).alias("value"))
