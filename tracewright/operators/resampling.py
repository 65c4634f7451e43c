"""Bootstrap over authors, gallery scaling, noise bounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def poisson_weights(authors: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """``author, rep, w``: how often an author is drawn in each replicate, Poisson(1) by a keyed hash.

    The Poisson bootstrap is the multinomial's limit for many authors and needs no pass over them.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "author", "rep"), F.lit(1 << 40)) / float(1 << 40)
    cum, w = 0.0, F.lit(None).cast("int")
    cases = []
    for k in range(12):
        cum += math.exp(-1) / math.factorial(k)
        cases.append((cum, k))
    expr = F.when(u < cases[0][0], 0)
    for c, k in cases[1:]:
        expr = expr.when(u < c, k)
    reps = authors.select("author", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    return reps.select("author", "rep", expr.otherwise(12).alias("w"))


def ratio_interval(per_author: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """``estimate, low, high`` of sum(num) / sum(den) over authors; ``per_author`` has ``author, num, den``."""
    w = poisson_weights(per_author.select("author"), replicates, seed)
    r = per_author.join(w, "author").groupBy("rep").agg((F.sum(F.col("w") * F.col("num")) / F.nullif(F.sum(F.col("w") * F.col("den")), F.lit(0))).alias("r"))
    q = r.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    return per_author.agg((F.sum("num") / F.sum("den")).alias("estimate")).crossJoin(q)  # single rows


def gallery_view(scores: DataFrame, truth: DataFrame, sizes: tuple[int, ...], seed: int = 1) -> DataFrame:
    """``n, docs, top1, mean_best``: closed-set accuracy with the first n authors in hash order and the true one; a tie is a miss."""
    order = scores.select("label").distinct()
    from .timeline import positions

    place = positions(order.withColumn("h", F.xxhash64("label", F.lit(seed))), "h", "label").select("label", "pos")
    s = scores.join(place, "label").join(truth.select("q", "author"), "q")
    g = s.where(F.col("label") == F.col("author")).select("q", F.col("score").alias("genuine"))
    imp = s.where(F.col("label") != F.col("author")).select("q", "score", "pos")
    each = imp.select("q", "score", F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n > F.col("pos"))).alias("n"))
    best = each.groupBy("q", "n").agg(F.max("score").alias("best"))
    return best.join(g, "q").groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.avg((F.col("genuine") > F.col("best")).cast("double")).alias("top1"), F.avg("best").alias("mean_best"))


def impostor_tails(scores: DataFrame, truth: DataFrame, exceedances: int = 3) -> DataFrame:
    """``q, u, scale, tail_fraction``: an exponential tail above a document's (K + 1)-th best impostor."""
    s = scores.join(truth.select("q", "author"), "q").where(F.col("label") != F.col("author"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "label")
    n = s.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    top = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= exceedances + 1)
    t = top.groupBy("q").agg(F.min("score").alias("u"), (F.sum("score") - F.min("score") * F.count(F.lit(1))).alias("over"), F.count(F.lit(1)).alias("c"))
    return t.where(F.col("c") == exceedances + 1).join(n, "q").select("q", "u", (F.col("over") / exceedances).alias("scale"), (F.lit(exceedances) / F.col("n")).alias("tail_fraction"))


def survival(tails: DataFrame, genuine: DataFrame, new_authors: float) -> DataFrame:
    """``q, survival``: chance that a document's right answer stays first when authors are added; ``genuine`` has ``q, genuine``."""
    p = F.least(F.lit(1 - 1e-12), F.col("tail_fraction") * F.exp(-(F.greatest(F.col("genuine") - F.col("u"), F.lit(0.0))) / F.greatest(F.col("scale"), F.lit(1e-12))))
    return tails.join(genuine, "q").select("q", F.exp(F.lit(new_authors) * F.log1p(-p)).alias("survival"))


def sigma_of_c(c, d: int):
    """Noise at which the expected cosine of a d-dimensional unit vector to its noisy copy is c."""
    return F.sqrt((1 - c * c) / (c * c * d))


def eps_closed(sigma, delta: float = 1e-5):
    """Classical bound for the Gaussian mechanism at sensitivity 2."""
    return 2 / (sigma * sigma) + 2 / sigma * math.sqrt(2 * math.log(1 / delta))


def eps_exact(sigma: pd.Series, delta: float = 1e-5) -> pd.Series:
    """Smallest epsilon of the Gaussian mechanism, by bisection on the exact condition."""

    def log_phi(x: float) -> float:
        if x > -10:
            return math.log(0.5 * math.erfc(-x / math.sqrt(2)))
        return -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / x**2 + 3 / x**4)

    def excess(e: float, s: float) -> float:
        a, b = 1 / s - e * s / 2, -1 / s - e * s / 2
        return math.exp(log_phi(a)) - math.exp(min(e + log_phi(b), 700)) - delta

    def solve(s: float) -> float:
        if excess(0.0, s) <= 0:
            return 0.0
        lo, hi = 0.0, 2 / s**2 + 2 / s * math.sqrt(2 * math.log(1 / delta))
        while excess(hi, s) > 0:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(mid, s) > 0 else (lo, mid)
        return hi

    return sigma.map(solve)


def link_bound(margins: DataFrame, sigma: float) -> DataFrame:
    """``q, bound``: max(0, 1 - sum of Phi(-margin / sigma)) over a document's impostors; ``margins`` has ``q, margin``."""

    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))

    return margins.groupBy("q").agg(F.greatest(F.lit(0.0), 1 - F.sum(phi(F.col("margin") / sigma))).alias("bound"))


def joint_bounds(margins: DataFrame, sigma: float, k: int = 2) -> DataFrame:
    """``q, bound``: the union bound over impostors, each of which must outscore the k nearest own documents at once.

    ``margins`` has ``q, label, margins`` (k of them, nearest first) and ``rhos``, the correlations of the noise in two of
    them (for three documents those of 01, 02, 12). A joint term is at most the single one, so the bound only tightens.
    """
    from ..functions import normal

    @F.pandas_udf("double")
    def term(m: pd.Series, r: pd.Series) -> pd.Series:
        import numpy as np

        if not len(m):
            return pd.Series([], dtype=float)
        h = -np.stack(m.to_numpy()).astype(float)[:, :k] / sigma
        single = normal.phi(h[:, 0])
        rho = np.stack(r.to_numpy()).astype(float)
        joint = normal.bivariate(h[:, 0], h[:, 1], rho[:, 0]) if k == 2 else normal.trivariate(h[:, :3], rho[:, :3])
        return pd.Series(np.minimum(single, joint))

    return margins.groupBy("q").agg(F.greatest(F.lit(0.0), 1 - F.sum(term("margins", "rhos"))).alias("bound"))


def author_bound(bounds: DataFrame, truth: DataFrame) -> DataFrame:
    """``mean_bound, author_bound``: mean over documents, and mean over authors of the chance that one document at least is linked."""
    b = bounds.join(truth.select("q", "author"), "q")
    per = b.groupBy("author").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("bound"), F.lit(1e-300)))))).alias("a"), F.sum("bound").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean_bound"), F.avg("a").alias("author_bound"))
