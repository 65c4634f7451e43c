"""Galleries that grow: measured sub-galleries, models of the impostors' tails, extrapolated thresholds.

A sub-gallery of size n holds the first n authors in a keyed order and, for a document of a known author, that author. z
scores are taken over all candidates a document is compared with. A tie with an impostor is no hit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .openset import threshold_at_far
from .timeline import positions

_ALMOST_ONE = 1 - 1e-12


def placed_scores(scores: DataFrame, truth: DataFrame, seed: int = 1) -> DataFrame:
    """``q, author, label, score, pos, own``: scores with the place of their label in the keyed order."""
    order = positions(scores.select("label").distinct().withColumn("_h", F.xxhash64("label", F.lit(seed))), "_h", "label").select("label", "pos")
    return scores.join(order, "label").join(truth.select("q", "author"), "q").withColumn("own", F.col("label") == F.col("author"))


def sub_gallery(placed: DataFrame, n: int) -> DataFrame:
    """``q, author, genuine, best, mean, std, n_impostors``: statistics of each document in the sub-gallery of size n."""
    s = placed.where((F.col("pos") < n) | F.col("own"))
    other = F.when(~F.col("own"), F.col("score"))
    g = s.groupBy("q", "author").agg(
        F.max(F.when(F.col("own"), F.col("score"))).alias("genuine"), F.max(other).alias("best"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(other).alias("n_impostors")
    )
    return g.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def _z(view: DataFrame) -> DataFrame:
    """``q, author, is_out, z, right``."""
    known = F.col("genuine").isNotNull()
    first = F.greatest("genuine", "best")
    return view.select("q", "author", (~known).alias("is_out"), ((first - F.col("mean")) / F.col("std")).alias("z"), F.coalesce(F.col("genuine") > F.col("best"), known).alias("right"))


def measure(view: DataFrame, far: float) -> DataFrame:
    """``threshold, top1, dir`` of a sub-gallery: the z from which documents are accepted, and both rates of known documents."""
    z = _z(view).withColumn("score", -F.col("z"))
    t = threshold_at_far(z, far).select((-F.col("threshold")).alias("threshold"))
    known = z.where("not is_out").crossJoin(F.broadcast(t))  # a single row
    hit = F.col("right") & F.coalesce(F.col("z") >= F.col("threshold"), F.lit(False))
    return known.groupBy("threshold").agg(F.avg(F.col("right").cast("double")).alias("top1"), F.avg(hit.cast("double")).alias("dir"))


def measured(placed: DataFrame, sizes: tuple[int, ...], far: float = 0.1) -> DataFrame:
    """``n, threshold, top1, dir`` of each size."""
    out = None
    for n in sizes:
        row = measure(sub_gallery(placed, n), far).select(F.lit(n).alias("n"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def proportional_top1(placed: DataFrame, gallery: DataFrame, n: int) -> DataFrame:
    """``top1`` of a guesser who names authors in proportion to their known documents (``label, docs``)."""
    at = placed.select("label", "pos").distinct().join(gallery, "label")
    base = at.where(F.col("pos") < n).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total"))
    own = placed.where("own").select("q", "label").join(at, "label").crossJoin(F.broadcast(base))  # a single row
    return own.agg(F.avg(F.col("docs") / (F.col("total") + F.when(F.col("pos") >= n, F.col("docs")).otherwise(0))).alias("top1"))


# --- tails --------------------------------------------------------------------------------------------------------------
def shrink_scales(tails: DataFrame, exceedances: int) -> DataFrame:
    """Scales drawn to their geometric mean: the log of an exponential scale has variance 1/K, the rest of the spread is real."""
    pos = F.when(F.col("scale") > 0, F.log("scale"))
    m = tails.agg(F.avg(pos).alias("_c"), F.var_pop(pos).alias("_v"))
    signal = F.greatest(F.col("_v") - 1.0 / exceedances, F.lit(0.0))
    keep = signal / (signal + 1.0 / exceedances)
    got = tails.crossJoin(F.broadcast(m))  # a single row
    return got.withColumn("scale", F.greatest(F.when(F.col("scale") > 0, F.exp(F.col("_c") + keep * (F.log("scale") - F.col("_c")))).otherwise(F.col("scale")), F.lit(1e-9))).drop("_c", "_v")


def fit_tails(placed: DataFrame, n: int, exceedances: int = 3, stats: DataFrame | None = None) -> DataFrame:
    """``q, author, u, scale, tail_fraction, best, genuine``: an exponential tail over each document's K best impostors, in z.

    ``stats`` (``q, mean, std``) gives the z scores another gallery's mean and deviation. Documents with K impostors or
    fewer have no tail.
    """
    view = sub_gallery(placed, n)
    if stats is not None:
        view = view.drop("mean", "std").join(stats.select("q", "mean", "std"), "q")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "label")
    top = placed.where((F.col("pos") < n) & ~F.col("own")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= exceedances + 1)
    top = top.groupBy("q").agg(F.min("score").alias("low"), F.sum("score").alias("sum"), F.count(F.lit(1)).alias("c")).where(F.col("c") == exceedances + 1)
    z = lambda c: (F.col(c) - F.col("mean")) / F.col("std")
    got = view.join(top, "q").select(
        "q", "author", z("low").alias("u"), ((F.col("sum") - F.col("low") * (exceedances + 1)) / exceedances / F.col("std")).alias("scale"), (F.lit(float(exceedances)) / F.col("n_impostors")).alias("tail_fraction"),
        z("best").alias("best"), z("genuine").alias("genuine"),
    )
    return shrink_scales(got, exceedances)


def _beaten(x):
    """Chance that one new impostor scores above x."""
    p = F.col("tail_fraction") * F.exp(-F.greatest(x - F.col("u"), F.lit(0.0)) / F.col("scale"))
    return F.least(p, F.lit(_ALMOST_ONE))


def still_first(fit: DataFrame, new_authors: float) -> DataFrame:
    """``q, genuine, survival`` of the known documents: the chance to be still right when authors are added; 0 where wrong now."""
    known = fit.where("genuine is not null")
    stays = F.exp(F.lit(float(new_authors)) * F.log1p(-_beaten(F.col("genuine"))))
    return known.select("q", "genuine", F.when(F.col("genuine") > F.col("best"), stays).otherwise(0.0).alias("survival"))


def hybrid_dir(fit: DataFrame, new_authors: float, threshold: float) -> DataFrame:
    """``dir, top1``: mean survival of the documents accepted at a given threshold, and of all."""
    s = still_first(fit, new_authors)
    return s.agg(F.avg(F.when(F.col("genuine") >= threshold, F.col("survival")).otherwise(0.0)).alias("dir"), F.avg("survival").alias("top1"))


def expected_threshold(fit: DataFrame, new_authors: float, far: float, rounds: int = 6, ways: int = 64) -> float:
    """The z at which the expected rate of false acceptance falls to ``far``, after ``new_authors`` are added.

    Bisection with many cuts: each round is one aggregate over the strangers, and narrows the interval ``ways`` times.
    """
    out = fit.where("genuine is null").select("u", "scale", "tail_fraction", "best")
    edge = out.agg(F.min("best").alias("lo"), F.max("best").alias("hi"), F.max("scale").alias("s")).first()
    if edge.lo is None:
        return float("inf")
    lo, hi = edge.lo - 1.0, edge.hi + 1.0 + edge.s * float(np.log1p(new_authors) + 30)
    for _ in range(rounds):
        cuts = np.linspace(lo, hi, ways + 1)[1:]
        over = [F.avg(F.when(F.col("best") >= float(t), 1.0).otherwise(1 - F.exp(F.lit(float(new_authors)) * F.log1p(-_beaten(F.lit(float(t))))))).alias(f"c{i}") for i, t in enumerate(cuts)]
        got = np.array(out.agg(*over).first(), float)
        i = int(np.argmax(got <= far)) if (got <= far).any() else ways - 1
        lo, hi = (lo if i == 0 else float(cuts[i - 1])), float(cuts[i])
    return hi


def tail_model(fit: DataFrame, new_authors: float, far: float = 0.1) -> DataFrame:
    """``threshold, dir, top1``, all three from the tails: the low end of the range."""
    t = expected_threshold(fit, new_authors, far)
    return hybrid_dir(fit, new_authors, t).select(F.lit(t).alias("threshold"), "dir", "top1")


def threshold_line(points: DataFrame, form: str = "log") -> DataFrame:
    """``slope, intercept`` of ``threshold`` against ln n (``log``) or its square root (``sqrt_log``), by least squares."""
    x = F.log("n") if form == "log" else F.sqrt(F.log("n"))
    p = points.select(x.alias("x"), "threshold")
    return p.agg(F.regr_slope("threshold", "x").alias("slope"), F.regr_intercept("threshold", "x").alias("intercept"))


def scaling_table(placed: DataFrame, sizes: tuple[int, ...], targets: tuple[int, ...], far: float = 0.1, exceedances: int = 3, form: str = "log") -> DataFrame:
    """``n, kind, threshold, top1, dir``: measured sub-galleries, and sizes beyond the largest by the line of thresholds and the tails."""
    sizes = tuple(sorted(sizes))
    got = cut(measured(placed, sizes, far))
    line = threshold_line(got.where("n > 1 and threshold is not null"), form).first()
    fit = cut(fit_tails(placed, sizes[-1], exceedances))
    out = got.select("n", F.lit("measured").alias("kind"), "threshold", "top1", "dir")
    for n in targets:
        x = np.log(n) if form == "log" else np.sqrt(np.log(n))
        t = float(line.intercept + line.slope * x) if line.slope is not None else float("inf")
        row = hybrid_dir(fit, n - sizes[-1], t).select(F.lit(n).alias("n"), F.lit("modelled").alias("kind"), F.lit(t).alias("threshold"), "top1", "dir")
        out = out.unionByName(row)
    return out


def backtest(placed: DataFrame, small: int, full: int, far: float = 0.1, exceedances: int = 3) -> DataFrame:
    """``predicted_top1, measured_top1, predicted_dir, measured_dir``: tails of a small gallery held against the full one.

    Mean and deviation are the full gallery's, and so is the threshold, so that only the tails are tested.
    """
    whole = cut(sub_gallery(placed, full))
    m = measure(whole, far).first()
    fit = fit_tails(placed, small, exceedances, whole)
    t = float("inf") if m is None or m.threshold is None else float(m.threshold)
    p = hybrid_dir(fit, full - small, t)
    return p.select(F.col("top1").alias("predicted_top1"), F.lit(m.top1 if m else None).cast("double").alias("measured_top1"), F.col("dir").alias("predicted_dir"), F.lit(m.dir if m else None).cast("double").alias("measured_dir"))


# --- noise --------------------------------------------------------------------------------------------------------------
def noisy(vectors: DataFrame, sigma: float, reps: int, seed: int = 1, vec: str = "vec", key: str = "doc") -> DataFrame:
    """Unit vectors with Gaussian noise added, ``reps`` times (``rep``), by a keyed hash: the same in every run and plan."""
    from ..functions import vectors as V

    unit = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("rep"), i, F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2))
    each = vectors.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(vec, V.unit(vec))
    return each.withColumn(vec, F.transform(vec, lambda x, i: x + F.lit(sigma) * normal(i)))


def closest_own(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest own documents of each target: ``q, doc, score`` with ``author`` and ``label`` equal, ties by the smaller id."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    return pairs.where("author = label").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
