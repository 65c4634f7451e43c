"""Open-set detection, calibration and selection. ``score`` is higher for documents of strangers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rejection(best: DataFrame) -> DataFrame:
    """``q, score``: minus the z-score of the first candidate among a document's scores."""
    sd = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return best.select("q", (-(F.col("score") - F.col("mean")) / sd).alias("score"))


def max_softmax(scores: DataFrame) -> DataFrame:
    """``q, confidence``: probability of the first candidate, 1 / sum(exp(s - max))."""
    top = scores.groupBy("q").agg(F.max("score").alias("m"))
    return scores.join(top, "q").groupBy("q").agg((1 / F.sum(F.exp(F.col("score") - F.col("m")))).alias("confidence"))


def _curve(df: DataFrame) -> DataFrame:
    """Counts of positives and negatives at distinct scores, descending, with running sums in ranges of scores."""
    from .timeline import running_sums

    d = df.where(F.col("score").isNotNull() & F.col("is_out").isNotNull()).groupBy("score").agg(F.sum(F.col("is_out").cast("bigint")).alias("p"), F.sum((~F.col("is_out")).cast("bigint")).alias("n"))
    return running_sums(d, [F.desc("score")], {"tp": "p", "fp": "n"})


def auroc(df: DataFrame) -> DataFrame:
    """``auroc`` with strangers as positives, ties half; null where a class is missing.

    Rows are reduced to counts of distinct scores before they are ordered.
    """
    c = _curve(df)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return c.agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), area / (F.sum("p") * F.sum("n"))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    c = _curve(df)
    return c.agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"))


def equal_error_rate(df: DataFrame) -> DataFrame:
    """``eer, threshold`` where the rates of false acceptance and false rejection meet, interpolated between the steps."""
    c = _curve(df)
    tot = c.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    r = c.crossJoin(F.broadcast(tot)).where("np > 0 and nn > 0")  # one row
    r = r.select("score", (F.col("fp") / F.col("nn")).alias("fa"), (1 - F.col("tp") / F.col("np")).alias("fr")).withColumn("d", F.col("fa") - F.col("fr")).withColumn("e", (F.col("fa") + F.col("fr")) / 2)
    # the difference never falls along the scores: the crossing lies between the last negative and the first other one
    row = F.struct("score", "d", "e")
    x = r.agg(F.max_by(row, F.when(F.col("d") >= 0, F.col("score"))).alias("b"), F.min_by(row, F.when(F.col("d") < 0, F.col("score"))).alias("a")).where("b is not null")
    # before the first score nothing is accepted: the difference is -1 and the mean 0.5
    t = F.when(F.col("b.d") > 0, F.col("b.d") / (F.col("b.d") - F.coalesce("a.d", F.lit(-1.0)))).otherwise(0.0)
    mix = lambda c, start: (1 - t) * F.col(f"b.{c}") + t * F.coalesce(F.col(f"a.{c}"), start)
    return x.select(mix("e", F.lit(0.5)).alias("eer"), mix("score", F.col("b.score")).alias("threshold"))


def dir_at_far(df: DataFrame, fars: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """``far, threshold, dir``: known documents accepted and right where a share ``far`` of strangers is accepted.

    ``df`` has ``score, is_out, correct``. The threshold is the linear percentile of the strangers' scores.
    """
    th = df.where("is_out").agg(*[F.percentile("score", F.lit(f)).alias(f"t{i}") for i, f in enumerate(fars)])
    grid = th.select(F.explode(F.array(*[F.struct(F.lit(f).alias("far"), F.col(f"t{i}").alias("threshold")) for i, f in enumerate(fars)])).alias("x")).select("x.*")
    known = df.where(~F.col("is_out")).crossJoin(F.broadcast(grid))  # as many rows as rates
    return known.groupBy("far", "threshold").agg(F.avg(((F.col("score") <= F.col("threshold")) & F.col("correct")).cast("double")).alias("dir"))


def c_at_1(df: DataFrame) -> DataFrame:
    """``c_at_1`` of ``correct, answered``."""
    n, right, left = F.count(F.lit(1)), F.sum((F.col("correct") & F.col("answered")).cast("bigint")), F.sum((~F.col("answered")).cast("bigint"))
    return df.agg(((right + left * right / n) / n).alias("c_at_1"))


def selective(df: DataFrame, coverages: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """``coverage, n_answered, precision, recall`` of the most confident documents of ``q, confidence, correct``."""
    from .timeline import positions

    placed = positions(df.withColumn("_c", -F.col("confidence")), "_c", "q")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("n", F.explode(F.array(*[F.lit(c) for c in coverages])).alias("coverage"))
    grid = grid.withColumn("n_answered", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("n")).cast("bigint")))
    both = placed.crossJoin(F.broadcast(grid)).where(F.col("pos") < F.col("n_answered"))  # as many rows as coverages
    right = F.sum(F.col("correct").cast("bigint"))
    return both.groupBy("coverage", "n_answered", "n").agg(right.alias("right")).select("coverage", "n_answered", (F.col("right") / F.col("n_answered")).alias("precision"), (F.col("right") / F.col("n")).alias("recall"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected and maximal calibration error (right-closed bins), mean confidence, accuracy of ``confidence, correct``."""
    c = F.col("correct").cast("double")
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("confidence") * bins) - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf"), F.sum(c).alias("acc"), F.sum(F.pow(F.col("confidence") - c, 2)).alias("sq"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    return per.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"), (F.sum("conf") / F.sum("n")).alias("confidence"), (F.sum("acc") / F.sum("n")).alias("accuracy"))


def threshold_sweep(df: DataFrame, percentiles: tuple[int, ...] = tuple(range(1, 100))) -> DataFrame:
    """``percentile, threshold, accepted, dir, far`` of ``score, is_out, correct`` at percentiles of the scores."""
    th = df.agg(F.percentile("score", F.array(*[F.lit(p / 100) for p in percentiles])).alias("t"))
    grid = th.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in percentiles]).alias("p"), F.col("t"))).alias("x")).select(F.col("x.p").alias("percentile"), F.col("x.t").alias("threshold"))
    ok = F.col("score") <= F.col("threshold")
    both = df.crossJoin(F.broadcast(grid))  # as many rows as percentiles
    return both.groupBy("percentile", "threshold").agg(F.avg(ok.cast("double")).alias("accepted"), F.avg(F.when(~F.col("is_out"), (ok & F.col("correct")).cast("double"))).alias("dir"), F.avg(F.when(F.col("is_out"), ok.cast("double"))).alias("far"))


def rejection_features(scores: DataFrame) -> DataFrame:
    """Shape of a document's scores: z of the first, margins to the second and fifth, mean of five, probability, its margin, entropy."""
    w = Window.partitionBy("q")
    m, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    s = scores.withColumn("z", (F.col("score") - m) / F.when(sd > 0, sd).otherwise(1.0)).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "label"))).withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    s = s.withColumn("p", F.col("e") / F.sum("e").over(w))
    at = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    ent = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    return s.groupBy("q").agg(
        at("z", 1).alias("z_top"), (at("z", 1) - F.coalesce(at("z", 2), at("z", 1))).alias("margin2"), (at("z", 1) - F.min(F.when(F.col("r") <= 5, F.col("z")))).alias("margin5"),
        F.avg(F.when(F.col("r") <= 5, F.col("z"))).alias("mean5"), at("p", 1).alias("p_top"), (at("p", 1) - F.coalesce(at("p", 2), F.lit(0.0))).alias("p_margin"),
        F.when(F.count(F.lit(1)) > 1, ent / F.log(F.count(F.lit(1)))).otherwise(0.0).alias("entropy"),
    )
