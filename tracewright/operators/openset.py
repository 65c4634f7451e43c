"""Identification that survives a reject threshold: curves of documents and of authors, budgets, bins.

The document relation is ``q, author, rank, score, is_out`` (and ``pool``): ``rank`` of the true author, null for strangers;
a higher ``score`` looks more like a stranger. A document is accepted where its score is at most the threshold. Equal
scores are accepted together. Rows with a null score or ``is_out`` take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import running_sums

#: Points of the curves' horizontal axis: 0, 1/GRID, ..., 1.
GRID = 100


def author_table(docs: DataFrame) -> DataFrame:
    """``author, rank, score, hit_score, is_out, pool, n_documents``: the best each author's documents achieve.

    The least rank and score of any document, and the confidence (minus the score) of the most confident right one, null
    where none is right.
    """
    hit = F.when(F.col("rank") <= 1, -F.col("score"))
    return _usable(docs).groupBy("author").agg(
        F.min("rank").alias("rank"), F.min("score").alias("score"), F.max(hit).alias("hit_score"), F.max("is_out").alias("is_out"), F.max("pool").alias("pool"), F.count(F.lit(1)).alias("n_documents")
    )


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNotNull() & F.col("is_out").isNotNull())


def threshold_at_far(df: DataFrame, far: float, weight: str | None = None) -> DataFrame:
    """``threshold, achieved``: the largest threshold that accepts at most the share ``far`` of the strangers.

    Unweighted the budget is ``floor(far * n)`` strangers, weighted the share itself. The threshold is null where not even
    one score fits the budget.
    """
    w = F.col(weight) if weight else F.lit(1)
    per = _usable(df).groupBy("score").agg(F.sum(F.when(F.col("is_out"), w).otherwise(0)).alias("w"))
    seen = running_sums(per, ["score"], {"seen": "w"})
    total = per.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"))
    budget = F.lit(far) * F.col("total")
    fits = F.col("seen") <= ((F.floor(budget + 1e-12)) if weight is None else budget + 1e-12)
    got = seen.crossJoin(F.broadcast(total))  # a single row
    got = got.agg(F.max(F.when(fits, F.struct("score", "seen"))).alias("m"), F.max("total").alias("total"))
    return got.select(F.col("m.score").alias("threshold"), F.when(F.col("total") > 0, F.coalesce(F.col("m.seen"), F.lit(0)) / F.col("total")).otherwise(0.0).alias("achieved"))


def _curve(events: DataFrame, *keys: str) -> DataFrame:
    """``far, rate`` on the grid, linear between attained points, for integer weights.

    ``events`` has ``conf, out, hit`` and the totals ``n_out, n_in``, one row for each unit that can be accepted. Points
    are gathered by the grid cell they fall in before a grid meets them, so that it meets no more than its own size.
    """
    per = events.groupBy(*keys, "conf").agg(F.sum("out").cast("bigint").alias("out"), F.sum("hit").cast("bigint").alias("hit"), F.max("n_out").alias("n_out"), F.max("n_in").alias("n_in"))
    if keys:
        run = Window.partitionBy(*keys).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
        pts = per.withColumn("fp", F.sum("out").over(run)).withColumn("tp", F.sum("hit").over(run))
    else:
        pts = running_sums(per, [F.desc("conf")], {"fp": "out", "tp": "hit"})
    pts = pts.where("n_out > 0 and n_in > 0").select(*keys, "fp", "tp", "n_out", "n_in")
    zero = pts.groupBy(*keys).agg(F.max("n_out").alias("n_out"), F.max("n_in").alias("n_in")).where("n_out is not null")
    pts = pts.unionByName(zero.select(*keys, F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("tp"), "n_out", "n_in"))
    p = pts.select(*keys, F.struct((F.col("fp") / F.col("n_out")).alias("far"), (F.col("tp") / F.col("n_in")).alias("rate")).alias("p"), F.expr(f"(fp * {GRID} + n_out - 1) div n_out").alias("c"))
    cells = p.groupBy(*keys, "c").agg(F.max("p").alias("last"), F.min("p").alias("first"))
    grid = zero.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i"))
    on = [F.col(f"g.{k}") == F.col(f"c.{k}") for k in keys]
    both = grid.alias("g").join(cells.alias("c"), on) if keys else grid.alias("g").crossJoin(cells.alias("c"))  # at most GRID + 1 rows each
    got = both.groupBy(*[F.col(f"g.{k}").alias(k) for k in keys], "i").agg(F.max(F.when(F.col("c") <= F.col("i"), F.col("last"))).alias("a"), F.min(F.when(F.col("c") > F.col("i"), F.col("first"))).alias("b"))
    x = F.col("i") / float(GRID)
    between = F.col("a.rate") + (F.col("b.rate") - F.col("a.rate")) * (x - F.col("a.far")) / (F.col("b.far") - F.col("a.far"))
    return got.select(*keys, x.alias("far"), F.when(F.col("b").isNull() | (F.col("a.far") == x), F.col("a.rate")).otherwise(between).alias("rate"))


def _units(docs: DataFrame, level: str) -> DataFrame:
    """``author, conf, out, hit`` of the documents, or of the authors (any document counts), with ``in_set``."""
    if level == "author":
        a = author_table(docs)
        out = F.col("is_out")
        return a.select("author", F.when(out, -F.col("score")).otherwise(F.col("hit_score")).alias("conf"), out.cast("int").alias("out"), (~out & F.col("hit_score").isNotNull()).cast("int").alias("hit"), (~out).cast("int").alias("in_set"))
    out = F.col("is_out")
    right = ~out & F.coalesce(F.ceil("rank") <= 1, F.lit(False))
    return _usable(docs).select("author", (-F.col("score")).alias("conf"), out.cast("int").alias("out"), right.cast("int").alias("hit"), (~out).cast("int").alias("in_set"))


def identification_curve(docs: DataFrame, level: str = "document") -> DataFrame:
    """``far, rate``: share of known documents (authors) accepted and named right, by the share of strangers let through.

    At the author level a stranger is let through with any document; an author is identified by any right, accepted one.
    """
    u = _units(docs, level)
    total = u.agg(F.sum("out").alias("n_out"), F.sum("in_set").alias("n_in"))
    return _curve(u.where("conf is not null").crossJoin(F.broadcast(total)))  # a single row


def identification_band(docs: DataFrame, weights: DataFrame, level: str = "document") -> DataFrame:
    """``far, low, high``: pointwise 2.5 and 97.5 percentiles over bootstrap replicates ``author, rep, w``, within [0, 1]."""
    u = _units(docs, level).join(weights, "author")
    u = u.select("rep", "conf", *[(F.col(c) * F.col("w")).alias(c) for c in ("out", "hit", "in_set")])
    total = u.groupBy("rep").agg(F.sum("out").alias("n_out"), F.sum("in_set").alias("n_in"))
    c = _curve(u.where("conf is not null").join(F.broadcast(total), "rep"), "rep")
    q = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.percentile("rate", F.lit(x))))
    return c.groupBy("far").agg(q(0.025).alias("low"), q(0.975).alias("high"))


def chance_lines(docs: DataFrame) -> DataFrame:
    """``far, document, author``: what a detector that knows nothing before a uniform guesser reaches."""
    people = author_table(docs).where("not is_out")
    n = people.agg(F.max("pool").alias("pool"))
    each = people.groupBy("n_documents").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n))  # a single row
    grid = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID)))).withColumn("far", F.col("i") / float(GRID))
    once = F.col("far") / F.col("pool")
    return grid.groupBy("far").agg(F.max(once).alias("document"), (F.sum(F.col("c") * (1 - F.pow(1 - once, F.col("n_documents")))) / F.sum("c")).alias("author"))


def _accepted(docs: DataFrame, far: float, level: str) -> DataFrame:
    """The known documents with ``accepted`` and ``achieved``, at the level's own threshold."""
    t = threshold_at_far(author_table(docs) if level == "author" else docs, far)
    known = _usable(docs).where("not is_out").crossJoin(F.broadcast(t))  # a single row
    return known.withColumn("accepted", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False)))


def rejected_rank(rank: Column, accepted: Column, most: Column) -> Column:
    """A rank beyond every k where the document was refused."""
    return F.when(accepted, rank).otherwise(most + 1)


def cmc_at_far(docs: DataFrame, far: float = 0.1, level: str = "document") -> DataFrame:
    """``k, accuracy, n_accepted, achieved``: of all known documents (authors) those accepted with their author within k.

    An author's rank is the best of the accepted documents; the budget of strangers is spent on authors there.
    """
    a = _accepted(docs, far, level)
    most = a.agg(F.max("pool").cast("bigint").alias("most"))
    a = a.crossJoin(F.broadcast(most)).withColumn("r", rejected_rank(F.ceil("rank"), F.col("accepted") & F.col("rank").isNotNull(), F.col("most")))  # a single row
    unit = a.groupBy("author", "most", "achieved").agg(F.min("r").alias("r")) if level == "author" else a
    n = unit.agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("m"), F.max("achieved").alias("achieved")).crossJoin(a.agg(F.sum(F.col("accepted").cast("bigint")).alias("n_accepted")))
    hist = unit.groupBy(F.col("r").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    grid = n.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("k"))  # one number for each candidate
    up = Window.orderBy("k")
    return grid.join(hist, "k", "left").select("k", (F.coalesce(F.sum("c").over(up), F.lit(0)) / F.col("n")).alias("accuracy"), "n_accepted", "achieved")


def bin_label(edges: tuple[int, ...], i: int) -> str:
    """``1``, ``3-4``, ``33+``: the i-th bin of left-closed edges."""
    if i + 1 == len(edges):
        return f"{edges[i]}+"
    return str(edges[i]) if edges[i + 1] - edges[i] == 1 else f"{edges[i]}-{edges[i + 1] - 1}"


def bin_of(value: Column, edges: tuple[int, ...]) -> Column:
    """Index of the bin a value falls in; values before the first edge belong to the first bin."""
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(value >= e, F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def binned_rate(units: DataFrame, least_authors: int = 5) -> DataFrame:
    """``bin, accuracy, n_units, n_authors``: hit rate of each bin of ``bin, author, hit``; null with too few authors."""
    g = units.groupBy("bin").agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_units"), F.countDistinct("author").alias("n_authors"))
    return g.select("bin", F.when(F.col("n_authors") >= least_authors, F.col("rate")).alias("accuracy"), "n_units", "n_authors")


def binned_band(units: DataFrame, weights: DataFrame) -> DataFrame:
    """``bin, low, high``: percentiles of the bins' rates over replicates ``author, rep, w``; bins without weight don't count."""
    r = units.join(weights, "author").groupBy("bin", "rep").agg(F.sum(F.col("w") * F.col("hit").cast("double")).alias("h"), F.sum("w").alias("n")).where("n > 0")
    q = lambda x: F.percentile(F.col("h") / F.col("n"), F.lit(x))
    return r.groupBy("bin").agg(q(0.025).alias("low"), q(0.975).alias("high"))


def identification_by_words(docs: DataFrame, far: float = 0.1, level: str = "document", edges: tuple[int, ...] = (1, 20, 50, 200, 1000), least_authors: int = 5) -> DataFrame:
    """``bin, label, accuracy, random, n_units, n_authors, share, achieved`` by the number of words of a document (``words``).

    At the author level an author stands in the bin of the mean number of words and is linked by any document. Documents
    without a number of words are left out. ``random`` is a uniform guesser behind a detector that knows nothing.
    """
    a = _accepted(docs, far, level).where("words is not null").withColumn("hit", F.col("accepted") & F.coalesce(F.ceil("rank") <= 1, F.lit(False)))
    if level == "author":
        a = a.groupBy("author").agg(F.max("hit").alias("hit"), F.avg("words").alias("words"), F.count(F.lit(1)).alias("m"), F.max("pool").alias("pool"), F.max("achieved").alias("achieved"))
        chance = 1 - F.pow(1 - F.col("achieved") / F.col("pool"), F.col("m"))
    else:
        chance = F.col("achieved") / F.col("pool")
    a = a.withColumn("bin", bin_of(F.col("words"), edges)).withColumn("chance", chance)
    extra = a.groupBy("bin").agg(F.avg("chance").alias("random"), F.max("achieved").alias("achieved"))
    both = binned_rate(a, least_authors).join(extra, "bin")
    n = both.agg(F.sum("n_units").alias("n"))
    names = F.create_map(*[x for i in range(len(edges)) for x in (F.lit(i), F.lit(bin_label(edges, i)))])
    return both.crossJoin(F.broadcast(n)).select("bin", names[F.col("bin")].alias("label"), "accuracy", "random", "n_units", "n_authors", (F.col("n_units") / F.col("n")).alias("share"), "achieved")  # a single row


def _beside(*rows: DataFrame) -> DataFrame:
    """Single rows side by side; those that aren't there, for want of strangers, say, as nulls."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r, F.lit(True), "left")
    return out


def rates(docs: DataFrame, far: float = 0.1) -> DataFrame:
    """``top1, authors_linked, dir_documents, dir_authors``: closed set, closed set of authors, and both at a rate of false acceptance."""
    from .detection import dir_at_far

    right = F.coalesce(F.ceil("rank") <= 1, F.lit(False))
    known = _usable(docs).where("not is_out")
    top = known.agg(F.avg(right.cast("double")).alias("top1"))
    linked = known.groupBy("author").agg(F.max(right).alias("x")).agg(F.avg(F.col("x").cast("double")).alias("authors_linked"))
    d = dir_at_far(docs.withColumn("correct", right & ~F.col("is_out")), (far,)).select(F.col("dir").alias("dir_documents"))
    a = identification_curve(docs, "author").where(F.col("far") == round(far * GRID) / GRID).select(F.col("rate").alias("dir_authors"))
    return _beside(top, linked, d, a)


def open_set_report(docs: DataFrame, far: float = 0.05) -> DataFrame:
    """One row: AUROC and average precision of strangers, equal error rate, DIR at a rate, and the rates of the whole set."""
    from .detection import auroc, average_precision, equal_error_rate

    e = equal_error_rate(docs).select("eer")
    n = _usable(docs).agg(F.sum(F.col("is_out").cast("bigint")).alias("n_out"), F.sum((~F.col("is_out")).cast("bigint")).alias("n_in"))
    return _beside(n, auroc(docs), average_precision(docs), e, rates(docs, far))


def background_evidence(scores: DataFrame, background: str) -> DataFrame:
    """``q, score``: the background class's logit less the log sum of exponentials of the authors' logits."""
    own = scores.where(F.col("label").cast("string") == background).select("q", F.col("score").alias("b"))
    rest = scores.where(F.col("label").cast("string") != background)
    top = rest.groupBy("q").agg(F.max("score").alias("m"))
    lse = rest.join(top, "q").groupBy("q", "m").agg((F.col("m") + F.log(F.sum(F.exp(F.col("score") - F.col("m"))))).alias("l"))
    return own.join(lse, "q").select("q", (F.col("b") - F.col("l")).alias("score"))


def grid_of_ranks(n: int, head: int = 100, ratio: float = 1.1) -> list[int]:
    """Ranks at which a curve is evaluated: all up to ``head``, then a geometric row, and ``n``."""
    ks, k = list(range(1, min(head, n) + 1)), float(head)
    while n > head and k * ratio < n:
        k *= ratio
        ks.append(round(k))
    return sorted({*ks, n})


def quantiles(df: DataFrame, value: str, name: str = "quantile") -> DataFrame:
    """``df`` with the average-rank quantile of a column: (rank + (ties - 1) / 2) / n; null values have none."""
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(per, ["_v"], {"_upto": "_c"})
    n = per.agg(F.sum("_c").alias("_n"))
    q = run.crossJoin(F.broadcast(n)).select("_v", ((F.col("_upto") - F.col("_c") + 1 + (F.col("_c") - 1) / 2.0) / F.col("_n")).alias(name))  # a single row
    return df.join(q, F.col(value) == F.col("_v"), "left").drop("_v")
