"""Metrics of a partition ``id, cluster`` against ``id, author``; all closed forms over the contingency of the two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_noise(parts: DataFrame, noise: int = -1) -> DataFrame:
    """Noise documents become clusters of their own."""
    return parts.withColumn("cluster", F.when(F.col("cluster").cast("string") == str(noise), F.concat(F.lit("noise-"), F.col("id").cast("string"))).otherwise(F.col("cluster").cast("string")))


def contingency(parts: DataFrame, truth: DataFrame) -> DataFrame:
    """``cluster, author, n, in_cluster, by_author``."""
    c = parts.join(truth, "id").groupBy("cluster", "author").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.groupBy("cluster").agg(F.sum("n").alias("in_cluster")), c.groupBy("author").agg(F.sum("n").alias("by_author"))
    return c.join(a, "cluster").join(b, "author")


def bcubed(table: DataFrame) -> DataFrame:
    """``precision, recall, f1``: F is the harmonic mean of the averages."""
    n = F.sum("n")
    pr = table.agg((F.sum(F.col("n") * F.col("n") / F.col("in_cluster")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("by_author")) / n).alias("recall"))
    return pr.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def pairwise(table: DataFrame) -> DataFrame:
    """``true_links, linked, hits, precision, recall, f1`` over pairs, counted in closed form."""
    p = lambda c: F.col(c) * (F.col(c) - 1) / 2
    hits = table.agg(F.sum(p("n")).alias("hits"))
    linked = table.select("cluster", "in_cluster").distinct().agg(F.sum(p("in_cluster")).alias("linked"))
    true = table.select("author", "by_author").distinct().agg(F.sum(p("by_author")).alias("true_links"))
    one = true.crossJoin(linked).crossJoin(hits)  # three single rows
    pr, rc = F.col("hits") / F.nullif(F.col("linked"), F.lit(0.0)), F.col("hits") / F.nullif(F.col("true_links"), F.lit(0.0))
    return one.select("true_links", "linked", "hits", pr.alias("precision"), rc.alias("recall"), (2 * F.col("hits") / F.nullif(F.col("linked") + F.col("true_links"), F.lit(0.0))).alias("f1"))


def per_author(table: DataFrame) -> DataFrame:
    """Of each author: documents, clusters, largest part in one cluster, whether any are linked, whether all are in one pure cluster."""
    return table.groupBy("author").agg(
        F.max("by_author").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.max("n") / F.max("by_author")).alias("largest_share"), (F.max("n") > 1).alias("any_link"),
        F.bool_or((F.col("n") == F.col("by_author")) & (F.col("n") == F.col("in_cluster"))).alias("reassembled"),
    )


def summary(table: DataFrame) -> DataFrame:
    """Shape of the partition: clusters, authors, singletons, largest share, purity, amplification of the chance of a link."""
    cl = table.groupBy("cluster", "in_cluster").agg(F.max("n").alias("top"))
    a = cl.agg(F.count(F.lit(1)).alias("clusters"), F.sum("in_cluster").alias("docs"), (F.sum((F.col("in_cluster") == 1).cast("bigint")) / F.sum("in_cluster")).alias("singleton_rate"),
               (F.max("in_cluster") / F.sum("in_cluster")).alias("largest_share"), (F.sum("top") / F.sum("in_cluster")).alias("purity"))
    b = table.select("author", "by_author").distinct().agg(F.count(F.lit(1)).alias("authors"))
    pw = pairwise(table).select((F.col("precision")).alias("link_precision"), "true_links")
    prevalence = F.col("true_links") / F.nullif(F.col("docs") * (F.col("docs") - 1) / 2, F.lit(0.0))
    return a.crossJoin(b).crossJoin(pw).withColumn("amplification", F.col("link_precision") / prevalence).drop("true_links")  # single rows


def full_report(table: DataFrame) -> DataFrame:
    """One row with everything about a partition: shape, sizes, BCubed and link metrics, authors, ceilings, baselines, amplification."""
    one = lambda d, prefix: d.select(*[F.col(c).alias(f"{prefix}_{c}") for c in d.columns])
    sizes = table.select("cluster", "in_cluster").distinct().agg(
        F.max("in_cluster").alias("largest"), F.avg("in_cluster").alias("mean_size"), F.percentile("in_cluster", F.lit(0.5)).alias("median_size"), F.sum((F.col("in_cluster") > 1).cast("bigint")).alias("linked_clusters")
    )
    au = per_author(table).agg(
        F.avg("largest_share").alias("mean_largest_share"), F.avg(F.when(F.col("n") > 1, F.col("any_link").cast("double"))).alias("any_link_rate"), F.avg(F.col("reassembled").cast("double")).alias("reassembled_rate"), F.avg("clusters").alias("clusters_per_author")
    )
    by = table.select("author", "by_author").distinct()
    n = F.sum("by_author")
    base = by.agg((F.count(F.lit(1)) / n).alias("singleton_recall"), (F.sum(F.col("by_author") * F.col("by_author")) / (n * n)).alias("single_precision"))
    pw = pairwise(table)
    return summary(table).drop("link_precision").crossJoin(sizes).crossJoin(au).crossJoin(base).crossJoin(bcubed(table)).crossJoin(one(pw, "link")).crossJoin(one(oracle_split(table).select("recall", "f1"), "split")).crossJoin(one(oracle_merge(table).select("precision", "f1"), "merge"))  # single rows


def singleton_baseline(truth: DataFrame) -> DataFrame:
    """Every document alone: precision 1, recall the mean of one over the author's number."""
    n = F.count(F.lit(1)).over(Window.partitionBy("author"))
    return truth.withColumn("n", n).agg(F.lit(1.0).alias("precision"), F.avg(1 / F.col("n")).alias("recall"))


def single_cluster_baseline(truth: DataFrame) -> DataFrame:
    """All in one: recall 1, precision the mean share of the author."""
    c = truth.groupBy("author").agg(F.count(F.lit(1)).alias("c"))
    return c.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("precision"), F.lit(1.0).alias("recall"))


def oracle_split(table: DataFrame) -> DataFrame:
    """BCubed after an oracle has split every cluster by author: what fragmentation alone costs."""
    n = F.sum("n")
    pr = table.agg(F.lit(1.0).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("by_author")) / n).alias("recall"))
    return pr.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def oracle_merge(table: DataFrame) -> DataFrame:
    """BCubed after an oracle has given every cluster to its main author: what impurity alone costs."""
    main = table.groupBy("cluster").agg(F.max_by("author", F.struct("n", "author")).alias("main"))
    t = table.join(main, "cluster").groupBy("main", "author").agg(F.sum("n").alias("n"))
    again = t.withColumnRenamed("main", "cluster")
    a, b = again.groupBy("cluster").agg(F.sum("n").alias("in_cluster")), again.groupBy("author").agg(F.sum("n").alias("by_author"))
    return bcubed(again.join(a, "cluster").join(b, "author"))


def shape(table: DataFrame) -> DataFrame:
    """Mean clusters of an author, mean authors of a cluster, share of documents in pure clusters."""
    a = table.groupBy("author").agg(F.count(F.lit(1)).alias("k")).agg(F.avg("k").alias("clusters_per_author"))
    c = table.groupBy("cluster", "in_cluster").agg(F.count(F.lit(1)).alias("k"))
    c = c.agg(F.avg("k").alias("authors_per_cluster"), (F.sum(F.when(F.col("k") == 1, F.col("in_cluster")).otherwise(0)) / F.sum("in_cluster")).alias("pure_share"))
    return a.crossJoin(c)  # single rows


def size_bin(n) -> "F.Column":
    return F.when(n <= 1, "1").when(n <= 2, "2").when(n <= 4, "3-4").when(n <= 8, "5-8").when(n <= 16, "9-16").otherwise("17+")


def error_slices(table: DataFrame) -> DataFrame:
    """``bin, docs, precision, recall``: BCubed by the size of the author."""
    t = table.withColumn("bin", size_bin(F.col("by_author")))
    n = F.sum("n")
    return t.groupBy("bin").agg(n.alias("docs"), (F.sum(F.col("n") * F.col("n") / F.col("in_cluster")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("by_author")) / n).alias("recall"))


def per_document(parts: DataFrame, truth: DataFrame) -> DataFrame:
    """``id, precision, recall`` of each document."""
    t = contingency(parts, truth)
    return parts.join(truth, "id").join(t, ["cluster", "author"]).select("id", (F.col("n") / F.col("in_cluster")).alias("precision"), (F.col("n") / F.col("by_author")).alias("recall"))


def link_ranking(edges: DataFrame, truth: DataFrame, at: int = 10) -> DataFrame:
    """``average_precision, r_precision, precision_at`` of edges by distance (ties by ids); relevant edges join one author."""
    from .timeline import positions

    a = truth.toDF("src", "a1")
    b = truth.toDF("dst", "a2")
    e = edges.join(a, "src").join(b, "dst").select("src", "dst", "distance", (F.col("a1") == F.col("a2")).cast("bigint").alias("rel"))
    total = truth.groupBy("author").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("r"))
    p = positions(e, "distance", "src", "dst")
    # hits so far: within ranges of positions, then over their sums
    p = p.withColumn("bucket", F.floor(F.col("pos") / 10_000))
    sums = p.groupBy("bucket").agg(F.sum("rel").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.join(sums.select("bucket", "before"), "bucket").withColumn("hits", F.col("before") + F.sum("rel").over(Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.crossJoin(F.broadcast(total))  # one row
    return p.groupBy("r").agg(
        (F.sum(F.col("rel") * F.col("hits") / (F.col("pos") + 1))).alias("s"), F.sum(F.when(F.col("pos") < F.col("r"), F.col("rel")).otherwise(0)).alias("top"), F.sum(F.when(F.col("pos") < at, F.col("rel")).otherwise(0)).alias("first"),
    ).select((F.col("s") / F.col("r")).alias("average_precision"), (F.col("top") / F.col("r")).alias("r_precision"), (F.col("first") / F.lit(float(at))).alias("precision_at"))


def auc_from_histogram(h: DataFrame) -> DataFrame:
    """``auc`` from ``bin, pos, neg`` counts, higher bins more alike, ties half."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0))
    t = h.withColumn("u", F.col("pos") * (below + F.col("neg") / 2.0))
    return t.agg((F.sum("u") / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))


def ap_from_histogram(h: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    t = h.withColumn("tp", F.sum("pos").over(w)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(w)).where("all > 0")
    return t.agg((F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("ap"))


def shape_of_collection(truth: DataFrame) -> DataFrame:
    """Documents, authors, true links and their prevalence among all pairs."""
    c = truth.groupBy("author").agg(F.count(F.lit(1)).alias("c"))
    links, docs = F.sum(F.col("c") * (F.col("c") - 1) / 2), F.sum("c")
    return c.agg(docs.alias("docs"), F.count(F.lit(1)).alias("authors"), links.alias("true_links"), (links / F.nullif(docs * (docs - 1) / 2, F.lit(0.0))).alias("prevalence"))
