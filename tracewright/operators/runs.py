"""Runs: slices, attacks and metrics of a grid of cells, what they write, and what later steps read of them."""

from __future__ import annotations

import hashlib
import inspect
import json
import math
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from . import attacks as A
from . import detection as E
from . import ranking as K
from . import timeline as L


# --- keys ---------------------------------------------------------------------------------------------------------------
def params_hash(params: dict | None) -> str:
    """16 digits of the SHA-256 of parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(params or {}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def logic_hash(*producers: Callable, version: str = "") -> str:
    """16 digits of the SHA-256 of the producers' source texts and a version: another code, another key."""
    return hashlib.sha256("\0".join([version, *(inspect.getsource(p) for p in producers)]).encode()).hexdigest()[:16]


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def resolve_path(source: str, explicit: str | None = None, settings: dict | None = None, environment: str = "TRACEWRIGHT_DATA") -> str:
    """Where a source lies: the given path, else the environment's folder, else the settings'; never a download."""
    if explicit:
        return explicit
    folder = os.environ.get(environment) or (settings or {}).get(source) or (settings or {}).get("root")
    if not folder:
        raise FileNotFoundError(f"no path for {source!r}: give one, set {environment} or name it in the settings")
    return folder if (settings or {}).get(source) == folder else f"{folder.rstrip('/')}/{source}"


# --- rows of a run ------------------------------------------------------------------------------------------------------
def filter_documents(docs: DataFrame, **equal: str) -> DataFrame:
    """Rows whose columns have the given values, in any case; ``all`` lets every value pass."""
    for c, v in equal.items():
        if v.lower() != "all":
            docs = docs.where(F.lower(c) == v.lower())
    return docs


def scoped(docs: DataFrame, earlier: DataFrame, scope: str = "all", author: str = "author_id") -> DataFrame:
    """All rows, or with scope ``unseen`` those whose author doesn't occur in the earlier ones."""
    if scope not in ("all", "unseen"):
        raise ValueError(f"scope is all or unseen, not {scope!r}")
    return docs if scope == "all" else docs.join(earlier.select(author).where(F.col(author).isNotNull()).distinct(), author, "left_anti")


def with_known_side(docs: DataFrame, known: DataFrame, key: str = "doc") -> DataFrame:
    """The documents with the vectors of another table on the known side; a known document that isn't there is an error."""
    other = known.select(key, F.col("vec").alias("_other")).dropDuplicates([key])
    j = docs.join(other, key, "left").withColumn("vec", F.when(F.col("side") == "known", F.col("_other")).otherwise(F.col("vec")))
    lost = F.assert_true((F.col("side") != "known") | F.col("side").isNull() | F.col("_other").isNotNull(), F.concat(F.lit("no second vector of known document "), F.col(key).cast("string")))
    return j.where(lost.isNull()).drop("_other")


def halving_budget(n_known: int, n_authors: int, n_candidates: int, factor: int = 3) -> int:
    """Size of the first rung of a halving search, so that its last one uses the whole known side."""
    rungs = 1 + int(math.log(max(n_candidates, 1)) / math.log(factor) + 1e-9)
    if rungs == 1:
        return n_known
    return int(min(max(n_known // factor ** (rungs - 1), 2 * n_authors), max(n_known // factor, 1)))


def in_set_top1(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``top1, n`` over the documents whose author is a candidate."""
    known = truth.join(scores.select(F.col("label").alias("author")).distinct(), "author", "left_semi")
    return K.best(scores).join(known, "q").agg(F.avg((F.col("label") == F.col("author")).cast("double")).alias("top1"), F.count(F.lit(1)).alias("n"))


def halving_search(known: DataFrame, candidates: list[dict], attack: Callable, factor: int = 3, folds: tuple[float, ...] = (0.75,), seed: int = 1) -> DataFrame:
    """``settings, rung, n_docs, top1`` of a halving search over settings, by in-set top-1 on the later part of the known side.

    A rung takes a keyed sample of the authors' documents that grows by ``factor``; the best third goes on. Settings and
    rungs are few; what is large is one score relation at a time.
    """
    spark = known.sparkSession
    n, m = known.agg(F.count(F.lit(1)), F.countDistinct("author")).first()
    size, left, rows, rung = halving_budget(n, m, len(candidates), factor), list(candidates), [], 0
    while left:
        part = min(1.0, size / max(n, 1))
        some = cut(known.where(F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(1 << 20)) < int(part * (1 << 20)))) if part < 1 else known
        got = []
        for s in left:
            tops = []
            for f in folds:
                e = cut(L.split_known(some.drop("pos", "side"), "doc", end=f, test_start=f))
                u = e.where("side = 'unknown'")
                r = in_set_top1(attack(e.where("side = 'known'"), u, **s), u.select(F.col("doc").alias("q"), "author")).first()
                tops.append(r.top1 or 0.0)
            got.append((sum(tops) / len(tops), json.dumps(s, sort_keys=True), s))
        got.sort(key=lambda x: (-x[0], x[1]))
        rows += [(text, rung, int(part * n), float(top)) for top, text, _ in got]
        if len(left) == 1 or part >= 1:
            break
        left, size, rung = [s for *_, s in got[: max(1, len(got) // factor)]], size * factor, rung + 1
    return spark.createDataFrame(rows, "settings string, rung int, n_docs bigint, top1 double")


# --- cells --------------------------------------------------------------------------------------------------------------
def cell(known: DataFrame, unknown: DataFrame, attack: str, far: float = 0.1, standard: bool = False, **settings) -> tuple[DataFrame, DataFrame]:
    """One cell of a grid: predictions of all unknown documents, and one row of metrics.

    Predictions are ``q, author, label, score, rank, pool, accept_score, is_out``; documents of authors who aren't known have
    no rank and count for the open set only.
    """
    from .openset import open_set_report

    if standard:
        known, unknown = A.standardise(known, unknown)
    scores = cut(A.attack(attack)(known, unknown, **settings))
    truth = unknown.select(F.col("doc").alias("q"), "author")
    b, r = K.best(scores), K.true_ranks(scores, truth).select("q", "rank", "pool")
    accept = E.rejection(b).withColumnRenamed("score", "accept_score")
    names = known.select("author").distinct().withColumn("_in", F.lit(1))
    p = truth.join(b.select("q", "label", "score"), "q").join(r, "q", "left").join(accept, "q").join(names, "author", "left").withColumn("is_out", F.col("_in").isNull()).drop("_in")
    p = cut(p)
    known_docs = p.where("not is_out")
    s = K.summary(known_docs.select("q", "author", "rank", "pool")).crossJoin(K.top_k(known_docs, (1, 5, 10)).transform(top_columns))  # single rows
    o = open_set_report(p.select("q", "author", "rank", "pool", "is_out", F.col("accept_score").alias("score")), far).drop("top1")
    return p, s.crossJoin(o)


def top_columns(top: DataFrame) -> DataFrame:
    """``k, conv_acc, id_acc, …`` as one row with a column for each k: ``conv_acc1, id_acc1, …``."""
    names = [c for c in top.columns if c != "k"]
    r = top.groupBy().pivot("k", [1, 5, 10]).agg(*[F.first(c).alias(c) for c in names])
    return r.select(*[F.col(f"{k}_{c}").alias(f"{c}{k}") for k in (1, 5, 10) for c in names])


def grid(docs: DataFrame, windows: dict[str, tuple[float, float]], attacks: dict[str, dict], order: str = "doc", test_start: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of every known window and attack, with ``known_config, attack``: to be written partitioned by both."""
    preds = metrics = None
    for name, (start, end) in windows.items():
        e = cut(L.split_known(docs, order, start=start, end=end, test_start=test_start))
        for attack, settings in attacks.items():
            p, m = cell(e.where("side = 'known'"), e.where("side = 'unknown'"), attack, **settings)
            tag = lambda d, name=name, attack=attack: d.select(F.lit(name).alias("known_config"), F.lit(attack).alias("attack"), "*")
            preds, metrics = (tag(p), tag(m)) if preds is None else (preds.unionByName(tag(p)), metrics.unionByName(tag(m)))
    return preds, metrics


def write_grid(preds: DataFrame, metrics: DataFrame, path: str) -> None:
    """Both tables of a grid, partitioned by window and attack; writing again replaces the partitions that are there."""
    for d, name in ((preds, "predictions"), (metrics, "metrics")):
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("known_config", "attack").parquet(f"{path}/{name}")


def read_predictions(spark: SparkSession, path: str, attack: str | None = None, in_set: bool = True, from_share: float = 0.0) -> DataFrame:
    """Predictions of a run, of all windows: those of one attack, of known authors, and from a share of the test rows on."""
    p = spark.read.parquet(f"{path}/predictions")
    p = p if attack is None else p.where(F.col("attack") == attack)
    if from_share > 0:
        p = p.withColumn("_r", F.percent_rank().over(Window.partitionBy("known_config", "attack").orderBy("q"))).where(F.col("_r") >= from_share).drop("_r")
    return p.where("not is_out") if in_set else p


def chosen_settings(table: DataFrame, *keys: str) -> DataFrame:
    """Rows marked ``selected``, exactly one for each of the keys; none or several is an error when it is read."""
    per = table.groupBy(*keys).agg(F.sum(F.col("selected").cast("int")).alias("_n"))
    bad = F.assert_true(F.col("_n") == 1, F.concat(F.lit("not one selected row but "), F.col("_n").cast("string")))
    return table.where("selected").join(per.where(bad.isNull() | bad.isNotNull()), list(keys), "right").drop("_n")


def ledger(spark: SparkSession, path: str, **row) -> None:
    """Append one row to a ledger; earlier rows are never touched."""
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("append").json(path)


# --- caches of rows -----------------------------------------------------------------------------------------------------
def cached_rows(items: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``id, source, output`` of every item (``id, source``), and the rows to add to the cache.

    A cached row counts only where its id and its source are the item's; of all others each distinct source is computed
    once, however many ids have it.
    """
    if cache is None:
        hit = items.withColumn("output", F.lit(None).cast("string")).where("false")
        todo = items
    else:
        c = cache.select("id", "source", "output").dropDuplicates(["id", "source"])
        hit = items.join(c, ["id", "source"])
        todo = items.join(c, ["id", "source"], "left_anti")
    made = compute(todo.select("source").distinct())
    new = todo.join(made.select("source", "output"), "source").select("id", "source", "output")
    return hit.select("id", "source", "output").unionByName(new), new.distinct()


def requests_in_window(log: DataFrame, ts: str = "ts", tokens: str = "tokens", seconds: int = 60, limit: int | None = None) -> DataFrame:
    """``ts, tokens, in_window, wait``: tokens asked for in the last ``seconds``, and whether one more request has to wait.

    Time is cut into slices of the window's length, each with the slice before it, so that no sort has to hold the whole log.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = log.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts"), F.coalesce(F.col(tokens), F.lit(0)).alias("tokens"), at.alias("_at")).withColumn("_slice", F.floor(F.col("_at") / seconds))
    own = rows.withColumn("_own", F.lit(True))
    seen = own.unionByName(rows.withColumn("_slice", F.col("_slice") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_slice").orderBy("_at").rangeBetween(-seconds, 0)
    out = seen.withColumn("in_window", F.sum("tokens").over(w)).where("_own")
    return out.select("ts", "tokens", "in_window", (F.col("in_window") > limit if limit is not None else F.lit(False)).alias("wait"))


def taxonomy(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    """``kind, label``: label sets as a small table; empty sets, blank and repeated labels are errors."""
    for kind, labels in sets.items():
        if not labels or any(not x or x != x.strip() for x in labels) or len({x.lower() for x in labels}) < len(labels):
            raise ValueError(f"labels of {kind!r} are empty, blank or repeated")
    return spark.createDataFrame([(k, x) for k, v in sorted(sets.items()) for x in v], "kind string, label string")
