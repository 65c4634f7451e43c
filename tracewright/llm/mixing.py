"""Problem 8: a mixture of sources with target shares, by cube-method balanced sampling.

The size of the mixture is the largest at which every source can reach its share without a text being used more than the
source's ``max_repeats`` times. A source whose quota is q times its tokens uses every text floor(q) times, and a text once
more with the fractional inclusion probability q - floor(q). The cube method makes those into zeros and ones: in the flight
phase the probabilities move through the null space of the balancing constraints (numbers of documents and of tokens), so
that both totals stay as they are, until no more than two are left; these land on the vertex that is nearest to the totals.

The flight runs over cells of at most ``cell`` texts in parallel. What a cell leaves undecided, two texts at most, goes to
the next level, whose cells are those texts; after a few levels one cell for each source is left and lands. So neither a
task nor the driver ever holds a source, however large, and the totals of a source are missed by no more than two texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from . import bpe


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moves inclusion probabilities until at most two are fractional; keeps sum(p) and sum(p * size)."""
    p = np.asarray(p, float).tolist()
    scale = max(1.0, float(np.abs(size).max(initial=0)))
    x = (np.asarray(size, float) / scale).tolist()  # of each text its tokens; the other constraint counts it as 1
    eps = 1e-11
    open_ = iter([i for i, v in enumerate(p) if eps < v < 1 - eps])
    hand: list[int] = []
    while True:
        while len(hand) < 3 and (nxt := next(open_, None)) is not None:
            hand.append(nxt)
        if len(hand) < 3:
            break
        i, j, k = hand
        # a vector of the null space of the 2 x 3 matrix: the cross product of its rows (1, 1, 1) and the tokens
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if max(map(abs, u)) < eps:
            u = (1.0, -1.0, 0.0)  # texts of equal size: any exchange is balanced
        up = down = float("inf")
        for h, d in zip(hand, u):
            if d > 0:
                up, down = min(up, (1 - p[h]) / d), min(down, p[h] / d)
            elif d < 0:
                up, down = min(up, -p[h] / d), min(down, (p[h] - 1) / d)
        # the end is drawn so that the expectation stays; the draw is a hash of the position, so a rerun gives the same
        draw = ((i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + k) & 0xFFFFFFFF) / 0x100000000
        step = up if draw < down / (up + down) else -down
        for h, d in zip(hand, u):
            v = p[h] + step * d
            p[h] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        hand = [h for h in hand if 0 < p[h] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Zeros and ones for the last fractional probabilities: the vertex nearest in tokens, then in documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    best = None
    for bits in range(1 << len(left)):
        v = np.array([bits >> i & 1 for i in range(len(left))], float)
        miss = (abs(((v - p[left]) * size[left]).sum()), abs((v - p[left]).sum()), bits)
        if best is None or miss < best[0]:
            best = (miss, v)
    p = p.copy()
    p[left] = best[1]
    return p


def plan(usable: DataFrame, targets: DataFrame, most: int = 10_000) -> pd.DataFrame:
    """Quota of every source: a table with one row for each row of the targets, whose number is checked.

    Sources with a null name or without a positive share are left out, as are those without texts (their share can't be
    reached and is shared out among the others); a source named twice has its largest share.
    """
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source")
    t = t.agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    have = usable.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    rows = t.join(have, "source", "left").limit(most + 1).toPandas().sort_values("source", ignore_index=True)
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    rows[["docs", "tokens"]] = rows[["docs", "tokens"]].fillna(0).astype(float)
    rows["repeats"] = rows["repeats"].clip(lower=0)
    there = (rows["tokens"] > 0) & (rows["repeats"] > 0)
    share = rows["share"].where(there, 0.0)
    rows["goal"] = share / share.sum() if share.sum() > 0 else 0.0
    whole = (rows["tokens"] * rows["repeats"] / rows["goal"].where(rows["goal"] > 0)).min()
    rows["quota"] = (rows["goal"] * whole).fillna(0.0)
    rows["uses"] = np.minimum(rows["quota"] / rows["tokens"].where(rows["tokens"] > 0), rows["repeats"]).fillna(0.0)
    return rows


def texts_once(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the distinct texts of the sources with a target.

    Null, empty and blank texts, null ids and rows without a source of the targets take no part. A text under several ids
    counts once, under the smallest id, so that copies can't get round the cap on repeats.
    """
    known = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(F.col("source").alias("source")).distinct()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    rows = spread(rows.join(known, "source"), "doc_id")
    counted = bpe.count_tokens(rows, path=path).select("doc_id", "source", "n_tokens", F.sha2("text", 256).alias("same"))
    least = F.min_by(F.struct("doc_id", "source", "n_tokens"), F.struct("doc_id", "source")).alias("t")
    return counted.where("n_tokens > 0").groupBy("same").agg(least).select("t.*")


def mixture(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell: int = 4096, path: str = bpe.DEFAULT_VOCABULARY
) -> tuple[DataFrame, pd.DataFrame]:
    """``doc_id, source, n_tokens, copies`` of the texts in the mixture, and the plan it follows.

    An empty table, or one without a source of the targets, gives an empty mixture. Extra columns are left out.
    """
    spark = df.sparkSession
    once = cut(texts_once(df, targets, id_col, text_col, source_col, path))
    rows = plan(once, targets)
    kind = once.schema["doc_id"].dataType.simpleString()
    shape = f"source string, level int, cell bigint, doc_id {kind}, n_tokens bigint, base int, p double"
    if not len(rows) or rows["quota"].sum() <= 0:
        return spark.createDataFrame([], f"doc_id {kind}, source string, n_tokens bigint, copies int"), rows
    uses = rows.loc[rows["uses"] > 0, ["source", "uses", "docs"]].copy()
    uses["base"] = np.floor(uses["uses"] + 1e-12).astype(int)
    uses["p"] = (uses["uses"] - uses["base"]).clip(lower=0)
    uses["cells"] = np.ceil(uses["docs"] / (cell // 2)).clip(lower=1).astype(int)
    # one row for each source
    q = F.broadcast(spark.createDataFrame(uses[["source", "base", "p", "cells"]].astype({"base": "int32", "cells": "int64"})))
    start = once.join(q, "source").select(
        "source", F.lit(0).alias("level"), F.pmod(F.xxhash64("doc_id"), F.col("cells")).alias("cell"), "doc_id", "n_tokens", F.col("base").cast("int"), "p"
    )

    def step(last: bool):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            # the longest first, so that what is left to land is short
            f = f.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
            size = f["n_tokens"].to_numpy(float)
            p = flight(f["p"].to_numpy(), size)
            f["p"] = landing(p, size) if last else p
            return f

        return run

    done, level, cells = None, 0, int(uses["cells"].max())
    todo = start
    while True:
        last = cells == 1
        # as many tasks as there are cells, up to a few for each core: cells are small in bytes and heavy in work, so that
        # adaptive execution would put them all into one
        n_tasks = int(min(len(uses) * cells, 4 * spark.sparkContext.defaultParallelism + len(uses) * cells // 16))
        moved = cut(todo.repartition(max(1, n_tasks), "source", "cell").groupBy("source", "cell").applyInPandas(step(last), shape))
        settled = moved.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        # at most two texts of each cell are left, so a next cell of `cell` texts takes those of cell / 2 cells
        level, cells = level + 1, -(-cells // (cell // 2))
        todo = moved.where("p > 0 and p < 1").select(
            "source", F.lit(level).alias("level"), F.pmod("cell", F.lit(cells)).cast("bigint").alias("cell"), "doc_id", "n_tokens", "base", "p"
        )
    out = done.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("copies"))
    return out.where("copies > 0"), rows


def reached(mix: DataFrame, rows: pd.DataFrame) -> DataFrame:
    """``source, target_share, actual_share, docs, uses, tokens``: what the mixture really has; sources without a text as well."""
    spark = mix.sparkSession
    goal = spark.createDataFrame(rows[["source", "share"]]) if len(rows) else spark.createDataFrame([], "source string, share double")
    got = mix.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    all_tokens = got.agg(F.sum("tokens").alias("all"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = goal.join(got, "source", "left").crossJoin(F.broadcast(all_tokens))  # a single row
    return both.select("source", F.col("share").alias("target_share"), (F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), z("docs"), z("uses"), z("tokens"), z("most_copies"))
