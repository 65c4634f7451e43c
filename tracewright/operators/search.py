"""Search defenses: a probe loop toward a linkage target, and an evolved turn that hides every document it is added to.

Rewriting models are functions of texts; deterministic stand-ins make the loops testable without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .unlink import hashed_ngrams, objective, target


def _levels(text: str, level: int) -> str:
    """Stand-in rewriter: lower case; without punctuation; words in hash order of their sentence."""
    import re

    out = text.lower()
    if level >= 1:
        out = re.sub(r"[^\w\s]", "", out)
    if level >= 2:
        out = "\n".join(" ".join(sorted(line.split(), key=lambda w: xxhash.xxh3_64_intdigest(w))) for line in out.splitlines())
    return out


def footprint_loop(
    docs: DataFrame, *order: str, alpha: float = 0.5, priors: int = 20, pool: int = 20, most_probes: int = 4, rewrite: Callable[[str, int], str] = _levels, embed=hashed_ngrams, seed: int = 1
) -> DataFrame:
    """``doc_id, author_id, turns, linkage, target, probes, outcome``: each document rewritten until its linkage to the author's earlier ones meets a target.

    At most ``priors`` earlier documents and ``pool`` documents of others (by a hash) are compared with. A probe is kept if it
    improves strictly; after one that doesn't, the next level is tried. Turns keep their number. Outcomes: ``met``,
    ``exhausted``, ``no_priors``.
    """
    d = docs.where("doc_id is not null and turns is not null").withColumn("_text", F.array_join("turns", "\n\n"))
    before = Window.partitionBy("author_id").orderBy(*order).rowsBetween(-priors, -1)
    some = d.orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(pool).agg(F.collect_list(F.struct("author_id", "_text")).alias("_pool"))  # one row of a fixed number of texts
    # documents without an author have no earlier ones and stay out of the exchange
    rows = d.where("author_id is not null").withColumn("_prior", F.collect_list("_text").over(before))
    rows = rows.unionByName(d.where("author_id is null").withColumn("_prior", F.array().cast("array<string>"))).crossJoin(F.broadcast(some)).select("doc_id", "author_id", "turns", "_prior", "_pool")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            bank = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in f["_pool"].iloc[0]] if len(f) else []
            vectors = embed([t for _, t in bank])
            for r in f.itertuples(index=False):
                turns = ["" if t is None else t for t in r[2]]
                if not len(r[3]):
                    out.append((r[0], r[1], turns, None, None, 0, "no_priors"))
                    continue
                sib = embed(list(r[3]))
                others = vectors[[i for i, (a, _) in enumerate(bank) if a is None or a != r[1]]]
                most, now, generic = objective(embed(["\n\n".join(turns)])[0], sib, others)
                goal, level, best, probes = target(most, generic, alpha), 0, most, 0
                outcome = "met" if best <= goal else "exhausted"
                while probes < most_probes and best > goal and level < 3:
                    probes += 1
                    new = [rewrite(t, level) for t in turns]
                    got = objective(embed(["\n\n".join(new)])[0], sib, others)[0]
                    if got < best:
                        turns, best = new, got
                        outcome = "met" if best <= goal else outcome
                    else:
                        level += 1
                out.append((r[0], r[1], turns, best, goal, probes, outcome))
            yield pd.DataFrame(out, columns=["doc_id", "author_id", "turns", "linkage", "target", "probes", "outcome"])

    return rows.mapInPandas(run, "doc_id string, author_id string, turns array<string>, linkage double, target double, probes int, outcome string")


def fitness(docs: DataFrame, candidates: list[str], embed=hashed_ngrams) -> dict[str, float]:
    """One less the mean cosine of a document to itself with the turn added, for each candidate, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(shared.value)), 0
        for f in frames:
            for t in f["text"]:
                v = embed([t, *[f"{t}\n\n{c}" for c in shared.value]])
                total += v[1:] @ v[0]
                n += 1
        yield pd.DataFrame({"i": range(len(total)), "s": total, "n": n})

    t = docs.where("turns is not null").select(F.array_join("turns", "\n\n").alias("text")).where("length(text) > 0")
    got = t.mapInPandas(run, "i int, s double, n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # a row for each candidate
    return {candidates[r.i]: 1 - r.s / r.n if r.n else 0.0 for r in got}


def evolve_turn(docs: DataFrame, seeds: list[str], generations: int = 3, children: int = 8, lengths: tuple[int, ...] = (40, 120), mix: Callable[[str, str, int], str] | None = None, seed: int = 1) -> list[tuple[str, float]]:
    """Turns by fitness, best first: an archive with a cell for each class of length and of word variety, bred for some generations.

    ``mix`` makes a child of two parents; the stand-in joins their halves. Fitness is measured over all documents, for all
    children of a generation in one job.
    """

    def halves(a: str, b: str, k: int) -> str:
        x, y = a.split(), b.split()
        return " ".join(x[: max(1, len(x) // 2)] + y[len(y) // 2 :]) if k % 2 else f"{a} {b}"

    def cell(t: str) -> tuple[int, int]:
        w = t.lower().split()
        return sum(len(t) > x for x in lengths), int(3 * len(set(w)) / max(1, len(w)) * 0.999)

    breed, archive = mix or halves, {}

    def place(scored: dict[str, float]) -> None:
        for t, s in sorted(scored.items()):
            c = cell(t)
            if c not in archive or s > archive[c][1]:
                archive[c] = (t, s)

    place(fitness(docs, sorted(set(seeds))))
    for g in range(generations):
        elite = sorted(archive.values())
        pick = lambda k, j: elite[xxhash.xxh3_64_intdigest(f"{seed}/{g}/{k}/{j}") % len(elite)][0]  # noqa: B023, E731
        new = sorted({breed(pick(k, 0), pick(k, 1), k) for k in range(children)} - {t for t, _ in archive.values()})
        if not new:
            break
        place(fitness(docs, new))
    return sorted(archive.values(), key=lambda x: (-x[1], x[0]))
