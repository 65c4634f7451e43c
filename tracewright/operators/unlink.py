"""Greedy unlinking of an author's documents: drop the spans that link most until a budget is met.

The vectors of texts come from a function of texts, hashed character n-grams where no model is plugged in. A document is
measured against all of its author's other documents. A prolific author's documents are rewritten in blocks, each of which
holds the vectors of all the author's documents; other authors are put together into groups of about 2,048 documents.
With hashed n-grams a text without a span isn't made into a vector again: its counts are those of the text less those of
the n-grams in the span (:class:`Counts`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bins(raw: np.ndarray, n: int = 4, bits: int = 12) -> np.ndarray:
    """Hash of each n-gram of bytes along the last axis."""
    raw = raw.astype(np.uint64)
    size = max(raw.shape[-1] - n + 1, 0)
    h = np.zeros((*raw.shape[:-1], size), np.uint64)
    for k in range(n if size else 0):
        h = h * np.uint64(0x100000001B3) + raw[..., k : k + size] + np.uint64(1)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def hashed_ngrams(texts: list[str], n: int = 4, bits: int = 12) -> np.ndarray:
    """Unit vectors of counts of hashed character n-grams."""
    out = np.zeros((len(texts), 1 << bits))
    for i, t in enumerate(texts):
        out[i] = np.bincount(_bins(np.frombuffer(t.encode("utf-8"), np.uint8), n, bits), minlength=1 << bits)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def top_similarity(v: np.ndarray, siblings: np.ndarray, m: int = 3) -> float:
    """Mean of the m largest cosines to the siblings."""
    s = np.sort(siblings @ v)[::-1][:m]
    return float(s.mean()) if len(s) else 0.0


def objective(v: np.ndarray, siblings: np.ndarray, pool: np.ndarray, m: int = 3) -> tuple[float, float, float]:
    """Largest and mean of the m largest cosines to the siblings, median cosine to a pool of other texts."""
    s = siblings @ v if len(siblings) else np.zeros(1)
    return float(s.max()), float(np.sort(s)[::-1][:m].mean()), float(np.median(pool @ v)) if len(pool) else 0.0


def target(largest: float, generic: float, alpha: float) -> float:
    """The linkage to reach: generic similarity plus a share of what is above it."""
    return generic + alpha * max(0.0, largest - generic)


class Siblings:
    """Mean of the m largest cosines of a document's variants to all rows of ``vectors`` but its own.

    A row's cosine to a variant is at most that of its angle to the document less the variant's angle to the document; rows
    that can't come among the m largest by this aren't compared, so that the result is that of comparing all.
    """

    def __init__(self, vectors: np.ndarray, own: int, v: np.ndarray, m: int = 3, first: int = 64):
        self.vectors, self.v, self.m, self.first = vectors, v, m, first
        near = vectors @ v
        order = np.argsort(-near, kind="stable")
        self.order = order[order != own]
        self.near = near[self.order]

    def top(self, variants: np.ndarray) -> np.ndarray:
        got = variants @ self.vectors[self.order[: self.first]].T
        if len(self.order) > self.first:
            least = np.sort(got, axis=1)[:, -self.m]
            away = np.arccos(np.clip(variants @ self.v, -1, 1)) + np.arccos(np.clip(least, -1, 1))
            need = np.cos(np.minimum(away, np.pi)).min() - 1e-9
            n = int(np.searchsorted(-self.near, -need, side="right"))
            for k in range(self.first, n, 1024):
                more = variants @ self.vectors[self.order[k : min(n, k + 1024)]].T
                got = np.sort(np.concatenate([got, more], axis=1), axis=1)[:, -self.m :]
        return np.sort(got, axis=1)[:, -self.m :].mean(axis=1)


class Counts:
    """Counts of the hashed 4-grams of all of an author's texts, for :class:`Spans`.

    Products of counts are whole numbers, exact in the float type chosen, so that equal texts are equally near.
    """

    bits = 12

    def __init__(self, texts: list[str]):
        size = 1 << self.bits
        rows = np.zeros((len(texts), size), np.uint8)
        square = np.zeros(len(texts))
        for i, t in enumerate(texts):
            c = np.bincount(_bins(np.frombuffer(t.encode("utf-8"), np.uint8), bits=self.bits), minlength=size)
            if c.max() > np.iinfo(rows.dtype).max:
                rows = rows.astype(np.min_scalar_type(int(c.max())))
            rows[i], square[i] = c, c @ c
        self.columns = np.ascontiguousarray(rows.T)
        self.norm = np.maximum(np.sqrt(square), 1e-12)
        self.float = np.float32 if square.max(initial=0) < 1 << 22 else np.float64

    def products(self, counts: np.ndarray) -> np.ndarray:
        """Rows of counts times the counts of every text."""
        out = np.empty((len(counts), self.columns.shape[1]))
        for k in range(0, out.shape[1], 1024):
            out[:, k : k + 1024] = counts.astype(self.float) @ self.columns[:, k : k + 1024].astype(self.float)
        return out


class Spans:
    """Linkage of a text of spans to an author's other texts as its spans are left out one by one.

    A text without a span has at most the product of the text with a row, and what the n-grams over the gap add. Only the
    ``first`` rows nearest to the text are multiplied out for all spans, which gives each span's linkage or less than it;
    a span that may be the best by this is compared with all rows unless no other row can come among its m largest, so
    that the result is that of comparing all.
    """

    def __init__(self, counts: Counts, own: int, parts: list[bytes], gaps: list[int], products: np.ndarray, m: int = 3, first: int = 64):
        """``parts``: the text in pieces; ``gaps``: bytes between turns before each piece and after the last."""
        self.counts, self.own, self.m, self.first = counts, own, m, first
        self.parts, self.gaps, self.near = parts, gaps, products
        self.length = np.maximum(np.array([len(p.decode("utf-8")) for p in parts]) / 100, 0.05)
        self._read()

    def _read(self) -> None:
        joined, at = [], 0
        self.start = np.zeros(len(self.parts), np.int64)
        self.size = np.array([len(p) for p in self.parts])
        for i, p in enumerate(self.parts):
            joined += [b"\n" * self.gaps[i], p]
            self.start[i] = at = at + self.gaps[i]
            at += len(p)
        self.raw = np.frombuffer(b"".join(joined) + b"\n" * self.gaps[-1], np.uint8)
        self.hash = _bins(self.raw, bits=self.counts.bits)
        self.norm = float(np.linalg.norm(np.bincount(self.hash))) if len(self.hash) else 1e-12

    def _top(self, near: np.ndarray) -> np.ndarray:
        m = min(self.m, near.shape[-1])
        return np.sort(np.partition(near, near.shape[-1] - m, axis=-1)[..., near.shape[-1] - m :], axis=-1)

    def _others(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[self.own] = -np.inf
        return x

    def now(self) -> float:
        """Mean of the m largest cosines of the text."""
        if len(self.counts.norm) < 2:
            return 0.0
        x = np.delete(self.near, self.own) / np.delete(self.counts.norm, self.own) / self.norm
        return float(self._top(x).mean())

    def changes(self, tries: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in question, and of each span their counts in the text less those without it, the square without it, the norm added."""
        s = self.start[tries]
        e = s + self.size[tries]
        a, b = np.maximum(s - 3, 0), np.minimum(e, len(self.hash))
        n = np.maximum(b - a, 0)
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        k = np.arange(3)
        over = np.concatenate([s[:, None] - 3 + k, e[:, None] + k], axis=1)
        valid = (s[:, None] - 3 + k >= 0) & (e[:, None] + k < len(self.raw))
        new = _bins(self.raw[np.clip(over, 0, len(self.raw) - 1)], bits=self.counts.bits)[valid]
        u = np.flatnonzero(np.bincount(np.concatenate([self.hash, new])))
        place = np.zeros(1 << self.counts.bits, np.int64)
        place[u] = np.arange(len(u))
        whole, new = place[self.hash], place[new]
        less = np.bincount(np.repeat(np.arange(len(tries)), n) * len(u) + whole[at], minlength=len(tries) * len(u)).reshape(len(tries), len(u))
        more = np.bincount(np.nonzero(valid)[0] * len(u) + new, minlength=len(tries) * len(u)).reshape(len(tries), len(u))
        rest = np.bincount(whole, minlength=len(u)) - less + more
        return u, less - more, np.maximum(np.sqrt((rest * rest).sum(axis=1)), 1e-12), np.sqrt((more * more).sum(axis=1))

    def best(self, tries: list[int], now: float) -> tuple[int, float]:
        """Position among ``tries`` of the span with the most linkage for its length (of characters), and the linkage without it."""
        c = self.counts
        u, change, norm, added = self.changes(tries)
        near = self._others(self.near / c.norm)
        if len(near) - 1 > self.first:
            part = np.argpartition(-near, self.first)
            rows, beyond = part[: self.first], near[part[self.first]]
        else:
            rows, beyond = np.delete(np.arange(len(near)), self.own), -np.inf
        cos = (self.near[rows] - change.astype(c.float) @ c.columns[np.ix_(u, rows)].astype(c.float)) / c.norm[rows] / norm[:, None]
        top = self._top(cos)
        sims, done = top.mean(axis=1), (beyond + added) / norm < top[:, 0] - 1e-9
        length = self.length[tries]
        gain = (now - sims) / length
        while not done[i := int(np.argmax(gain))]:
            sims[i] = self._top(self._others((self.near - self._product(u, change[i])) / c.norm / norm[i])).mean()
            gain[i], done[i] = (now - sims[i]) / length[i], True
        self._last = (u, change)
        return i, float(sims[i])

    def _product(self, u: np.ndarray, change: np.ndarray) -> np.ndarray:
        use = np.nonzero(change)[0]
        return change[use].astype(self.counts.float) @ self.counts.columns[u[use]].astype(self.counts.float)

    def drop(self, part: int, place: int) -> None:
        """Leave a span out that stood at ``place`` of the last tries."""
        u, change = self._last
        self.near = self.near - self._product(u, change[place])
        self.parts = [b"" if i == part else p for i, p in enumerate(self.parts)]
        self._read()


def _turns(turns: list[str], parts: list[dict], keep: list[bool]) -> list[str]:
    """The turns of the spans that are kept; a turn without spans is empty."""
    out = [""] * len(turns)
    for p, x in zip(parts, keep):
        if x:
            out[p["turn_no"]] += p["text"]
    return out


def _by_counts(texts: list[str], at: list[int], docs: list[tuple[list[str], list[dict]]], budget: float, most_steps: int):
    """``keep, before, after`` of each document: its place among the author's texts, its turns and spans."""
    c = Counts(texts)
    for k in range(0, len(docs), 128):
        made = []
        for turns, parts in docs[k : k + 128]:
            pieces = [p["text"].encode("utf-8") for p in parts] if parts else ["\n\n".join(turns).encode("utf-8")]
            no = [p["turn_no"] for p in parts] if parts else [0]
            made.append((pieces, [2 * (x - y) for x, y in zip([*no, (len(turns) if parts else 1) - 1], [0, *no])]))
        whole = [b"".join(x for p, g in zip([b"", *pieces], gaps) for x in (p, b"\n" * g)) for pieces, gaps in made]
        rows = np.stack([np.bincount(_bins(np.frombuffer(x, np.uint8), bits=c.bits), minlength=1 << c.bits) for x in whole])
        for (_, parts), (pieces, gaps), own, near in zip(docs[k : k + 128], made, at[k : k + 128], c.products(rows)):
            s = Spans(c, own, pieces, gaps, near)
            keep = [True] * len(parts)
            before = now = s.now()
            for _ in range(most_steps):
                if now <= (1 - budget) * before:
                    break
                tries = [i for i, (p, x) in enumerate(zip(parts, keep)) if x and p["editable"]]
                if len(tries) < 2:
                    break
                best, sim = s.best(tries, now)
                if sim >= now:
                    break
                s.drop(tries[best], best)
                keep[tries[best]], now = False, sim
            yield keep, before, now


def _by_vectors(texts: list[str], at: list[int], docs: list[tuple[list[str], list[dict]]], budget: float, most_steps: int, embed: Callable[[list[str]], np.ndarray]):
    """As :func:`_by_counts`, for any function of texts."""
    vectors = np.concatenate([embed(texts[k : k + 256]) for k in range(0, len(texts), 256)])
    for own, (turns, parts) in zip(at, docs):
        keep = [True] * len(parts)
        full = lambda k: "\n\n".join("".join(p["text"] for p, x in zip(parts, k) if x and p["turn_no"] == t) for t in range(len(turns)))  # noqa: B023, E731
        v = embed([full(keep) if parts else "\n\n".join(turns)])[0]
        sib = Siblings(vectors, own, v)
        before = now = float(sib.top(v[None])[0])
        for _ in range(most_steps):
            if now <= (1 - budget) * before:
                break
            tries = [i for i, (p, x) in enumerate(zip(parts, keep)) if x and p["editable"]]
            if len(tries) < 2:
                break
            sims = sib.top(embed([full([x and j != i for j, x in enumerate(keep)]) for i in tries]))
            gain = [(now - s) / max(len(parts[i]["text"]) / 100, 0.05) for i, s in zip(tries, sims)]
            best = int(np.argmax(gain))
            if sims[best] >= now:
                break
            keep[tries[best]], now = False, float(sims[best])
        yield keep, before, now


def unlink(docs: DataFrame, budget: float = 0.2, block: int = 1024, most_blocks: int = 16, most_steps: int = 10, embed: Callable[[list[str]], np.ndarray] = hashed_ngrams, seed: int = 1) -> DataFrame:
    """``doc_id, author_id, turns, before, after, dropped``: spans dropped until the linkage has fallen by the share ``budget``.

    In each step the span with the most linkage for its length goes; documents without siblings stay. Protected spans and
    turns' number stay; a turn may become empty.
    """
    from .defenses import span_array

    d = docs.where("doc_id is not null and turns is not null").select("doc_id", "author_id", "turns")
    n = d.where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    large = n.where(F.col("n") > block).select("author_id", F.least(F.ceil(F.col("n") / block), F.lit(most_blocks)).cast("int").alias("blocks"))  # a row for each `block` documents at most
    groups = n.agg(F.coalesce(F.ceil(F.sum(F.when(F.col("n") <= block, F.col("n"))) / 2048), F.lit(1)).alias("groups"))
    alone = d.where("author_id is null").select("doc_id", "author_id", F.transform("turns", lambda t: F.coalesce(t, F.lit(""))).alias("turns"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"), F.lit(0).alias("dropped"))
    work = d.where("author_id is not null").join(F.broadcast(large), "author_id", "left").crossJoin(F.broadcast(groups))  # a single row
    work = work.select(
        "doc_id", "author_id", F.transform("turns", lambda t: t.isNull()).alias("absent"), span_array("turns").alias("spans"), F.when(F.col("blocks").isNull(), "").otherwise(F.col("author_id").cast("string")).alias("owner"),
        F.when(F.col("blocks").isNull(), -1 - F.pmod(F.xxhash64("author_id", F.lit(seed)), F.col("groups"))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).cast("int").alias("block"),
    )
    every = d.join(F.broadcast(large), "author_id").select(F.col("doc_id").alias("other"), F.array_join("turns", "\n\n").alias("text"), F.col("author_id").cast("string").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, own in mine.groupby("author_id", sort=False):
            docs = [([""] * len(r.absent), [dict(s) if isinstance(s, dict) else s.asDict() for s in r.spans]) for r in own.itertuples()]
            if len(others):
                texts, at = list(others["text"]), {x: i for i, x in enumerate(others["other"])}
                places = [at[x] for x in own["doc_id"]]
            else:  # all of the author's documents are here; turns that are null aren't in a text
                places = list(range(len(own)))
                texts = ["\n\n".join(t for t, no in zip(_turns(turns, parts, [True] * len(parts)), absent) if not no) for (turns, parts), absent in zip(docs, own["absent"])]
            if len(texts) < 2:
                how = [([True] * len(docs[0][1]), None, None)]
            elif embed is hashed_ngrams:
                how = _by_counts(texts, places, docs, budget, most_steps)
            else:
                how = _by_vectors(texts, places, docs, budget, most_steps, embed)
            for x, (turns, parts), (keep, before, now) in zip(own["doc_id"], docs, how):
                out.append((x, a, _turns(turns, parts, keep), before, now, keep.count(False)))
        return pd.DataFrame(out, columns=["doc_id", "author_id", "turns", "before", "after", "dropped"])

    done = work.groupBy("owner", "block").cogroup(every.groupBy("to", "part")).applyInPandas(
        run, "doc_id string, author_id string, turns array<string>, before double, after double, dropped int"
    )
    return done.unionByName(alone)
