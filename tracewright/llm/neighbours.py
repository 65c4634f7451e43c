"""Problem 3: the most similar vectors of every vector, by multiprobe p-stable hashing.

A table hashes a unit vector by K Gaussian (2-stable) projections, each cut into cells of width W. A vector is stored in
its own bucket; it also visits the buckets reached by moving some projections to the neighbouring cell, in the order of
their estimated success (the expected squared distance to the cell borders, after Lv et al. 2007). In each bucket all
visitors are compared with all that are stored, by matrix products; a pair counts for both sides. The best candidates
of all tables are compared exactly, in double precision.

* K follows the logarithm of the number of vectors, so that buckets keep their size as the table grows.
* Equal vectors are one class: they are compared once and expanded to documents at the end, each side by at most k. Classes
  are numbered in the order of their smallest ids, so that ties between classes (one direction with many norms, say) go
  by the smaller id wherever candidates are cut to k.
* A vector isn't sent to each bucket it visits but once to each region, a set of buckets that share the cells of their first
  projections; regions are split by further projections until they are small, from a sample's counts.
* The exchange is done in rounds of about as many rows as there are vectors, each round's files are let go before the next,
  and of its pairs only the best k of each vector are kept: the disk needed doesn't follow the number of probes.
* A region with more than ``32 * block`` vectors, a hot bucket say, is cut into blocks and done block by block, all of them;
  of a bucket no more than ``block`` stored vectors and ``2 * block`` visitors are compared at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, release, spread


def _rows(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    v = F.col(vec_col).cast("array<float>")
    ok = (
        F.col(id_col).isNotNull()
        & (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return df.where(ok).select(F.col(id_col).cast("string").alias("id"), v.alias("vec"))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vec`` of the rows with a non-null id and ``dim`` finite values, not all zero; a repeated id counts once."""
    return _rows(df, id_col, vec_col, dim).dropDuplicates(["id"])


def probe_order(k: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` perturbation sets over the 2k sorted border distances, by expected score."""
    e = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    e += [1 - m / (k + 1) + m * (m + 1) / (4 * (k + 1) * (k + 2)) for m in range(k, 0, -1)]
    heap, out = [(e[0], (0,))], []
    while heap and len(out) < probes:
        score, a = heapq.heappop(heap)
        if all(2 * k - 1 - x not in a for x in a):  # one projection can't move both ways
            out.append(a)
        if (last := a[-1]) + 1 < 2 * k:
            heapq.heappush(heap, (score - e[last] + e[last + 1], (*a[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*a, last + 1)))
    return out


class Tables:
    """Hash functions of all tables, made from a seed."""

    def __init__(self, dim: int, k: int, width: float, tables: int, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.width, self.sets = k, width, probe_order(k, probes)
        self.a = rng.standard_normal((tables, dim, k)).astype(np.float32)
        self.b = rng.uniform(0, width, (tables, k)).astype(np.float32)
        self.mult = rng.integers(1, 2**62, (tables, k), dtype=np.int64) | 1
        #: which of the nearest borders a probe crosses; the own bucket, which crosses none, comes first
        self.cross = np.zeros((1 + max((max(x) for x in self.sets), default=0), 1 + len(self.sets)), np.int64)
        for i, x in enumerate(self.sets):
            self.cross[list(x), 1 + i] = 1

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of table t: each vector's cells; the projections of its nearest borders; the change of the cell beyond them."""
        p = (x @ self.a[t] + self.b[t]) / self.width
        cell = np.floor(p)
        order = np.argsort(np.concatenate([p - cell, 1 - (p - cell)], 1), 1, kind="stable")[:, : len(self.cross)]
        return cell.astype(np.int64), order % self.k, np.where(order < self.k, -1, 1)

    def buckets(self, t: int, cells: np.ndarray, at: np.ndarray, step: np.ndarray, depth: int | None = None) -> np.ndarray:
        """[vector, 1 + probes] of bucket numbers, the own bucket first; of the first ``depth`` projections only, where given."""
        d = self.k if depth is None else depth
        m = self.mult[t]
        with np.errstate(over="ignore"):
            own = (cells[:, :d] * m[:d]).sum(1)
            return own[:, None] + np.where(at < d, step * m[at], 0) @ self.cross + (t * self.k + d) * np.int64(7046029254386353131)


class Regions:
    """A table's buckets as regions, cells of blocks and rounds; made from a sample, so that sizes are estimates.

    A region that the sample hasn't seen is small; it is one cell.
    """

    def __init__(self, tab: Tables, t: int, sample: np.ndarray, scale: float, cap: int, most: float) -> None:
        self.tab, self.t = tab, t
        cells, at, step = tab.cells(sample, t)
        live = np.ones((len(sample), 1 + len(tab.sets)), bool)
        self.split: list[np.ndarray] = []
        leaves: list[tuple[int, float, float]] = []
        for d in range(tab.k + 1):
            code = tab.buckets(t, cells, at, step, d)
            r, c = np.nonzero(live)
            by = np.lexsort((r, code[r, c]))
            key, row = code[r, c][by], r[by]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            number, n = np.unique(key[once], return_counts=True)
            own = np.sort(code[live[:, 0], 0])
            stored = np.searchsorted(own, number, "right") - np.searchsorted(own, number)
            big = (n * scale > cap) & (d < tab.k)
            leaves += zip(number[~big].tolist(), (stored[~big] * scale).tolist(), (n[~big] * scale).tolist())
            self.split.append(number[big])
            live &= np.isin(code, number[big])
            if not live.any():
                break
        half = cap / 2
        self.blocks = {c: (-int(-s // half) or 1, -int(-n // half)) for c, s, n in leaves if n > 1.25 * cap}
        # cells to rounds, in the order of their numbers; a cell's rows are an estimate
        size = []
        for c, s, n in leaves:
            i, j = self.blocks.get(c, (1, 1))
            size += [(self.cell(c, x, y), n if c not in self.blocks else s / i + n / j) for x in range(i) for y in range(j)]
        size.sort()
        total = sum(n for _, n in size)
        self.rounds = max(1, -int(-total // most))
        self.number = np.array([c for c, _ in size], np.int64)
        filled = np.cumsum([0.0, *(n for _, n in size)])[:-1]
        self.round = np.minimum(filled * self.rounds // max(total, 1), self.rounds - 1).astype(int)

    @staticmethod
    def cell(code, i=0, j=0):
        """Number of a cell of blocks."""
        with np.errstate(over="ignore"):
            x = np.asarray(code, np.int64) + np.int64(1_000_003) * np.int64(i) + np.int64(998_244_353) * np.int64(j)
            x = (x ^ (x >> np.int64(31))) * np.int64(0x5851F42D4C957F2D)
            return x if x.ndim else int(x)

    def round_of(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.number):
            return np.zeros(len(cell), int)
        at = np.minimum(np.searchsorted(self.number, cell), len(self.number) - 1)
        return np.where(self.number[at] == cell, self.round[at], cell % self.rounds)

    def sent(self, x: np.ndarray, cls: np.ndarray, turn: int):
        """Rows of a round: vector's row, cell, whether it is stored there, and the buckets (lengths, flat), the own first if stored."""
        cells, at, step = self.tab.cells(x, self.t)
        bucket = self.tab.buckets(self.t, cells, at, step)
        code = np.zeros_like(bucket)
        live = np.ones(bucket.shape, bool)
        for d, split in enumerate(self.split):
            now = self.tab.buckets(self.t, cells, at, step, d)
            code[live] = now[live]
            if not len(split):
                break
            live &= split[np.minimum(np.searchsorted(split, now), len(split) - 1)] == now
        row, p = (v.ravel() for v in np.indices(bucket.shape))
        own = (code == code[:, :1]).ravel()
        code, bucket = code.ravel(), bucket.ravel()
        hot = np.isin(code, np.fromiter(self.blocks, np.int64, len(self.blocks)))
        parts = [(row[~hot], self.cell(code[~hot]), own[~hot], p[~hot], bucket[~hot])]
        if hot.any():
            mix = lambda salt, m: ((cls * np.int64(salt) >> np.int64(33)) & np.int64(0x3FFFFFFF)) % m
            for c in np.unique(code[hot]).tolist():
                i, j = self.blocks[c]
                e = np.flatnonzero(code == c)
                with np.errstate(over="ignore"):
                    x_of, y_of = mix(0x2545F4914F6CDD1D, i)[row[e]], mix(0x5DEECE66D1CE4E5B, j)[row[e]]
                # stored rows once for each block of visitors; all rows, as visitors, once for each block of stored ones
                o = p[e] == 0
                for y in range(j):
                    parts.append((row[e][o], self.cell(np.full(o.sum(), c), x_of[o], y), np.ones(o.sum(), bool), p[e][o], bucket[e][o]))
                for z in range(i):
                    parts.append((row[e], self.cell(np.full(len(e), c), z, y_of), np.zeros(len(e), bool), p[e], bucket[e]))
        row, cell, store, p, bucket = (np.concatenate(v) for v in zip(*parts))
        keep = self.round_of(cell) == turn
        row, cell, store, p, bucket = row[keep], cell[keep], store[keep], p[keep], bucket[keep]
        by = np.lexsort((p, store, cell, row))
        row, cell, store, bucket = row[by], cell[by], store[by], bucket[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]) | (store[1:] != store[:-1])
        first = np.flatnonzero(new)
        return row[first], cell[first], store[first], np.diff(np.append(first, len(row))), bucket


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x /= np.where(scale > 0, scale, 1)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(left: np.ndarray, lid: np.ndarray, right: np.ndarray, rid: np.ndarray, k: int):
    """For each row of left its k nearest rows of right, exact to double precision; (id, id, similarity)."""
    s = left.astype(np.float32) @ right.astype(np.float32).T
    s[lid[:, None] == rid[None, :]] = -9
    # all that can be among the k in double precision: single precision is off by less than 1e-5
    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else s.min(axis=1)
    near = (s >= kth[:, None] - np.float32(1e-5)) & (s > -8)
    # rows in pieces of bounded size, should many be tied
    n = near.sum(axis=1)
    piece = np.cumsum(n) // 200_000
    out = []
    for at in np.split(np.arange(len(left)), np.flatnonzero(np.diff(piece)) + 1):
        rows, cols = np.nonzero(near[at])
        rows = at[rows]
        exact = np.round(np.einsum("ij,ij->i", left[rows], right[cols]), 12)
        order = np.lexsort((rid[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((lid[rows[keep]], rid[cols[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _packed(flat: np.ndarray, n) -> pa.Array:
    """Runs of n numbers as bytes, which go through an exchange at less cost than arrays."""
    ends = np.append(0, np.cumsum(n)).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, and how many each run has."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return flat.view(kind) if not flat.ctypes.data % size else flat.copy().view(kind), np.diff(ends) // size


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int):
    """The best k of each a, sorted by a; a pair counts once."""
    by = np.lexsort((b, -s, a))
    a, b, s = a[by], b[by], s[by]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[once], b[once], s[once]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


class _Kept:
    """The best k of each vector among the pairs seen so far."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.n, self.least = k, [], 0, 1_000_000

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((a, b, s))
        self.n += len(a)
        if self.n > self.least:
            self.parts = [self.best()]
            self.n = len(self.parts[0][0])
            self.least = max(1_000_000, 2 * self.n)

    def best(self):
        return _top(*(np.concatenate(c) for c in zip(*self.parts)), self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        a, b, s = self.best()
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for at in range(0, len(first), 20_000):
            f = np.append(first[at : at + 20_000], first[at + 20_000] if at + 20_000 < len(first) else len(a))
            own, n = slice(f[0], f[-1]), np.diff(f)
            yield pa.RecordBatch.from_arrays([pa.array(a[f[:-1]]), _packed(b[own], n), _packed(s[own], n)], ["a", "b", "sim"])


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(k)
        for t in batches:
            if t.num_rows:
                kept.add(*_flat(t))
        yield from kept.batches()

    return run


def _flat(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, n = _unpacked(t.column("b"), np.int64)
    return np.repeat(t.column("a").to_numpy(), n), b, _unpacked(t.column("sim"), np.float64)[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        if t.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _flat(t)], ["a", "b", "sim"])


def _compare(k: int, dim: int, block: int):
    def cell(store, ids, flat, n, bucket) -> Iterator[pa.RecordBatch]:
        """The best pairs of a cell, bucket by bucket, a bucket's rows in blocks."""
        x = _unit(flat, dim)
        row = np.repeat(np.arange(len(ids)), n)
        first = np.zeros(len(row), bool)
        first[np.cumsum(n) - n] = True
        visit = ~(first & store[row])
        by = np.lexsort((visit, bucket))
        row, visit, bucket = row[by], visit[by], bucket[by]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        end = np.append(start[1:], len(bucket))
        mid = start + np.add.reduceat(~visit, start)
        kept = _Kept(k)
        live = (mid > start) & (end > start + 1)
        for i, m, j in zip(start[live].tolist(), mid[live].tolist(), end[live].tolist()):
            stored = [row[q : min(q + block, m)] for q in range(i, m, block)]
            visits = [row[q : min(q + 2 * block, j)] for q in range(m, j, 2 * block)]
            for a in stored:
                for b in visits:
                    kept.add(*_best(x[b], ids[b], x[a], ids[a], k))
                    kept.add(*_best(x[a], ids[a], x[b], ids[b], k))
                for b in stored:
                    kept.add(*_best(x[a], ids[a], x[b], ids[b], k))
        yield from kept.batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell never has many more rows than its size allows."""
        held: list[tuple] = []

        def done():
            yield from cell(*(np.concatenate(c) for c in zip(*held)))
            held.clear()

        now = None
        for t in batches:
            if not t.num_rows:
                continue
            key = t.column("grp").to_numpy()
            vec = _unpacked(t.column("vec"), np.float32)[0].reshape(-1, dim)
            flat, n = _unpacked(t.column("buckets"), np.int64)
            ends = np.append(0, np.cumsum(n))
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            store, ids = t.column("store").to_numpy() == 1, t.column("id").to_numpy()
            for i, j in zip(edge[:-1], edge[1:]):
                if held and key[i] != now:
                    yield from done()
                now = key[i]
                held.append((store[i:j], ids[i:j], vec[i:j], n[i:j], flat[ends[i] : ends[j]]))
        if held:
            yield from done()

    return run


def nearest(
    df: DataFrame,
    id_col: str = "doc_id",
    vec_col: str = "features",
    k: int = 5,
    dim: int = 96,
    tables: int = 3,
    probes: int | None = None,
    width: float = 2.5,
    bucket: int = 128,
    block: int = 2048,
    seed: int = 7,
) -> DataFrame:
    """``id, other, sim``: for every usable vector the k other documents of highest cosine similarity.

    Approximate in which candidates are seen (recall is measured in the tests and stated in the README), exact in their
    order: equal similarities (to 12 digits) go by the smaller id. The number of probes of a table grows with the number of
    projections, and so with the logarithm of the number of vectors, unless ``probes`` is given. Rows with a null id or vector, another length, a null,
    NaN or infinite value, or zeros only have no row; a repeated id counts once; a vector with fewer than k others has
    fewer rows; an empty table gives an empty one. Other columns are left out.
    """
    spark = df.sparkSession
    rows = _rows(df, id_col, vec_col, dim).withColumn("same", F.xxhash64("vec"))
    # 1. classes of equal vectors, numbered by their smallest id; vectors are exchanged once
    docs = rows.groupBy("id").agg(F.min("same").alias("same"))
    number = docs.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    number = cut(number.orderBy("least").withColumn("cls", F.monotonically_increasing_id()).drop("least"))
    docs = cut(docs.join(number.select("same", "cls"), "same").select("id", "cls"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vec = b.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), _packed(vec, np.full(b.num_rows, dim))], ["same", "vec"])

    bytes_ = rows.select("same", "vec").mapInArrow(pack, "same bigint, vec binary")
    rep = cut(bytes_.groupBy("same").agg(F.first("vec").alias("vec")).join(number.select("same", "cls"), "same").select("cls", "vec"))
    release(spark)
    by_class = Window.partitionBy("cls").orderBy("id")
    first = docs.select("cls", "id").withColumn("at", F.row_number().over(by_class)).where(F.col("at") <= k + 1)
    n = rep.count()
    # cells per projection are nearly those of a Gaussian cut at W: about 1.3 bits each at 2.5
    kk = max(4, round(np.log2(max(n, 2) / bucket) * 0.95))
    t = Tables(dim, kk, width, tables, max(7, 2 * kk - 9) if probes is None else probes, seed)
    # 2. regions from a sample, a hundred of its rows for each of the largest
    most = max(n, 100_000)
    cores = spark.sparkContext.defaultParallelism
    cap = min(32 * block, max(1024, most // cores))
    every = max(1, min(n // 20_000, cap // 100))
    drawn = rep.where(F.pmod(F.xxhash64("cls"), F.lit(every)) == 0).select("vec").toArrow().column(0)
    drawn = np.concatenate([np.empty(0, np.float32), *(_unpacked(c, np.float32)[0] for c in drawn.chunks if len(c))])
    drawn = _unit(drawn, dim).astype(np.float32)
    regions = [Regions(t, i, drawn, every, cap, most) for i in range(tables)] if n else []
    shared = spark.sparkContext.broadcast(regions)

    def send(table: int, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            region = shared.value[table]
            for b in batches:
                if not b.num_rows:
                    continue
                ids, raw = b.column(0).to_numpy(), _unpacked(b.column(1), np.float32)[0].reshape(-1, dim)
                row, cell, store, size, bucket = region.sent(_unit(raw, dim).astype(np.float32), ids, turn)
                vec, lists = _packed(raw[row].ravel(), np.full(len(row), dim)), _packed(bucket, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(store.astype(np.int32)), pa.array(ids[row]), vec, lists], ["grp", "store", "id", "vec", "buckets"]
                )

        return run

    # 3. round by round, the best k classes of each class
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * cores)
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)
    lists = "a bigint, b binary, sim binary"
    top = spark.createDataFrame([], lists)
    for i, region in enumerate(regions):
        for turn in range(region.rounds):
            sent = rep.mapInArrow(send(i, turn), "grp bigint, store int, id bigint, vec binary, buckets binary")
            sent = sent.repartition(parts, "grp").sortWithinPartitions("grp")
            pairs = sent.mapInArrow(_compare(k, dim, block), lists)
            top = cut(top.unionByName(pairs).repartition(few, "a").mapInArrow(_merge(k), lists))
            del sent, pairs
            release(spark)
    top = top.mapInArrow(_pairs, "a bigint, b bigint, sim double")
    # 4. from classes to documents: of each class no more than k + 1 members can be needed
    several = number.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("sim"))
    full = top.unionByName(several).join(first.select(F.col("cls").alias("b"), F.col("id").alias("other")), "b")
    # the k + 1 best documents of a class, then each member leaves itself out
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "other")
    full = full.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("a", "other", "sim")
    mine = docs.select("id", F.col("cls").alias("a")).join(full, "a").where(F.col("id") != F.col("other"))
    last = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return mine.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).select("id", "other", "sim")


def found_pairs(df: DataFrame, id_col: str = "doc_id", vec_col: str = "features", **parameters) -> DataFrame:
    """``doc_id_a, doc_id_b``: pairs of which one is among the k nearest of the other, the smaller id first."""
    near = nearest(df, id_col, vec_col, **parameters)
    return near.select(F.least("id", "other").alias("doc_id_a"), F.greatest("id", "other").alias("doc_id_b")).distinct()


def brute_force(pdf: pd.DataFrame, k: int = 5) -> set[tuple[str, str]]:
    """Pairs by comparing everything with everything; for tests on small tables."""
    pdf = pdf.sort_values("id").drop_duplicates("id")
    x = _unit(np.concatenate(pdf["vec"].map(np.asarray).to_list()), len(pdf["vec"].iloc[0]))
    ids = pdf["id"].to_numpy()
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    out = set()
    for i, row in enumerate(s):
        for j in np.lexsort((ids, -row))[: min(k, len(ids) - 1)]:
            out.add(tuple(sorted((ids[i], ids[j]))))
    return out
