"""Problem 6: near-duplicate conversations by Golay-code fuzzy hashing.

1. A conversation's words are cut into runs of three; the set of their hashes is its shingle set. Conversations of the
   same set are one class and are compared once.
2. A class's fingerprint has ``segments`` segments of 23 one-bit min-hashes. At a Jaccard similarity J a bit differs with
   probability (1 - J) / 2, so by the pigeonhole principle some segments have few errors. Each segment is decoded to the
   indices of the codewords nearby, up to six keys (:mod:`golay`): segments at distance 2 or less always share one.
3. One segment has 12 bits of choice, too few for large collections, so that a key also holds two min-hashes. Table t
   finds a pair with probability J^2 g(J); g(0.6) = 0.42, measured. With 48 tables a pair at J = 0.6 is missed about once
   in 1,500, at 0.7 less than once in ten million.
4. Classes with a key in common are joined, sifted by 128 further one-bit min-hashes (a pair at J = 0.6 passes at four
   standard deviations) and verified exactly on the whole shingle sets.

What is kept of a class is a signature of fixed size, from which a table's keys are made when its turn comes: tables are
worked through in rounds of about 32 keys a class, each round's files are let go, and of its pairs only those that the sieve
passes are kept. Shingle sets are made again for the classes of these pairs, from one text of each.

A key that more than ``block`` classes share is not gathered: its rows go to a second exchange in which pairs of blocks are
tasks of their own, all of them, so no pair is lost and no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release, spread
from . import golay

#: Maximal runs of letters and digits.
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
_SKETCH_BITS = 128
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hasher:
    """Shingle sets of texts; keeps the hashes of words it has seen."""

    def __init__(self, n: int) -> None:
        self.n, self._word = n, {}

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted distinct hashes of the runs of n words."""
        known = self._word
        if len(known) > 1_000_000:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = v
        m = len(words) - self.n + 1
        with np.errstate(over="ignore"):
            s = np.zeros(m, np.uint64)
            for k in range(self.n):
                s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
        return np.unique(s)


class Keys:
    """Min-hash anchors, Golay segments and sketch of a shingle set."""

    def __init__(self, tables: int, segments: int, anchors: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.segments, self.anchors = segments, anchors
        self.total = anchors + golay.BITS * segments + _SKETCH_BITS
        self.mult = rng.integers(0, 1 << 63, self.total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        pairs = [(i, j) for i in range(anchors) for j in range(i)]
        rng.shuffle(pairs)
        self.pairs = np.array(pairs[:tables])
        self.segment = np.arange(tables) % segments
        self.salt = rng.integers(0, 1 << 63, tables, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, segments and sketch (two words of 64 bits) of a set."""
        with np.errstate(over="ignore"):
            low = np.full(self.total, _MASK, np.uint64)
            for at in range(0, len(s), 2048):  # long texts in pieces, all of them
                part = s[at : at + 2048]
                low = np.minimum(low, (part[:, None] * self.mult[None, :]).min(0))
            mixed = _mix(low ^ self.mult)
        bits = (mixed[self.anchors :] & np.uint64(1)).astype(np.int64)
        seg = bits[: golay.BITS * self.segments].reshape(self.segments, golay.BITS) @ (1 << np.arange(golay.BITS))
        sketch = np.packbits(bits[golay.BITS * self.segments :].astype(np.uint8)).view(np.int64)
        return mixed[: self.anchors].astype(np.uint32), seg.astype(np.uint32), sketch

    def keys(self, anchors: np.ndarray, segments: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the tables from ``first`` to before ``last``, and the number of the row each belongs to."""
        with np.errstate(over="ignore"):
            index, new = golay.indices(segments[:, self.segment[first:last]].astype(np.int64).ravel())
            a, b = (anchors[:, self.pairs[first:last, i]].astype(np.uint64) for i in (0, 1))
            base = _mix(a * np.uint64(0x9E3779B97F4A7C15) + b + self.salt[first:last]).ravel()
            keys = _mix(base[:, None] + index.astype(np.uint64))
        row = np.repeat(np.arange(len(anchors)), last - first)
        return keys[new].view(np.int64), np.broadcast_to(row[:, None], new.shape)[new]


def _texts(df: DataFrame, id_col: str, turns_col: str) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & F.col(turns_col).isNotNull())
    return spread(rows.select(F.col(id_col).cast("string").alias("id"), F.col(turns_col).alias("turns")), "id")


def _shingled(batch: pa.RecordBatch, hasher: Hasher, min_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, class and shingle set of the texts with enough words."""
    for i, turns in enumerate(batch.column("turns").to_pylist()):
        words = _WORDS("\n\n".join(t for t in turns if t is not None).lower())
        if len(words) >= max(min_words, hasher.n):
            s = hasher.shingles(words)
            yield i, int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)), s


def _signatures(n: int, min_words: int, maker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, keys = Hasher(n), maker.value
        seen: dict[int, tuple] = {}  # copies are signed once, where they meet in a task
        for b in batches:
            at, cls, made = [], [], []
            for i, c, s in _shingled(b, hasher, min_words):
                if c not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    x, y, z = keys.signature(s)
                    seen[c] = np.concatenate([x, y]).tobytes(), int(z[0]), int(z[1])
                at.append(i)
                cls.append(c)
                made.append(seen[c])
            if at:
                sign, s0, s1 = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(cls, pa.int64()), pa.array(sign, pa.binary()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64())],
                    ["id", "cls", "sign", "s0", "s1"],
                )

    return run


def _sets(n: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts ``id, turns, cls`` to ``cls, shingles``, where the text is of the class."""
        hasher = Hasher(n)
        for b in batches:
            want = b.column("cls").to_numpy()
            got = [(c, s) for i, c, s in _shingled(b, hasher, min_words) if c == want[i]]
            if got:
                cls, sets = zip(*got)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["cls", "shingles"])

    return run


def _pairs_of_groups(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, cls) sorted by key to pairs (a, b, null); keys of more than ``block`` rows to rows (key, cls, 1)."""
        key_left = np.empty(0, np.int64)
        cls_left = np.empty(0, np.int64)
        hot: int | None = None

        def emit(a, b, deferred):
            flag = pa.array(np.full(len(a), deferred), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), flag], ["a", "b", "deferred"])

        def cold(key, cls):
            """All pairs in runs of equal keys; work in proportion to their number."""
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls = key[once], cls[once]
            a, b = [], []
            gap = 1
            at = np.arange(len(key))
            while True:
                at = at[at + gap < len(key)]
                at = at[key[at] == key[at + gap]]
                if not len(at):
                    break
                a.append(cls[at])
                b.append(cls[at + gap])
                gap += 1
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                return emit(both[:, 0], both[:, 1], 0)
            return None

        for batch in batches:
            key = np.concatenate([key_left, batch.column(0).to_numpy()])
            cls = np.concatenate([cls_left, batch.column(1).to_numpy()])
            if not len(key):
                continue
            if hot is not None:
                n = int(np.argmax(key != hot)) if key[-1] != hot else len(key)
                yield emit(key[:n], cls[:n], 1)
                key, cls = key[n:], cls[n:]
                if not len(key):
                    key_left, cls_left = key, cls
                    continue
                hot = None
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            edges = np.flatnonzero(np.diff(key[:last])) + 1 if last else np.empty(0, int)
            starts = np.concatenate([[0], edges, [last]]) if last else np.array([0])
            size = np.diff(starts)
            big = np.repeat(size > block, size) if last else np.empty(0, bool)
            if big.any():
                yield emit(key[:last][big], cls[:last][big], 1)
            if last and (out := cold(key[:last][~big], cls[:last][~big])) is not None:
                yield out
            key_left, cls_left = key[last:], cls[last:]
            if len(key_left) > block:
                hot = int(key_left[-1])
                yield emit(key_left, cls_left, 1)
                key_left, cls_left = key_left[:0], cls_left[:0]
        if len(key_left) and (out := cold(key_left, cls_left)) is not None:
            yield out

    return run


def candidates(keys: DataFrame, block: int, parts: int) -> DataFrame:
    """Distinct pairs ``a < b`` of classes that share a key; ``keys`` has ``key, cls``."""
    first = cut(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_pairs_of_groups(block), "a bigint, b bigint, deferred int"))
    pairs = first.where("deferred = 0").select("a", "b")
    rest = first.where("deferred = 1").select(F.col("a").alias("key"), F.col("b").alias("cls")).distinct()
    n = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (block // 2)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")
    cells = rest.join(n, "key").withColumn("o", own)
    cells = cells.select("key", "cls", "o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    cells = cells.select(F.xxhash64("key", F.least("o", "p"), F.greatest("o", "p")).alias("cell"), "key", "cls", "o")
    left, right = cells.alias("l"), cells.alias("r")
    on = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.cls") < F.col("r.cls"))
    more = left.join(right, on).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
    return pairs.unionByName(more).distinct()


def _tables_a_round(count: int) -> int:
    """Tables whose keys of ``count`` classes are exchanged at once: about 32 keys a class, or three million rows."""
    return max(1, int(max(32 * count, 3_000_000) / (5.5 * max(count, 1))))


def _rounds_of_shingles(count: int, shingles: int, sets: int, pairs: int) -> int:
    """Rounds in which the sets of both sides and of the pairs are exchanged, about 64 shingles a class or eight million each."""
    return max(1, -(-int((2 + pairs / max(sets, 1)) * shingles) // max(64 * count, 8_000_000)))


def near_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    turns_col: str = "turns",
    n: int = 3,
    min_words: int = 70,
    numerator: int = 3,
    denominator: int = 5,
    tables: int = 48,
    segments: int = 24,
    anchors: int = 32,
    block: int = 512,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, cls`` and links ``a, b, common, total`` of classes whose Jaccard similarity is at least the fraction.

    The non-null turns joined by a blank line and lower-cased are the text. Rows with a null id or null turns and texts with
    fewer than ``min_words`` words aren't in it; a repeated id counts once; other columns are left out; an empty table
    gives empty ones.
    """
    spark = df.sparkSession
    maker = spark.sparkContext.broadcast(Keys(tables, segments, anchors, seed))
    texts = _texts(df, id_col, turns_col)
    signed = cut(texts.mapInArrow(_signatures(n, min_words, maker), "id string, cls bigint, sign binary, s0 bigint, s1 bigint"))
    release(spark)
    members = cut(signed.select("id", "cls").distinct())
    reps = cut(signed.dropDuplicates(["cls"]).drop("id"))
    del signed
    release(spark)
    count = reps.count()

    def make(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = maker.value
            for b in batches:
                if b.num_rows:
                    sign = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)
                    keys, row = k.keys(sign[:, :anchors], sign[:, anchors:], first, last)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(b.column(0).to_numpy()[row])], ["key", "cls"])

        return run

    # a one-bit min-hash differs with probability (1 - J) / 2: mean plus four standard deviations
    p = (1 - numerator / denominator) / 2
    most = int(_SKETCH_BITS * p + 4 * (_SKETCH_BITS * p * (1 - p)) ** 0.5 + 1)
    l, r = reps.select("cls", "s0", "s1").toDF("a", "l0", "l1"), reps.select("cls", "s0", "s1").toDF("b", "r0", "r1")
    apart = F.bit_count(F.col("l0").bitwiseXOR(F.col("r0"))) + F.bit_count(F.col("l1").bitwiseXOR(F.col("r1")))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # rounds of tables, a table has up to six keys a class
    step = _tables_a_round(count)
    near = None
    for first in range(0, tables, step):
        last = min(first + step, tables)
        parts = max(least, count * (last - first) * 5 // 1_500_000)
        keys = reps.select("cls", "sign").mapInArrow(make(first, last), "key bigint, cls bigint")
        pairs = candidates(keys, block, parts).join(l, "a").join(r, "b").where(apart <= most).select("a", "b")
        near = cut(pairs if near is None else near.unionByName(pairs).distinct())
        del keys, pairs
        release(spark)
    del reps, l, r
    # the whole sets of the classes in pairs, from the text of the smallest id
    wanted = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = members.join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    sets = texts.join(wanted.hint("shuffle_hash"), "id").select("id", "turns", "cls").mapInArrow(_sets(n, min_words), "cls bigint, shingles array<bigint>")
    sets = cut(sets.dropDuplicates(["cls"]))
    release(spark)
    # rounds of shingles: what two sets have in common is the sum over the rounds
    w, k = sets.agg(F.sum(F.size("shingles")), F.count(F.lit(1))).first()
    turns = _rounds_of_shingles(count, w or 0, k, near.count())
    common = None
    for turn in range(turns):
        part = sets.withColumn("shingles", F.filter("shingles", lambda v: F.pmod(v, F.lit(turns)) == turn)) if turns > 1 else sets
        both = near.join(part.toDF("a", "x"), "a").join(part.toDF("b", "y"), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("common"))
        common = cut(both if common is None else common.unionByName(both).groupBy("a", "b").agg(F.sum("common").alias("common")))
        del part, both
        release(spark)
    size = sets.select("cls", F.size("shingles").cast("bigint").alias("size"))
    links = common.join(size.toDF("a", "m"), "a").join(size.toDF("b", "n"), "b")
    links = links.select("a", "b", "common", (F.col("m") + F.col("n") - F.col("common")).alias("total"))
    links = cut(links.where(F.col("common") * denominator >= F.col("total") * numerator))
    del near, sets, common, size
    release(spark)
    return members, links


def found_pairs(df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", expand: int = 64, **parameters) -> DataFrame:
    """``doc_id_a, doc_id_b``: near-duplicate pairs of documents, the smaller id first.

    Classes of up to ``expand`` exact copies are expanded to all their pairs; a larger class is given by pairs of its
    representative (its smallest id) with each member, and by its representative in pairs with other classes.
    """
    members, links = near_classes(df, id_col, turns_col, **parameters)
    stat = members.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    large = stat.where(F.col("n") > expand)
    several = members.join(stat.where(F.col("n") > 1), "cls")
    # what stands for a class in pairs: all members of a small one, the representative of a large one
    small = members.join(stat.where(F.col("n") <= expand).select("cls"), "cls").select("cls", "id")
    stands = small.unionByName(large.select("cls", F.col("rep").alias("id")))
    inside = several.where(F.col("n") <= expand).select("cls", "id")
    within = inside.alias("p").join(inside.alias("q"), (F.col("p.cls") == F.col("q.cls")) & (F.col("p.id") < F.col("q.id")))
    within = within.select(F.col("p.id").alias("p"), F.col("q.id").alias("q"))
    star = several.where((F.col("n") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("p"), F.col("id").alias("q"))
    across = links.join(stands.toDF("a", "p"), "a").join(stands.toDF("b", "q"), "b").select("p", "q")
    both = within.unionByName(star).unionByName(across)
    return both.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()
