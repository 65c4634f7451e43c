"""Problem 1: subject areas of conversations, by one-versus-rest linear classifiers on hashed word n-grams.

Weak labels: the phrase in ``label_topics.subject`` names an area where it has words of a short list of ordinary English
words for each area; a conversation passes its area on to its sentences, in whatever language they are. A sentence with two
words of another area's list takes that one. A word that sentences of all areas share, figures of speech with it, gets no
weight, as its labels are spread evenly.

An area without a list has the words of its name and scope note instead.

The classifiers are fitted on a bounded sample of labelled conversations (``train_rows``, by a hash of the id, at most an
eighth of it with the same language label, so that rare languages are learned as well); its sentences are cut and hashed in
tasks. Fitted once, they correct the weak labels of the fitted part (a sentence that is clearly about another area, or
about none) and are fitted again. A threshold for each area is calibrated on conversations held out from both fits, whose
weak labels no model has touched. Prediction covers every sentence of every conversation: an
area is assigned where two sentences or more are about it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from . import residue
from ._turns import SENTENCE, explode_turns, without_code
from .language import label_code

#: Ordinary words of each area, for weak labels only.
SEEDS = {
    "software": "software code program script compiler bug regex database server debug linter thread cache commit",
    "mathematics": "equation number proof probability matrix integral derivative theorem polynomial vector logarithm algebra triangle",
    "natural_science": "physics chemistry biology cell gravity enzyme isotope photosynthesis protein comet star magnetic genome rock chemical",
    "medicine": "illness drug doctor nurse vaccine surgery blood insulin allergy fracture antibiotic diagnosis migraine skin cough",
    "law": "law contract court judge statute legal clause plaintiff defendant copyright liability witness trademark attorney",
    "finance": "money tax bank stock loan mortgage budget invoice savings credit bond inflation pension",
    "sport": "sport training team coach match referee tennis marathon league goalkeeper cycling penalty basketball",
    "cooking": "cook recipe food oven dough soup sauce bread butter rice stew curry cake egg",
    "travel": "travel ticket hotel hostel flight airport visa luggage train ferry tour suitcase hiking boarding",
    "history": "history ancient medieval empire dynasty crusader archaeological treaty colonial revolt siege royal papyrus",
    "music": "music song melody chord guitar violin piano opera choir jazz orchestra drum",
    "home_garden": "garden house repair lawn door wallpaper paint compost greenhouse gutter tap rose tile soil",
    "general": "weekend birthday greeting neighbour mood afternoon daily bedtime shopping cat polite lucky",
}
BITS = 17
_TOKEN = regex.compile(r"\p{Han}+|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")
_HAN = regex.compile(r"\p{Han}")
_MAIL = regex.compile(r"\S+(?:@|\[at\]|\(at\))\S+|https?://\S+")


def seed_words(notes: dict[str, str | None]) -> dict[str, str]:
    """The area each seed word stands for; words that several areas have stand for none."""
    out: dict[str, str | None] = {}
    for area, note in sorted(notes.items()):
        given = SEEDS.get(area)
        words = given.split() if given else [w for w in _TOKEN.findall(f"{area} {note or ''}".lower().replace("_", " ")) if len(w) > 3]
        for w in set(words):
            out[w] = area if out.get(w, area) == area else None
    return {w: a for w, a in out.items() if a is not None}


def weak_areas(subject: str | None, seeds: dict[str, str] | None = None) -> list[str]:
    """Areas whose words a subject phrase has most of."""
    seeds = seed_words(dict.fromkeys(SEEDS)) if seeds is None else seeds
    votes: dict[str, int] = {}
    for w in _TOKEN.findall((subject or "").lower()):
        for v in (w, w.removesuffix("s")):
            if v in seeds:
                votes[seeds[v]] = votes.get(seeds[v], 0) + 1
                break
    most = max(votes.values(), default=0)
    return sorted(a for a, n in votes.items() if n == most)


def sentences(text: str, openers: frozenset[tuple[str, str]] = frozenset()) -> list[tuple[str, float]]:
    """Sentences of a turn, counting 1 each.

    Passages without punctuation are cut before pairs of words that open sentences elsewhere; where none occurs, a long one
    is cut into parts of seven words that count half. Pieces of fewer than five words are no sentences.
    """
    body = _MAIL.sub(" ", without_code(text))
    out = []
    for s in SENTENCE.split(body):
        if not s or not s.strip():
            continue
        if len(_HAN.findall(s)) >= 6:
            out.append((s, 1.0))
            continue
        words = s.split()
        plain = [w.lower() for w in words]
        cuts = [0]
        if len(words) > 14:
            for i in range(4, len(words) - 4):
                if i - cuts[-1] >= 5 and (plain[i], plain[i + 1]) in openers:
                    cuts.append(i)
        for i, j in zip(cuts, [*cuts[1:], len(words)]):
            part = words[i:j]
            if j - i > 34:
                out += [(" ".join(part[k : k + 7]), 0.5) for k in range(0, len(part), 7)]
            elif sum(bool(_TOKEN.search(w)) for w in part) >= 5:
                out.append((" ".join(part), 1.0))
    return out


def opening_pairs(texts: list[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """How often a pair of neighbouring words stands anywhere, and how often at the beginning of a sentence."""
    start: dict[tuple[str, str], int] = {}
    anywhere: dict[tuple[str, str], int] = {}
    for text in texts:
        for s in SENTENCE.split(without_code(text)):
            w = s.lower().split() if s else []
            if len(w) >= 5:
                for pair in zip(w, w[1:]):
                    anywhere[pair] = anywhere.get(pair, 0) + 1
                start[w[0], w[1]] = start.get((w[0], w[1]), 0) + 1
    return {p: (n, start.get(p, 0)) for p, n in anywhere.items()}


def openers_of(some: DataFrame, least: int = 8, share: float = 0.7) -> frozenset[tuple[str, str]]:
    """Pairs of words that mostly stand at the beginning of sentences, in a sample of texts (``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = opening_pairs(b.column(0).to_pylist())
            cols = [[p[0] for p in got], [p[1] for p in got], [n for n, _ in got.values()], [m for _, m in got.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["a", "b", "n", "m"])

    pairs = some.select("text").mapInArrow(run, "a string, b string, n bigint, m bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return frozenset((r.a, r.b) for r in pairs.where((F.col("m") >= least) & (F.col("m") >= share * F.col("n"))).collect())


class Features:
    """Hashed words and pairs of neighbouring words of a sentence; runs of Han by twos and threes."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def _hash(self, gram: str) -> int:
        v = self._known.get(gram)
        if v is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            v = self._known[gram] = xxhash.xxh3_64_intdigest(gram) & ((1 << BITS) - 1)
        return v

    def of(self, sentence: str) -> list[int]:
        words: list[str] = []
        grams: list[str] = []
        for w in _TOKEN.findall(sentence.lower()):
            if _HAN.match(w):
                grams += [w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)]
            else:
                words.append(w)
        grams += words
        grams += [f"{a} {b}" for a, b in zip(words, words[1:])]
        return sorted({self._hash(g) for g in grams})


class Model:
    """Weights, already multiplied by the features' rarity, thresholds, and the openers of sentences."""

    def __init__(self, areas: list[str], weight: np.ndarray, bias: np.ndarray, rarity: np.ndarray) -> None:
        self.areas, self.weight, self.bias, self.rarity = areas, weight, bias, rarity
        self.threshold = np.full(len(areas), 0.5)
        self.openers: frozenset[tuple[str, str]] = frozenset()

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities, a row for each sentence."""
        out = np.tile(self.bias, (len(rows), 1))
        for i, r in enumerate(rows):
            if r:
                out[i] += self.weight[r].sum(0) / (self.rarity[r] ** 2).sum() ** 0.5
        return 1 / (1 + np.exp(-out))


def _block(data: tuple, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of three classifiers, the j-th and the next two."""
    index, value, starts, at_sorted, value_sorted, cuts, y, n, steps, rate, shrink = data
    yj = y[:, j : j + 3]
    w, b = np.zeros((n, yj.shape[1]), np.float32), np.full(yj.shape[1], -2.0, np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(steps):
        z = np.add.reduceat(w[index] * value, starts, axis=0) + b
        d = (1 / (1 + np.exp(-z)) - yj).astype(np.float32)
        g = np.add.reduceat(d[at_sorted] * value_sorted, cuts, axis=0) + np.float32(shrink) * w
        gw += g * g
        w -= np.float32(rate) * g / np.sqrt(gw)
        s = d.sum(0)
        gb += s * s
        b -= np.float32(rate) * s / np.sqrt(gb)
    return w, b


def _logistic(rows: list[list[int]], y: np.ndarray, areas: list[str], steps: int, rate: float, shrink: float, spark=None) -> Model:
    """One-versus-rest logistic classifiers on features weighted by rarity, by full-batch adaptive gradient steps."""
    k = len(areas)
    weight, b = np.zeros((1 << BITS, k), np.float32), np.full(k, -2.0, np.float32)
    rarity = np.ones(1 << BITS, np.float32)
    if not rows:
        return Model(areas, weight, b, rarity)
    size = np.array([len(r) for r in rows])
    used, index, df = np.unique(np.concatenate([np.array(r, np.int32) for r in rows]), return_inverse=True, return_counts=True)
    idf = np.log(len(rows) / df).astype(np.float32) + 0.1
    rarity[:] = idf.max()
    rarity[used] = idf
    at = np.repeat(np.arange(len(rows)), size)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    value = idf[index]
    value = (value / np.sqrt(np.add.reduceat(value * value, starts))[at]).astype(np.float32)[:, None]
    order = np.argsort(index, kind="stable")
    at_sorted, value_sorted, cuts = at[order], value[order], np.searchsorted(index[order], np.arange(len(used)))
    data = (index.astype(np.int32), value, starts, at_sorted.astype(np.int32), value_sorted, cuts, y.astype(np.float32), len(used), steps, rate, shrink * len(rows))
    # the classifiers don't depend on each other: three at a time in tasks of their own
    blocks = list(range(0, k, 3))
    if spark is None:
        done = {j: _block(data, j) for j in blocks}
    else:
        shared = spark.sparkContext.broadcast(data)  # its size is bounded by train_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in batch.column(0).to_pylist():
                    part, bj = _block(shared.value, j)
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([part.tobytes()]), pa.array([bj.tobytes()])], ["j", "w", "b"])

        todo = spark.range(0, len(blocks), 1, len(blocks)).select((F.col("id") * 3).cast("int").alias("j"))
        done = {r.j: (np.frombuffer(r.w, np.float32).reshape(len(used), -1), np.frombuffer(r.b, np.float32)) for r in todo.mapInArrow(run, "j int, w binary, b binary").collect()}
        shared.unpersist()
    w = np.zeros((len(used), k), np.float32)
    for j, (part, bj) in done.items():
        w[:, j : j + 3], b[j : j + 3] = part, bj
    weight[used] = w * idf[:, None]
    return Model(areas, weight, b, rarity)


def fit(rows: list[list[int]], labels: np.ndarray, areas: list[str], held: np.ndarray, steps: int = 30, rate: float = 1.0, shrink: float = 1e-6, spark=None) -> Model:
    """Classifiers fitted twice on the rows that aren't held out, and thresholds of best F1 on the untouched labels of those that are."""
    has = np.array([bool(r) for r in rows], bool)
    fitted = [r for r, ok in zip(rows, has & ~held) if ok]
    y = labels[has & ~held]
    first = _logistic(fitted, y, areas, steps, rate, shrink, spark)
    if fitted and areas:
        p = first.scores(fitted)
        top = p.argmax(1)
        y = y * (p >= 0.15)  # about none of its labels: figures of speech, thanks, addresses
        sure = p[np.arange(len(fitted)), top] >= 0.5
        y[sure] = y[sure] * (p[sure] >= 0.3)
        y[np.flatnonzero(sure), top[sure]] = 1
    model = _logistic(fitted, y, areas, 3 * steps, rate, shrink, spark)
    if (has & held).any():
        p = model.scores([r for r, ok in zip(rows, has & held) if ok])
        yh = labels[has & held] > 0
        for j in range(len(areas)):
            best = (-1.0, 0.5)
            for t in np.arange(0.3, 0.71, 0.05):
                hit = p[:, j] >= t
                f1 = 2 * (hit & yh[:, j]).sum() / max(1, hit.sum() + yh[:, j].sum())
                best = max(best, (round(float(f1), 3), float(t)))
            model.threshold[j] = best[1]
    return model


def train(df: DataFrame, labels: DataFrame, notes: dict[str, str | None], id_col: str = "doc_id", turns_col: str = "turns", label_col: str = "language_primary", train_rows: int = 8_000, seed: int = 5) -> Model:
    """Classifiers from at most about ``train_rows`` conversations with a weak label; ``notes`` are the areas and their scope notes."""
    areas, seeds = sorted(notes), seed_words(notes)

    @F.pandas_udf("array<string>")
    def weak(subjects):
        return subjects.map(lambda x: weak_areas(x, seeds))

    named = labels.where(F.col("subject").isNotNull() & F.col(id_col).isNotNull())
    named = named.groupBy(F.col(id_col).cast("string").alias("doc_id")).agg(F.min("subject").alias("subject")).select("doc_id", weak("subject").alias("weak"))
    named = named.where(F.size("weak") > 0)
    code = F.pandas_udf(lambda x: x.map(label_code), "string")  # spellings of a language are one label
    label = code(F.col(label_col).cast("string")) if label_col in df.columns else F.lit(None).cast("string")
    spoken = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), label.alias("label"))
    spoken = spoken.groupBy("doc_id").agg(F.coalesce(F.min("label"), F.lit("")).alias("label"))
    named = named.join(spoken, "doc_id")
    quota = F.least(F.lit(1.0), F.lit(train_rows / 8) / F.col("n"))
    share = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("part", quota)
    expected = share.agg(F.sum(F.col("n") * F.col("part"))).first()[0] or 0.0
    part = F.col("part") * min(1.0, train_rows / max(1.0, expected))
    named = named.join(share, "label").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < part * (1 << 20)).select("doc_id", "weak")
    some = cut(explode_turns(df, id_col, turns_col).join(named, "doc_id").select("doc_id", "text", "weak"))
    openers = openers_of(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            held, rows, own = [], [], []
            for test, text, weak_ in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s, _ in sentences(text, openers):
                    words: dict[str, int] = {}
                    for w in _TOKEN.findall(s.lower()):
                        if w in seeds:
                            words[seeds[w]] = words.get(seeds[w], 0) + 1
                    clear = [a for a, n in words.items() if n >= 2 and n == sum(words.values())]
                    held.append(test)
                    rows.append(features.of(s))
                    own.append(weak_ if test else clear or weak_)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(rows, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.string()))], ["held", "row", "own"])

    # whole conversations are held out; the sample's size is bounded by train_rows, its order made the same in every run
    test = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0
    made = some.select(test.alias("held"), "text", "weak").mapInArrow(run, "held boolean, row array<int>, own array<string>")
    got = made.orderBy(F.xxhash64("row"), "own", "held").toArrow()
    rows = got.column("row").to_pylist()
    place = {a: i for i, a in enumerate(areas)}
    y = np.zeros((len(rows), len(areas)), np.float32)
    for i, own in enumerate(got.column("own").to_pylist()):
        for a in own:
            if a in place:
                y[i, place[a]] = 1
    model = fit(rows, y, areas, np.array(got.column("held").to_pylist(), bool), spark=df.sparkSession)
    model.openers = openers
    return model


def subject_areas(
    df: DataFrame, labels: DataFrame, areas: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", least: int = 2, lean: float = 0.2, most_areas: int = 500, **train_with
) -> DataFrame:
    """``doc_id, area, sentences``: the areas two or more sentences of a conversation are about.

    ``general`` stands only where no other area does and a user's words are there. Turns that are leftovers (problem 4)
    don't count, nor do code, markers and addresses. Null ids, null and blank turns are left out; a
    repeated delivery counts once; other columns are left out; an empty table gives an empty one. A subject without a known
    word is no label.
    """
    spark = df.sparkSession
    note = F.col("scope_note").cast("string") if "scope_note" in areas.columns else F.lit(None).cast("string")
    got = areas.where(F.col("area").isNotNull()).groupBy("area").agg(F.min(note).alias("note")).limit(most_areas + 1).collect()
    if len(got) > most_areas:
        raise ValueError(f"more than {most_areas} areas: not a table to hand to every task")
    notes = {r.area: r.note for r in got}
    if not notes:
        return spark.createDataFrame([], "doc_id string, area string, sentences double")
    model = spark.sparkContext.broadcast(train(df, labels, notes, id_col, turns_col, **train_with))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), model.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, no, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = sentences(text, m.openers)
                # of each area: sentences above its threshold, those that lean to it, sum of probabilities
                total = {"": [float(len(_TOKEN.findall(without_code(text)))), 0.0, 0.0]}
                if parts and m.areas:
                    p = m.scores([features.of(s) for s, _ in parts])
                    for (_, n), row in zip(parts, p):
                        for j in np.flatnonzero(row >= np.minimum(m.threshold, lean)):
                            t = total.setdefault(m.areas[j], [0.0, 0.0, 0.0])
                            t[0] += n * (row[j] >= m.threshold[j])
                            t[1] += n * (row[j] < m.threshold[j] and row[j] == row.max())
                            t[2] += n * row[j]
                for area, (n, w, mass) in total.items():
                    for c, v in zip(cols, (doc, no, area, n, w, round(float(mass), 6))):
                        c.append(v)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "turn_no", "area", "n", "w", "mass"])

    rows = spread(explode_turns(df, id_col, turns_col), "doc_id").mapInArrow(run, "doc_id string, turn_no int, area string, n double, w double, mass double").distinct()
    rows = rows.join(residue.found_turns(df, id_col, turns_col), ["doc_id", "turn_no"], "left_anti")
    each = rows.groupBy("doc_id", "area").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("mass").alias("mass"))
    # no more rows for a conversation than there are areas
    per = each.groupBy("doc_id").agg(
        F.collect_list(F.struct("area", "n", "w")).alias("all"),
        F.max_by("area", F.when(F.col("area") != "", F.struct("mass", "area"))).alias("main"),
        F.max(F.when(F.col("area") == "", F.col("n"))).alias("words"),
    )
    # sentences that lean to the main area count for it
    counted = F.transform("all", lambda x: F.struct(x["area"].alias("area"), (x["n"] + F.when(x["area"] == F.col("main"), x["w"]).otherwise(0.0)).alias("n")))
    named = F.filter(counted, lambda x: ~x["area"].isin("", "general") & (x["n"] >= least))
    small = F.coalesce(F.get(F.transform(F.filter(counted, lambda x: x["area"] == "general"), lambda x: x["n"]), F.lit(0)), F.lit(0.0))
    other = F.filter(F.array(F.struct(F.lit("general").alias("area"), small.alias("n"))), lambda x: F.col("words") >= 3)
    per = per.select("doc_id", F.explode(F.when(F.size(named) > 0, named).otherwise(other)).alias("f"))
    return per.select("doc_id", "f.area", F.col("f.n").alias("sentences"))


def found_areas(df: DataFrame, labels: DataFrame, areas: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", **parameters) -> DataFrame:
    """``doc_id, area``."""
    return subject_areas(df, labels, areas, id_col, turns_col, **parameters).select("doc_id", "area")
