"""Problem 5: languages of conversations and of stretches within them, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the letter itself and a seed. A run of three letters is the
product (binding) of its letters' vectors, each rotated (permuted) by its place; a text is the sum (bundle) of its runs. A
language's prototype is the bundle of sentences in it, and a sentence has the language whose prototype, without the mean of all
prototypes, is nearest by cosine.

The prototypes are made from sentences whose common words (the table ``common_words``) point to one language, never from
labels, since labels may be wrong. They are made from a bounded sample of conversations (``train_rows``, by a hash of the
id); everything else covers all rows.

Long passages without punctuation are cut into pieces of six words; a passage changes language where two pieces in a row,
or one with a clear margin, do so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import residue
from ._turns import QUOTED, SENTENCE, explode_turns, without_code

DIM = 8192
#: Names and codes of the languages told apart, in their usual spellings.
NAMES = {
    "en": ("English", "english eng en anglais inglés englisch inglês inglese engels английский 英语 英文"),
    "de": ("German", "german deutsch ger deu de allemand alemán alemão tedesco duits немецкий 德语 德文"),
    "fr": ("French", "french français francais fre fra fr französisch francés francês francese frans французский 法语 法文"),
    "es": ("Spanish", "spanish español espanol castellano castilian spa es espagnol spanisch espanhol spagnolo spaans испанский 西班牙语"),
    "pt": ("Portuguese", "portuguese português portugues por pt portugais portugiesisch portugués portoghese portugees португальский 葡萄牙语"),
    "it": ("Italian", "italian italiano ita it italien italienisch italiaans итальянский 意大利语"),
    "nl": ("Dutch", "dutch nederlands flemish vlaams dut nld nl néerlandais holländisch niederländisch holandés holandês olandese нидерландский голландский 荷兰语"),
    "ru": ("Russian", "russian русский russkij rus ru russe russisch ruso russo 俄语 俄文"),
    "zh": ("Chinese", "chinese mandarin cantonese 中文 汉语 漢語 普通话 zho chi cmn zh chinois chinesisch chino chinês cinese chinees китайский"),
}
_ALIAS = {a: code for code, (_, names) in NAMES.items() for a in names.split()}
_UNKNOWN = frozenset("unknown unk und undetermined undefined none null nan na n/a n.a. ? - -- other misc unbekannt inconnu desconocido zxx mul".split())

_HAN = regex.compile(r"\p{Han}")
_TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_WORDS_ONLY = regex.compile(r"[^\p{L}\p{M}]+")
_MAIL = regex.compile(r"\S+(?:@|\[at\]|\(at\))\S+|https?://\S+|\S*[/\\]\S*[/\\]\S*")
_LABEL = regex.compile(r"[\s_]*(?:[-_(].*)?$")


def label_code(label: str | None) -> str | None:
    """Language code a label names; '' for a missing label or a word for unknown; the label itself for other languages."""
    x = (label or "").strip().lower()
    if not x or x in _UNKNOWN:
        return ""
    if x in _ALIAS:
        return _ALIAS[x]
    head = regex.split(r"[-_ (,;/]", x, maxsplit=1)[0]
    if head in _ALIAS:
        return _ALIAS[head]
    for part in regex.split(r"[^\p{L}]+", x):
        if len(part) > 3 and part in _ALIAS:
            return _ALIAS[part]
    return x


class Space:
    """Vectors of letters and of runs of three letters."""

    def __init__(self, seed: int = 3) -> None:
        self.seed, self._letters = seed, {}

    def letter(self, c: str) -> np.ndarray:
        v = self._letters.get(c)
        if v is None:
            rng = np.random.default_rng(xxhash.xxh3_64_intdigest(c, seed=self.seed))
            v = self._letters[c] = (rng.integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
        return v

    def gram(self, g: str) -> np.ndarray:
        """The letters of a run, each rotated by its place, bound by multiplication."""
        a, b, c = (self.letter(x) for x in g)
        return np.roll(a, 2) * np.roll(b, 1) * c

    def bundle(self, weights: dict[str, float]) -> np.ndarray:
        """The weighted sum of runs."""
        out = np.zeros(DIM, np.float64)
        for g, w in weights.items():
            out += w * self.gram(g)
        return out


def normal(text: str) -> str:
    """Lower-case letters with single blanks between words and at both ends."""
    return " " + _WORDS_ONLY.sub(" ", text.lower()).strip() + " "


class Model:
    """Prototypes, centred and of length one, and the cosine of a text with each of them.

    Bundling is linear, so the product of a text's vector with a prototype is the sum of the products of its runs; those are
    kept, and a text's own vector is never built. Its length is the expected one: runs are nearly orthogonal.
    """

    def __init__(self, codes: list[str], proto: np.ndarray, seed: int, most: int = 300_000) -> None:
        proto = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        proto = proto - proto.mean(0)
        self.codes, self.seed, self.most = codes, seed, most
        self.proto = (proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self._open()

    def _open(self) -> None:
        self._space, self._row = Space(self.seed), {}
        self._rows = np.empty((4096, len(self.codes)), np.float32)

    def __getstate__(self):
        return self.codes, self.proto, self.seed, self.most

    def __setstate__(self, state) -> None:
        self.codes, self.proto, self.seed, self.most = state
        self._open()

    def _at(self, g: str) -> int:
        i = self._row.get(g)
        if i is None:
            if len(self._row) == len(self._rows):
                self._rows = np.concatenate([self._rows, np.empty_like(self._rows)])
            i = self._row[g] = len(self._row)
            self._rows[i] = self.proto @ self._space.gram(g).astype(np.float32)
        return i

    def cosines(self, texts: list[str]) -> np.ndarray:
        """One row for each normalised text."""
        if len(self._row) > self.most:  # a bounded memory; the vectors follow from the letters
            self._open()
        out = np.zeros((len(texts), len(self.codes)), np.float32)
        at = self._at
        for k, t in enumerate(texts):
            n = len(t) - 2
            if n > 0:
                index = [at(t[i : i + 3]) for i in range(n)]
                length = sum(c * c for c in Counter(index).values())
                out[k] = self._rows[index].sum(0) / (DIM * length) ** 0.5
        return out


def word_table(words: DataFrame, most: int = 10_000) -> dict[str, dict[str, float]]:
    """Weight of each common word for its languages; the table's size is checked."""
    rows = words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct()
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} common words: not a table to hand to every task")
    langs: dict[str, set] = {}
    for r in got:
        langs.setdefault(r.word, set()).add(r.lang)
    return {w: {x: 1 / len(s) for x in sorted(s)} for w, s in langs.items()}


def pointed_to(text: str, table: dict[str, dict[str, float]], least: float = 1.5, lead: float = 1.6) -> str | None:
    """The language to which the common words of a sentence point, if they do so clearly."""
    score: dict[str, float] = {}
    for w in _TOKEN.findall(text.lower()):
        for lang, weight in table.get(w, {}).items():
            score[lang] = score.get(lang, 0) + weight
    if not score:
        return None
    best = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    if best[0][1] < least or len(best) > 1 and best[0][1] < lead * best[1][1]:
        return None
    return best[0][0]


def pieces(text: str) -> list[tuple[str, bool]]:
    """Sentences of a turn, and parts of six words of passages without punctuation; True where a passage goes on."""
    body = _MAIL.sub(" ", QUOTED.sub(" ", without_code(text)))
    out = []
    for s in SENTENCE.split(body):
        if not s or not s.strip():
            continue
        words = s.split()
        if len(words) <= 16:
            out.append((s, False))
        else:
            parts = [words[i : i + 6] for i in range(0, len(words), 6)]
            if len(parts) > 1 and len(parts[-1]) < 4:
                parts[-2:] = [parts[-2] + parts[-1]]
            out += [(" ".join(p), i > 0) for i, p in enumerate(parts)]
    return out


def train(df: DataFrame, words: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", train_rows: int = 20_000, seed: int = 3) -> Model:
    """Prototypes from at most about ``train_rows`` conversations, chosen by a hash of their id."""
    table = word_table(words)
    codes = sorted({x for v in table.values() for x in v}) or sorted(NAMES)  # a language without a name goes by its code
    n = df.count()
    part = min(1.0, train_rows / max(n, 1))
    some = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)))
    given = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, Counter] = {c: Counter() for c in codes}
        for b in batches:
            for t in b.column(2).to_pylist():
                for s, _ in pieces(t):
                    lang = pointed_to(s, given.value)
                    if lang in count:
                        x = normal(s)
                        count[lang].update(x[i : i + 3] for i in range(len(x) - 2))
        got = [(c, g, n) for c, grams in count.items() for g, n in grams.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*got) if got else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    counts = explode_turns(some, id_col, turns_col).mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # runs of letters in a bounded sample; their square roots keep the most frequent ones from drowning the rest
    weights: dict[str, dict[str, float]] = {c: {} for c in codes}
    for lang, gram, n in counts.toPandas().sort_values(["lang", "gram"]).itertuples(index=False):
        weights[lang][gram] = n**0.5
    space = Space(seed)
    return Model(codes, np.stack([space.bundle(weights[c]) for c in codes]), seed)


def _stands(model: Model, table: dict, text: str, lang: str, main: str, cut: bool) -> bool:
    """Whether a passage in another language than its turn bears a check: length, and common words of the two languages."""
    words = _TOKEN.findall(text.lower())
    if cut and len(words) < 9:
        return False  # a part of a passage that goes on
    here = sum(table.get(w, {}).get(lang, 0) for w in words)
    there = sum(table.get(w, {}).get(main, 0) for w in words)
    return here > there or here == there == 0


def _stretches(model: Model, table: dict, text: str) -> list[tuple[str, float, int, int]]:
    """Language, confidence, whole sentences and letters of each stretch of a turn."""
    parts = pieces(text)
    keep = [(normal(s), s, more) for s, more in parts]
    keep = [(t, s, more) for t, s, more in keep if len(t) > 4]
    if not keep:
        return []
    # one language at a time: the whole turn's is kept where a sentence speaks for another one by a small margin only
    cos = model.cosines([t for t, _, _ in keep])
    size = np.array([len(t) for t, _, _ in keep], float)
    main = int((cos * size[:, None]).sum(0).argmax())
    best = cos.argmax(1)
    margin = cos.max(1) - cos[:, main]
    best[margin < 0.04] = main
    top2 = np.sort(cos, 1)[:, -2:]
    margin = top2[:, 1] - top2[:, 0] if cos.shape[1] > 1 else cos[:, 0]
    runs: list[list[int]] = []
    for i, (_, _, more) in enumerate(keep):
        if more and runs and (best[i] == best[runs[-1][-1]] or margin[i] < 0.08 and not (i + 1 < len(keep) and keep[i + 1][2] and best[i + 1] == best[i])):
            if best[i] != best[runs[-1][-1]]:
                best[i] = best[runs[-1][-1]]
            runs[-1].append(i)
        else:
            runs.append([i])
    for r in runs:
        if best[r[0]] != main and not _stands(model, table, " ".join(keep[i][1] for i in r), model.codes[best[r[0]]], model.codes[main], len(r) > 1 or keep[r[0]][2] or r[0] + 1 < len(keep) and keep[r[0] + 1][2]):
            best[r] = main
    out: list[list] = []
    for r in runs:
        words = sum(len(_TOKEN.findall(keep[i][1])) for i in r)
        han = sum(len(_HAN.findall(keep[i][1])) for i in r)
        part = size[r]
        mean = (cos[r] * part[:, None]).sum(0) / part.sum()
        lang = int(best[r[0]])
        e = np.exp((mean - mean.max()) * 25)
        conf = float(e[lang] / e.sum())
        letters = int(part.sum())
        whole = han >= 6 or words >= 5 and letters >= 22
        out.append([model.codes[lang], conf, int(whole), letters])
    merged: list[list] = []
    for x in out:
        if not x[2]:
            continue  # a label, a name: no language of its own
        if merged and merged[-1][0] == x[0]:
            m = merged[-1]
            m[1] = (m[1] * m[3] + x[1] * x[3]) / (m[3] + x[3])
            m[2] += x[2]
            m[3] += x[3]
        else:
            merged.append(x)
    return [tuple(m) for m in merged]


def language_stretches(df: DataFrame, words: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", label_col: str = "language_primary", seed: int = 3, **train_with) -> DataFrame:
    """``doc_id, label, turn_no, stretch, lang, confidence, sentences, letters``: each stretch of one language in a turn.

    Turns that are leftovers (problem 4) have none, nor have code, markers, addresses, short quoted phrases and pieces of
    fewer than five words. Null and blank turns and null ids are left out; a repeated delivery counts once; other columns
    are left out; an empty table gives an empty one.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(train(df, words, id_col, turns_col, seed=seed, **train_with))
    given = spark.sparkContext.broadcast(word_table(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "label", "turn_no", "stretch", "lang", "confidence", "sentences", "letters"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, label, no, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                for k, (lang, conf, whole, letters) in enumerate(_stretches(model.value, given.value, text)):
                    for c, v in zip(cols, (doc, label, no, k, lang, round(conf, 6), whole, letters)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    label = F.col(label_col) if label_col in df.columns else F.lit(None)
    rows = explode_turns(df.withColumn(label_col, label.cast("string")), id_col, turns_col, F.col(label_col).alias("label"))
    got = spread(rows.select("doc_id", "label", "turn_no", "text"), "doc_id").mapInArrow(
        run, "doc_id string, label string, turn_no int, stretch int, lang string, confidence double, sentences int, letters bigint"
    ).distinct()
    return got.join(residue.found_turns(df, id_col, turns_col), ["doc_id", "turn_no"], "left_anti")


def conversation_languages(stretches: DataFrame, sure: float = 0.8, fair: float = 0.45, letters: int = 60) -> DataFrame:
    """``doc_id, label, langs, lang, confidence``: languages of a conversation and the one most of its letters are in.

    A second language counts if one of its stretches has at least the confidence ``sure``, or the confidence ``fair`` where it
    has enough letters: two near languages share a confidence that a third one doesn't touch.
    """
    by_lang = stretches.groupBy("doc_id", "lang").agg(
        F.max("label").alias("label"),
        F.sum("letters").alias("letters"),
        F.max("confidence").alias("most"),
        (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"),
    )
    main = F.max_by(F.struct("lang", "confidence"), F.struct("letters", "lang")).alias("main")
    counts = (F.col("most") >= sure) | ((F.col("most") >= fair) & (F.col("letters") >= letters))
    got = by_lang.groupBy("doc_id").agg(F.max("label").alias("label"), F.collect_set(F.when(counts, F.col("lang"))).alias("langs"), main)
    return got.select("doc_id", "label", F.array_union("langs", F.array("main.lang")).alias("langs"), "main.lang", "main.confidence")


def found_languages(df: DataFrame, words: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", label_col: str = "language_primary", **parameters) -> DataFrame:
    """``doc_id, lang_name`` of conversations whose label is missing or wrong or which hold several languages."""
    got = conversation_languages(language_stretches(df, words, id_col, turns_col, label_col, **parameters))

    @F.pandas_udf("string")
    def code(label: pd.Series) -> pd.Series:
        return label.map(label_code)

    named = F.create_map(*[F.lit(x) for c, (name, _) in NAMES.items() for x in (c, name)])
    case = (F.size("langs") > 1) | (F.col("code") == "") | ~F.array_contains("langs", F.col("code"))
    rows = got.withColumn("code", code("label")).where(case).select("doc_id", F.explode("langs").alias("lang"))
    return rows.select("doc_id", F.coalesce(named[F.col("lang")], F.col("lang")).alias("lang_name"))
