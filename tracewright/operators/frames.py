"""Frames and passages: scenes a document is moved into, passages it is padded with, and what may replace a text.

Every draw is a hash of seed and document, so an assignment can be told from the ids alone and any split of the work gives
the same one. Models are slots; a rewrite outside the length bounds falls back to the original.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import defenses as D

PLACES = ("harbour", "orchard", "night train", "lighthouse", "museum", "market hall", "observatory", "ferry", "bakery", "mountain hut")
OCCASIONS = ("letter", "logbook", "interview", "radio talk", "guided walk")


def scenes() -> list[tuple[str, str]]:
    """Key and label of each scene: every occasion at every place."""
    return [(f"{p}-{o}".replace(" ", "_"), f"a {o} from the {p}") for p in PLACES for o in OCCASIONS]


def _draw(n: int, seed: int, *salt) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", *[F.lit(x) for x in salt]), F.lit(n)).cast("int")


def with_scene(docs: DataFrame, seed: int = 1, single: str | None = None) -> DataFrame:
    """``docs`` with ``framing`` and ``label``; ``single`` puts all of them into one scene."""
    all_ = scenes()
    if single is not None and single not in dict(all_):
        raise KeyError(f"no scene {single!r}; there are {', '.join(k for k, _ in all_)}")
    i = F.lit([k for k, _ in all_].index(single)) if single else _draw(len(all_), seed, "scene")
    pick = lambda j: F.get(F.array(*[F.lit(s[j]) for s in all_]), i)
    return docs.withColumn("framing", pick(0)).withColumn("label", pick(1))


def scene_manifest(docs: DataFrame, seed: int = 1, single: str | None = None) -> DataFrame:
    """``doc_id, framing, label`` of each document."""
    return with_scene(docs.select("doc_id").distinct(), seed, single).select("doc_id", "framing", "label")


def within_length(original, rewritten, least: float = 0.5, most: float = 4.0) -> Column:
    """Whether a rewrite is neither empty nor far shorter or longer than the text."""
    a, b = F.greatest(F.length(T._c(original)), F.lit(1)), F.length(T._c(rewritten))
    return F.coalesce((b > 0) & (b >= least * a) & (b <= most * a), F.lit(False))


def shift(docs: DataFrame, rewrite: Callable[[pd.Series, pd.Series], pd.Series], seed: int = 1, single: str | None = None, least: int = 20, bounds: tuple[float, float] = (0.5, 4.0)) -> DataFrame:
    """Every turn told as its document's scene; ``rewrite`` maps labels and texts. Each distinct pair is rewritten once.

    Turns shorter than ``least`` and rewrites outside the bounds stay as they were.
    """
    slot = F.pandas_udf(rewrite, "string")
    turns = D.flatten(docs).join(scene_manifest(docs, seed, single), "doc_id")
    done = turns.where(F.length(F.trim("text")) >= least).select("label", "text").distinct().withColumn("new", slot("label", "text"))
    out = turns.join(done, ["label", "text"], "left").withColumn("text", F.when(within_length("text", "new", *bounds), F.col("new")).otherwise(F.col("text")))
    return D.regroup(out.select("doc_id", "author_id", "turn_no", "text"))


# --- passages -----------------------------------------------------------------------------------------------------------
def rule_bank(spark: SparkSession) -> DataFrame:
    """``framing, passage``: a bank made by rule, four passages for each scene; a model's bank has the same columns."""
    parts = (
        "The keeper of the {p} wrote that the old clock had stopped at nine and nobody had wound it since the frost of 1987.",
        "Three crates of copper lamps stood by the door of the {p}, each with a paper tag from the workshop in Ostmar.",
        "On the second evening the visitors at the {p} counted forty-one swallows under the eaves before the rain began.",
        "A brass plate at the {p} names the four carpenters who raised its roof in the spring after the great flood.",
    )
    rows = [(f"{p}-{o}".replace(" ", "_"), f"From {('an' if o[0] in 'aeiou' else 'a')} {o}: {t.format(p=p)}") for p in PLACES for o in OCCASIONS for t in parts]
    return spark.createDataFrame(rows, "framing string, passage string")


def _numbered(bank: DataFrame, most: int = 100_000) -> DataFrame:
    """One row for each scene with its passages in order; a bank of checked size."""
    if bank.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} passages: not a bank to hand to every task")
    return bank.where(F.col("passage").isNotNull()).groupBy("framing").agg(F.array_sort(F.collect_set("passage")).alias("bank"))


def with_passage(docs: DataFrame, bank: DataFrame, seed: int = 1, single: str | None = None) -> DataFrame:
    """``docs`` with scene and ``passage``, one of its scene's passages; null where the bank has none."""
    got = with_scene(docs, seed, single).join(F.broadcast(_numbered(bank)), "framing", "left")
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.lit("passage")), F.size("bank").cast("bigint")).cast("int")
    return got.withColumn("passage", F.when(F.size("bank") > 0, F.get("bank", at))).drop("bank")


def pad(docs: DataFrame, bank: DataFrame, seed: int = 1, single: str | None = None) -> DataFrame:
    """Exactly one passage as a last turn; the other turns stay byte for byte."""
    p = with_passage(docs, bank, seed, single)
    turns = F.coalesce("turns", F.array().cast("array<string>"))
    return p.withColumn("turns", F.when(F.col("passage").isNotNull(), F.concat(turns, F.array("passage"))).otherwise(turns)).select(*docs.columns)


def pad_manifest(docs: DataFrame, bank: DataFrame, seed: int = 1, single: str | None = None) -> DataFrame:
    """``doc_id, framing, label, pad_id, pad_chars``: which passage a document gets, by the first 12 digits of its hash."""
    p = with_passage(docs.select("doc_id").distinct(), bank, seed, single)
    return p.select("doc_id", "framing", "label", F.substring(F.sha2(F.coalesce("passage", F.lit("")), 256), 1, 12).alias("pad_id"), F.coalesce(F.length("passage"), F.lit(0)).alias("pad_chars"))


def bank_quality(bank: DataFrame, floor: float = 4.0) -> DataFrame:
    """``passages, questions, imperatives, technical, thin, density, min_chars, median_chars, max_chars``: rules a bank breaks.

    Density counts numbers and capitalised words inside sentences for each hundred words; the median is the upper one.
    """
    t = F.col("passage")
    markers = F.size(F.regexp_extract_all(t, F.lit(r"\d+|(?<=[a-z,;] )\p{Lu}\p{L}+"), F.lit(0)))
    d = F.when(F.size(T.words(t)) > 0, 100.0 * markers / F.size(T.words(t))).otherwise(0.0)
    imperative = F.lower(F.ltrim(t)).rlike(r"^(?:please|write|tell|give|show|explain|make|list|describe|let|consider|imagine|remember|note)\b")
    technical = t.rlike(r"`|https?://|\b\w+\(\)|\b\w+\.(?:py|js|ts|java|c|cpp|go|rs|sql|json|yaml)\b")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    b = bank.where(t.isNotNull()).withColumn("_n", F.length(t)).withColumn("_d", d)
    upper = F.get(F.array_sort(F.collect_list("_n")), F.floor(F.count(F.lit(1)) / 2).cast("int"))  # a bank is small, see _numbered
    return b.agg(
        F.count(F.lit(1)).alias("passages"), n(t.contains("?")).alias("questions"), n(imperative).alias("imperatives"), n(technical).alias("technical"), n(F.col("_d") < floor).alias("thin"),
        F.coalesce(F.avg("_d"), F.lit(0.0)).alias("density"), F.coalesce(F.min("_n"), F.lit(0)).alias("min_chars"), F.coalesce(upper, F.lit(0)).alias("median_chars"), F.coalesce(F.max("_n"), F.lit(0)).alias("max_chars"),
    )


# --- turns that are added, and what is admitted --------------------------------------------------------------------------
def append_turns(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Documents with a generated last turn (``doc_id, turn``), where there is one that isn't blank; the other turns stay."""
    one = made.groupBy("doc_id").agg(F.min("turn").alias("_turn"))
    turns = F.coalesce("turns", F.array().cast("array<string>"))
    has = F.coalesce(T.strip("_turn") != "", F.lit(False))
    return docs.join(one, "doc_id", "left").withColumn("turns", F.when(has, F.concat(turns, F.array("_turn"))).otherwise(F.col("turns"))).select(*docs.columns)


def admissible(candidate, original, least: float = 0.5, most: float = 2.0) -> Column:
    """Whether a candidate has as many turns, blank ones only where they were, and a length within the bounds."""
    c, o = T._c(candidate), T._c(original)
    filled = F.forall(F.arrays_zip(c.alias("c"), o.alias("o")), lambda x: (T.strip(F.coalesce(x["o"], F.lit(""))) == "") | (T.strip(F.coalesce(x["c"], F.lit(""))) != ""))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    ratio = total(c) / F.nullif(total(o), F.lit(0))
    return F.coalesce((F.size(c) == F.size(o)) & filled & (ratio.isNull() | ratio.between(least, most)), F.lit(False))


def nearest_prior(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """``key, prior``: of the priors of a candidate (``key, vec`` and ``key, prior, vec``) the one of highest cosine, the smaller on ties."""
    p = candidates.select("key", F.col("vec").alias("_c")).join(priors, "key")
    cos = V.dot(V.unit("_c"), V.unit("vec"))
    return p.withColumn("_s", F.round(cos, 12)).groupBy("key").agg(F.min(F.struct((-F.col("_s")).alias("s"), "prior")).alias("b")).select("key", F.col("b.prior").alias("prior"))


def topic_rejection(topic, least: int = 30, most: int = 160) -> Column:
    """Why a generated topic isn't taken, by the first rule it breaks, or null."""
    t = T._c(topic)
    return (
        F.when(t.isNull() | t.contains("\n") | (T.strip(t) != t), "not a single trimmed line").when(~F.length(t).between(least, most), "length band").when(t.rlike(r"[^\x00-\x7f]"), "non-ASCII")
        .when(~t.rlike(r"^[^,.;:!?]{6,}, [^,.;:!?]{3,}, [^,.;:!?]{3,} and [^,.;:!?]{3,}$"), "wrong shape").when(F.lower(F.split(t, ",")[0]).isin("the subject", "this subject", "subject"), "placeholder head term")
    )


def harvest(headings: DataFrame, rejection: Callable[[Column], Column] = topic_rejection, column: str = "heading", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Headings that pass, one of each spelling in any case, by a keyed order; and ``reason, n`` of the others."""
    h = headings.withColumn("_reason", rejection(F.col(column)))
    good = h.where("_reason is null").groupBy(F.lower(column).alias("_k")).agg(F.min(column).alias(column))
    good = good.select(column, F.xxhash64(F.lit(seed), "_k").alias("place"))
    return good, h.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- compositions and slots ---------------------------------------------------------------------------------------------
def compose(name: str, *parts: str) -> None:
    """Register the defenses applied one after the other under a name of its own."""

    @D.defense(name)
    def run(docs: DataFrame) -> DataFrame:
        for p in parts:
            docs = D.apply(p, docs)
        return docs


def round_trip(name: str, *steps: Callable[[pd.Series], pd.Series], least: int = 1) -> None:
    """Register translators applied one after the other, there and back again; each distinct turn once."""

    def all_of(x: pd.Series) -> pd.Series:
        for s in steps:
            x = s(x)
        return x

    D.model_defense(name, all_of, least)


def guarded(name: str, rewrite: Callable[[pd.Series], pd.Series], bounds: tuple[float, float] = (0.5, 4.0), least: int = 1) -> None:
    """Register a model whose rewrites outside the length bounds are dropped for the original."""

    def run(x: pd.Series) -> pd.Series:
        y = rewrite(x)
        a, b = x.str.len().clip(lower=1), y.fillna("").str.len()
        return y.where((b > 0) & (b >= bounds[0] * a) & (b <= bounds[1] * a), x)

    D.model_defense(name, run, least)


#: What is protected, else a word, else what is between words; these one after the other are the text.
_PIECES = rf"{D._PROTECTED}|(?:(?!{D._PROTECTED})[\p{{L}}'])++|(?:(?!{D._PROTECTED})[^\p{{L}}'])++"
#: A word among the pieces; longer ones are protected.
_WORD = r"^'*\p{L}[\p{L}']*\z"


def word_mechanism(docs: DataFrame, candidates: DataFrame, epsilon: float = 100.0, sensitivity: float = 1.0, add: float = 0.0, drop: float = 0.0, seed: int = 1, few: int = 256) -> DataFrame:
    """Every word of the free text drawn anew by the exponential mechanism over its candidates (``word, candidate, score``).

    Words without candidates stay, as do code, placeholders, links and what is between words. ``drop`` and ``add`` are the
    chances that a drawn word is left out, or said twice with another draw. Draws are Gumbel noise from a keyed hash. Up to
    ``few`` candidates go to every row, which is rewritten where it is; more are joined to the words of the text.
    """
    c = candidates.select(F.lower("word").alias("_word"), "candidate", "score").where("_word is not null")
    share = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), "doc_id", *key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noisy = lambda score, candidate, s, *at: score * epsilon / (2 * sensitivity) - F.log(-F.log(share(*at, candidate, F.lit(s))))
    new = lambda w, one, more, *at: F.when(one.isNull(), w).when(share(*at, F.lit("drop")) < drop, "").when(share(*at, F.lit("add")) < add, F.concat_ws(" ", one, more)).otherwise(one)
    if c.limit(few + 1).count() > few:
        return _drawn_by_join(docs, c, noisy, new)
    plain = lambda x: F.translate(F.lower(x), "ς", "σ")  # noqa: E731  (at a word's end there may be the other one)
    table = c.groupBy("_word").agg(F.collect_list(F.struct("candidate", "score")).alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_of"))).alias("_of"), F.transform(F.collect_list("_word"), plain).alias("_words"))

    def piece(x: Column, *at: Column) -> Column:
        draw = lambda s: F.array_max(F.transform(x["c"], lambda k: F.struct(noisy(k["score"], k["candidate"], s, *at).alias("noisy"), k["candidate"].alias("candidate"))))["candidate"]
        return F.when(x["c"].isNull() | (F.length(x["w"]) >= 25) | ~x["w"].rlike(_WORD), x["w"]).otherwise(new(x["w"], draw("a"), draw("b"), *at))

    def turn(t: Column, no: Column) -> Column:
        some = F.exists(F.array(plain(t)), lambda x: F.exists("_words", lambda w: F.contains(x, w)))
        pieces = F.transform(F.regexp_extract_all(t, F.lit(_PIECES), F.lit(0)), lambda w: F.struct(w.alias("w"), F.try_element_at("_of", F.lower(w)).alias("c")))
        return F.when(some, F.array_join(F.transform(pieces, lambda x, at: piece(x, no, at)), "")).otherwise(F.coalesce(t, F.lit("")))

    rows = docs.select("doc_id", "author_id", F.coalesce("turns", F.array().cast("array<string>")).alias("turns"))
    return rows.crossJoin(F.broadcast(table)).select("doc_id", "author_id", F.transform("turns", turn).alias("turns"))  # a single row


def _drawn_by_join(docs: DataFrame, c: DataFrame, noisy: Callable[..., Column], new: Callable[..., Column]) -> DataFrame:
    """:func:`word_mechanism` for any number of candidates."""
    t = D.flatten(docs)
    pieces = F.flatten(F.transform(D.protected_chunks("text"), lambda x: F.when(x["free"], F.transform(F.regexp_extract_all(x["chunk"], F.lit(r"(?U)[\p{L}']+|[^\p{L}']+"), F.lit(0)), lambda w: F.struct(w.alias("w"), F.lit(True).alias("free")))).otherwise(F.array(F.struct(x["chunk"].alias("w"), F.lit(False).alias("free"))))))
    each = t.select("doc_id", "author_id", "turn_no", F.posexplode_outer(pieces).alias("at", "p")).select("doc_id", "author_id", "turn_no", "at", F.coalesce("p.w", F.lit("")).alias("w"), F.coalesce("p.free", F.lit(False)).alias("free"))
    word = each.where(F.col("free") & F.col("w").rlike(r"\p{L}"))
    draw = lambda s: F.max_by("candidate", F.struct(noisy(F.col("score"), F.col("candidate"), s, "turn_no", "at"), "candidate"))
    drawn = word.join(c, F.lower("w") == F.col("_word")).groupBy("doc_id", "turn_no", "at").agg(draw("a").alias("new"), draw("b").alias("more"))
    # never broadcast, as would be tried where its files are small
    out = each.join(drawn.hint("merge"), ["doc_id", "turn_no", "at"], "left")
    text = new(F.col("w"), F.col("new"), F.col("more"), "turn_no", "at")
    done = out.groupBy("doc_id", "author_id", "turn_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("x")))), lambda x: x["x"]), "").alias("text"))
    return D.regroup(done)


D.defense("frame_pad")(lambda docs: pad(docs, rule_bank(docs.sparkSession)))
D.defense("frame_pad_single")(lambda docs: pad(docs, rule_bank(docs.sparkSession), single=scenes()[0][0]))
compose("placeholders_normalise", "placeholders", "normalise")
