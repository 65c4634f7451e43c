"""Text-rewriting defenses: a registry, deterministic rewrites, and slots for models.

A defense is a function from a document table (``doc_id, author_id, turns``) to the same rows with rewritten turns. Deterministic
ones draw by a hash of seed, author, marker and document, so any split of the work gives the same result. A model is plugged
in with :func:`model_defense`: each distinct turn is rewritten once and joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}

#: What no rewrite may touch (code, placeholders, links, long tokens).
_PROTECTED = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`|<[A-Z][A-Z_]*>|https?://\S+|\]\([^)\s]*\)|\S{25,}"


def defense(name: str):
    def put(f):
        REGISTRY[name] = f
        return f

    return put


def apply(name: str, docs: DataFrame) -> DataFrame:
    """A registered defense by name."""
    if name not in REGISTRY:
        raise KeyError(f"no defense {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](docs)


def flatten(docs: DataFrame) -> DataFrame:
    """``turn_id, doc_id, author_id, turn_no, text``: one row for each turn, null turns as empty ones.

    A document without turns has one row with a null number, so that it is there again after :func:`regroup`.
    """
    t = docs.select("doc_id", "author_id", F.posexplode_outer("turns").alias("turn_no", "text"))
    return t.select(F.concat("doc_id", F.lit("#"), "turn_no").alias("turn_id"), "doc_id", "author_id", "turn_no", F.when(F.col("turn_no").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))


def regroup(turns: DataFrame) -> DataFrame:
    """``doc_id, author_id, turns`` in the order of the turns."""
    g = turns.groupBy("doc_id", "author_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "text"))).alias("t"))
    return g.select("doc_id", "author_id", F.transform(F.filter("t", lambda x: x["turn_no"].isNotNull()), lambda x: x["text"]).alias("turns"))


def protected_chunks(text) -> Column:
    """``array<struct<chunk, free>>`` whose chunks joined are the text: code, placeholders, links and long tokens aren't free."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    kept = F.regexp_extract_all(t, F.lit(_PROTECTED), F.lit(0))
    free = F.split(t, _PROTECTED)
    at = F.sequence(F.lit(0), F.size(free) - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.array(F.struct(F.get(free, i).alias("chunk"), F.lit(True).alias("free")), F.struct(F.get(kept, i).alias("chunk"), F.lit(False).alias("free")))))
    return F.filter(pairs, lambda x: x["chunk"].isNotNull() & (x["chunk"] != ""))


def on_free_text(text, f: Callable[[Column], Column]) -> Column:
    """The text with ``f`` applied to its free chunks only."""
    return F.array_join(F.transform(protected_chunks(text), lambda x: F.when(x["free"], f(x["chunk"])).otherwise(x["chunk"])), "")


@defense("normalise")
def normalise(docs: DataFrame) -> DataFrame:
    """Lower case, no punctuation, single blanks."""
    return docs.withColumn("turns", F.transform("turns", T.normalise_style))


@defense("placeholders")
def placeholders(docs: DataFrame) -> DataFrame:
    """Identifiers by pattern to placeholders; the stand-in for a model that does it."""
    return docs.withColumn("turns", F.transform("turns", lambda t: T.scrub_identifiers(t, mask_ids=True)))


def _swap(text: str, word: str, to: str) -> str:
    """A whole word replaced, its capitals kept."""

    def same_case(m: re.Match) -> str:
        w = m.group()
        return to.upper() if w.isupper() and len(w) > 1 else to[:1].upper() + to[1:] if w[:1].isupper() else to

    return re.sub(rf"(?<!\w){word}(?!\w)", same_case, text, flags=re.I)


@defense("truncate")
def truncate(docs: DataFrame, most: int = 400) -> DataFrame:
    return docs.withColumn("turns", T.cap_turns("turns", most))


def model_defense(name: str, rewrite: Callable[[pd.Series], pd.Series], least: int = 1) -> None:
    """Register a model: ``rewrite`` maps a series of texts. Turns shorter than ``least`` and blank ones pass through."""

    @defense(name)
    def run(docs: DataFrame) -> DataFrame:
        slot = F.pandas_udf(rewrite, "string")
        turns = flatten(docs)
        use = F.length(F.trim("text")) >= least
        done = turns.where(use).select("text").distinct().withColumn("new", slot("text"))
        out = turns.join(done, "text", "left").withColumn("text", F.coalesce("new", "text"))
        return regroup(out.select("doc_id", "author_id", "turn_no", "text"))


def exponential_choice(candidates: DataFrame, epsilon: float, sensitivity: float = 1.0, seed: int = 1) -> DataFrame:
    """``key, word``: one candidate of each key with probability in proportion to exp(eps score / (2 sensitivity)).

    ``candidates`` has ``key, word, score``. Drawn as the maximum of scores plus Gumbel noise from a keyed hash.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "key", "word"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noisy = F.col("score") * epsilon / (2 * sensitivity) - F.log(-F.log(u))
    return candidates.groupBy("key").agg(F.max_by("word", F.struct(noisy, "word")).alias("word"))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, turn_no, span_no, start, stop, text, editable, granularity``: sentences that tile a turn; words where it is one sentence.

    Boundaries never fall inside protected chunks. Empty turns have no spans.
    """
    turns = docs.select("doc_id", F.posexplode("turns").alias("turn_no", "turn")).where("turn is not null and turn <> ''")
    # a piece is a protected chunk, or text up to the end of a sentence with the blanks after it
    sent = rf"{_PROTECTED}|(?:(?!```|~~~|`|<[A-Z]|https?://).)+?(?:[.!?…]+[\s\"')\]]*(?=\s|$|\S)|\n+|$|(?=```|~~~|`|<[A-Z]|https?://))|."
    word = rf"{_PROTECTED}|(?s)\s*\S+(?:\s+$)?|\s+"
    s = F.regexp_extract_all("turn", F.lit(sent), F.lit(0))
    many = F.size(F.filter(s, lambda x: F.length(F.trim(x)) > 0)) > 1
    pieces = F.when(many, s).when(F.size(T.words("turn")) >= 4, F.regexp_extract_all("turn", F.lit(word), F.lit(0))).otherwise(F.array("turn"))
    pieces = F.filter(pieces, lambda x: x != "")
    p = turns.select("doc_id", "turn_no", pieces.alias("p"), F.when(many | (F.size(T.words("turn")) < 4), "sentence").otherwise("word").alias("granularity"))
    # a span ends where the spans up to it end: a running sum over the exploded pieces of a turn
    e = p.select("doc_id", "turn_no", "granularity", F.posexplode("p").alias("span_no", "p")).withColumn("stop", F.sum(F.length("p")).over(Window.partitionBy("doc_id", "turn_no").orderBy("span_no")))
    e = e.select("doc_id", "turn_no", "granularity", "span_no", F.struct("p", F.col("stop").cast("int").alias("stop")).alias("x"))
    free = F.length(F.regexp_replace(F.regexp_replace("x.p", _PROTECTED, ""), r"\s+", ""))
    floor = F.when(F.col("granularity") == "word", 2).otherwise(12)
    return e.select("doc_id", "turn_no", "span_no", (F.col("x.stop") - F.length("x.p")).alias("start"), F.col("x.stop").alias("stop"), F.col("x.p").alias("text"), (free >= floor).alias("editable"), "granularity")


def span_array(turns) -> Column:
    """``array<struct<turn_no, text, editable>>``: the spans of a row's turns as :func:`spans` has them, in their order."""
    sent = rf"{_PROTECTED}|(?:(?!```|~~~|`|<[A-Z]|https?://).)+?(?:[.!?…]+[\s\"')\]]*(?=\s|$|\S)|\n+|$|(?=```|~~~|`|<[A-Z]|https?://))|."
    word = rf"{_PROTECTED}|(?s)\s*\S+(?:\s+$)?|\s+"

    def of(turn: Column, no: Column) -> Column:
        free = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, _PROTECTED, ""), r"\s+", ""))
        put = lambda pieces, floor: F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.struct(no.alias("turn_no"), x.alias("text"), (free(x) >= floor).alias("editable")))
        cut = lambda s: F.when(F.size(F.filter(s, lambda x: F.length(F.trim(x)) > 0)) > 1, put(s, 12)).when(F.size(T.words(turn)) >= 4, put(F.regexp_extract_all(turn, F.lit(word), F.lit(0)), 2)).otherwise(put(F.array(turn), 12))
        # an array of one, so that the sentences are looked for once
        return F.flatten(F.transform(F.filter(F.array(turn), lambda x: x.isNotNull() & (x != "")), lambda x: F.flatten(F.transform(F.array(F.regexp_extract_all(x, F.lit(sent), F.lit(0))), cut))))

    return F.flatten(F.transform(turns, of))


from . import frames, habits  # noqa: E402, F401  (they register defenses of their own)


def _searches() -> None:
    """The search defenses under their names, with their budgets and targets."""
    from .search import footprint_loop
    from .unlink import unlink

    def put_back(docs: DataFrame, out: DataFrame) -> DataFrame:
        """All documents, those the search leaves out (without an id or turns) as they were."""
        new = out.select("doc_id", F.col("turns").alias("_new"))
        return docs.join(new, "doc_id", "left").withColumn("turns", F.coalesce("_new", "turns")).select(*docs.columns)

    for name, budget in {"loo_unlink": 0.2, **{f"loo_unlink_b{b:02d}": b / 100 for b in (5, 10, 20, 30, 50)}}.items():
        defense(name)(lambda docs, budget=budget: put_back(docs, unlink(docs, budget)))
    for name, alpha in {"afr": 0.5, **{f"afr_a{a:02d}": a / 100 for a in (0, 25, 50, 75)}}.items():
        defense(name)(lambda docs, alpha=alpha: put_back(docs, footprint_loop(docs, "doc_id", alpha=alpha)))
    defense("afr_stage1")(lambda docs: put_back(docs, footprint_loop(docs, "doc_id", most_probes=0)))


_searches()
