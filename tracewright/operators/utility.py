"""What a defense costs: aligned turns, fluency, entailment and judge aggregates. Model scores come as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def aligned_pairs(original: DataFrame, defended: DataFrame) -> DataFrame:
    """``doc_id, part, original, defended``: by turn where both have as many turns, else the joined documents."""
    both = original.select("doc_id", F.col("turns").alias("a")).join(defended.select("doc_id", F.col("turns").alias("b")), "doc_id")
    whole = F.array(F.struct(F.array_join("a", "\n\n").alias("a"), F.array_join("b", "\n\n").alias("b")))
    pairs = F.when(F.size("a") == F.size("b"), F.arrays_zip("a", "b")).otherwise(whole)
    return both.select("doc_id", F.posexplode(pairs).alias("part", "x")).select("doc_id", "part", F.col("x.a").alias("original"), F.col("x.b").alias("defended"))


def key_alignment(original: DataFrame, defended: DataFrame, key: str = "doc_id") -> DataFrame:
    """``status, n`` of keys: in both, missing, extra, repeated."""
    a, b = (d.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((original, "a"), (defended, "b")))
    s = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when((F.col("a") > 1) | (F.col("b") > 1), "repeated").otherwise("both")
    return a.join(b, key, "full").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def length_weighted(pairs: DataFrame, score: str, baseline: str | None = None) -> DataFrame:
    """``doc_id, score``: mean of the parts by the length of their original, rescaled by a baseline of mismatched pairs if given."""
    w = F.greatest(F.length("original"), F.lit(1))
    m = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    value = m(score) if baseline is None else (m(score) - m(baseline)) / F.greatest(1 - m(baseline), F.lit(1e-9))
    return pairs.where(F.col(score).isNotNull()).groupBy("doc_id").agg(value.alias("score"))


def fluency(df: DataFrame, before: str = "ppl_before", after: str = "ppl_after") -> DataFrame:
    """Geometric mean and median of the ratio of perplexities, and the share above 1.5."""
    r = F.col(after) / F.col(before)
    d = df.where((F.col(before) > 0) & (F.col(after) > 0))
    return d.agg(F.exp(F.avg(F.log(r))).alias("geometric_mean"), F.percentile(r, F.lit(0.5)).alias("median"), F.avg((r > 1.5).cast("double")).alias("worse"), F.count(F.lit(1)).alias("n"))


def judged(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Mean score, share of usable (4 and more) and of unparsed replies of a judge."""
    s = T.parse_score(reply)
    return df.agg(F.avg(s).alias("mean"), F.avg((s >= 4).cast("double")).alias("usable"), F.avg(s.isNull().cast("double")).alias("unparsed"), F.count(F.lit(1)).alias("n"))


def render_template(template: str, **values: Column) -> Column:
    """``{{KEY}}`` replaced by columns."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def tagged(text, tag: str) -> Column:
    """The inner text of a tag, else the whole, trimmed."""
    t = F.col(text) if isinstance(text, str) else text
    inner = T.strip(F.regexp_extract(t, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(t.rlike(rf"(?s)<{tag}>.*?</{tag}>"), inner).otherwise(T.strip(t))


def render_conversation(turns, per_turn: int = 2000, most: int = 8000) -> Column:
    """Turns as ``<turn_k>`` blocks, each cut to ``per_turn`` characters, as many as fit; the number of those left out at the end."""
    t = T.drop_empty_turns(turns)
    block = F.transform(t, lambda x, i: F.concat(F.lit("<turn_"), i + 1, F.lit(">"), F.substring(x, 1, per_turn), F.lit("</turn_"), i + 1, F.lit(">")))
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    fits = lambda a, b: (F.length(a["s"]) + F.length(b) <= most)
    got = F.aggregate(block, zero, lambda a, b: F.when(fits(a, b), F.struct(F.concat(a["s"], F.when(a["s"] == "", F.lit("")).otherwise("\n"), b).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))
    left = F.size(t) - got["n"]
    return F.when(left > 0, F.concat(got["s"], F.lit("\n["), left, F.lit(" turns omitted]"))).otherwise(got["s"])


_LOOP = re.compile(r"(.{1,120}?)\1{3}", re.S)


def _cut(texts: pd.Series) -> pd.Series:
    def cut(t: str | None) -> str | None:
        m = _LOOP.search(t) if t else None
        return t if m is None else t[: m.end(1)]

    return texts.map(cut)


def cut_repetition(text) -> Column:
    """The text up to the first copy of a block of at most 120 characters that stands four times in a row."""
    return F.pandas_udf(_cut, "string")(F.col(text) if isinstance(text, str) else text)


def _edit(a: pd.Series, b: pd.Series) -> pd.Series:
    def distance(x: str | None, y: str | None) -> float:
        u, v = (x or "").split(), (y or "").split()
        if not u and not v:
            return 0.0
        row = list(range(len(v) + 1))
        for i, w in enumerate(u, 1):
            last, row[0] = row[0], i
            for j, z in enumerate(v, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != z))
        return row[-1] / max(len(u), len(v))

    return pd.Series([distance(x, y) for x, y in zip(a, b)])


def word_edit_distance(a, b) -> Column:
    """Word-level Levenshtein distance over the longer length."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.pandas_udf(_edit, "double")(c(a), c(b))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``mean_difference, n`` over keys that both have a value for."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).dropna()
    return d.agg(F.avg(F.col("y") - F.col("x")).alias("mean_difference"), F.count(F.lit(1)).alias("n"))
