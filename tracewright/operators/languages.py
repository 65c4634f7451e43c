"""Languages of documents by script, by a detector's confidences and by the corpus' own labels.

A detector is a slot: a relation ``doc_id, lang, value`` with one row for each language it considers, the values of a
document adding up to 1. :func:`word_confidences` makes one from a table of common words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Scripts by ranges of characters; letters of no other script are Latin. Those with one language of their own name it.
SCRIPTS = {
    "Kana": r"぀-ヿ", "Han": r"㐀-䶿一-鿿", "Hangul": r"ᄀ-ᇿ가-힣", "Cyrillic": r"Ѐ-ӿ", "Arabic": r"؀-ۿݐ-ݿ", "Devanagari": r"ऀ-ॿ", "Thai": r"฀-๿",
}
_ALL = "".join(SCRIPTS.values())
_PLACES = 12  # decimals at which confidences are compared


def _class(*scripts: str) -> str:
    return "[" + "".join(SCRIPTS[s] for s in scripts) + "]" if "Latin" not in scripts else rf"[\p{{L}}&&[^{_ALL}]]"


def letters(text, *scripts: str) -> Column:
    """How many characters of the scripts a text has."""
    return F.length(F.array_join(F.regexp_extract_all(F.coalesce(T._c(text), F.lit("")), F.lit(_class(*scripts) + "+"), F.lit(0)), ""))


def script_runs(text, *scripts: str) -> Column:
    """Unbroken runs of characters of the scripts, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.coalesce(T._c(text), F.lit("")), F.lit(_class(*scripts) + "+"), F.lit(0)), " ")


def word_confidences(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", token: str = r"\p{L}+", most: int = 10_000) -> DataFrame:
    """``doc_id, lang, value``: each language's share of a text's common words; ``words`` has ``lang, word`` and a checked size."""
    w = words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).select(F.lower("lang").alias("lang"), F.lower("word").alias("_w")).distinct()
    if w.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} common words: not a table to hand to every task")
    tokens = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(token), F.lit(0))).alias("_w"))
    n = tokens.join(F.broadcast(w), "_w").groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("doc_id").agg(F.sum("n").alias("t"))
    return n.join(total, "doc_id").select("doc_id", "lang", (F.col("n") / F.col("t")).alias("value"))


def vocabulary(docs: DataFrame, label: str, known: list[str] | None = None) -> DataFrame:
    """``lang``: the distinct labels of a corpus, those a detector knows if a list is given; null labels are none."""
    v = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("lang")).distinct()
    return v if known is None else v.where(F.col("lang").isin(known))


def _first(conf: DataFrame, value: str = "value", name: str = "top") -> DataFrame:
    """``doc_id, name, name_value``: the language of the greatest confidence, the smaller name on ties."""
    b = F.min(F.struct((-F.round(value, _PLACES)).alias("v"), "lang", F.col(value).alias("x"))).alias("b")
    return conf.groupBy("doc_id").agg(b).select("doc_id", F.col("b.lang").alias(name), F.col("b.x").alias(f"{name}_value"))


def secondary(docs: DataFrame, conf: DataFrame, threshold: float = 0.3, floor: float = 0.05) -> DataFrame:
    """``doc_id, language_secondary``: the most confident language beside the trusted ``primary``, where that itself is there.

    A document whose primary stays below ``floor`` is a mislabel, and one of one language has no second: both null.
    """
    both = conf.join(docs.select("doc_id", "primary").distinct(), "doc_id")
    own = both.where("lang = primary").select("doc_id", F.col("value").alias("own"))
    other = _first(both.where("lang <> primary"), name="other")
    got = docs.join(own, "doc_id", "left").join(other, "doc_id", "left")
    return got.select("doc_id", F.when((F.col("own") >= floor) & (F.col("other_value") >= threshold), F.col("other")).alias("language_secondary"))


def by_script(docs: DataFrame, conf: DataFrame, least_letters: int = 2, share: float = 0.2, sure: float = 0.7, fair: float = 0.5, latin: str = "en", one_language: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, language_primary, language_secondary``: the script decides where a fifth of the letters isn't Latin.

    A script that one language has (``one_language``) names it; else the detector's first language that isn't Latin
    counts from confidence ``sure`` on. Latin is then a second language if it has its share and the detector gives
    ``latin`` the confidence ``fair``. Other documents have the detector's first language. Undecided ones are null.
    """
    names = {"Kana": "ja", "Hangul": "ko", "Cyrillic": "ru", "Han": "zh", "Arabic": "ar", "Devanagari": "hi", "Thai": "th"} if one_language is None else one_language
    text = T.strip_for_detection("text") if hasattr(T, "strip_for_detection") else F.col("text")
    counts = {s: letters("_t", s) for s in (*SCRIPTS, "Latin")}
    d = docs.withColumn("_t", text).select("doc_id", *[c.alias(s) for s, c in counts.items()])
    total = sum((F.col(s) for s in counts), F.lit(0))
    most = F.greatest(*[F.struct(F.col(s).alias("n"), F.lit(s).alias("s")) for s in SCRIPTS])
    d = d.select("doc_id", total.alias("n"), F.col("Latin").alias("latin"), most.alias("m"))
    top = _first(conf)
    of_latin = conf.where(F.col("lang") == latin).select("doc_id", F.col("value").alias("latin_value"))
    d = d.join(top, "doc_id", "left").join(of_latin, "doc_id", "left")
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    foreign = (F.col("n") - F.col("latin")) >= share * F.col("n")
    whole = F.when(F.col("top_value") >= sure, F.col("top"))
    primary = F.when(F.col("n") < least_letters, None).when(foreign, F.coalesce(named[F.col("m.s")], whole)).otherwise(whole)
    second = F.when(foreign & primary.isNotNull() & (F.col("n") >= least_letters) & (F.col("latin") >= share * F.col("n")) & (F.col("latin_value") >= fair), F.lit(latin))
    return d.select("doc_id", primary.alias("language_primary"), second.alias("language_secondary"))


def resolve(docs: DataFrame, detected: DataFrame | None, default: str = "English") -> DataFrame:
    """``doc_id, language_primary, language_secondary, path``: detector, else the first upstream label, else ``default``.

    ``docs`` has ``doc_id, languages`` (array). The upstream second label counts only where nothing is detected anew.
    """
    up = lambda i: F.get("languages", F.lit(i))
    if detected is None:
        return docs.select("doc_id", F.coalesce(up(0), F.lit(default)).alias("language_primary"), F.when(up(0).isNotNull(), up(1)).alias("language_secondary"), F.when(up(0).isNotNull(), "upstream").otherwise("default").alias("path"))
    got = docs.join(detected, "doc_id", "left")
    has = F.col("language_primary").isNotNull()
    return got.select(
        "doc_id", F.coalesce("language_primary", up(0), F.lit(default)).alias("language_primary"), F.when(has, F.col("language_secondary")).alias("language_secondary"), F.when(has, "detector").when(up(0).isNotNull(), "upstream").otherwise("default").alias("path")
    )


def observed(docs: DataFrame, conf: DataFrame, sure: float = 0.5, second: float = 0.3, default: str = "English") -> DataFrame:
    """``doc_id, language_primary, language_secondary, step``: a detector over the corpus' own labels, with the corpus' prior.

    A confident detection is taken (``confident``), else the upstream label where the detector's first language is the same
    (``agree``), else the greatest posterior under the prior (``prior``), else the upstream label or the default. The prior is
    each language's add-one share of the confident documents; a row for each language, so it is broadcast. A second
    language must reach ``second`` by posterior, and only the first three steps have one. ``docs`` has ``doc_id, upstream``.
    """
    top = _first(conf)
    voc = conf.select("lang").distinct()
    n = top.where(F.col("top_value") >= sure).groupBy(F.col("top").alias("lang")).agg(F.count(F.lit(1)).alias("c"))
    prior = voc.join(n, "lang", "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
    total = prior.agg(F.sum("c").alias("all"))
    prior = prior.crossJoin(F.broadcast(total)).select("lang", (F.col("c") / F.col("all")).alias("prior"))  # a single row
    weighted = conf.join(F.broadcast(prior), "lang").withColumn("w", F.col("value") * F.col("prior"))
    post = weighted.join(weighted.groupBy("doc_id").agg(F.sum("w").alias("s")), "doc_id").select("doc_id", "lang", (F.col("w") / F.col("s")).alias("p"))
    best = _first(post, "p", "posterior")
    got = docs.join(top, "doc_id", "left").join(best, "doc_id", "left")
    step = (
        F.when(F.col("top_value") >= sure, "confident").when(F.col("upstream") == F.col("top"), "agree").when(F.col("posterior_value") >= sure, "prior").when(F.col("upstream").isNotNull(), "fallback").otherwise("default")
    )
    primary = F.when(F.col("step").isin("confident", "agree"), F.col("top")).when(F.col("step") == "prior", F.col("posterior")).when(F.col("step") == "fallback", F.col("upstream")).otherwise(default)
    got = got.withColumn("step", step).withColumn("language_primary", primary).select("doc_id", "step", "language_primary")
    others = post.join(got.where(F.col("step").isin("confident", "agree", "prior")).distinct(), "doc_id").where("lang <> language_primary")
    others = _first(others.select("doc_id", "lang", "p"), "p", "other").where(F.col("other_value") >= second)
    return got.join(others, "doc_id", "left").select("doc_id", "language_primary", F.col("other").alias("language_secondary"), "step")
