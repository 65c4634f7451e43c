"""Turns of conversations as rows, and the cleaning all text operators share."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The markers that earlier cleaning leaves in texts.
MARKERS = ("URL", "EMAIL", "IP", "PATH", "REPO", "USER", "ID", "HOST")

FENCE = regex.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", regex.S)
TICKS = regex.compile(r"(`+)(?!`)[^`\n]*?\1")
MARKER = regex.compile(r"<(?:" + "|".join(MARKERS) + r")>", regex.I)
#: Quoted phrases of up to six words.
QUOTED = regex.compile(r"[\"“„«»”]\s?[^\"“”„«»\n]{1,60}?\s?[\"”“«»]")
SENTENCE = regex.compile(r"(?<=[.?!…])[\"”»)']*\s+|(?<=[。！？；])|[;；]\s+|\n+|[ \t　]{2,}")


def without_code(text: str) -> str:
    """A text with code in fences and backticks and the markers replaced by blanks of the same length."""
    blank = lambda m: regex.sub(r"[^\n]", " ", m.group())
    for rx in (FENCE, TICKS, MARKER):
        text = rx.sub(blank, text)
    return text


def explode_turns(df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", *keep: str) -> DataFrame:
    """``doc_id, turn_no, text`` (and columns to keep) of the turns that are neither null nor blank, numbered from 0."""
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("doc_id"), *keep, F.posexplode(turns_col).alias("turn_no", "text")
    )
    return rows.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))
