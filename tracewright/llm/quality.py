"""Problem 9: text quality statistics of a document, and what they say: prose, list, table or junk.

Counts and ratios of words, symbols, line ends and common words, and repetition statistics: shares of duplicate lines and
paragraphs, and the share of characters that the dominant word n-grams cover. The form follows from rules over all of
them; every text is read whole. Code in fences is counted in the statistics and left out of the decision on the form.

Repetition in the decision: a text whose words nearly all belong to one repeated n-gram, or whose lines or paragraphs
nearly all repeat others, is junk; of the rest, a line that repeats an earlier one is boilerplate and counts neither as
prose nor as items.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

SCHEMA = (
    "n_chars bigint, n_words bigint, n_lines bigint, n_paragraphs bigint, mean_word_length double, symbol_ratio double,"
    " digit_ratio double, letter_ratio double, line_end_ratio double, common_word_ratio double, distinct_word_ratio double,"
    " top_word_ratio double, duplicate_line_ratio double, duplicate_paragraph_ratio double, top_bigram_coverage double,"
    " top_trigram_coverage double, list_line_ratio double, sentence_ratio double, form string"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(",")]

_word = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
_fence = regex.compile(r"```.*?(?:```|\Z)", regex.S)
_bullet = regex.compile(r"^\s*(?:[-*+•‣◦▪·–—]\s+|\(?\d{1,4}[.):]\s+|\(?[a-zA-Z][.)]\s+|\[[ xX✓]?\]\s*|☐|☑|☒)")
_row_tag = regex.compile(r"<tr\b|<td\b|</tr>|</td>", regex.I)
_tag = regex.compile(r"<[^<>]{1,80}>")
_end = regex.compile(r"[.!?…。！？:;][\"'”’)\]]*$")
_han = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_split = regex.compile(r"(?<=[.!?…])\s+|[。！？]|\n+|\s{2,}")
_moji = regex.compile(r"[ÃÂÐÑåæçèéêï][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]|ï¿½|�|Ã|Â|Ð")
_blob = regex.compile(r"[A-Za-z0-9+/=_\-]{32,}")
_vowel = regex.compile(r"[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿаеёиоуыэюя]")
_harsh = regex.compile(r"[^\W\d_aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿаеёиоуыэюя]{4,}")
_seps = ("\t", "|", "│", "¦", ";", ",")
_rule = regex.compile(r"[\s|+:=\-─┼├┤│]+")
_wide = regex.compile(r"\s{2,}")
_blank_line = regex.compile(r"\n\s*\n")
_hex = regex.compile(r"(?<!\S)(?:0x)?[0-9a-fA-F]{1,8}[:,;]?(?!\S)")
_tr = regex.compile(r"<tr\b.*?</tr>", regex.I | regex.S)
_pieces = regex.compile(r"[;,、]")
_gap = regex.compile(r"\S\s{3,}\S")


class Repetition:
    """Repetition statistics of a text, made when they are asked for; the statistics and the decision share them."""

    def __init__(self, text: str, words: list[str]) -> None:
        self._text, self.words = text, words
        self.inside = sum(map(len, words))

    @functools.cached_property
    def lines(self) -> list[str]:
        return [x.strip() for x in self._text.splitlines() if x.strip()]

    @functools.cached_property
    def paragraphs(self) -> list[str]:
        return [p.strip() for p in _blank_line.split(self._text) if p.strip()]

    @functools.cached_property
    def duplicate_lines(self) -> float:
        return _repeated(self.lines)

    @functools.cached_property
    def duplicate_paragraphs(self) -> float:
        return _repeated(self.paragraphs)

    @functools.cached_property
    def bigrams(self) -> float:
        return _coverage(self.words, 2, self.inside)

    @functools.cached_property
    def trigrams(self) -> float:
        return _coverage(self.words, 3, self.inside)


def _coverage(words: list[str], n: int, chars: int) -> float:
    """Share of the characters of the words that the most frequent run of n words covers, if it occurs more than once."""
    if len(words) < 2 * n or not chars:
        return 0.0
    g = Counter(zip(*(words[i:] for i in range(n))))
    top, c = max(g.items(), key=lambda x: (x[1] * sum(map(len, x[0])), x[0]))
    return min(1.0, c * sum(map(len, top)) / chars) if c > 1 else 0.0


def _repeated(parts: list[str]) -> float:
    """Share of parts that have occurred before."""
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _columns(lines: list[str]) -> bool:
    """Whether lines are records of three fields or more with the same separators."""
    if len(lines) < 3:
        return False
    kept = [x for x in lines if not _rule.fullmatch(x)]
    for sep in _seps:
        n = [x.strip().strip("|│").count(sep) if sep in "|│" else x.count(sep) for x in kept]
        if len(n) < 2:
            continue
        top, c = Counter(n).most_common(1)[0]
        if top < (1 if sep in "\t|│" else 2) or c < 0.75 * len(n):
            continue
        fields = [f for x in lines for f in x.split(sep) if f.strip()]
        long = sum(len(f.split()) > 6 for f in fields)
        if fields and long <= 0.15 * len(fields):
            return True
    # fields set apart by blanks, one below the other
    wide = [_wide.split(x.strip()) for x in lines]
    n = [len(x) for x in wide]
    if sum(k >= 2 for k in n) >= 0.75 * len(n) and sum(n) >= 2.5 * len(n):
        fields = [f for x in wide for f in x]
        return sum(len(f.split()) > 5 for f in fields) <= 0.1 * len(fields)
    return False


def _sentence_like(part: str, common: frozenset[str], chars: frozenset[str]) -> bool:
    """Whether a piece of text reads as a sentence: long enough, with common words in it."""
    han = len(_han.findall(part))
    if han >= 8:
        return sum(c in chars for c in part) >= 0.04 * han or han >= 18
    w = [x.lower() for x in _word.findall(part)]
    if len(w) < 6:
        return False
    known = sum(x in common for x in w)
    return known >= 2 and known >= 0.12 * len(w) and (len(w) >= 8 or bool(_end.search(part.strip())))


def _items(line: str) -> int:
    """Number of short items in one line, 0 if it isn't an enumeration."""
    best = 0
    for sep in (";", ",", "|", "·", "•", "、", "/"):
        parts = [p for p in line.split(sep) if p.strip()]
        if len(parts) >= 4 and sum(len(p.split()) > 6 or len(p) > 60 for p in parts) <= 0.1 * len(parts):
            best = max(best, len(parts))
    return best


def _repeats(rep: Repetition, distinct: int) -> bool:
    """Whether a text is one thing over and over: few distinct words whose n-grams cover it, or lines that repeat others."""
    n = len(rep.words)
    if n < 8:
        return False
    if distinct <= max(1, 0.05 * n) or distinct < 0.4 * n and Counter(rep.words).most_common(1)[0][1] > 0.6 * n:
        return True
    if distinct < 0.3 * n and max(rep.bigrams, rep.trigrams) > 0.75:
        return True
    copies = max(rep.duplicate_lines if len(rep.lines) >= 8 else 0.0, rep.duplicate_paragraphs if len(rep.paragraphs) >= 6 else 0.0)
    return copies > 0.8 and distinct < 0.2 * n


def _junk(body: str, rep: Repetition, common: frozenset[str]) -> bool:
    words = rep.words
    tokens = body.split()
    solid = "".join(tokens)
    n = len(solid)
    if not n:
        return False
    letters = sum(map(str.isalpha, solid))
    han = len(_han.findall(solid))
    known = sum(map(common.__contains__, words))
    if letters < 0.3 * n and known < 3:
        return True  # symbols, numbers, emoji
    if sum(map(len, _moji.findall(solid))) > 0.2 * n:
        return True  # broken characters
    if max(map(len, tokens)) >= 32 and sum(map(len, _blob.findall(body))) > 0.5 * n:
        outside = [w.lower() for w in _word.findall(_blob.sub(" ", body))]
        if sum(map(common.__contains__, outside)) < 3:
            return True  # codes
    if len(tokens) >= 8 and len(_hex.findall(body)) > 0.8 * len(tokens):
        return True  # dumps
    if len(tokens) >= 12 and not han and n < 8 * len(tokens) and sum(len(t) == 1 for t in tokens) > 0.7 * len(tokens):
        return True  # letters spaced out
    if _repeats(rep, len(set(words))):
        return True  # one word or phrase over and over
    if len(words) >= 3 and not han and known < 0.06 * len(words):
        latin = [w for w in words if len(w) >= 4 and w.isalpha()]
        if len(latin) >= 0.4 * len(words):
            harsh = sum(bool(_harsh.search(w)) or len(_vowel.findall(w)) < 0.2 * len(w) for w in latin)
            return harsh > 0.45 * len(latin)  # keyboard noise
    return False


def form_of(text: str, common: frozenset[str], chars: frozenset[str], rep: Repetition | None = None) -> str:
    """prose, list, table or junk; empty for texts without a visible character. ``rep`` is the text's, if it is at hand."""
    body = _fence.sub("\n", text) if "```" in text else text
    lines = [x for x in body.splitlines() if x.strip()]
    if not lines:
        return "prose" if text.strip() else ""
    if rep is None or body is not text:
        rep = Repetition(body, [w.lower() for w in _word.findall(body)])
    if "<" in body and len(_row_tag.findall(body)) >= 6:
        inside = sum(map(len, _tr.findall(body)))
        if inside > 0.5 * len(body):
            return "table"
    total = sum(len(x.strip()) for x in lines)
    marked = [bool(_bullet.match(x)) for x in lines]
    # one line of introduction doesn't change the form
    rest = lines[1:] if len(lines) > 3 and not marked[0] else lines
    if _columns(rest) or len(lines) > 3 and _columns(lines):
        inner = [x for x in lines if _sentence_like(x, common, chars) and not _bullet.match(x) and sum(s in x for s in "\t|│") == 0 and _items(x) < 3 and not _gap.search(x)]
        if sum(map(len, inner)) < 0.5 * total:
            return "table"
    if _junk(body, rep, common):
        return "junk"
    prose = listed = total = short = kept = 0
    seen: set[str] = set()
    for line, mark in zip(lines, marked):
        size = len(line.strip())
        if rep.duplicate_lines and size > 20:
            if line.strip() in seen:
                continue  # boilerplate
            seen.add(line.strip())
        total += size
        kept += 1
        plain = _bullet.sub("", line) if mark else line
        whole = _sentence_like(plain, common, chars)
        short += not whole
        if not mark and _items(line) >= 4 and not any(_sentence_like(p, common, chars) for p in _pieces.split(line)):
            listed += size
            continue
        parts = [p for p in _split.split(plain) if p and p.strip()]
        good = size if len(parts) == 1 and whole else sum(len(p.strip()) for p in parts if _sentence_like(p, common, chars))
        if good > 0.5 * max(1, len(plain.strip())):
            prose += size
        elif mark or len(_word.findall(plain)) <= 7:
            listed += size
        else:
            prose += size
    one_line = len(rest) <= 2 and max(map(_items, rest)) >= 5
    if listed > 0.6 * total and (short >= 4 and short >= 0.6 * kept or one_line):
        return "list"
    return "prose"


def statistics(text: str, common: frozenset[str], chars: frozenset[str]) -> tuple:
    """The values of :data:`SCHEMA` for one text."""
    solid = "".join(text.split())
    n = len(solid)
    words = [w.lower() for w in _word.findall(text)]
    rep = Repetition(text, words)
    lines = rep.lines
    letters = sum(map(str.isalpha, solid))
    digits = sum(map(str.isdigit, solid))
    nw, nl = len(words), len(lines)
    parts = [p for p in _split.split(text) if p and p.strip()]
    known = sum(map(common.__contains__, words)) + sum(map(chars.__contains__, solid))
    distinct = Counter(words)
    return (
        len(text),
        nw,
        nl,
        len(rep.paragraphs),
        rep.inside / nw if nw else 0.0,
        (n - letters - digits) / n if n else 0.0,
        digits / n if n else 0.0,
        letters / n if n else 0.0,
        sum(bool(_end.search(x)) for x in lines) / nl if nl else 0.0,
        min(1.0, known / nw) if nw else 0.0,
        len(distinct) / nw if nw else 0.0,
        max(distinct.values()) / nw if nw else 0.0,
        rep.duplicate_lines,
        rep.duplicate_paragraphs,
        rep.bigrams,
        rep.trigrams,
        sum(bool(_bullet.match(x)) for x in lines) / nl if nl else 0.0,
        sum(_sentence_like(p, common, chars) for p in parts) / len(parts) if parts else 0.0,
        form_of(text, common, chars, rep),
    )


def common_words(words: DataFrame, lang_col: str = "lang", word_col: str = "word", most: int = 10_000) -> tuple[frozenset[str], frozenset[str]]:
    """The common words as two sets, words and single CJK characters; a table of fixed size, refused above ``most`` rows."""
    rows = words.where(F.col(word_col).isNotNull()).select(F.lower(word_col).alias("w")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words: not a table to hand to every task")
    all_words = {r.w for r in rows}
    return frozenset(w for w in all_words if not _han.match(w)), frozenset(w for w in all_words if len(w) == 1 and _han.match(w))


def text_quality(df: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the statistics of every row's text, in a map-only stage.

    A null text has null statistics and a null form, an empty or blank one zeros and an empty form. Rows come out as often
    as they come in; other columns are left out, so clashing names don't matter.
    """
    return _each(df, words, id_col, text_col, statistics, SCHEMA, (None,) * len(_NAMES))


def _each(df: DataFrame, words: DataFrame, id_col: str, text_col: str, make, schema: str, none: tuple) -> DataFrame:
    """``id_col`` and the columns ``make`` gives for each text, ``none`` for a null one."""
    sets = df.sparkSession.sparkContext.broadcast(common_words(words))
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, chars = sets.value
        for b in batches:
            got = [none if x is None else make(x, common, chars) for x in b.column(1).to_pylist()]
            cols = [pa.array(c, k) for c, k in zip(zip(*got) if got else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, *names])

    return spread(rows, id_col).mapInArrow(run, f"{id_col} {kind}, {schema}")


def found_forms(df: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, form`` of the texts that are lists, tables or junk; of the statistics only those the decision asks for are made."""
    got = _each(df, words, id_col, text_col, lambda *a: (form_of(*a),), "form string", (None,))
    return got.where(F.col("form").isin("list", "table", "junk")).distinct()
