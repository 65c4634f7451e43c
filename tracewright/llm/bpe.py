"""Problem 7: byte-level BPE as a lazily determinised transducer, and incremental UTF-8 decoding.

*Encoding.* The encoding of a byte string by ranked merges can be built from left to right: the last token of every
prefix is unique, and a token ``t`` may follow the last token ``s`` of the prefix before it exactly if merging
``bytes(s) + bytes(t)`` gives back ``[s, t]``. The transducer reads one byte at a time. Its state is the last token that
is settled and the bytes read since; a token is settled, and emitted, as soon as every start from which a longer token
may still grow has it in its chain, so the lookahead is bounded by the longest token. States and transitions are
determinised only when a text first reaches them and are kept in a bounded memory; when that is full it is emptied
and filled again, which changes the speed and never the result.

*Decoding.* :class:`Utf8Stream` takes bytes in pieces of any size and gives text as soon as a character is complete.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

#: Fixed value: the public pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64(token) rank`` of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class _State:
    __slots__ = ("pending", "token", "back", "live", "next", "flushed")

    def __init__(self, pending: bytes, token: dict, back: dict, live: tuple) -> None:
        self.pending, self.token, self.back, self.live = pending, token, back, live
        self.next: dict[int, tuple[tuple[int, ...], _State]] = {}
        self.flushed: tuple[int, ...] | None = None


class Transducer:
    """Encoder for one vocabulary. Not shared between threads."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000, max_words: int = 400_000) -> None:
        self.ranks = ranks
        self.spelling = {i: b for b, i in ranks.items()}
        self.max_states, self.max_words = max_states, max_words
        self._prefixes: set[bytes] = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        self._pair: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple[int, bytes], _State] = {}
        self._start = _State(b"", {0: -1}, {}, ((0, b""),))
        self._states[(-1, b"")] = self._start

    def _merge(self, word: bytes) -> list[int]:
        """Ranked merging as it is defined; only ever called on the bytes of two tokens."""
        parts = [bytes((b,)) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            both = parts[best] + parts[best + 1]
            if both not in self.ranks:
                break
            parts[best : best + 2] = [both]
        return [self.ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        key = (a, b)
        if (ok := self._pair.get(key)) is None:
            ok = self._merge((self.spelling[a] if a >= 0 else b"") + self.spelling[b]) == ([a, b] if a >= 0 else [b])
            if len(self._pair) > 2_000_000:
                self._pair.clear()
            self._pair[key] = ok
        return ok

    def _step(self, s: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        """The transition of a state by a byte: tokens settled, state reached."""
        n = len(s.pending) + 1
        pending = s.pending + bytes((byte,))
        grown = [(at, piece + pending[-1:]) for at, piece in s.live]
        live = [(at, piece) for at, piece in grown if piece in self._prefixes]
        token, back = dict(s.token), dict(s.back)
        for at, piece in live:  # the longest first
            t = self.ranks.get(piece)
            if t is not None and self._follows(token[at], t):
                token[n], back[n] = t, at
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        starts = [(at, piece) for at, piece in live if at in token] + [(n, b"")]
        common: set[int] | None = None
        for at, _ in starts:
            chain = {at}
            while at in back:
                at = back[at]
                chain.add(at)
            common = chain if common is None else common & chain
        cut = max(common)
        out = []
        at = cut
        while at in back:
            out.append(token[at])
            at = back[at]
        key = (token[cut], pending[cut:])
        to = self._states.get(key)
        if to is None:
            keep = {cut}
            for p in range(cut + 1, n + 1):  # the others can't be followed by anything any more
                if p in back and back[p] in keep:
                    keep.add(p)
            to = _State(
                pending[cut:],
                {p - cut: token[p] for p in keep},
                {p - cut: back[p] - cut for p in keep if p > cut},
                tuple((at - cut, piece) for at, piece in starts),
            )
            if len(self._states) > self.max_states:
                self._reset()
            self._states[key] = to
        got = (tuple(reversed(out)), to)
        s.next[byte] = got
        return got

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        s = self._start
        for byte in raw:
            got = s.next.get(byte) or self._step(s, byte)
            if got[0]:
                out += got[0]
            s = got[1]
        if s.flushed is None:
            at, rest = len(s.pending), []
            while at in s.back:
                rest.append(s.token[at])
                at = s.back[at]
            s.flushed = tuple(reversed(rest))
        out += s.flushed
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, special tokens not used."""
        words, out = self._words, []
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= 40:
                    if len(words) >= self.max_words:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids; bytes that aren't UTF-8 become U+FFFD."""
        stream = Utf8Stream()
        return "".join(stream.feed(self.spelling[i]) for i in ids) + stream.end()


class Utf8Stream:
    """Incremental UTF-8 decoding: a state machine over (bytes still missing, range of the next byte)."""

    def __init__(self) -> None:
        self._missing, self._low, self._high, self._value = 0, 0x80, 0xBF, 0

    def feed(self, piece: bytes) -> str:
        if not self._missing and piece.isascii():
            return piece.decode("ascii")
        out = []
        for b in piece:
            if self._missing:
                if self._low <= b <= self._high:
                    self._value = self._value << 6 | b & 0x3F
                    self._missing -= 1
                    self._low, self._high = 0x80, 0xBF
                    if not self._missing:
                        out.append(chr(self._value))
                    continue
                out.append("�")
                self._missing, self._low, self._high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self._missing, self._value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self._missing, self._value = 2, b & 0x0F
                self._low, self._high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self._missing, self._value = 3, b & 0x07
                self._low, self._high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        cut, self._missing = self._missing, 0
        return "�" if cut else ""


_made: dict[int, Transducer] = {}


def transducer(vocabulary) -> Transducer:
    """The worker's transducer for a broadcast vocabulary file; built once in a Python process."""
    raw = vocabulary.value
    key = hash(raw)
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(read_ranks(raw))
    return _made[key]


def share_vocabulary(df: DataFrame, path: str = DEFAULT_VOCABULARY):
    """Broadcast of a vocabulary file (its size is fixed: half a megabyte)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, ids``: token ids of every row's text, in a map-only stage.

    Null and empty texts have an empty list, blank ones the tokens of their white space. Rows come out as often as they
    come in, null ids included; other columns are left out, so clashing names don't matter. A text is encoded whole,
    whatever its length. An empty table gives an empty one.
    """
    vocabulary = share_vocabulary(df, path)
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            lists = [t.encode(x) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [id_col, "ids"])

    return spread(rows, id_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text_col``; null and empty texts have 0."""
    vocabulary = share_vocabulary(df, path)

    @F.pandas_udf("bigint")
    def size(texts):
        t = transducer(vocabulary)
        return texts.map(lambda x: len(t.encode(x)) if x else 0).astype("int64")

    return df.withColumn(out, size(F.col(text_col)))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, n_tokens, same``: whether decoding the ids of a text gives the text back (null counts as empty)."""
    vocabulary = share_vocabulary(df, path)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [t.encode(x) for x in texts]
            same = [t.decode(i) == x for i, x in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, lists), pa.int64()), pa.array(same)], [id_col, "n_tokens", "same"])

    return spread(rows, id_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, same boolean")
