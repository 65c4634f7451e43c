import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe

PATH = bpe.DEFAULT_VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pair():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return bpe.Transducer(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(pair):
    ours, ref = pair
    rnd = random.Random(1)
    parts = ["a", "b", "ab", "the", "ing", " ", "\n", "0", "é", "я", "中", "😀", "<|endoftext|>", "==", "  ", "\t", "'s", "Z", "tion", "‍", "\x00"]
    texts = ["", " ", "\n\n", "x" * 5000, "ab" * 3000, "日本語" * 500] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert ours.encode(t) == ref.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_of_any_text(pair, text):
    ours, ref = pair
    text = text.encode("utf-8", "replace").decode()
    assert ours.decode(ours.encode(text)) == text and ours.encode(text) == ref.encode_ordinary(text)


def test_small_memory_changes_nothing(pair):
    ours, ref = pair
    small = bpe.Transducer(ours.ranks, max_states=50, max_words=5)
    rnd = random.Random(2)
    for _ in range(200):
        t = "".join(rnd.choice("abcdefgh ABC0123+/=") for _ in range(80))
        assert small.encode(t) == ref.encode_ordinary(t)


@given(st.binary(max_size=12))
def test_utf8_stream(raw):
    s = bpe.Utf8Stream()
    assert "".join(s.feed(raw[i : i + 1]) for i in range(len(raw))) + s.end() == raw.decode("utf-8", "replace")


def test_frame(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (3, None), (None, "x"), (4, " "), (5, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _text")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == 7 and [r.ids for r in got if r.doc_id in (2, 3)] == [[], [], []]
    assert len(next(r.ids for r in got if r.doc_id == 5)) > 50_000
    assert all(r.same for r in bpe.round_trip(df).collect())
    assert bpe.encode_corpus(df.limit(0)).count() == 0
