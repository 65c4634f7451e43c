import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import bpe
from tracewright.llm import mixing as M


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 2000):
        size, p = rng.integers(1, 3000, n).astype(float), rng.random(n)
        q = M.flight(p, size)
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3 and ((q > 0) & (q < 1)).sum() <= 2
        r = M.landing(q, size)
        assert set(r) <= {0.0, 1.0}
    equal = M.flight(np.full(9, 0.5), np.full(9, 7.0))
    assert ((equal > 0) & (equal < 1)).sum() <= 2


def test_inclusion_probabilities_are_kept():
    size = np.arange(1, 41, dtype=float) * 10
    hits = np.zeros(40)
    for k in range(600):
        order = np.random.default_rng(k).permutation(40)
        hits[order] += M.landing(M.flight(np.full(40, 0.3), size[order]), size[order])
    assert np.all(np.abs(hits / 600 - 0.3) < 0.12)


needs = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary file")


@needs
def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{rng.integers(1000)}" for _ in range(rng.integers(5, 200))), "big" if i % 10 else "small") for i in range(600)]
    rows += [(1000, rows[1][1], "small"), (1001, None, "big"), (1002, "", "big"), (1003, " \n", "big"), (1004, "x y", None), (1005, "x z", "other"), (None, "a b", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as p", "3 as cell")
    t = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), (None, 0.1, 1), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    for cell in (4096, 32):
        mix, plan = M.mixture(df, t, cell=cell)
        got = mix.collect()
        assert len({r.doc_id for r in got}) == len(got) and not {1000, 1001, 1002, 1003, 1004, 1005, None} & {r.doc_id for r in got}
        assert max(r.copies for r in got if r.source == "small") <= 3 and all(r.copies == 1 for r in got if r.source == "big")
        shares = {r.source: r for r in M.reached(mix, plan).collect()}
        assert abs(shares["big"].actual_share - 0.7) < 0.01 and abs(shares["small"].actual_share - 0.3) < 0.01
    assert M.mixture(df.limit(0), t)[0].count() == 0
    assert M.mixture(df.where(F.col("source") == "other"), t)[0].count() == 0
