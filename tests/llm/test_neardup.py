import itertools
import random

import numpy as np
import regex

from tracewright.llm import golay
from tracewright.llm import neardup as D


def test_golay_guarantee():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 20_000)
    ix, new = golay.indices(x)
    assert set(new.sum(1)) == {1, 6}
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(flips):
            y ^= 1 << ((np.arange(len(x)) * 7 + k * 5) % 23)
        iy, _ = golay.indices(y)
        assert (ix[:, :, None] == iy[:, None, :]).any((1, 2)).all()
    n = golay.nearest_index(x)
    assert (ix[:, 0] == n).all()


def brute(docs, least=70):
    sets = {}
    for i, t in docs:
        if t is None:
            continue
        w = regex.findall(r"[\p{L}\p{N}]+", "\n\n".join(x for x in t if x is not None).lower())
        if len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {tuple(sorted((a, b))) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(70, 400))]
        docs.append((f"a{i}", [" ".join(base)]))
        for j, rate in enumerate((0.0, 0.01, 0.04, 0.08, 0.12)):
            edited = [rnd.choice(vocab) if rnd.random() < rate else w for w in base]
            docs.append((f"a{i}-{j}", [" ".join(edited[:50]), None, " ".join(edited[50:]).upper()]))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id string, turns array<string>").selectExpr("*", "1 as id", "2 as cls", "3 as key")


def test_all_links(spark):
    docs = corpus() + [("s", ["too short"]), ("n", None), ("e", []), ("x", [None])]
    got = {tuple(r) for r in D.found_pairs(frame(spark, docs + docs[:9])).collect()}
    assert got == brute(docs)


def test_hot_keys_in_blocks(spark):
    docs = corpus(n=6)
    a = {tuple(r) for r in D.found_pairs(frame(spark, docs)).collect()}
    b = {tuple(r) for r in D.found_pairs(frame(spark, docs), block=2).collect()}
    assert a == b == brute(docs)


def test_large_class_is_a_star(spark):
    text = " ".join(f"t{i}" for i in range(90))
    docs = [(f"c{i}", [text]) for i in range(10)] + [("z", [text + " more"])]
    got = {tuple(r) for r in D.found_pairs(frame(spark, docs), expand=5).collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 10)} | {("c0", "z")}
    assert len(D.found_pairs(frame(spark, docs), expand=64).collect()) == 55


def test_empty(spark):
    assert D.found_pairs(frame(spark, corpus(n=1)).limit(0)).count() == 0
    assert D.found_pairs(frame(spark, [("a", ["x"])])).count() == 0


def test_long_text_whole(spark):
    t = " ".join(f"q{i}" for i in range(30_000))
    got = D.found_pairs(frame(spark, [("a", [t]), ("b", [t.replace("q29999", "changed")])])).collect()
    assert [tuple(r) for r in got] == [("a", "b")]


def test_rounds_lose_nothing(spark, monkeypatch):
    docs = corpus(n=8)
    monkeypatch.setattr(D, "_tables_a_round", lambda count: 13)
    monkeypatch.setattr(D, "_rounds_of_shingles", lambda *a: 3)
    assert {tuple(r) for r in D.found_pairs(frame(spark, docs)).collect()} == brute(docs)


def test_rounds_follow_the_classes():
    for n in (1_000_000, 10_000_000):
        assert D._tables_a_round(n) * 6 * n <= 36 * n
        # each set in ten pairs: what a round exchanges stays a fixed number of shingles a class
        assert 12 * 150 * n / D._rounds_of_shingles(n, 150 * n, n, 10 * n) <= 64 * n


def test_repeated_id_and_copies(spark):
    docs = corpus(n=3)
    copies = [(f"b{i}", t) for i, t in docs if t]
    assert {tuple(r) for r in D.found_pairs(frame(spark, docs + copies + docs)).collect()} == brute(docs + copies)


def test_disk_of_the_keys_is_bounded(spark, tmp_path):
    import threading
    import time
    from pathlib import Path

    import pandas as pd

    from tracewright.runtime import shared_folder

    n, sc = 30_000, spark.sparkContext
    folders = [shared_folder(spark).removeprefix("file:"), *map(str, (f.getPath() for f in sc._jsc.sc().env().blockManager().diskBlockManager().localDirs()))]

    def used():
        total = 0
        for p in (p for f in folders for p in Path(f).rglob("*")):
            try:
                total += p.stat().st_size
            except OSError:
                pass
        return total

    words = np.random.default_rng(5).integers(0, 50_000, (n, 75))
    words[1] = words[0]
    words[1, 74] = 50_001
    pd.DataFrame({"doc_id": [f"d{i}" for i in range(n)], "turns": [[" ".join(f"w{j}" for j in w)] for w in words]}).to_parquet(tmp_path / "t.parquet")
    low, most, over = [used()], [0], threading.Event()

    def watch():
        while not over.is_set():
            now = used()
            low[0] = min(low[0], now)  # files of earlier tests may go meanwhile
            most[0] = max(most[0], now - low[0])
            time.sleep(0.1)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = D.found_pairs(spark.read.parquet(str(tmp_path / "t.parquet"))).collect()
    finally:
        over.set()
        watcher.join()
    assert [tuple(r) for r in got] == [("d0", "d1")]
    # with the keys of all tables at once it took 242 MB
    assert most[0] < 130e6, most
