import numpy as np
import pytest

from tracewright.llm import neighbours as N


def frame(spark, x, extra=()):
    rows = [(f"d{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "doc_id string, features array<float>").selectExpr("*", "'a' as id", "1 as vec", "2 as cls")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(60, 96))
    return np.concatenate([c[rng.integers(0, 60, 600)] + rng.normal(size=(600, 96)) * 0.35, rng.normal(size=(200, 96))]).astype(np.float32)


def test_recall(spark, clustered):
    df = frame(spark, clustered)
    got = {tuple(r) for r in N.found_pairs(df, bucket=8).collect()}
    want = N.brute_force(N.usable(df, "doc_id", "features", 96).toPandas())
    assert len(got & want) >= 0.9 * len(want)


def test_blocks_lose_nothing(spark, clustered):
    df = frame(spark, clustered[:300])
    a = {tuple(r) for r in N.nearest(df, bucket=1000).collect()}
    b = {tuple(r) for r in N.nearest(df, bucket=1000, block=16).collect()}
    assert a == b


def test_dirty_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 96)).astype(np.float32)
    bad = [("n1", None), ("n2", [1.0] * 95), ("n3", [0.0] * 96), ("n4", [float("nan")] + [1.0] * 95), ("n5", [float("inf")] + [1.0] * 95), (None, [1.0] * 96), ("d0003", [float(a) for a in x[3]])]
    got = N.nearest(frame(spark, x, bad), bucket=1000).collect()
    assert {r.id for r in got} == {f"d{i:04d}" for i in range(12)}
    assert len(got) == 12 * 5 and all(r.id != r.other for r in got)


def test_equal_vectors_go_by_id(spark):
    x = np.ones((9, 96), np.float32)
    x[8, 0] = 5
    got: dict = {}
    for r in N.nearest(frame(spark, x), bucket=1000).orderBy("id", "other").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["d0000"] == ["d0001", "d0002", "d0003", "d0004", "d0005"]
    assert got["d0007"] == ["d0000", "d0001", "d0002", "d0003", "d0004"]
    assert got["d0008"] == ["d0000", "d0001", "d0002", "d0003", "d0004"]
    want = N.brute_force(N.usable(frame(spark, x), "doc_id", "features", 96).toPandas())
    assert {tuple(r) for r in N.found_pairs(frame(spark, x), bucket=1000).collect()} == want


def test_ties_of_a_direction_with_many_norms_go_by_id(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=96).astype(np.float32)
    x = np.concatenate([np.stack([v * np.float32(2.0**j) for j in rng.permutation(12) - 6]), rng.normal(size=(5, 96)).astype(np.float32)])
    df = frame(spark, x)
    want = N.brute_force(N.usable(df, "doc_id", "features", 96).toPandas())
    assert {tuple(r) for r in N.found_pairs(df, bucket=1000).collect()} == want
    assert {tuple(r) for r in N.found_pairs(df, bucket=1000, block=4).collect()} == want


def test_small_tables(spark):
    one = np.ones((1, 96), np.float32)
    assert N.nearest(frame(spark, one)).count() == 0
    assert N.nearest(frame(spark, one).limit(0)).count() == 0


def test_probe_order_is_by_score():
    sets = N.probe_order(6, 20)
    assert sets[0] == (0,) and len(set(sets)) == 20 and all(2 * 6 - 1 - a not in s for s in sets for a in s)


def test_each_meeting_in_a_bucket_is_sent_once_in_rounds_of_bounded_size(clustered):
    x = N._unit(clustered.ravel(), 96).astype(np.float32)
    tab = N.Tables(96, 6, 2.5, 1, 9, 7)
    ids = np.arange(len(x)) * 8_589_934_592 + 5
    for cap in (40, 150, 4000):
        region = N.Regions(tab, 0, x, 1.0, cap, 500)
        assert region.rounds > 1 and (cap == 4000 or region.blocks or len(region.split) > 1)
        met, stored_at = set(), {}
        for turn in range(region.rounds):
            row, cell, store, size, bucket = region.sent(x, ids, turn)
            assert len(row) <= 500 + 4 * cap or cap == 4000
            ends = np.append(0, np.cumsum(size))
            by: dict = {}
            for r, c, s, i, j in zip(row, cell, store, ends[:-1], ends[1:]):
                for q, b in enumerate(bucket[i:j]):
                    by.setdefault((c, b), ([], []))[0 if s and not q else 1].append(r)
            for (_, b), (s, v) in by.items():
                met |= {(p, q, b) for p in s for q in [*v, *s] if p != q}
        own = tab.buckets(0, *tab.cells(x, 0))
        for i in range(len(x)):
            stored_at.setdefault(own[i, 0], []).append(i)
        assert met == {(p, i, b) for i in range(len(x)) for b in own[i].tolist() for p in stored_at.get(b, []) if p != i}


def test_hot_region_in_blocks(spark, clustered):
    df = frame(spark, clustered[:300])
    a = {tuple(r) for r in N.nearest(df, bucket=1000).collect()}
    assert a == {tuple(r) for r in N.nearest(df, bucket=1000, block=1).collect()}


def test_disk_does_not_follow_the_probes(spark, tmp_path):
    import threading
    import time
    from pathlib import Path

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

    x = np.random.default_rng(5).normal(size=(n, 96)).astype(np.float32)
    import pandas as pd

    pd.DataFrame({"doc_id": [f"d{i}" for i in range(n)], "features": list(x)}).to_parquet(tmp_path / "v.parquet")
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
        assert N.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), probes=20).count() > 4 * n
    finally:
        over.set()
        watcher.join()
    # one exchange with 63 buckets a vector took 306 MB
    assert most[0] < 250e6
