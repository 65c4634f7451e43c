import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import gallery as G
from tracewright.operators import openset as O
from tracewright.operators import resampling as M

DOC = "q int, author string, rank double, score double, is_out boolean, pool int, words int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for q in range(300):
        stranger = bool(rng.random() < 0.3)
        author = f"s{rng.integers(20)}" if stranger else f"a{rng.integers(30)}"
        out.append((q, author, None if stranger else float(rng.integers(1, 6)), float(np.round(rng.normal() + stranger, 1)), stranger, 10, int(rng.integers(1, 1500))))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def interp(points, grid):
    x, y = zip(*points)
    return np.interp(grid, x, y)


def brute(rows, level):
    if level == "author":
        people = {}
        for _, a, r, s, o, *_ in rows:
            p = people.setdefault(a, [o, -np.inf, -np.inf])
            p[1] = max(p[1], -s)
            p[2] = max(p[2], -s) if r is not None and r <= 1 else p[2]
        ev = [(p[1] if p[0] else p[2], p[0], not p[0] and np.isfinite(p[2])) for p in people.values()]
        n_out, n_in = sum(p[0] for p in people.values()), sum(not p[0] for p in people.values())
    else:
        ev = [(-s, o, not o and r <= 1) for _, _, r, s, o, *_ in rows]
        n_out, n_in = sum(o for _, o, _ in ev), sum(not o for _, o, _ in ev)
    pts = [(0.0, 0.0)]
    for c in sorted({c for c, *_ in ev if np.isfinite(c)}, reverse=True):
        pts.append((sum(o for x, o, _ in ev if x >= c) / n_out, sum(h for x, _, h in ev if x >= c) / n_in))
    return pts


@pytest.mark.parametrize("level", ["document", "author"])
def test_curves(docs, rows, level):
    got = {round(r.far, 2): r.rate for r in O.identification_curve(docs, level).collect()}
    grid = np.arange(101) / 100
    assert len(got) == 101 and np.allclose([got[round(g, 2)] for g in grid], interp(brute(rows, level), grid))


def test_budget(docs, rows):
    t = O.threshold_at_far(docs, 0.1).first()
    out = sorted(s for _, _, _, s, o, *_ in rows if o)
    assert sum(s <= t.threshold for s in out) <= int(0.1 * len(out)) and t.achieved == sum(s <= t.threshold for s in out) / len(out)
    above = min(s for _, _, _, s, *_ in rows if s > t.threshold)
    assert sum(s <= above for s in out) > int(0.1 * len(out))
    assert O.threshold_at_far(docs.where("is_out"), 0.0).first().threshold is None
    c = O.cmc_at_far(docs).orderBy("k").collect()
    hit = [x for x in rows if not x[4]]
    assert abs(c[0].accuracy - sum(x[3] <= t.threshold and x[2] <= 1 for x in hit) / len(hit)) < 1e-12 and [r.accuracy for r in c] == sorted(r.accuracy for r in c)
    a = O.cmc_at_far(docs, level="author").orderBy("k").collect()
    assert len(a) == 10 and a[-1].accuracy <= 1
    w = O.threshold_at_far(docs.withColumn("w", F.lit(1.0)), 0.1, "w").first()
    assert abs(w.threshold - t.threshold) < 1e-12


def test_bins_bands_and_labels(docs):
    assert [O.bin_label((1, 2, 3, 5, 33), i) for i in range(5)] == ["1", "2", "3-4", "5-32", "33+"]
    b = O.identification_by_words(docs, least_authors=1).collect()
    assert abs(sum(r.share for r in b) - 1) < 1e-12 and sum(r.n_units for r in b) == docs.where("not is_out").count()
    thin = O.identification_by_words(docs, level="author", least_authors=1000).collect()
    assert all(r.accuracy is None for r in thin)
    band = {r.far: r for r in O.identification_band(docs, M.poisson_weights(docs.select("author").distinct(), 30)).collect()}
    curve = {r.far: r.rate for r in O.identification_curve(docs).collect()}
    assert all(0 <= band[f].low <= band[f].high <= 1 for f in band) and sum(band[f].low <= curve[f] <= band[f].high for f in band) > 80


def test_reports_without_strangers_and_of_nothing(spark, docs):
    r = O.open_set_report(docs.where("not is_out")).first()
    assert r.auroc is None and r.dir_authors is None and r.top1 is not None
    assert O.identification_curve(docs.limit(0)).count() == 0 and O.author_table(docs.limit(0)).count() == 0
    q = O.quantiles(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v double"), "v").orderBy("v").collect()
    assert [x.quantile for x in q] == [None, 0.5, 0.5, 1.0]
    assert O.grid_of_ranks(5) == [1, 2, 3, 4, 5] and O.grid_of_ranks(1000)[-1] == 1000 and len(O.grid_of_ranks(100_000)) < 250


def test_background(spark):
    s = spark.createDataFrame([(1, "b", 2.0), (1, "x", 0.0), (1, "y", 1.0)], "q int, label string, score double")
    assert abs(O.background_evidence(s, "b").first().score - (2 - np.log(1 + np.e))) < 1e-12


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(2)
    truth = [(q, f"a{q % 25}" if q % 5 else f"z{q}") for q in range(120)]
    scores = [(q, f"a{j}", float(rng.normal() + 1.5 * (a == f"a{j}"))) for q, a in truth for j in range(25)]
    return G.placed_scores(spark.createDataFrame(scores, "q int, label string, score double"), spark.createDataFrame(truth, "q int, author string")).cache()


def test_sub_galleries(placed):
    v = G.sub_gallery(placed, 7)
    known = placed.where("own").select("q").distinct().count()
    assert v.where("genuine is not null").count() == known and v.agg(F.max("n_impostors")).first()[0] <= 7
    m = {r.n: r for r in G.measured(placed, (3, 10, 25)).collect()}
    assert m[3].top1 >= m[10].top1 >= m[25].top1 and all(r.dir <= r.top1 for r in m.values())


def test_tails(placed):
    fit = G.fit_tails(placed, 25).cache()
    now, later = G.hybrid_dir(fit, 0.0, -1e9).first(), G.hybrid_dir(fit, 500.0, -1e9).first()
    assert abs(now.top1 - G.measure(G.sub_gallery(placed, 25), 0.1).first().top1) < 1e-9 and later.top1 < now.top1
    t = G.expected_threshold(fit, 200.0, 0.1)
    out = fit.where("genuine is null").toPandas()
    miss = np.exp(200.0 * np.log1p(-np.minimum(1 - 1e-12, out.tail_fraction * np.exp(-np.maximum(t - out.u, 0) / out.scale))))
    assert abs(np.where(out.best >= t, 1.0, 1 - miss).mean() - 0.1) < 1e-3
    b = G.backtest(placed, 10, 25).first()
    assert abs(b.predicted_top1 - b.measured_top1) < 0.25
    table = G.scaling_table(placed, (5, 10, 25), (100,)).collect()
    assert [r.kind for r in table].count("modelled") == 1


def test_noise_and_bounds(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(2000)], "doc int, vec array<double>")
    n = G.noisy(v, 0.5, 1).toPandas()
    x = np.stack(n["vec"].to_numpy()) - np.array([1.0, 0, 0])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 0.5) < 0.02
    m = spark.createDataFrame([(1, "a", [1.0, 1.5], [0.3]), (1, "b", [2.0, 2.0], [0.0])], "q int, label string, margins array<double>, rhos array<double>")
    single = M.link_bound(m.select("q", F.get("margins", F.lit(0)).alias("margin")), 1.0).first().bound
    joint = M.joint_bounds(m, 1.0).first().bound
    assert single <= joint <= 1
    a = M.author_bound(spark.createDataFrame([(1, 0.5), (2, 0.5)], "q int, bound double"), spark.createDataFrame([(1, "x"), (2, "x")], "q int, author string")).first()
    assert a.mean_bound == 0.5 and abs(a.author_bound - 0.75) < 1e-9
