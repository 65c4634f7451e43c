import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import attacks as A
from tracewright.operators import blocks, build, defenses, detection, features, graph, partitions, ranking, resampling, timeline


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 8)) * 2
    rows = [(a * 5 + i, a, (centre[a] + rng.normal(size=8) * 0.9).tolist()) for a in range(12) for i in range(5)]
    unk = [(1000 + i, i % 12, (centre[i % 12] + rng.normal(size=8) * 0.9).tolist()) for i in range(20)]
    schema = "doc long, author int, vec array<double>"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(unk, schema), pd.DataFrame(rows, columns=["doc", "author", "vec"]), pd.DataFrame(unk, columns=["doc", "author", "vec"])


def accuracy(scores, unknown):
    r = ranking.true_ranks(scores, unknown.select(F.col("doc").alias("q"), "author"))
    return r.select(F.avg((F.col("rank") <= 1).cast("double"))).first()[0]


def test_block_scores_equal_plain_scores(clusters):
    k, u, kp, up = clusters
    x, y = np.stack(up.vec), np.stack(kp.vec)
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    s = pd.DataFrame(x @ y.T, index=up.doc, columns=kp.author)
    for linkage, want in (("max", s.T.groupby(level=0).max().T), ("mean", s.T.groupby(level=0).mean().T)):
        got = blocks.author_scores(u.select(F.col("doc").alias("q"), "vec"), k.select(F.col("doc").alias("g"), F.col("author").alias("label"), "vec"), linkage, block=7).toPandas()
        for r in got.itertuples():
            assert abs(r.score - want.loc[r.q, r.label]) < 1e-9
        assert len(got) == want.size


@pytest.mark.parametrize("name", ["nearest_neighbor", "nearest_mean", "centroid", "wccn", "lda", "lda_wccn", "plda", "rlsc", "logistic", "cross_encoder", "euclidean"])
def test_attacks_beat_chance(clusters, name):
    k, u, *_ = clusters
    assert accuracy(A.attack(name)(k, u.select("doc", "vec")), u) > 0.5


def test_unknown_attack():
    with pytest.raises(KeyError):
        A.attack("no such")


def test_plda_is_the_likelihood_ratio(clusters):
    k, u, kp, up = clusters
    c = A.within_covariance(k, 0.1)
    m = A._inverse_root(c)
    b = A.between_covariance(k)
    mu = np.stack(kp.vec).mean(0)
    got = {(r.q, r.label): r.score for r in A.plda(k, u.select("doc", "vec"), 0.1).collect()}
    w, v = np.linalg.eigh(m @ b @ m)
    psi, t = np.maximum(w, 0), m @ v
    for doc, vec in list(zip(up.doc, up.vec))[:3]:
        x = (np.array(vec) - mu) @ t
        for a in range(3):
            mean = ((np.stack(kp[kp.author == a].vec) - mu) @ t).mean(0)
            post, var = 5 * psi / (5 * psi + 1) * mean, psi / (5 * psi + 1) + 1
            one = -0.5 * (np.log(var) + (x - post) ** 2 / var).sum()
            two = -0.5 * (np.log(psi + 1) + x * x / (psi + 1)).sum()
            assert abs(got[doc, a] - (one - two)) < 1e-6


def test_within_covariance(clusters):
    k, _, kp, _ = clusters
    x = np.stack(kp.vec)
    centred = x - np.stack(kp.groupby("author").vec.transform(lambda v: [np.stack(v).mean(0)] * len(v)))
    c = centred.T @ centred / len(x)
    assert np.allclose(A.within_covariance(k, 0.0), c)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = blocks.neighbours(df, 3, "id", "vec", block=11).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(50) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {(int(r.src), int(r.dst), int(r.rank)) for r in got.itertuples()} == want


def test_ranks_average_ties(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 0.0), (2, "a", 0.5), (2, "b", None)], "q long, label string, score double")
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "q long, author string")
    got = {r.q: (r.rank, r.pool) for r in ranking.true_ranks(s, t).collect()}
    assert got == {1: (1.5, 3), 2: (1.0, 1)}


def test_fold_keeps_the_shortlist(spark):
    s = spark.createDataFrame([(1, c, 1.0 - i / 10) for i, c in enumerate("abcdef")], "q long, label string, score double")
    short = ranking.shortlist(s, 3)
    orders = spark.createDataFrame([(1, [2, 7, 2])], "q long, ranking array<int>")
    got = ranking.fold(s, short, orders)
    assert [r.label for r in got.orderBy(F.desc("score")).collect()] == list("cabdef")


def test_detection(spark):
    rows = [(float(i), i >= 6, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "score double, is_out boolean, correct boolean")
    assert detection.auroc(df).first().auroc == 1.0
    neg = df.withColumn("score", -F.col("score"))
    assert detection.auroc(neg).first().auroc == 0.0
    assert detection.auroc(df.where("is_out")).first().auroc is None
    assert detection.auroc(df.withColumn("score", F.lit(1.0))).first().auroc == 0.5
    assert detection.equal_error_rate(df).first().eer == 0.0
    assert detection.c_at_1(df.withColumn("answered", F.lit(True))).first().c_at_1 == 0.5


def test_partition_properties(spark):
    truth = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, author int")
    alone = truth.select("id", F.col("id").alias("cluster"))
    one = truth.select("id", F.lit(1).alias("cluster"))
    assert partitions.bcubed(partitions.contingency(alone, truth)).first().precision == 1.0
    assert partitions.bcubed(partitions.contingency(one, truth)).first().recall == 1.0
    assert abs(partitions.singleton_baseline(truth).first().recall - 1 / 3) < 1e-12
    assert abs(partitions.single_cluster_baseline(truth).first().precision - 1 / 3) < 1e-12
    noise = partitions.expand_noise(truth.select("id", F.lit(-1).alias("cluster")))
    assert noise.select("cluster").distinct().count() == 9


def test_components(spark):
    n = 200
    nodes = spark.range(n + 3).select("id")
    chain = [(i, i + 1) for i in range(0, 99)] + [(i, i + 1) for i in range(100, n - 1)] + [(5, 3), (7, 7)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in chain], "src long, dst long, distance double")
    got = {r.id: r.component for r in graph.components(nodes, e).collect()}
    assert all(got[i] == 0 for i in range(100)) and all(got[i] == 100 for i in range(100, n)) and got[n + 1] == n + 1
    none = graph.components(nodes, e.limit(0))
    assert none.where("id = component").count() == n + 3


def test_clusterings(spark):
    e = [(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.15), (3, 4, 0.1), (4, 5, 0.1), (3, 5, 0.12), (2, 3, 0.6)]
    nodes, edges = spark.range(7).select("id"), spark.createDataFrame(e, "src long, dst long, distance double")
    for f in (lambda: graph.agglomerative(nodes, edges, 0.5), lambda: graph.communities(nodes, edges, 0.5), lambda: graph.capped_linkage(nodes, edges, 0.7, 4), lambda: graph.density_clusters(nodes, edges)):
        got = {r.id: r.cluster for r in f().collect()}
        assert set(got) == set(range(7)) and got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] and got[6] == 6


def test_positions(spark):
    df = spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "x long")
    got = {r.x: r.pos for r in timeline.positions(df, "x").collect()}
    assert all(got[i] == i for i in range(100))
    sides = timeline.split_known(df, "x").groupBy("side").count().collect()
    assert {r.side: r["count"] for r in sides} == {"known": 75, "unknown": 25}


def test_dedup_fixture(spark):
    p, s = "p" * 100, "s" * 100
    rows = [("a", 1, p + "1" * 5), ("a", 2, p + "1" * 5), ("b", 3, p + "2"), ("a", 4, "x1" + s), ("b", 5, "x2" + s), ("c", 6, "q" * 100 + "1"), ("c", 7, "q" * 100 + "2"), ("c", 8, "q" * 100 + "3"), ("d", 9, "k" * 99), ("e", 10, "k" * 99), (None, 11, "z" * 120)]
    df = spark.createDataFrame(rows, "author string, doc long, text string")
    assert sorted(r.doc for r in build.deduplicate(df, "author", "text", "doc").collect()) == [6, 7, 9, 10, 11]


def test_sessions_fixture(spark):
    schema = "session_id string, turn_number int, turn_type string, content string, turn_id long, turn_timestamp timestamp, turn_language string, model string, agent string, user_id string, repo_id string, loaded_at timestamp"
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        ("s1", 0, "user_prompt", "hello", 1, t(0), "ENGLISH", None, "x", "u1", "r1", t(0)), ("s1", 0, "user_prompt", "hello", 1, t(0), "ENGLISH", None, "x", "u1", "r1", t(9)),
        ("s1", 1, "agent_message", "hi", 2, t(1), None, "gpt-4", "x", "u1", "r1", t(1)), ("s1", 2, "user_prompt", "[Image: x]", 3, t(2), None, None, "x", "u1", "r1", t(2)),
        ("s1", 3, "user_prompt", "bye", 4, t(3), "english", None, "x", "u1", "r1", t(3)), ("s2", 0, "user_prompt", "a", 5, t(0), None, None, None, None, "r1", t(0)),
        ("s3", 0, "user_prompt", "a", 6, t(0), None, None, None, None, "r9", t(0)), ("s4", 0, "user_prompt", None, 7, t(0), None, None, None, "u2", None, t(0)),
    ]
    got = {r.doc_id: r for r in build.session_documents(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"sc-s1", "sc-s2", "sc-s3"}
    assert got["sc-s1"].turns == ["hello", "bye"] and got["sc-s1"].model_owner == "OpenAI" and got["sc-s1"].language_primary == "English"
    assert got["sc-s2"].identity == "u1" and got["sc-s3"].identity == "r9" and got["sc-s2"].model == "<no_model>"


def test_markdown_runs(spark):
    rows = [("s", 0, "# a", 0), ("s", 1, "# b", 0), ("s", 3, "# c", 1), ("s", 4, "x", 1)]
    got = build.markdown_runs(spark.createDataFrame(rows, "session_id string, turn_number int, content string, cum_agent long")).orderBy("turn_number").collect()
    assert [(r.content, r.n_merged) for r in got] == [("# a\n\n# b", 2), ("# c", 1), ("x", 1)]


def test_relays(spark):
    rows = [("a", ["x\nAssistant:"], 1), ("a", ["System: y"], 1), ("b", ["System: y"], 1), ("b", ["System: y"], 2), ("c", ["x"], 1), (None, ["System: y"], 1)]
    df = spark.createDataFrame(rows, "author_id string, turns array<string>, num_turns int")
    assert [r.author_id for r in build.relay_authors(df).collect()] == ["a"]
    assert build.drop_relays(df).count() == 4


def test_defenses(spark):
    docs = spark.createDataFrame([("d1", "a", ["definitely `definitely` more", "ok"]), ("d2", None, []), ("d3", "b", None)], "doc_id string, author_id string, turns array<string>")
    for name in defenses.REGISTRY:
        got = {r.doc_id: r.turns for r in defenses.apply(name, docs).collect()}
        assert set(got) == {"d1", "d2", "d3"}
        if name.startswith("frame_pad"):
            assert got["d1"][:2] == ["definitely `definitely` more", "ok"] and len(got["d1"]) == 3
        elif name != "truncate":
            assert len(got["d1"]) == 2
    again = [defenses.apply("collisions", docs).orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1] and "`definitely`" in again[0][0].turns[0]
    with pytest.raises(KeyError):
        defenses.apply("no such", docs)
    defenses.model_defense("shout", lambda s: s.str.upper(), least=3)
    assert {r.doc_id: r.turns for r in defenses.apply("shout", docs).collect()}["d1"] == ["DEFINITELY `DEFINITELY` MORE", "ok"]
    del defenses.REGISTRY["shout"]


def test_gaussian_bound(spark):
    eps = resampling.eps_exact(pd.Series([0.5, 2.0]))
    closed = [2 / s**2 + 2 / s * (2 * np.log(1e5)) ** 0.5 for s in (0.5, 2.0)]
    assert all(0 < e <= c for e, c in zip(eps, closed))


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(400)], "author long, num double, den double")
    r = resampling.ratio_interval(df, 100).first()
    assert r.estimate == 0.5 and 0.4 < r.low < 0.5 < r.high < 0.6


def test_ngrams(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, "ab"), (3, None), (4, "x" * 3000)], "id long, text string")
    got = {(r.id, r.gram): r.tf for r in features.char_ngrams(df, "id", "text", 3).collect()}
    assert got == {(1, "abc"): 2, (1, "bca"): 1, (1, "cab"): 1, (4, "xxx"): 2998}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, source string, author_id string, turns array<string>, num_turns int, language_primary string, started_at string, ended_at string")
    assert build.drop_relays(docs).count() == 0 and build.violations(docs).agg(F.sum("n")).first()[0] == 0
    s = spark.createDataFrame([], "q long, label string, score double")
    assert ranking.true_ranks(s, s.select("q", F.col("label").alias("author"))).count() == 0
    assert graph.components(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, distance double")).count() == 0
