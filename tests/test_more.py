import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import edges as X
from tracewright.operators import ranking as K
from tracewright.operators import unlink as N
from tracewright.operators import utility as U
from tracewright.sources import images as I


def test_alignment(spark):
    a = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "b"]), ("z", ["q"])], "doc_id string, turns array<string>")
    b = spark.createDataFrame([("x", ["A", "B"]), ("y", ["AB"])], "doc_id string, turns array<string>")
    got = {(r.doc_id, r.part): (r.original, r.defended) for r in U.aligned_pairs(a, b).collect()}
    assert got == {("x", 0): ("a", "A"), ("x", 1): ("b", "B"), ("y", 0): ("a\n\nb", "AB")}
    assert {r.status: r.n for r in U.key_alignment(a, b).collect()} == {"both": 2, "missing": 1}


def test_text_helpers(spark):
    df = spark.createDataFrame([("ab" * 9 + "tail", "the cat sat", "the dog sat"), (None, "", "")], "t string, a string, b string")
    got = df.select(U.cut_repetition("t").alias("c"), U.word_edit_distance("a", "b").alias("d"), U.render_template("Hi {{X}}!", X=F.col("a")).alias("r"), U.tagged(F.lit("x <out> y </out> z"), "out").alias("g"), U.tagged(F.lit(" w "), "out").alias("h")).collect()
    assert (got[0].c, got[1].c) == ("ab", None) and abs(got[0].d - 1 / 3) < 1e-12 and got[1].d == 0.0
    assert got[0].r == "Hi the cat sat!" and got[0].g == "y" and got[0].h == "w"
    conv = spark.createDataFrame([(["a" * 30, "", "b" * 30, "c" * 30],)], "turns array<string>").select(U.render_conversation("turns", 10, 60).alias("x")).first().x
    assert conv == "<turn_1>aaaaaaaaaa</turn_1>\n<turn_2>bbbbbbbbbb</turn_2>\n[1 turns omitted]"


def test_weighted_scores(spark):
    p = spark.createDataFrame([("d", "aa", 1.0, 0.5), ("d", "bbbbbb", 0.0, 0.5), ("e", "x", None, 0.1)], "doc_id string, original string, s double, base double")
    assert [(r.doc_id, r.score) for r in U.length_weighted(p, "s").collect()] == [("d", 0.25)]
    assert U.length_weighted(p, "s", "base").first().score == pytest.approx(-0.5)
    j = U.judged(spark.createDataFrame([('{"score": 5}',), ("score: 2",), ("?",)], "reply string")).first()
    assert (j.mean, j.usable, j.n) == (3.5, 0.5, 3)


def test_within_and_between(spark):
    rng = np.random.default_rng(0)
    x, a = rng.normal(size=(30, 5)), np.arange(30) % 4
    df = spark.createDataFrame([(i, int(a[i]), x[i].tolist()) for i in range(30)], "id long, author int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, same = 1 - u @ u.T, a[:, None] == a[None, :]
    off = ~np.eye(30, dtype=bool)
    r = X.within_and_between(df, "id", "author", "v").first()
    assert abs(r.within - d[same & off].mean()) < 1e-9 and abs(r.between - d[~same].mean()) < 1e-9


def test_interpolation(spark):
    grid = spark.createDataFrame([(1, 0.0), (100, 1.0)], "k int, value double")
    at = spark.createDataFrame([(1,), (10,), (100,), (1000,)], "k int")
    got = {r.k: r.value for r in K.interpolate(grid, at).collect()}
    assert got[1] == 0.0 and abs(got[10] - 0.5) < 1e-12 and got[100] == 1.0 and got[1000] == 1.0


def test_elo_keeps_the_sum(spark):
    r = spark.createDataFrame([(q, c, 1500.0 + i) for q in (1, 2) for i, c in enumerate("abcde")], "q int, label string, rating double")
    got = K.elo_round(r, lambda a, b: a < b)
    assert abs(got.agg(F.sum("rating")).first()[0] - r.agg(F.sum("rating")).first()[0]) < 1e-9 and got.count() == 10


def test_unlink(spark):
    same = ["I always say howdy partner to everyone I meet. ", "The report is due on Monday morning. ", "My cat prefers the blue sofa near the window. "]
    docs = [(f"d{i}", "a", [same[0] + f"Today number {i} was strange and rather long."]) for i in range(5)] + [("e", "b", ["Only one."]), ("f", None, ["x y z"]), ("g", "a", []), ("h", "a", None)]
    df = spark.createDataFrame(docs, "doc_id string, author_id string, turns array<string>")
    got = {r.doc_id: r for r in N.unlink(df, budget=0.5).collect()}
    assert set(got) == {"d0", "d1", "d2", "d3", "d4", "e", "f", "g"} and got["e"].turns == ["Only one."] and got["e"].dropped == 0
    done = [r for r in got.values() if r.dropped]
    assert done and all(r.after < r.before and len(r.turns) == 1 for r in done)
    assert N.target(0.8, 0.5, 0.5) == 0.65 and N.target(0.4, 0.5, 0.5) == 0.5
    v = N.hashed_ngrams(["hello there", "hello there", "", "quite another thing"])
    assert v[0] @ v[1] == pytest.approx(1.0) and not v[2].any() and N.objective(v[0], v[1:2], v[3:])[0] == pytest.approx(1.0)


def png(w: int, h: int, icc: bytes | None = None) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    extra = chunk(b"iCCP", b"name\0\0" + zlib.compress(icc)) if icc else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rows = [("a", bytearray(png(3, 4))), ("b", bytearray(png(5, 6, b"profile"))), ("c", bytearray(b"no image")), ("d", None)]
    df = spark.createDataFrame(rows, "name string, image binary").coalesce(1)
    df.write.parquet(str(tmp_path / "shards"))
    path = str(tmp_path / "shards")
    idx = {r.name: r for r in I.index(spark, path, "name").collect()}
    assert [idx[c].image_row for c in "abcd"] == [0, 1, 2, 3]
    got = {r.name: (r.width, r.height, r.icc) for r in I.headers(spark.read.parquet(path), "name", "image").collect()}
    assert got["a"] == (3, 4, None) and got["b"][:2] == (5, 6) and bytes(got["b"][2]) == b"profile" and got["c"] == got["d"] == (None, None, None)
    assert [bytes(r.image) for r in I.pick(spark, path, idx["a"].image_shard, [1]).collect()] == [png(5, 6, b"profile")]


def test_search_defenses(spark):
    from tracewright.operators import search as S

    docs = [(f"d{i}", "a", i, [f"Howdy partner, this is my report number {i}. It says: all is WELL, as always!"]) for i in range(4)] + [("e", None, 9, ["quite another text about the sea"]), ("f", "a", 10, None)]
    df = spark.createDataFrame(docs, "doc_id string, author_id string, n int, turns array<string>")
    got = {r.doc_id: r for r in S.footprint_loop(df, "n").collect()}
    assert set(got) == {"d0", "d1", "d2", "d3", "e"} and got["d0"].outcome == got["e"].outcome == "no_priors"
    assert all(got[k].probes >= 1 and len(got[k].turns) == 1 and got[k].linkage < 1 for k in ("d1", "d2", "d3"))
    best = S.evolve_turn(df, ["the sea is calm", "numbers 12 34 56 78"], generations=2, children=4)
    assert best and best[0][1] == max(s for _, s in best) > 0
    assert S.fitness(df.limit(0), ["x"]) in ({}, {"x": 0.0})


def test_full_texts_and_labels(spark, data, tmp_path):
    import re
    import string

    from tracewright.plans import catalogue

    def plain(t):
        kept = "".join(c for c in (t or "").lower() if c not in set(string.punctuation))
        return re.sub(r"\s+", " ", kept).strip()

    docs = [
        ("a", "x", ["Привет,  МИР!", None], "Mandarin Chinese"), ("b", "x", ["Straße – ÜBER «ALLES»? 你好，世界。"], None), ("c", None, ["Plain ASCII, only."], "ENGLISH"),
        ("d", "y", [], " nan "), ("e", "y", None, "français"), ("f", "y", ["ΌΔΟΣ\u00a0\u2003и...\n\tÉCOLE"], "brazilian portuguese"), ("a", "x", ["Привет,  МИР!", None], "Mandarin Chinese"),
    ]
    spark.createDataFrame(docs, "doc_id string, author_id string, turns array<string>, language_primary string").write.parquet(str(tmp_path / "chat_docs.parquet"))
    got = catalogue.QUERIES["language_title_full"](spark, str(tmp_path)).collect()
    titles = {"a": "Mandarin Chinese", "b": None, "c": "English", "d": None, "e": "Français", "f": "Brazilian Portuguese"}
    assert len(got) == len(titles) and {r.doc_id: r.lang for r in got} == titles
    for d in (str(tmp_path), data):
        source = spark.read.parquet(f"{d}/chat_docs.parquet").where("doc_id is not null and turns is not null").select("doc_id", "author_id", "turns").distinct().collect()
        got = catalogue.QUERIES["normalise_defense_full"](spark, d).collect()
        assert sorted((r.doc_id, r.turns) for r in got) == sorted((r.doc_id, [plain(t) for t in r.turns]) for r in source)


def test_unlink_compares_all_documents_of_an_author(spark):
    texts = {f"d{i:03}": f"Note {i * 7919} on {chr(97 + i % 26) * 3}{i} things. Number {i} is quite another matter, {chr(97 + i // 4)}{i * i}. It ends." for i in range(90)}
    texts |= {f"p{i}": f"Pair {i} of one author says howdy partner. It is a rare and odd line {i}. It ends here." for i in range(2)}
    df = spark.createDataFrame([(k, "b" if k[0] == "p" else "a", [t]) for k, t in texts.items()], "doc_id string, author_id string, turns array<string>")
    for block in (16, 512):
        got = {r.doc_id: r for r in N.unlink(df, block=block).collect()}
        assert set(got) == set(texts)
        for name, r in got.items():
            other = N.hashed_ngrams([t for k, t in texts.items() if k != name and k[0] == name[0]])
            old, new = N.hashed_ngrams([texts[name], r.turns[0]])
            assert r.before == pytest.approx(N.top_similarity(old, other)) and r.after == pytest.approx(N.top_similarity(new, other))
    v = np.random.default_rng(1).random((500, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tries = v[:40] + 0.02
    tries /= np.linalg.norm(tries, axis=1, keepdims=True)
    want = [N.top_similarity(x, np.delete(v, 7, 0)) for x in tries]
    assert N.Siblings(v, 7, v[7], first=8).top(tries) == pytest.approx(np.array(want))


def test_large_clusters_keep_their_own_labels(spark):
    scores = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 2.0), *[(f"c{i}", f"l{k}", float(k == i)) for i in range(3) for k in range(3)], ("c3", "l1", 5.0), ("c3", "l0", 5.0)], "q string, label string, score double")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), *[(f"c{i}", 2) for i in range(4)]], "q string, cluster int")
    got = {r.q: r.label for r in K.pooled_argmax(scores, clusters, most=2).collect()}
    assert got == {"a": "x", "b": "x", "c0": "l0", "c1": "l1", "c2": "l2", "c3": "l0"}


def test_rendered_conversations_are_whole(spark, tmp_path):
    from tracewright.plans import catalogue

    turns = [chr(97 + i) * 4000 for i in range(4)]
    spark.createDataFrame([("a", "x", turns)], "doc_id string, author_id string, turns array<string>").write.parquet(str(tmp_path / "chat_docs.parquet"))
    text = catalogue.QUERIES["rendered_conversations"](spark, str(tmp_path)).first().text
    assert all(t in text for t in turns) and "omitted" not in text


def test_unlink_by_counts_is_unlink_by_vectors(spark):
    rng = np.random.default_rng(3)
    words = ["grüße", "日本", "report", "sofa", "howdy", "partner", "monday", "x", "strange", "window", "things", "it's", "quite"]
    say = lambda n: " ".join(rng.choice(words, n)) + ". "
    rows = [(f"d{i}", "a", ["".join(say(int(rng.integers(1, 9))) for _ in range(int(rng.integers(1, 6)))), None if i % 7 else "", say(2)]) for i in range(330)]
    rows += [("e", "b", ["", None]), ("f", "b", []), ("g", "b", ["a b"]), ("h", "b", ["Same text here, same text. Same text here, same text. Same text here, same text."]), ("i", None, ["z"])]
    df = spark.createDataFrame(rows, "doc_id string, author_id string, turns array<string>")
    old = {r.doc_id: r for r in N.unlink(df, block=200, embed=lambda t: N.hashed_ngrams(t)).collect()}
    new = {r.doc_id: r for r in N.unlink(df, block=200).collect()}
    assert set(new) == set(old) == {r[0] for r in rows} and sum(r.dropped for r in new.values()) > 300
    assert all(new[k].turns == old[k].turns and new[k].before == pytest.approx(old[k].before) and new[k].after == pytest.approx(old[k].after) for k in old if k != "i")
    texts = ["".join(say(12) for _ in range(8)) for _ in range(2000)]
    docs = [([t], [{"turn_no": 0, "span_no": i, "text": p + ". ", "editable": True} for i, p in enumerate(t.split(". ")[:-1])]) for t in texts[:25]]
    took, got = [], []
    for how in (N._by_counts, lambda *a: N._by_vectors(*a, N.hashed_ngrams)):
        list(how(texts, [0], docs[:1], 0.2, 1))
        at = time.process_time()
        got.append(list(how(texts, list(range(25)), docs, 0.2, 10)))
        took.append(time.process_time() - at)
    assert [x[0] for x in got[0]] == [x[0] for x in got[1]] and took[0] < took[1] / 2, took
