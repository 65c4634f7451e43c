import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import defenses as D
from tracewright.operators import frames as R
from tracewright.operators import habits as H
from tracewright.operators import lists as I
from tracewright.operators import runs as U
from tracewright.operators import sweeps as W
from tracewright.sources import readers

DOC = "doc_id string, author_id string, turns array<string>"


@pytest.fixture(scope="module")
def docs(spark):
    long = "please tell me about the thing and what it does. I definitely want to color the code `the_var` because of it."
    return spark.createDataFrame([(f"d{i}", f"a{i % 4}" if i % 5 else None, [long, None, "", f"short {i}"] if i else []) for i in range(30)] + [("n", "a1", None)], DOC)


def test_scenes(docs):
    a, b = (R.scene_manifest(d).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert a == b and len(R.scenes()) == len(set(R.scenes())) == 50
    assert {r.framing for r in R.scene_manifest(docs, single="harbour-letter").collect()} == {"harbour-letter"}
    with pytest.raises(KeyError):
        R.scene_manifest(docs, single="no such")
    out = {r.doc_id: r.turns for r in R.shift(docs, lambda label, t: label + t).collect()}
    assert len(out) == 31 and out["d1"][3] == "short 1" and out["d1"][0].startswith("a ") and len(out["d1"]) == 4 and out["d0"] == []
    kept = {r.doc_id: r.turns for r in R.shift(docs, lambda label, t: t.str[:3]).collect()}
    assert kept["d1"][0].startswith("please tell me about")


def test_passages(spark, docs):
    bank = R.rule_bank(spark)
    out, man = {r.doc_id: r.turns for r in R.pad(docs, bank).collect()}, {r.doc_id: r for r in R.pad_manifest(docs, bank).collect()}
    assert out["d1"][:4] == docs.where("doc_id = 'd1'").first().turns and len(out["d0"]) == 1 and len(out["d1"][4]) == man["d1"].pad_chars and len(man["d1"].pad_id) == 12
    q = R.bank_quality(spark.createDataFrame([("s", "Why not?"), ("s", "Please go to `x`."), ("s", None)], "framing string, passage string")).first()
    assert (q.passages, q.questions, q.imperatives, q.technical, q.min_chars, q.median_chars) == (2, 1, 1, 1, 8, 17)
    assert R.pad(docs, bank.limit(0)).where("doc_id = 'd1'").first().turns == docs.where("doc_id = 'd1'").first().turns


def test_habits(docs):
    a, b = (H.seed_habits(d).orderBy("doc_id").collect() for d in (docs, docs.repartition(5)))
    assert a == b
    for r in a:
        if r.turns and len(r.turns) == 4:
            assert "`the_var`" in r.turns[0]
    man = {r.author_id: r for r in H.manifest(docs).collect()}
    book = H.Codebook()
    assert set(man) == {"a0", "a1", "a2", "a3"} and all(man[x].markers == "|".join(book.of(x)) for x in man) and len(set(book.profiles)) == 12
    full = H.Codebook(profiles=4, rates=(1.0, 1.0))
    assert all(len(p) >= 4 for p in full.profiles)
    audit = {r.marker: r for r in H.audit(docs).collect()}
    assert set(audit) == set(H.markers()) and abs(audit["tp_teh"].trigger_rate - 29 / 31) < 1e-9 and audit["tp_teh"].base_rate == 0
    assert {"collisions", "collisions_k24", "collisions_independent", "loo_unlink_b10", "afr_a25", "frame_pad_single", "placeholders_normalise"} <= set(D.REGISTRY)


def test_guards(spark):
    rows = [(["a b", ""], ["x y z", ""], True), (["a b", ""], ["", ""], False), (["a b"], ["a", "b"], False), (["ab"], ["abcdefgh"], False), ([], [], True), (["", None], ["", ""], True)]
    d = spark.createDataFrame(rows, "o array<string>, c array<string>, want boolean")
    assert all(r.got == r.want for r in d.select("want", R.admissible("c", "o").alias("got")).collect())
    w = spark.createDataFrame([("abcd", "ab", True), ("abcd", "a", False), ("abcd", "", False), ("abcd", None, False), ("ab", "abcdefghi", False)], "o string, r string, want boolean")
    assert all(r.got == r.want for r in w.select("want", R.within_length("o", "r").alias("got")).collect())
    t = spark.createDataFrame([("Garden tools, spades, rakes and old hoses",), ("x",), ("Garden tools, spades, rakes and öld hoses",), ("no commas in this one at all, though long",), ("the subject, spades, rakes and old hoses",), (" padded topic, spades, rakes and hoses",), (None,)], "t string")
    assert [r[0] for r in t.select(R.topic_rejection("t")).collect()] == [None, "length band", "non-ASCII", "wrong shape", "placeholder head term", "not a single trimmed line", "not a single trimmed line"]
    good, bad = R.harvest(spark.createDataFrame([("Garden tools, spades, rakes and old hoses",), ("GARDEN tools, spades, rakes and old hoses",), ("x",)], "heading string"))
    assert good.count() == 1 and bad.first().n == 1


def test_turns_added_and_words_drawn(spark, docs):
    made = spark.createDataFrame([("d1", "extra"), ("d2", " "), ("d3", None)], "doc_id string, turn string")
    out = {r.doc_id: r.turns for r in R.append_turns(docs, made).collect()}
    assert out["d1"][-1] == "extra" and len(out["d2"]) == 4 and len(out["d3"]) == 4 and out["n"] is None
    c = spark.createDataFrame([("thing", "matter", 1.0), ("thing", "object", 0.0)], "word string, candidate string, score double")
    got = {r.doc_id: r.turns for r in R.word_mechanism(docs, c, epsilon=1e6).collect()}
    assert got["d1"][0] == docs.where("doc_id = 'd1'").first().turns[0].replace("thing", "matter") and got["d0"] == []
    drop = {r.doc_id: r.turns for r in R.word_mechanism(docs, c, epsilon=1e6, drop=1.0).collect()}
    assert "the  and" in drop["d1"][0]
    v = spark.createDataFrame([(1, [1.0, 0.0])], "key int, vec array<double>")
    p = spark.createDataFrame([(1, 7, [0.0, 1.0]), (1, 9, [2.0, 0.1])], "key int, prior int, vec array<double>")
    assert R.nearest_prior(v, p).first().prior == 9


def test_lists(spark):
    s = spark.createDataFrame([(q, f"a{j}", float(-j)) for q in range(40) for j in range(6)], "q int, label string, score double")
    short = I.K.shortlist(s, 4).select("q", "label", "slot")
    shown = I.present(short)
    assert all(sorted(r[0]) == [0, 1, 2, 3] for r in shown.groupBy("q").agg(F.collect_list("shown")).select("collect_list(shown)").collect()) and shown.where("shown <> slot").count() > 0
    d = I.detail(I.present(short, shuffle=False), spark.createDataFrame([(0, [2])], "q int, ranking array<int>"), spark.createDataFrame([(0, "a2")], "q int, author string")).where("q = 0").orderBy("given").collect()
    assert [r.label for r in d] == ["a2", "a0", "a1", "a3"] and d[0].is_true
    ev = short.select("q", "label", F.lit("x").alias("query_text"), F.col("label").alias("known_text"))
    top = I.rerank(s, ev, lambda a, b: b.str[-1].astype(float), k=4)
    first = top.groupBy("q").agg(F.max_by("label", "score").alias("l"))
    assert {r.l for r in first.collect()} == {"a3"}


def test_windows_and_excerpts(spark):
    words = " ".join(f"w{i}" for i in range(250))
    d = spark.createDataFrame([("x", "a", [words, "one two\n\nthree"], "2024-01-02"), ("y", "a", ["tail"], "2024-03-01"), ("z", None, ["lost"], None)], "doc_id string, author_id string, turns array<string>, ended_at string")
    w = I.windows(d, 64)
    assert sum(len(r.text.split()) for r in w.where("doc_id = 'x'").collect()) == 253 and max(len(r.text.split()) for r in w.collect()) <= 128
    e = I.excerpts(w, d).orderBy("place").collect()
    assert e[0].doc_id == "y" and e[1].doc_id == "x" and {r.author_id for r in e} == {"a"}
    v = I.label_vectors(d, spark.createDataFrame([("x", [1.0, 2.0])], "doc_id string, vec array<double>"), 2).where("doc_id <> 'x'").collect()
    assert all(x != x for r in v for x in r.vec)
    lab = I.labelled(spark.createDataFrame([("a", "good"), ("b", ""), ("c", "odd"), ("d", "none")], "doc_id string, text string"), lambda t: t.map({"good": "Yes", "odd": "what"}), ["yes", "no"])
    assert {r.doc_id: r.label_status for r in lab.collect()} == {"a": "labeled", "b": "empty", "c": "invalid", "d": "failed"}


def test_runs(spark, tmp_path):
    assert U.params_hash({"b": 1, "a": 2}) == U.params_hash({"a": 2, "b": 1}) and U.logic_hash(U.params_hash) != U.logic_hash(U.params_hash, version="2")
    assert U.halving_budget(9000, 10, 9, 3) == 1000 and U.halving_budget(100, 10, 1, 3) == 100
    (tmp_path / "f").write_bytes(b"abc")
    assert U.file_digest(tmp_path / "f").startswith("ba7816bf")
    assert U.resolve_path("x", "/p") == "/p" and U.resolve_path("x", settings={"root": "/r"}) == "/r/x"
    with pytest.raises(FileNotFoundError):
        U.resolve_path("x")
    U.ledger(spark, str(tmp_path / "led"), a=1)
    U.ledger(spark, str(tmp_path / "led"), a=2)
    assert spark.read.json(str(tmp_path / "led")).count() == 2
    items = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, source string")
    cache = spark.createDataFrame([("1", "a", "A"), ("3", "x", "X")], "id string, source string, output string")
    out, new = U.cached_rows(items, cache, lambda s: s.withColumn("output", F.upper("source")))
    assert {(r.id, r.output) for r in out.collect()} == {("1", "A"), ("2", "A"), ("3", "B")} and new.count() == 2
    with pytest.raises(ValueError):
        U.taxonomy(spark, {"topic": ["a", "A"]})
    assert U.taxonomy(spark, {"topic": ["a", "b"]}).count() == 2
    sel = spark.createDataFrame([("nn", True), ("nn", False)], "attack string, selected boolean")
    assert U.chosen_settings(sel, "attack").count() == 1
    with pytest.raises(Exception):
        U.chosen_settings(sel.where("not selected"), "attack").collect()


def test_grid_is_written_and_read(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("label").alias("author"), F.col("embedding").alias("vec"))
    p, m = U.grid(e, {"k75": (0.0, 0.75)}, {"centroid": {}, "nearest_neighbor": {}})
    U.write_grid(p, m, str(tmp_path / "run"))
    assert U.read_predictions(spark, str(tmp_path / "run"), "centroid", in_set=False).count() == p.where("attack = 'centroid'").count() > 0


def test_image_conversations(spark, tmp_path):
    talk = [("user", "what is this"), ("assistant", "a cat"), ("user", " ")]
    rows = [
        ("c1", 1, "i1", "2024-01-01 00:00:00", False, talk, "gpt-4o", "english", {"ocr": True}), ("c2", 2, "i1", "2024-01-01 00:00:05", False, talk, "gpt-4o", "unknown", {}), ("c3", 3, "i2", "2024-01-01 00:00:00", False, talk, "x", None, None),
        ("c4", 3, "i3", "2024-01-02 00:00:00", True, talk, "x", None, None), ("c5", 2, "i9", "2024-02-01 00:00:00", False, [("assistant", "hi")], "x", None, None),
    ]
    d = spark.createDataFrame(rows, "conversation_id string, user_id long, image_name string, tstamp string, is_preset boolean, conversation array<struct<role:string,content:string>>, model string, language string, categories map<string,boolean>").withColumn("tstamp", F.to_timestamp("tstamp"))
    d.write.parquet(str(tmp_path / "va"))
    got = {r.doc_id: r for r in readers.image_documents(spark, str(tmp_path / "va")).collect()}
    assert set(got) == {"va-c1", "va-c2"} and got["va-c1"].author_id == got["va-c2"].author_id and got["va-c1"].n_upstream_ids == 2 and got["va-c1"].ocr and not got["va-c2"].ocr and got["va-c2"].language_primary is None
    assert set(r.doc_id for r in readers.image_documents(spark, str(tmp_path / "va"), merge=False).collect()) == {"va-c2"}


def test_sweeps(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.4), (3, 4, 0.2)], "src int, dst int, distance double")
    n = spark.createDataFrame([(i,) for i in range(1, 5)], "id int")
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, author string")
    s = W.sweep_algorithms(n, e, t, ("components",), (0.34, 0.99))
    assert W.best_setting(s).first().quantile == "0.34" and W.best_setting(s).first().f1 == 1.0
    assert W.weight_grid(0.5) == (0.0, 0.125, 0.25, 0.5, 0.75, 0.8)
    h = {r.bin: (r.pos, r.neg) for r in W.pair_histogram(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 1.0])], "id int, author string, vec array<double>")).collect()}
    assert h == {0: (1, 0), -25: (0, 2)}
    from tracewright.operators import graph as G

    with pytest.raises(ValueError, match="raise `largest`"):
        G.capped_linkage(n, e, 1.0, largest=2).collect()
    with pytest.warns(UserWarning, match="stays one cluster"):
        assert G.agglomerative(n, e, 1.0, largest=2).select("cluster").distinct().count() == 1


def test_logistic_in_steps_agrees_with_the_dense_model(spark, data):
    from tracewright.operators import attacks as A
    from tracewright.operators import ranking as K

    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("label").alias("author"), F.col("embedding").alias("vec"))
    k = e.where("doc % 4 <> 0")
    a, b = (K.best(f(k, k)).join(k.select(F.col("doc").alias("q"), "author"), "q").agg(F.avg((F.col("label") == F.col("author")).cast("double"))).first()[0] for f in (A.logistic, A.logistic_in_steps))
    assert abs(a - b) < 0.15


def test_text_features_agree_with_the_relational_way(spark, data):
    from tracewright.operators import features as X

    d = spark.read.parquet(f"{data}/documents.parquet")
    v, vocab = X.tfidf_of_texts(d, "doc_id", "text", most=300)
    c = X.char_ngrams(d, "doc_id", "text")
    want = X.tfidf(c, X.vocabulary(c, 300))
    a = {(r.id, r.gram): round(r.w, 9) for r in v.collect()}
    assert a == {(r.id, r.gram): round(r.w, 9) for r in want.collect()} and vocab.count() == 300
    assert {(r.gram, r.n) for r in X.gram_totals(d, "text").collect()} == {(r.gram, r.n) for r in c.groupBy("gram").agg(F.sum("tf").alias("n")).collect()}


def test_requests(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00", 5), ("2024-01-01 00:00:30", 5), ("2024-01-01 00:01:10", 5), (None, 1)], "ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    got = [(r.in_window, r.wait) for r in U.requests_in_window(d, limit=9).orderBy("ts").collect()]
    assert got == [(5, False), (10, True), (10, True)]


def test_words_are_drawn_where_the_rows_are(spark):
    odd = ["Good good GOOD make's don'tmake make", None, "", "see https://good.make/good good,`make good` <GOOD> [x](make) make ```good\nmake``` good", "x" * 30 + "good make", "ΟΔΟΣ.Α ΟΔΟΣ İstanbul good日本 " + "-- " * 3000 + "make " + "a b " * 900]
    docs = spark.createDataFrame([("a", "x", odd), ("b", "x", []), ("c", None, None), ("d", "y", ["nothing of these"])], "doc_id string, author_id string, turns array<string>")
    words = [("good", "fine", 1.0), ("Good", "nice", 0.9), ("make", "build", 1.0), ("make", None, 0.9), ("ΟΔΟΣ", "δρόμος", 1.0), ("a", "", None), ("b", "nan", float("nan")), ("`make good`", "no", 1.0), (None, "n", 1.0), ("İstanbul", "I", 1.0)]
    c = spark.createDataFrame(words, "word string, candidate string, score double")
    for how in ({"epsilon": 2.0}, {"epsilon": 2.0, "add": 0.3, "drop": 0.2}):
        here = R.word_mechanism(docs, c, **how)
        got = {r.doc_id: (r.author_id, r.turns) for r in here.collect()}
        assert got == {r.doc_id: (r.author_id, r.turns) for r in R.word_mechanism(docs, c, few=3, **how).collect()}
        assert got["b"] == ("x", []) and got["c"] == (None, []) and got["a"][1][1:3] == ["", ""] and "https://good.make/good" in got["a"][1][3] and "`make good` <GOOD> [x](make)" in got["a"][1][3]
        assert got["a"][1][0] != odd[0] and got["d"] == ("y", ["nothing of these"])
        plan = here._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan
    assert R.word_mechanism(docs, c.limit(0)).where("doc_id = 'a'").first().turns == [t or "" for t in odd]


def test_spans_of_a_row_are_the_spans(spark, data):
    odd = ["One. Two is here! `code. x` Three", None, "", "just four words here", "two words", "a\n\nb c d e f ", "  ", "see https://a.b/c. And <NAME> said ```x\ny``` so. " + "z" * 30, "日本語。です. Ünï? “Q.” end"]
    docs = spark.read.parquet(f"{data}/chat_docs.parquet").where("doc_id is not null and turns is not null").select("doc_id", "turns").dropDuplicates(["doc_id"])
    docs = docs.union(spark.createDataFrame([("odd", odd), ("none", [])], "doc_id string, turns array<string>"))
    want = {}
    for r in D.spans(docs).orderBy("doc_id", "turn_no", "span_no").collect():
        want.setdefault(r.doc_id, []).append((r.turn_no, r.text, r.editable))
    got = {r.doc_id: [tuple(x) for x in r.s] for r in docs.select("doc_id", D.span_array("turns").alias("s")).collect()}
    assert got["none"] == [] and all(got[k] == want.get(k, []) for k in got) and set(want) <= set(got)
