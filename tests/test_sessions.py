import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import languages as G
from tracewright.operators import sessions as S

LOG = "session_id string, turn_number int, turn_type string, content string, turn_id long, turn_timestamp timestamp, turn_language string, model string, agent string, user_id string, repo_id string, loaded_at timestamp"
DOC = "# One\nA line of it\n"


def log(spark, turns, session="s"):
    return spark.createDataFrame([(session, i, kind, text, 100 + i, None, None, None, None, None, None, None) for i, (kind, text) in enumerate(turns)], LOG)


def reasons(spark, turns):
    got = S.human_prompts(S.merged_markdown(S.user_prompts(log(spark, turns)))).orderBy("turn_number").collect()
    return [(r.text, r.reason) for r in got]


U, A = "user_prompt", "agent_message"


def test_commands_injections_and_continuations(spark):
    cmd = "<command-name>review</command-name><command-args>src/a.py now</command-args>"
    got = reasons(spark, [
        (U, "please look"), (A, "ok"), (U, cmd), (U, "## Part of the template"), (U, "yes"), (U, "- an item of it"), (A, "done"), (U, "- my own list"), (U, "Base directory for this skill: x"), (U, None), (U, "<environment_context>x</environment_context>"), (U, "* y"),
    ])
    assert got == [
        ("please look", None), ("/review src/a.py now", None), ("## Part of the template", "continuation"), ("yes", None), ("- an item of it", None), ("- my own list", None), ("<environment_context>x</environment_context>", "env-context"), ("* y", "continuation"),
    ]


def test_state_is_carried_over_many_pieces(spark):
    got = reasons(spark, [(U, "[OMX status]"), *[(U, f"- piece {i}") for i in range(40)], (A, "x"), (U, "- mine")])
    assert [r for _, r in got] == ["orchestration"] + ["continuation"] * 40 + [None]


def test_markdown_runs_become_one(spark):
    got = S.merged_markdown(S.user_prompts(log(spark, [(U, "# a"), (U, "# b"), (A, "x"), (U, "# c"), (U, "plain"), (U, "# d")]))).orderBy("turn_number").collect()
    assert [r.content for r in got] == ["# a\n\n# b", "# c", "plain", "# d"]


@pytest.mark.parametrize("text, left", [
    ("a <system_instruction>x\ny</system_instruction> b", "a  b"), ("mine <teammate-message id=1>open", "mine"), ("You are OMX Explore x User request: find it", "find it"), ("[Request interrupted by user] [Image: a]  go on", "go on"),
    ("You are a code reviewer. Your job is to review code changes x Input: main --- y", "main"), ("", ""), ("plain", "plain"),
])
def test_wrappers(spark, text, left):
    assert spark.createDataFrame([(text,)], "t string").select(T.strip_wrappers("t")).first()[0] == left


def test_repeats(spark):
    again = [(U, "run it"), (A, "x")] * 6
    p = S.human_prompts(S.user_prompts(log(spark, again))).where("reason is null")
    assert S.without_repeats(p).count() == 1  # spam of one session
    both = p.unionByName(S.human_prompts(S.user_prompts(log(spark, again, "other"))).where("reason is null"))
    assert S.without_repeats(both).count() == 12  # said in several sessions, answered each time
    resent = S.human_prompts(S.user_prompts(log(spark, [(U, "go"), (U, "go"), (A, "x"), (U, "go")])))
    assert [r.turn_number for r in S.without_repeats(resent).orderBy("turn_number").collect()] == [0, 3]
    assert S.without_repeats(p.limit(0)).count() == 0


def test_a_session_from_log_to_turns(spark):
    turns = [(U, "mail me at a.b@c.org please"), (A, "x"), (U, "<command-name>/cmd</command-name><command-args>https://x.org/y</command-args>"), (U, "   ")]
    got = S.session_turns(log(spark, turns).unionByName(log(spark, turns))).orderBy("turn_number").collect()
    assert [r.text for r in got] == ["mail me at <EMAIL> please", "/cmd <URL>"]
    assert S.session_turns(log(spark, turns).limit(0)).count() == 0


@pytest.mark.parametrize("agent, device, program", [
    ("Mozilla/5.0 (X11) Firefox/120", "firefox;linux;;", False), ("", "x;y", True), (None, None, True), ("{'a': 1}", "x;y", True), ("User-Agent: Mozilla", "x;y", True), ("python-httpx/0.2", "x;y", True), ("Mozilla HeadlessChrome/1", "chrome;x", True),
    ("Unknown thing", None, True), ("Mozilla x", "mozilla;x", True), ("Mozilla x", "node", True),
])
def test_programs(spark, agent, device, program):
    assert spark.createDataFrame([(agent, device)], "a string, d string").select(T.is_program("a", "d")).first()[0] is program


def test_edits_and_json(spark):
    d = spark.createDataFrame([("abcdef", [(4, 6, "!"), (0, 2, "x")]), ("abc", [(0, 2, "x"), (1, 3, "y")]), ("abc", None), (None, [])], "t string, e array<struct<start:int,stop:int,new:string>>")
    assert [r[0] for r in d.select(T.apply_edits("t", "e")).collect()] == ["xcd!", None, "abc", None]
    j = spark.createDataFrame([('{"A": 1, "b": "x"}',), ("[1]",), ("no",), (None,)], "t string").select(T.json_object("t")).collect()
    assert [r[0] for r in j] == [{"a": "1", "b": "x"}, None, None, None]


def test_languages(spark):
    docs = spark.createDataFrame([("a", "en"), ("b", "fr"), ("c", None), ("d", "de"), ("e", None)], "doc_id string, upstream string")
    conf = spark.createDataFrame([("a", "en", 0.9), ("a", "fr", 0.1), ("b", "fr", 0.4), ("b", "en", 0.35), ("b", "de", 0.25), ("c", "de", 0.45), ("c", "en", 0.4), ("c", "fr", 0.15)], "doc_id string, lang string, value double")
    got = {r.doc_id: (r.language_primary, r.step, r.language_secondary) for r in G.observed(docs, conf).collect()}
    assert got["a"][:2] == ("en", "confident") and got["b"][:2] == ("fr", "agree") and got["d"] == ("de", "fallback", None) and got["e"] == ("English", "default", None)
    # prior: en (1 + 1) / 4, the others 1 / 4: posteriors of c are 0.45, 0.8, 0.15 over 1.4
    assert got["c"] == ("en", "prior", "de")
    sec = {r.doc_id: r.language_secondary for r in G.secondary(docs.select("doc_id", F.col("upstream").alias("primary")), conf).collect()}
    assert sec == {"a": None, "b": "en", "c": None, "d": None, "e": None}
    t = spark.createDataFrame([("x", "Это здесь good"), ("y", "plain words"), ("z", "?")], "doc_id string, text string")
    c = spark.createDataFrame([("x", "en", 1.0), ("y", "en", 1.0)], "doc_id string, lang string, value double")
    s = {r.doc_id: (r.language_primary, r.language_secondary) for r in G.by_script(t, c).collect()}
    assert s == {"x": ("ru", "en"), "y": ("en", None), "z": (None, None)}
    assert spark.createDataFrame([("аб cd вг",)], "t string").select(G.script_runs("t", "Cyrillic")).first()[0] == "аб вг"
    up = spark.createDataFrame([("a", ["English", "French"]), ("b", []), ("c", None)], "doc_id string, languages array<string>")
    assert {r.doc_id: (r.language_primary, r.language_secondary, r.path) for r in G.resolve(up, None).collect()} == {"a": ("English", "French", "upstream"), "b": ("English", None, "default"), "c": ("English", None, "default")}


def test_hot_nulls_stay_out_of_the_exchanges(spark):
    from tracewright.operators import build as B

    rows = [(i, None if i % 2 else f"a{i % 7}", ("short" if i % 3 else "x" * 120 + str(i % 5)) + ("" if i % 4 else f" {i}"), i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, author_id string, text string, at int")
    kept = {r.doc_id for r in B.cap_affixes(d, "author_id", "text", "at", "doc_id").collect()}
    assert {i for i, a, t, _ in rows if a is None or len(t) < 100} <= kept
    for a in {x[1] for x in rows if x[1]}:
        mine = [x for x in rows if x[1] == a and len(x[2]) >= 100]
        assert sum(x[0] in kept for x in mine) == min(2, len(mine))
    assert B.drop_shared_affixes(d, "author_id", "text").where("length(text) < 100").count() == sum(len(x[2]) < 100 for x in rows)
