from pyspark.sql import functions as F

from tracewright.functions import text as T


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr.alias("x")).first().x


def scrub(spark, text, **kw):
    return one(spark, T.scrub_identifiers("t", mask_ids=True, **{k: k for k in kw}), t=text, **kw)


def test_scrub(spark):
    cases = {
        "see https://a.b/c now": "see <URL> now",
        "mail a.b+c@d-e.org now": "mail <EMAIL> now",
        "at 192.168.0.1 now": "at <IP> now",
        "v1.2.3.4": "v1.2.3.4",
        "and/or": "and/or",
        "on 3/4/2025 or 3/4": "on 3/4/2025 or 3/4",
        "open src/main.py now": "open <PATH> now",
        "~/config and /usr/lib/x": "<PATH> and <PATH>",
        "id 123e4567-e89b-12d3-a456-426614174000 x": "id <ID> x",
        "decade 12345678": "decade 12345678",
        "commit a1b2c3d x": "commit <ID> x",
        "me@host$ and actions/checkout@v4": "<HOST> $ and actions/checkout@v4",
        "": "",
    }
    for raw, want in cases.items():
        assert scrub(spark, raw) == want, raw
    assert scrub(spark, None) == ""
    assert scrub(spark, "the Acme/Rocket cli is rocket fast", repo_id="acme/rocket") == "the <REPO> cli is <REPO> fast"
    assert scrub(spark, "ask (jo.smith) a+b", user_id="jo.smith@x.y") == "ask ( <USER> ) a+b"
    assert scrub(spark, "a nan b", repo_id=None, user_id="nan") == "a nan b"


def test_whitespace(spark):
    assert one(spark, T.normalize_whitespace("t"), t="  a \r\nb\\nc\n\n\n\nd \t\n e  ") == "a\nb\nc\n\nd\n e"
    assert one(spark, T.normalize_whitespace("t"), t=None) is None


def test_classes(spark):
    for text, want in {"": "empty", None: "empty", "<bash-input>x": "tool-io", "# a\n\nb": "markdown-body", "# a": None, "x" * 8000: "too-long", "[Image: a]": "scaffolding", "hello": None}.items():
        assert one(spark, T.nonhuman_reason("t"), t=text) == want
    got = one(spark, T.normalize_command("t"), t="<command-name>review</command-name><command-args>a b</command-args>")
    assert (got.text, got.is_command) == ("/review a b", True)
    assert one(spark, T.normalize_command("t"), t="x").is_command is False
    assert one(spark, T.is_error_response("t"), t='  API Error: 1') is True


def test_names(spark):
    for m, want in {"claude-x": "Anthropic", "GPT-4": "OpenAI", "code-codex": "OpenAI", None: "unknown", "llama": "unknown", "<no_model>": "unknown"}.items():
        assert one(spark, T.model_owner("t"), t=m) == want
    for m, want in {"ENGLISH": "English", " german ": "German", "nan": None, "": None, None: None}.items():
        assert one(spark, T.normalize_language("t"), t=m) == want
    assert one(spark, T.last_segment("t"), t="https://a.b/share/xyz/?q=1#f") == "xyz"


def test_replies(spark):
    for reply, want in {'{"score": 4}': 4, "```json\n{\"score\": 2}\n```": 2, "Score: 3, final score: 5": 5, "score 9": None, "no": None, None: None}.items():
        assert one(spark, T.parse_score("t"), t=reply) == want
    for reply, want in {"[2, 1, 2, 9]": [1, 0], "Ranking: [3,1": [2, 0], "none": [], None: []}.items():
        assert one(spark, T.parse_ranking("t", 3), t=reply) == want
    assert one(spark, T.parse_choice("t"), t="a 3 b 7") == 7 and one(spark, T.parse_choice("t"), t=None) == 0


def test_arrays(spark):
    df = spark.createDataFrame([(["ab", None, " ", "cdef"],), ([],), (None,)], "turns array<string>")
    got = df.select(T.drop_empty_turns("turns").alias("a"), T.document_words("turns").alias("w"), T.token_estimate("turns").alias("n"), T.cap_turns("turns", 3).alias("c")).collect()
    assert got[0].a == ["ab", "cdef"] and got[0].w == 2 and got[0].n == 2 and got[0].c == ["ab"]
    assert got[1].a == [] and got[1].n == 0 and got[2].w == 0
    long_ = spark.createDataFrame([(["abcdef"],)], "turns array<string>").select(T.cap_turns("turns", 3).alias("c")).first().c
    assert long_ == ["abc […]"]


def test_reuse(spark):
    a, b = "a b c d e f g h i", "x a b c d e f g h"
    assert one(spark, T.ngram_reuse("a", "b"), a=a, b=b) == 0.5
    assert one(spark, T.ngram_reuse("a", "b"), a="short", b="short") == 0.0


def test_times(spark):
    f = F.date_format(T.to_utc("t"), "yyyy-MM-dd HH:mm")
    for raw, want in {"2024-01-02T03:04:05+01:00": "2024-01-02 02:04", "2024-01-02 03:04:05": "2024-01-02 03:04", "ts:0": "1970-01-01 00:00", "2024-01-02": "2024-01-02 00:00", "x": None, None: None}.items():
        assert one(spark, f, t=raw) == want
