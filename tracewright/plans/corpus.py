"""Queries over texts and documents: cleaning, features, deduplication, sessions, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import defenses as D
from ..operators import features as X
from ..operators import utility as U
from ..operators.unlink import unlink
from ..runtime import cut, table
from ..sources import readers as R
from ..sources import sinks as S
from .registry import query

#: White space, as a class of the SQL's regular expressions.
_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_ws = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, '\\n', chr(10)), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10)||chr(10), 'g'), '^\\s+', ''), '\\s+$', '')"


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source IS NOT NULL AND n_chars > 500")
def scan_project_filter_documents(spark, d):
    return table(spark, d, "documents").where("lang = 'en' and source is not null and n_chars > 500").select("doc_id", "source", "lang")


@query("SELECT doc_id, CASE WHEN source IS NULL OR author_id IS NULL THEN NULL ELSE source || '-' || substr(sha256('|' || source || '|' || author_id), 1, 16) END AS hashed FROM documents")
def identity_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.hash_author_id("source", "author_id").alias("hashed"))


@query()
def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_whitespace("text").alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.-]+', ' <EMAIL> ', 'g') AS text FROM documents")
def scrub_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", " <EMAIL> ").alias("text"))


@query()
def scrub_identifiers(spark, d):
    t = table(spark, d, "turn_log").where(F.col("content").isNotNull())
    return t.select("turn_id", "session_id", "turn_number", T.clean_prompt("content", repo_id="repo_id", user_id="user_id", mask_ids=True).alias("text")).distinct()


@query(
    rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, greatest(length(t), 1)::DOUBLE AS n, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS w FROM t)
    SELECT doc_id, length(t) AS n_chars_found, round(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / n, 9) AS upper_ratio, round(length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) / n, 9) AS digit_ratio,
    round((length(t) - length(regexp_replace(t, '{_WS}', '', 'g'))) / n, 9) AS space_ratio, round(length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g')) / n, 9) AS punct_ratio,
    round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE ELSE 0 END, 9) AS mean_word_length, len(w)::BIGINT AS n_words FROM w"""
)
def char_statistics(spark, d):
    s = table(spark, d, "documents").select("doc_id", *T.character_statistics("text"))
    r = lambda c: F.round(c, 9).alias(c)
    return s.select("doc_id", "n_chars_found", *map(r, ("upper_ratio", "digit_ratio", "space_ratio", "punct_ratio", "mean_word_length")), "n_words")


@query()
def char_statistics_full(spark, d):
    return table(spark, d, "documents").select("doc_id", *T.character_statistics("text"))


_FW = ", ".join(f"round(len(list_filter(w, lambda x: x = '{w}')) / greatest(len(w), 1)::DOUBLE, 9) AS fw_{w}" for w in T.FUNCTION_WORDS)


@query(rf"WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\p{{Nl}}\pM\p{{Nd}}\p{{Pc}}\x{{200c}}\x{{200d}}]+') AS w FROM documents) SELECT doc_id, {_FW} FROM t")
def function_words(spark, d):
    f = table(spark, d, "documents").select("doc_id", *T.function_word_frequencies("text"))
    return f.select("doc_id", *[F.round(f"fw_{w}", 9).alias(f"fw_{w}") for w in T.FUNCTION_WORDS])


@query(
    r"""WITH t AS (SELECT doc_id, length(regexp_replace(coalesce(text,''), '[^\pL]', '', 'g')) AS n, length(regexp_replace(coalesce(text,''), '[^\p{Latin}]', '', 'g')) AS l FROM documents)
    SELECT doc_id, round(CASE WHEN n > 0 THEN l / n::DOUBLE ELSE 1.0 END, 6) AS latin_ratio FROM t"""
)
def latin_ratio(spark, d):
    t = F.coalesce("text", F.lit(""))
    latin = F.regexp_count(t, F.lit(r"\p{IsLatin}"))
    n = F.regexp_count(t, F.lit(r"\p{L}"))
    return table(spark, d, "documents").select("doc_id", F.round(F.when(n > 0, latin / n).otherwise(1.0), 6).alias("latin_ratio"))


@query()
def style_statistics(spark, d):
    return table(spark, d, "documents").select("doc_id", *T.style_stats("text"))


_OWNER = """CASE WHEN {m} IS NULL OR lower({m}) IN ('', 'none', 'nan', '<no_model>') THEN 'unknown' WHEN lower({m}) LIKE 'claude%' THEN 'Anthropic'
 WHEN lower({m}) LIKE 'gpt%' OR lower({m}) LIKE 'chatgpt%' OR contains(lower({m}), 'codex') THEN 'OpenAI' WHEN lower({m}) LIKE 'gemini%' THEN 'Google' WHEN lower({m}) LIKE 'glm%' THEN 'Zhipu'
 WHEN lower({m}) LIKE 'reka%' THEN 'Reka' WHEN lower({m}) LIKE 'yi-vision%' THEN '01.AI' ELSE 'unknown' END"""


@query(f"SELECT {_OWNER.format(m='model')} AS owner, count(*) AS docs FROM chat_docs GROUP BY 1")
def model_owner_counts(spark, d):
    return table(spark, d, "chat_docs").groupBy(T.model_owner("model").alias("owner")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    """WITH t AS (SELECT DISTINCT doc_id, trim(language_primary) AS l FROM chat_docs)
    SELECT doc_id, CASE WHEN l IS NULL OR lower(l) IN ('', 'nan', 'none') THEN NULL ELSE array_to_string(list_transform(string_split(lower(l), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END AS lang FROM t"""
)
def language_title(spark, d):
    return table(spark, d, "chat_docs").select("doc_id", T.normalize_language("language_primary").alias("lang")).distinct()


@query()
def language_title_full(spark, d):
    """Every label, also those in scripts for which SQL has another title case."""
    return language_title(spark, d)


@query(
    r"""SELECT DISTINCT doc_id, len(list_filter(coalesce(turns, []), lambda t: t IS NOT NULL AND regexp_replace(t, '^\s+|\s+$', '', 'g') <> '')) AS kept,
    CAST(round_even(list_sum(list_transform(coalesce(turns, []), lambda t: length(coalesce(t,'')))) / 4.0, 0) AS BIGINT) AS tokens FROM chat_docs WHERE len(turns) > 0"""
)
def turns_kept(spark, d):
    c = table(spark, d, "chat_docs").where(F.size("turns") > 0)
    return c.select("doc_id", F.size(T.drop_empty_turns("turns")).cast("bigint").alias("kept"), T.token_estimate("turns").alias("tokens")).distinct()


@query()
def capped_turns(spark, d):
    return table(spark, d, "chat_docs").select("doc_id", T.cap_turns("turns", 500).alias("turns")).distinct()


@query()
def detection_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_for_detection("text").alias("text"), F.round(T.script_share("text", "Han"), 6).alias("han"), F.round(T.script_share("text", "Cyrillic"), 6).alias("cyrillic"))


def _sql_reasons() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    t, s = "t", "s"
    how = {"begins": f"starts_with({s}, {{}})", "begins in any case": f"starts_with(lower({s}), {{}})", "holds": f"contains({t}, {{}})"}
    lines = [f"WHEN {' OR '.join(how[k].format(q(x)) for x in texts)} THEN '{reason}'" for reason, k, texts in T.INJECTED]
    return " ".join(["CASE WHEN t = '' THEN 'empty'", *lines, f"WHEN regexp_matches(s, {q(T._SCAFFOLD)}) THEN 'scaffolding' WHEN (starts_with(s, '#') OR starts_with(s, '**')) AND contains(s, chr(10) || chr(10)) THEN 'markdown-body' WHEN length(t) >= 8000 THEN 'too-long' END"])


@query(f"WITH x AS (SELECT turn_type, coalesce(content, '') AS t, regexp_replace(coalesce(content, ''), '^{_WS}+', '') AS s FROM turn_log) SELECT turn_type, {_sql_reasons()} AS reason, count(*) AS n FROM x GROUP BY ALL")
def human_turn_classes(spark, d):
    return table(spark, d, "turn_log").groupBy("turn_type", T.nonhuman_reason("content").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- deduplication and filters ------------------------------------------------------------------------------------------
_EXACT = "SELECT *, row_number() OVER (PARTITION BY author_id, text ORDER BY created_at NULLS FIRST, doc_id) AS r FROM documents WHERE text IS NOT NULL"
_KEPT = f"""x AS ({_EXACT} QUALIFY r = 1), a AS (SELECT *, CASE WHEN length(text) >= 100 THEN substr(text, 1, 100) END AS p, CASE WHEN length(text) >= 100 THEN substr(text, length(text) - 99, 100) END AS s FROM x),
 bp AS (SELECT p FROM a WHERE p IS NOT NULL GROUP BY p HAVING count(DISTINCT author_id) >= 2), bs AS (SELECT s FROM a WHERE s IS NOT NULL GROUP BY s HAVING count(DISTINCT author_id) >= 2),
 y AS (SELECT * FROM a WHERE (p IS NULL OR p NOT IN (SELECT p FROM bp)) AND (s IS NULL OR s NOT IN (SELECT s FROM bs)))"""


def _texts(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "author_id", "text", "created_at")


@query(f"SELECT doc_id FROM ({_EXACT}) WHERE r = 1")
def exact_dedup_keep_first(spark, d):
    return B.exact_dedup(_texts(spark, d), "author_id", "text", "created_at", "doc_id").select("doc_id")


@query(f"WITH {_KEPT} SELECT doc_id FROM y")
def cross_identity_affix_drop(spark, d):
    return B.drop_shared_affixes(B.exact_dedup(_texts(spark, d), "author_id", "text", "created_at", "doc_id"), "author_id", "text").select("doc_id")


@query(
    f"""WITH {_KEPT}, z AS (SELECT doc_id, CASE WHEN p IS NULL OR author_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY author_id, p ORDER BY created_at NULLS FIRST, doc_id) END AS rp,
    CASE WHEN s IS NULL OR author_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY author_id, s ORDER BY created_at NULLS FIRST, doc_id) END AS rs FROM y) SELECT doc_id FROM z WHERE rp <= 2 AND rs <= 2"""
)
def dedup_pipeline(spark, d):
    return B.deduplicate(_texts(spark, d), "author_id", "text", "created_at", "doc_id").select("doc_id")


@query(
    """WITH x AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY created_at NULLS FIRST, doc_id) AS r FROM documents WHERE text IS NOT NULL QUALIFY r = 1),
    a AS (SELECT doc_id, CASE WHEN length(text) >= 100 THEN substr(text, 1, 100) END AS p, CASE WHEN length(text) >= 100 THEN substr(text, length(text) - 99, 100) END AS s FROM x)
    SELECT doc_id FROM a WHERE coalesce(p NOT IN (SELECT p FROM a WHERE p IS NOT NULL GROUP BY p HAVING count(*) > 1), true) AND coalesce(s NOT IN (SELECT s FROM a WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1), true)"""
)
def dedup_unidentified(spark, d):
    return B.deduplicate_unidentified(_texts(spark, d), "doc_id", "text", "created_at", "doc_id").select("doc_id")


@query("SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 12")
def min_docs_filter(spark, d):
    return B.min_docs(table(spark, d, "orders"), "o_custkey", 12).select("o_orderkey")


@query(
    r"""WITH c AS (SELECT author_id, num_turns, array_to_string(list_filter(turns, lambda t: t IS NOT NULL), chr(10)) AS t FROM chat_docs WHERE author_id IS NOT NULL),
    r AS (SELECT author_id FROM c GROUP BY author_id HAVING sum(coalesce(regexp_matches(t, '(?i)^\s*(?:System|Assistant|AI|ChatGPT|Bot)\s*:\s') OR regexp_matches(t, '(?i)(?:^|\n)\s*(?:Assistant|AI|ChatGPT|Bot)\s*:\s*$'), false)::INT) >= 2 AND bool_and(coalesce(num_turns = 1, false)))
    SELECT DISTINCT doc_id, author_id FROM chat_docs WHERE author_id IS NULL OR author_id NOT IN (SELECT author_id FROM r)"""
)
def relay_author_drop(spark, d):
    return B.drop_relays(table(spark, d, "chat_docs")).select("doc_id", "author_id").distinct()


@query("SELECT CASE WHEN r > 1 THEN id || '-' || (r - 1) ELSE id END AS id, o_orderkey FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def uniquify_ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey")
    return B.uniquify(o, "id", "o_orderkey")


@query(
    """WITH c AS (SELECT author_id, lang, count(*) AS n, min(doc_id) AS seen FROM documents WHERE lang IS NOT NULL AND author_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, seen) AS r FROM c)
    SELECT author_id, array_to_string(list(lang ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, lang), ',') AS languages FROM r GROUP BY author_id"""
)
def ordered_languages(spark, d):
    docs = table(spark, d, "documents").where(F.col("author_id").isNotNull())
    return B.ordered_languages(docs, "author_id", "lang", "doc_id").select("author_id", F.array_join("languages", ",").alias("languages"))


@query(
    """WITH c AS (SELECT session_id, model, count(*) AS n FROM turn_log WHERE session_id IS NOT NULL AND model IS NOT NULL AND lower(trim(model)) NOT IN ('', 'none', 'nan') GROUP BY ALL)
    SELECT session_id, model FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, model) AS r FROM c) WHERE r = 1"""
)
def dominant_model_mode(spark, d):
    return B.dominant_value(table(spark, d, "turn_log").where(F.col("session_id").isNotNull()), "session_id", "model")


_LOG = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY loaded_at DESC NULLS LAST, session_id, turn_number) AS rd FROM turn_log) WHERE rd = 1 AND turn_id IS NOT NULL"""


@query(
    f"""WITH l AS ({_LOG}) SELECT turn_id, coalesce(sum(CASE WHEN turn_type = 'agent_message' OR turn_type = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum_agent FROM l"""
)
def cum_agent_before(spark, d):
    log = B.latest_delivery(table(spark, d, "turn_log")).where(F.col("turn_id").isNotNull())
    return B.agent_turns_before(log).select("turn_id", "cum_agent")


@query()
def session_documents(spark, d):
    return B.session_documents(table(spark, d, "turn_log"))


@query()
def markdown_runs(spark, d):
    log = B.latest_delivery(table(spark, d, "turn_log").where(F.col("session_id").isNotNull()))
    prompts = B.agent_turns_before(log).where((F.col("turn_type") == "user_prompt") & F.col("content").isNotNull())
    return B.markdown_runs(prompts)


@query(
    f"""WITH l AS ({_LOG}), p AS (SELECT *, lag(content) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id) AS prev FROM l WHERE turn_type = 'user_prompt' AND content IS NOT NULL)
    SELECT content, count(*) AS extra, count(DISTINCT session_id) AS docs FROM p WHERE content = prev GROUP BY content"""
)
def consecutive_dup_runs(spark, d):
    p = B.latest_delivery(table(spark, d, "turn_log")).where((F.col("turn_id").isNotNull()) & (F.col("turn_type") == "user_prompt") & F.col("content").isNotNull())
    p = p.withColumn("at", F.struct("turn_number", "turn_id"))
    return B.consecutive_duplicates(p, "session_id", "at", "content")


# --- identities ---------------------------------------------------------------------------------------------------------
@query(
    """SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, (SELECT event_type FROM (SELECT event_type, count(*) c FROM events x WHERE x.user_id = e.user_id GROUP BY 1 ORDER BY c DESC, event_type LIMIT 1)) AS modal_type
    FROM events e GROUP BY user_id HAVING count(*) >= 2"""
)
def identity_intervals(spark, d):
    e = table(spark, d, "events")
    base = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).where("n >= 2")
    return base.join(B.dominant_value(e, "user_id", "event_type").withColumnRenamed("event_type", "modal_type"), "user_id")


@query(
    """WITH r AS (SELECT DISTINCT author_id, first_seen, last_seen, n_docs, state, accept_language, device_info, country FROM identity_intervals
      WHERE author_id IS NOT NULL AND first_seen IS NOT NULL AND last_seen IS NOT NULL AND accept_language IS NOT NULL AND device_info IS NOT NULL AND country IS NOT NULL),
    b AS (SELECT *, count(*) OVER (PARTITION BY accept_language, device_info, country) AS block_size FROM r)
    SELECT a.author_id AS a, c.author_id AS b, round((epoch_us(c.first_seen) - epoch_us(a.last_seen)) / 86400000000.0, 2) AS gap_days, a.block_size AS block_size, a.n_docs AS n_a, c.n_docs AS n_b, a.state IS NOT DISTINCT FROM c.state AS same_state
    FROM b a JOIN b c ON a.accept_language = c.accept_language AND a.device_info = c.device_info AND a.country = c.country AND a.author_id <> c.author_id
    WHERE a.block_size BETWEEN 2 AND 50 AND c.first_seen >= a.last_seen AND (epoch_us(c.first_seen) - epoch_us(a.last_seen)) / 86400000000.0 <= 30"""
)
def candidate_pairs_interval_join(spark, d):
    return B.interval_pairs(table(spark, d, "identity_intervals"), ["accept_language", "device_info", "country"])


@query(
    """WITH e AS (SELECT event_type || '-' || strftime(ts, '%Y%m%d%H') AS key, user_id, ts FROM events), f AS (SELECT key FROM e GROUP BY key HAVING count(DISTINCT user_id) BETWEEN 2 AND 3)
    SELECT a.user_id AS a, b.user_id AS b, min(abs(epoch_us(a.ts) - epoch_us(b.ts))) / 1e6 AS seconds FROM e a JOIN e b ON a.key = b.key AND a.user_id < b.user_id JOIN f ON a.key = f.key
    WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 <= 600 GROUP BY ALL"""
)
def nearest_time_merge(spark, d):
    e = table(spark, d, "events").withColumn("key", F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMddHH")))
    return B.nearest_time_pairs(e, "key", "user_id", "ts").withColumn("seconds", F.round("seconds", 6))


@query(
    """WITH s AS (SELECT session_id, min(user_id) AS u0, min(repo_id) AS r FROM turn_log WHERE session_id IS NOT NULL GROUP BY session_id), v AS (SELECT session_id, CASE WHEN lower(u0) <> 'nan' THEN u0 END AS u, r FROM s),
    p AS (SELECT r, min(u) AS lo, max(u) AS hi FROM v WHERE u IS NOT NULL AND r IS NOT NULL GROUP BY r) SELECT session_id, coalesce(u, CASE WHEN lo IS NULL THEN v.r WHEN lo = hi THEN lo END) AS identity FROM v LEFT JOIN p USING (r)"""
)
def recovered_identities(spark, d):
    s = table(spark, d, "turn_log").where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.min("repo_id").alias("repo_id"))
    return B.recover_identity(s).select("session_id", "identity")


# --- reports, sidecars, sinks -------------------------------------------------------------------------------------------
@query(
    """SELECT source, count(*) AS docs, count(DISTINCT author_id) AS authors, round(avg(n_chars), 6) AS mean_turns, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, grouping(source) AS is_total
    FROM documents GROUP BY ROLLUP (source)"""
)
def build_summary(spark, d):
    s = B.summarize(table(spark, d, "documents"), turns="n_chars")
    return s.withColumn("mean_turns", F.round("mean_turns", 6))


@query()
def validate_invariants(spark, d):
    return B.violations(table(spark, d, "chat_docs"))


@query(
    """WITH l AS (SELECT doc_id, min({'s': label_status, 't': topic, 'j': subject}) AS x FROM label_topics GROUP BY doc_id)
    SELECT DISTINCT c.doc_id, x.s AS label_status, coalesce(x.s = 'labeled', false) AND trim(coalesce(x.t, '')) <> '' AND trim(coalesce(x.j, '')) <> '' AS usable FROM chat_docs c LEFT JOIN l USING (doc_id)"""
)
def topic_labels_join(spark, d):
    return R.attach_labels(table(spark, d, "chat_docs").select("doc_id"), table(spark, d, "label_topics"), "topic", "subject").select("doc_id", "label_status", "usable").distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def intersect_ids(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return t.intersect(table(spark, d, "documents").where("lang = 'en'").select("doc_id"))


@query("SELECT doc_id FROM chat_docs EXCEPT SELECT doc_id FROM label_topics")
def except_ids(spark, d):
    return table(spark, d, "chat_docs").select("doc_id").subtract(table(spark, d, "label_topics").select("doc_id"))


@query("SELECT author_id, source FROM chat_docs UNION ALL SELECT author_id, source FROM documents")
def union_sources(spark, d):
    return table(spark, d, "chat_docs").select("author_id", "source").unionByName(table(spark, d, "documents").select("author_id", "source"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def rollup_counts(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT coalesce(a.c_custkey, b.k) AS c_custkey, coalesce(b.total, a.c_acctbal) AS c_acctbal FROM customer a FULL JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) b ON a.c_custkey = b.k"""
)
def upsert_scores(spark, d):
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    return S.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey")


# --- n-grams ------------------------------------------------------------------------------------------------------------
_GRAMS = "SELECT doc_id AS id, unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS gram FROM documents WHERE length(text) >= 4"
_TFIDF = f"""c AS (SELECT id, gram, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c), g AS (SELECT gram, sum(tf) AS total, count(*) AS df FROM c GROUP BY gram ORDER BY total DESC, gram LIMIT 2000),
 t AS (SELECT id, gram, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN g USING (gram), n), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM t GROUP BY id), v AS (SELECT id, gram, w / norm AS w FROM t JOIN nm USING (id))"""


@query(f"SELECT gram, count(*) AS n FROM ({_GRAMS}) GROUP BY gram")
def char4_counts(spark, d):
    return X.gram_totals(table(spark, d, "documents"), "text")


@query(f"WITH {_TFIDF} SELECT id, round(sum(w), 5) AS total, count(*) AS grams FROM v GROUP BY id")
def tfidf_vectors(spark, d):
    v, _ = X.tfidf_of_texts(table(spark, d, "documents"), "doc_id", "text")
    return v.groupBy("id").agg(F.round(F.sum("w"), 5).alias("total"), F.count(F.lit(1)).alias("grams"))


@query(
    f"""WITH {_TFIDF} SELECT q, id, rank FROM (SELECT a.id AS q, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.w * b.w), 9) DESC, b.id) AS rank FROM v a JOIN v b ON a.gram = b.gram AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id) WHERE rank <= 5"""
)
def tfidf_cosine_search(spark, d):
    """The stated query set, ids divisible by 100, against all rows."""
    v, vocab = X.tfidf_of_texts(table(spark, d, "documents"), "doc_id", "text")
    v = cut(v)
    return X.cosines(v.where("id % 100 = 0"), v, vocab).select("q", "id", "rank")


@query()
def fragment_lift(spark, d):
    docs = table(spark, d, "chat_docs").where("author_id is not null").select("author_id", F.array_join("turns", "\n").alias("text")).distinct()
    c = docs.select(F.col("author_id").alias("id"), F.explode(X.word_bounded(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    c = cut(X.sublinear(c))
    pairs = B.interval_pairs(table(spark, d, "identity_intervals"), ["accept_language", "device_info", "country"])
    return X.author_lift(pairs, X.tfidf(c, X.vocabulary(c, ids=docs.select(F.col("author_id").alias("id")))))


# --- defenses -----------------------------------------------------------------------------------------------------------
def _chat(spark, d):
    return table(spark, d, "chat_docs").where(F.col("doc_id").isNotNull() & F.col("turns").isNotNull()).select("doc_id", "author_id", "turns").distinct()


@query(
    rf"""SELECT DISTINCT doc_id, list_transform(turns, lambda t: trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '{_WS}+', ' ', 'g'))) AS turns FROM chat_docs WHERE doc_id IS NOT NULL AND turns IS NOT NULL"""
)
def normalise_defense(spark, d):
    return D.apply("normalise", _chat(spark, d)).select("doc_id", "turns")


@query()
def normalise_defense_full(spark, d):
    """Every conversation, whatever its script."""
    return D.apply("normalise", _chat(spark, d)).select("doc_id", "turns")


@query()
def collision_seed_rewrite(spark, d):
    return D.apply("collisions", _chat(spark, d))


@query()
def frame_pad_rewrite(spark, d):
    return D.apply("frame_pad", _chat(spark, d))


@query()
def truncate_documents(spark, d):
    return D.apply("truncate", _chat(spark, d))


@query()
def protected_spans(spark, d):
    return D.spans(_chat(spark, d))


@query()
def defended_turn_export(spark, d):
    c = _chat(spark, d)
    return S.turn_export(c, D.apply("placeholders", c))


@query()
def defense_reuse(spark, d):
    c = _chat(spark, d)
    both = c.select("doc_id", F.array_join("turns", "\n").alias("a")).join(D.apply("collisions", c).select("doc_id", F.array_join("turns", "\n").alias("b")), "doc_id")
    return both.select("doc_id", F.round(T.ngram_reuse("a", "b"), 6).alias("reuse"), F.round(F.length("b") / F.greatest(F.length("a"), F.lit(1)), 6).alias("expansion"))


# --- utility ------------------------------------------------------------------------------------------------------------
@query(
    """WITH c AS (SELECT DISTINCT doc_id, turns FROM chat_docs WHERE turns IS NOT NULL), x AS (SELECT doc_id, len(turns) AS n FROM c) SELECT doc_id, n AS parts FROM x WHERE n > 0"""
)
def aligned_turn_pairs(spark, d):
    c = _chat(spark, d)
    return U.aligned_pairs(c, D.apply("normalise", c)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query(
    """WITH a AS (SELECT doc_id, count(*) AS a FROM chat_docs GROUP BY 1), b AS (SELECT doc_id, count(*) AS b FROM label_topics GROUP BY 1)
    SELECT CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'missing' WHEN a > 1 OR b > 1 THEN 'repeated' ELSE 'both' END AS status, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1"""
)
def key_alignment(spark, d):
    return U.key_alignment(table(spark, d, "chat_docs"), table(spark, d, "label_topics"))


@query("SELECT round(exp(avg(ln(l_extendedprice / l_quantity))), 4) AS geometric_mean, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 4) AS median, round(avg((l_extendedprice / l_quantity > 1.5)::INT::DOUBLE), 6) AS worse, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def fluency_aggregate(spark, d):
    f = U.fluency(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return f.select(F.round("geometric_mean", 4).alias("geometric_mean"), F.round("median", 4).alias("median"), F.round("worse", 6).alias("worse"), "n")


@query("SELECT round(avg(b.n_docs - a.n_docs), 6) AS mean_difference, count(*) AS n FROM (SELECT author_id, min(n_docs) AS n_docs FROM identity_intervals GROUP BY 1) a JOIN (SELECT author_id, max(n_docs) AS n_docs FROM identity_intervals GROUP BY 1) b USING (author_id) WHERE a.n_docs IS NOT NULL")
def paired_difference(spark, d):
    i = table(spark, d, "identity_intervals")
    a, b = i.groupBy("author_id").agg(F.min("n_docs").alias("n")), i.groupBy("author_id").agg(F.max("n_docs").alias("n"))
    return U.paired_difference(a, b, "author_id", "n").withColumn("mean_difference", F.round("mean_difference", 6))


@query()
def rendered_conversations(spark, d):
    return _chat(spark, d).select("doc_id", U.render_conversation("turns", 5000, 20_000).alias("text"))


@query()
def repetition_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", U.cut_repetition("text").alias("text"))


@query()
def rewrite_distance(spark, d):
    c = _chat(spark, d)
    both = U.aligned_pairs(c, D.apply("collisions", c))
    return both.select("doc_id", "part", F.round(U.word_edit_distance("original", "defended"), 6).alias("distance"))


@query()
def loo_unlink(spark, d):
    return unlink(_chat(spark, d))


@query()
def footprint_rewrite(spark, d):
    from ..operators.search import footprint_loop

    c = table(spark, d, "chat_docs").where(F.col("doc_id").isNotNull() & F.col("turns").isNotNull()).select("doc_id", "author_id", "turns", "ended_at").distinct()
    return footprint_loop(c, "ended_at", "doc_id")


@query()
def evolved_turn(spark, d):
    from ..operators.search import evolve_turn

    best = evolve_turn(_chat(spark, d), ["Thanks for all of it.", "The harbour is quiet and the lighthouse is dark tonight.", "0 1 2 3 4 5 6 7 8 9"], generations=1, children=4)
    return spark.createDataFrame(best, "turn string, fitness double").withColumn("fitness", F.round("fitness", 6))


@query("SELECT source, language_primary AS language, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, language_primary) AS rank FROM (SELECT source, language_primary, count(*) AS n FROM chat_docs WHERE language_primary IS NOT NULL GROUP BY ALL)) WHERE rank <= 12")
def language_report(spark, d):
    return B.language_table(table(spark, d, "chat_docs"))


@query("SELECT count(t) AS docs, round(avg(t), 6) AS mean, quantile_cont(t, 0.5)::DOUBLE AS median, quantile_cont(t, 0.95)::DOUBLE AS p95, max(t) AS most, sum(t)::BIGINT AS total FROM (SELECT CAST(round_even(list_sum(list_transform(turns, lambda x: length(coalesce(x, '')))) / 4.0, 0) AS BIGINT) AS t FROM chat_docs WHERE len(turns) > 0)")
def token_report(spark, d):
    return T.token_summary(table(spark, d, "chat_docs").where(F.size("turns") > 0)).withColumn("mean", F.round("mean", 6))


@query("WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)```.*?```|`[^`\n]+`') AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(s) = 0 THEN 'no code' WHEN len(list_filter(s, lambda x: NOT contains(lower(text), x))) = 0 THEN 'kept' ELSE 'changed' END AS code FROM c")
def code_kept_lowered(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    kept = T.code_kept("text", F.lower("text"))
    return t.select("doc_id", F.when(kept.isNull(), "no code").when(kept, "kept").otherwise("changed").alias("code"))
