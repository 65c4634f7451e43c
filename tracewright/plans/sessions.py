"""Queries of coding sessions, user agents and languages of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import languages as G
from ..operators import sessions as S
from ..runtime import table
from .registry import query


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _without(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, {_sql(pattern)}, '', 'g')"


#: A log with distinct turn ids in order, as SQL; failed answers of the agent don't count.
_LOG = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY loaded_at DESC NULLS LAST, session_id, turn_number) AS rd FROM turn_log) WHERE rd = 1 AND turn_id IS NOT NULL AND session_id IS NOT NULL),
a AS (SELECT *, coalesce(sum((turn_type IN ('agent_message', 'tool_call'))::INT) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM l)"""
_BODY = "(starts_with(content, 'Base directory for this skill:') OR contains(content, '<manually_attached_skills>') OR contains(content, 'Execute the following steps non-interactively'))"
_PURE = f"contains(content, '<command-name>') AND trim({_without(_without(_without('content', '(?s)<command-name>.*?</command-name>'), '(?s)<command-message>.*?</command-message>'), '(?s)<command-args>.*?</command-args>')}, ' ' || chr(9) || chr(10) || chr(13)) = ''"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TYPED = f"""trim(regexp_extract(content, '(?s)<command-name>(.*?)</command-name>', 1), {_BLANK})"""
_ARGS = f"""trim(regexp_extract(content, '(?s)<command-args>(.*?)</command-args>', 1), {_BLANK})"""
_PROMPTS = f"""{_LOG}, p0 AS (SELECT session_id, turn_number, turn_id, cum, {_PURE} AS cmd, content FROM a WHERE turn_type = 'user_prompt' AND content IS NOT NULL AND NOT {_BODY}),
p1 AS (SELECT * REPLACE (CASE WHEN cmd THEN trim(concat_ws(' ', CASE WHEN starts_with({_TYPED}, '/') THEN {_TYPED} ELSE '/' || {_TYPED} END, CASE WHEN {_ARGS} <> '' THEN {_ARGS} END), {_BLANK}) ELSE content END AS content),
  coalesce(cum > lag(cum) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id), false) AS ab FROM p0),
p2 AS (SELECT *, NOT cmd AND starts_with(ltrim(content, {_BLANK}), '#') AS md FROM p1), p3 AS (SELECT *, md AND coalesce(lag(md) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id), false) AND NOT ab AS joins FROM p2),
p4 AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY session_id ORDER BY turn_number, turn_id) AS run FROM p3),
m AS (SELECT session_id, run, min(struct_pack(n := turn_number, i := turn_id)) AS place, string_agg(content, chr(10) || chr(10) ORDER BY turn_number, turn_id) AS content, arg_min(cmd, struct_pack(n := turn_number, i := turn_id)) AS cmd, arg_min(ab, struct_pack(n := turn_number, i := turn_id)) AS ab FROM p4 GROUP BY session_id, run)"""


def _reasons(t: str, s: str) -> str:
    how = {"begins": f"starts_with({s}, {{}})", "begins in any case": f"starts_with(lower({s}), {{}})", "holds": f"contains({t}, {{}})"}
    lines = [f"WHEN {t} = '' THEN 'empty'"]
    lines += [f"WHEN {' OR '.join(how[kind].format(_sql(x)) for x in texts)} THEN '{reason}'" for reason, kind, texts in T.INJECTED]
    return "CASE " + " ".join([*lines, f"WHEN regexp_matches({s}, {_sql(T._SCAFFOLD)}) THEN 'scaffolding'", f"WHEN (starts_with({s}, '#') OR starts_with({s}, '**')) AND contains({s}, chr(10) || chr(10)) THEN 'markdown-body'", f"WHEN length({t}) >= 8000 THEN 'too-long'"]) + " END"


def _stripped(c: str) -> str:
    for p in T.WRAPPERS:
        c = _without(c, p)
    return c


_TEXT = f"""{_PROMPTS}, t0 AS (SELECT *, {_stripped('content')} AS x FROM m), t1 AS (SELECT *, CASE WHEN regexp_matches(x, {_sql(T.REVIEW)}) THEN regexp_extract(x, {_sql(T.REVIEW)}, 1) ELSE x END AS y FROM t0),
t2 AS (SELECT *, CASE WHEN cmd THEN content ELSE trim({_without(f"ltrim({_without('y', T.REMINDER)}, {_BLANK})", T.LEADING)}, {_BLANK}) END AS text FROM t1),
t3 AS (SELECT *, CASE WHEN cmd THEN CASE WHEN length(content) >= 8000 THEN 'too-long' END ELSE {_reasons('text', f'ltrim(text, {_BLANK})')} END AS own FROM t2),
t4 AS (SELECT *, NOT cmd AND own IS NULL AND NOT ab AND (regexp_matches(ltrim(text, {_BLANK}), {_sql(T.CONTINUES)}) OR length(text) >= 500) AS dep FROM t3),
t5 AS (SELECT *, last_value(CASE WHEN NOT dep THEN cmd OR own IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM t4)"""


def _log(spark, d):
    return B.latest_delivery(table(spark, d, "turn_log")).where(F.col("turn_id").isNotNull() & F.col("session_id").isNotNull())


def _human(spark, d):
    return S.human_prompts(S.merged_markdown(S.user_prompts(_log(spark, d))))


@query(f"WITH {_TEXT} SELECT place.i AS turn_id, coalesce(own, CASE WHEN dep AND coalesce(carried, false) THEN 'continuation' END) AS reason, length(text)::INT AS n FROM t5")
def human_prompt_filter(spark, d):
    """Every prompt of the log, with the reason it isn't a human's."""
    return _human(spark, d).select("turn_id", "reason", F.length("text").alias("n"))


@query(
    f"""WITH {_TEXT}, k AS (SELECT session_id, place, text, ab FROM t5 WHERE own IS NULL AND NOT (dep AND coalesce(carried, false))),
    g AS (SELECT *, text <> '' AND coalesce(text = lag(text) OVER (PARTITION BY session_id ORDER BY place), false) AS again FROM k), c AS (SELECT text, count(*) AS n, count(DISTINCT session_id) AS docs FROM g WHERE again GROUP BY text)
    SELECT place.i AS turn_id FROM g LEFT JOIN c USING (text) WHERE NOT again OR NOT (NOT ab OR length(text) >= 1000 OR regexp_matches(text, {_sql(T._SCAFFOLD)}) OR (c.n >= 5 AND c.docs = 1))"""
)
def prompts_without_repeats(spark, d):
    return S.without_repeats(_human(spark, d).where("reason is null")).select("turn_id")


@query()
def session_turns(spark, d):
    return S.session_turns(table(spark, d, "turn_log")).select("session_id", "turn_number", "turn_id", "text")


@query("WITH t AS (SELECT doc_id, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM (SELECT DISTINCT doc_id, turns FROM chat_docs WHERE turns IS NOT NULL)), r AS (SELECT t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p, i FROM t) SELECT coalesce(max(length(t)), 0)::INT AS longest FROM r WHERE t = p AND t <> ''")
def surviving_repeats(spark, d):
    return S.surviving_repeats(table(spark, d, "chat_docs").select("doc_id", "turns").distinct()).select("longest")


_AGENT = "device_info IS NULL OR trim(device_info) = '' OR starts_with(ltrim(device_info), '{') OR regexp_matches(device_info, " + _sql(T._MALFORMED_AGENT) + ") OR regexp_matches(device_info, " + _sql(T._PROGRAM_AGENT) + ")"


@query(f"SELECT author_id, coalesce({_AGENT} OR NOT contains(device_info, ';') OR lower(trim(split_part(device_info, ';', 1))) IN ({', '.join(map(_sql, T.PROGRAM_CLIENTS))}), true) AS program, count(*) AS n FROM identity_intervals GROUP BY ALL")
def program_clients(spark, d):
    t = table(spark, d, "identity_intervals").select("author_id", T.is_program("device_info", "device_info").alias("program"))
    return t.groupBy("author_id", "program").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substring(regexp_replace(text, '\\s+', ' ', 'g'), 1, 160) AS sample FROM documents WHERE text IS NOT NULL")
def sample_prompts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.sample_prompt("text").alias("sample"))


# --- languages ----------------------------------------------------------------------------------------------------------
_CONF = """cw AS (SELECT DISTINCT lower(lang) AS lang, lower(word) AS word FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL), tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lang, count(*) AS n FROM tk JOIN cw USING (word) GROUP BY ALL), conf AS (SELECT doc_id, lang, n / sum(n) OVER (PARTITION BY doc_id) AS value FROM h)"""


def _confidences(spark, d):
    return G.word_confidences(table(spark, d, "documents"), table(spark, d, "common_words"), "doc_id", "text", "[a-z]+")


@query(f"WITH {_CONF} SELECT doc_id, lang, round(value, 9) AS value FROM conf")
def language_confidences(spark, d):
    return _confidences(spark, d).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {_CONF}, top AS (SELECT doc_id, first(lang ORDER BY round(value, 12) DESC, lang) AS top, max(value) AS tv FROM conf GROUP BY doc_id), voc AS (SELECT DISTINCT lang FROM conf), cnt AS (SELECT top AS lang, count(*) AS c FROM top WHERE tv >= 0.5 GROUP BY 1),
    prior AS (SELECT lang, (coalesce(c, 0) + 1.0) / ((SELECT coalesce(sum(c), 0) FROM cnt) + (SELECT count(*) FROM voc)) AS pr FROM voc LEFT JOIN cnt USING (lang)), post AS (SELECT doc_id, lang, value * pr / sum(value * pr) OVER (PARTITION BY doc_id) AS p FROM conf JOIN prior USING (lang)),
    bp AS (SELECT doc_id, first(lang ORDER BY round(p, 12) DESC, lang) AS pl, max(p) AS pv FROM post GROUP BY doc_id),
    r AS (SELECT d.doc_id, CASE WHEN tv >= 0.5 THEN top WHEN d.lang = top THEN top WHEN pv >= 0.5 THEN pl WHEN d.lang IS NOT NULL THEN d.lang ELSE 'en' END AS language_primary, CASE WHEN tv >= 0.5 THEN 'confident' WHEN d.lang = top THEN 'agree' WHEN pv >= 0.5 THEN 'prior' WHEN d.lang IS NOT NULL THEN 'fallback' ELSE 'default' END AS step
      FROM documents d LEFT JOIN top ON d.doc_id = top.doc_id LEFT JOIN bp ON d.doc_id = bp.doc_id)
    SELECT r.doc_id, language_primary, step, CASE WHEN step IN ('confident', 'agree', 'prior') THEN (SELECT first(lang ORDER BY round(p, 12) DESC, lang) FROM post WHERE post.doc_id = r.doc_id AND lang <> language_primary AND p >= 0.3) END AS language_secondary FROM r"""
)
def languages_observed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("upstream"))
    return G.observed(docs, _confidences(spark, d), default="en")


@query(
    f"""WITH {_CONF}, own AS (SELECT doc_id, value AS ov FROM conf JOIN documents d USING (doc_id) WHERE conf.lang = d.lang), best AS (SELECT conf.doc_id, first(conf.lang ORDER BY round(value, 12) DESC, conf.lang) AS l, max(value) AS v FROM conf JOIN documents d ON conf.doc_id = d.doc_id WHERE d.lang IS NOT NULL AND conf.lang <> d.lang GROUP BY conf.doc_id)
    SELECT d.doc_id, CASE WHEN ov >= 0.05 AND v >= 0.3 THEN l END AS language_secondary FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN best ON d.doc_id = best.doc_id"""
)
def languages_secondary(spark, d):
    return G.secondary(table(spark, d, "documents").select("doc_id", F.col("lang").alias("primary")), _confidences(spark, d))


@query()
def languages_by_script(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return G.by_script(docs, G.word_confidences(table(spark, d, "documents"), table(spark, d, "common_words"), "doc_id", "text"))


@query()
def script_runs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", G.script_runs("text", "Cyrillic").alias("cyrillic"), G.script_runs("text", "Han").alias("han"))
