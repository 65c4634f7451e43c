"""Queries of frames, habits, rewriting guards, lists for judges, runs and features of parts of speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attacks as A
from ..operators import defenses as D
from ..operators import frames as R
from ..operators import habits as H
from ..operators import lists as I
from ..operators import ranking as K
from ..operators import runs as U
from ..runtime import cut, table
from .attribution import _S, scored, sides
from .registry import query


def _chat(spark, d):
    c = table(spark, d, "chat_docs").where("doc_id is not null and turns is not null")
    return c.select("doc_id", "author_id", "turns").dropDuplicates(["doc_id"])


@query()
def scene_manifest(spark, d):
    return R.scene_manifest(_chat(spark, d))


@query()
def frame_shift_rewrite(spark, d):
    return R.shift(_chat(spark, d), lambda label, text: "As in " + label + ": " + text)


@query()
def pad_manifest(spark, d):
    return R.pad_manifest(_chat(spark, d), R.rule_bank(spark))


@query()
def bank_quality(spark, d):
    return R.bank_quality(R.rule_bank(spark))


@query()
def habit_manifest(spark, d):
    return H.manifest(_chat(spark, d))


@query()
def habit_audit(spark, d):
    return H.audit(_chat(spark, d)).select("marker", "pool", F.round("base_rate", 9).alias("base_rate"), F.round("trigger_rate", 9).alias("trigger_rate"))


@query("SELECT doc_id, CASE WHEN length(t.topic) IS NOT NULL THEN t.topic END AS turn FROM (SELECT doc_id, min(topic) AS topic FROM label_topics WHERE doc_id IS NOT NULL GROUP BY doc_id) t JOIN (SELECT DISTINCT doc_id FROM chat_docs WHERE doc_id IS NOT NULL AND turns IS NOT NULL) c USING (doc_id) WHERE trim(coalesce(t.topic, '')) <> ''")
def appended_turns(spark, d):
    made = table(spark, d, "label_topics").where("doc_id is not null").select("doc_id", F.col("topic").alias("turn"))
    c = _chat(spark, d)
    out = R.append_turns(c, made).join(c.select("doc_id", F.size("turns").alias("n")), "doc_id").where(F.size("turns") > F.col("n"))
    return out.select("doc_id", F.element_at("turns", -1).alias("turn"))


@query("SELECT DISTINCT subject, CASE WHEN contains(subject, chr(10)) OR trim(subject) <> subject THEN 'not a single trimmed line' WHEN length(subject) NOT BETWEEN 10 AND 160 THEN 'length band' WHEN regexp_matches(subject, '[^\\x00-\\x7f]') THEN 'non-ASCII' WHEN NOT regexp_full_match(subject, '[^,.;:!?]{6,}, [^,.;:!?]{3,}, [^,.;:!?]{3,} and [^,.;:!?]{3,}') THEN 'wrong shape' END AS reason FROM label_topics WHERE subject IS NOT NULL")
def topic_rejections(spark, d):
    t = table(spark, d, "label_topics").where("subject is not null").select("subject").distinct()
    return t.select("subject", R.topic_rejection("subject", least=10).alias("reason"))


@query("WITH c AS (SELECT doc_id, any_value(turns) AS t FROM chat_docs WHERE doc_id IS NOT NULL AND turns IS NOT NULL GROUP BY doc_id), s AS (SELECT doc_id, coalesce(list_sum(list_transform(t, lambda x: coalesce(length(x), 0))), 0) AS a FROM c) SELECT doc_id, a = 0 OR 2 * a BETWEEN 0.5 * a AND 2.0 * a AS fits FROM s")
def admissible_doubles(spark, d):
    c = _chat(spark, d)
    return c.select("doc_id", R.admissible(F.transform("turns", lambda t: F.concat(t, t)), F.col("turns")).alias("fits"))


@query()
def word_mechanism(spark, d):
    words = spark.createDataFrame([("good", w, s) for w, s in (("fine", 1.0), ("nice", 0.9), ("poor", 0.1))] + [("make", w, s) for w, s in (("build", 1.0), ("do", 0.4))], "word string, candidate string, score double")
    return R.word_mechanism(_chat(spark, d), words, epsilon=10.0)


# --- lists --------------------------------------------------------------------------------------------------------------
@query()
def presented_lists(spark, d):
    return I.present(K.shortlist(scored(spark, d)[0], 5).select("q", "label", "slot"))


@query(f"WITH {_S}, r AS (SELECT q, label, author, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS slot FROM s) SELECT q, label, slot, slot AS shown, CASE WHEN slot = 4 THEN 0 ELSE slot + 1 END AS given, label = author AS is_true FROM r WHERE slot < 5")
def judged_lists(spark, d):
    """The last candidate is put first by the judge, who names no other one."""
    s, t = scored(spark, d)
    shown = I.present(K.shortlist(s, 5).select("q", "label", "slot"), shuffle=False)
    orders = shown.select("q").distinct().select("q", F.array(F.lit(4)).alias("ranking"))
    return I.detail(shown, orders, t)


@query()
def reranked_lists(spark, d):
    s, t = scored(spark, d)
    ev = K.shortlist(s, 5).select("q", "label", F.col("q").cast("string").alias("query_text"), F.col("label").cast("string").alias("known_text"))
    return I.rerank(s, ev, lambda a, b: (a.str[-1] == b.str[-1]).astype(float)).withColumn("score", F.round("score", 6))


@query()
def text_windows(spark, d):
    return I.windows(_chat(spark, d), 64)


@query()
def author_excerpts(spark, d):
    c = table(spark, d, "chat_docs").where("doc_id is not null and turns is not null").dropDuplicates(["doc_id"])
    return I.excerpts(I.windows(c, 64), c, 8)


@query("SELECT DISTINCT c.doc_id, v.doc_id IS NOT NULL AS has FROM chat_docs c LEFT JOIN (SELECT DISTINCT doc_id FROM doc_vectors WHERE features IS NOT NULL AND len(features) = 96) v ON c.doc_id = v.doc_id WHERE c.doc_id IS NOT NULL")
def label_vector_rows(spark, d):
    v = table(spark, d, "doc_vectors").where("size(features) = 96").select("doc_id", F.transform("features", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))).alias("vec"))
    out = I.label_vectors(table(spark, d, "chat_docs").where("doc_id is not null"), v, 96)
    return out.select("doc_id", (~F.isnan(F.get("vec", F.lit(0)))).alias("has"))


@query()
def pos_features(spark, d):
    return I.pos_features(table(spark, d, "documents"))


@query()
def embedded_turns(spark, d):
    import pandas as pd

    docs = table(spark, d, "documents").select("doc_id", "text")
    return I.embedded(docs, lambda x: pd.Series([[float(len(t)), float(t.count(" "))] for t in x])).select("doc_id", "vec")


# --- runs ---------------------------------------------------------------------------------------------------------------
@query()
def run_cell(spark, d):
    k, u = sides(spark, d, strangers=True)
    return U.cell(k, u, "centroid")[1]


@query()
def run_grid(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("author"), F.col("embedding").alias("vec"))
    return U.grid(e, {"known0075": (0.0, 0.75), "known2575": (0.25, 0.75)}, {"centroid": {}})[1]


@query()
def halving_search(spark, d):
    k, _ = sides(spark, d)
    return U.halving_search(k, [{"linkage": "mean"}, {"linkage": "max"}], A.nearest)


@query("SELECT doc_id, lang, source FROM documents WHERE lower(lang) = 'en' AND lower(source) = 'wildchat'")
def filtered_documents(spark, d):
    return U.filter_documents(table(spark, d, "documents"), lang="EN", source="WildChat").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents WHERE created_at >= TIMESTAMP '2024-07-01' AND author_id NOT IN (SELECT author_id FROM documents WHERE created_at < TIMESTAMP '2024-07-01' AND author_id IS NOT NULL)")
def unseen_scope(spark, d):
    t = table(spark, d, "documents").where("author_id is not null")
    cut_at = F.to_timestamp(F.lit("2024-07-01"))
    return U.scoped(t.where(F.col("created_at") >= cut_at), t.where(F.col("created_at") < cut_at), "unseen").select("doc_id")


@query("SELECT ts, event_id AS tokens, (SELECT sum(event_id) FROM events x WHERE x.ts > e.ts - INTERVAL 60 SECOND - INTERVAL 1 MICROSECOND AND x.ts <= e.ts) AS in_window FROM events e")
def requests_in_window(spark, d):
    return U.requests_in_window(table(spark, d, "events"), tokens="event_id").select("ts", "tokens", "in_window")


@query()
def cached_outputs(spark, d):
    items = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("source"))
    cache = items.where("id < '5'").withColumn("output", F.upper(F.substring("source", 1, 5)))
    out, new = U.cached_rows(items, cut(cache), lambda s: s.withColumn("output", F.upper(F.substring("source", 1, 5))))
    return out.select("id", "output")


@query("SELECT doc_id, text FROM (SELECT doc_id, regexp_replace(text, 'zzz', '') AS text FROM documents WHERE text IS NOT NULL)")
def spliced_texts(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    at = F.transform(F.filter(F.array(F.instr("text", "zzz")), lambda i: i > 0), lambda i: F.struct((i - 1).alias("start"), (i + 2).alias("stop"), F.lit("").alias("new")))
    return t.select("doc_id", T.apply_edits("text", at).alias("text"))
