"""Queries of the nine training-data problems; production parameters, whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship, table
from . import bpe, language, mixing, neardup, neighbours, personal, quality, residue, subjects

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.found_pairs(table(spark, sf_dir, "doc_vectors"))


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


@query
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found_pairs(table(spark, sf_dir, "chat_docs"))


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(*mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found_forms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found_turns(table(spark, sf_dir, "chat_docs"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found_languages(table(spark, sf_dir, "chat_docs"), table(spark, sf_dir, "common_words"))


@query
def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_stretches(table(spark, sf_dir, "chat_docs"), table(spark, sf_dir, "common_words"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_items(table(spark, sf_dir, "chat_docs"))


@query
def p2_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.sanitised_turns(table(spark, sf_dir, "chat_docs"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found_areas(table(spark, sf_dir, "chat_docs"), table(spark, sf_dir, "label_topics"), table(spark, sf_dir, "subject_areas"))


# the two searches on small tables by comparing everything; SQL knows nothing of the operators' methods
ORACLES["p3_found"] = """
WITH v AS (
  SELECT doc_id, any_value(features)::DOUBLE[] AS x FROM doc_vectors
  WHERE doc_id IS NOT NULL AND len(features) = 96 AND len(list_filter(features, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(features, lambda a: a <> 0)) > 0
  GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(list_cosine_similarity(a.x, b.x), 12) AS s FROM v a JOIN v b ON a.doc_id <> b.doc_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p)
SELECT DISTINCT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM r WHERE r <= 5"""
ORACLES["p6_found"] = r"""
WITH d AS (SELECT doc_id, any_value(turns) AS t FROM chat_docs WHERE doc_id IS NOT NULL AND turns IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(lower(array_to_string(list_filter(t, lambda x: x IS NOT NULL), chr(10) || chr(10))), '[\pL\pN]+') AS w FROM d),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 70),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 5 * k >= 3 * (x.n + y.n - k)"""
