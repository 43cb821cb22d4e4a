"""Queries over vectors: search, joins, groups, hybrid ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import similarity as sim
from corpusloom.plans.registry import query
from corpusloom.plans.relations import table

QUERY_ID = 7
VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
DOT = "list_dot_product"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding", "label")


def query_vector(spark, sf) -> list[float]:
    return vectors(spark, sf).where(F.col("id") == QUERY_ID).first()["embedding"]  # the query itself: one row


ONE = f"(SELECT e FROM v WHERE id = {QUERY_ID})"


@query("top_k", f"WITH {VEC} SELECT id, round({DOT}(e, {ONE}), 6) AS similarity FROM v ORDER BY {DOT}(e, {ONE}) DESC, id LIMIT 10")
def top_k(spark, sf):
    return sim.top_k(vectors(spark, sf), query_vector(spark, sf), 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("semantic_search", f"WITH {VEC} SELECT id, round({DOT}(e, {ONE}), 3) AS similarity FROM v WHERE {DOT}(e, {ONE}) >= 0.2 ORDER BY {DOT}(e, {ONE}) DESC, id LIMIT 20")
def semantic_search(spark, sf):
    return sim.top_k(vectors(spark, sf), query_vector(spark, sf), 20, floor=0.2).select("id", F.round("similarity", 3).alias("similarity"))


@query("link_candidates", f"WITH {VEC} SELECT id, round({DOT}(e, {ONE}), 6) AS similarity FROM v WHERE id <> {QUERY_ID} AND {DOT}(e, {ONE}) >= 0.25 ORDER BY {DOT}(e, {ONE}) DESC, id LIMIT 5")
def link_candidates(spark, sf):
    return sim.top_k(vectors(spark, sf).where(F.col("id") != QUERY_ID), query_vector(spark, sf), 5, floor=0.25).select("id", F.round("similarity", 6).alias("similarity"))


PAIRS = f"p AS (SELECT a.id AS a, b.id AS b, {DOT}(a.e, b.e) AS s FROM v a JOIN v b ON a.id < b.id WHERE {DOT}(a.e, b.e) >= 0.4)"


@query("similarity_join", f"WITH {VEC}, {PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p")
def similarity_join(spark, sf):
    return sim.similarity_join(vectors(spark, sf), 0.4, block_rows=200).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("duplicate_groups", f"WITH RECURSIVE {VEC}, {PAIRS}, e2 AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(n, m) AS (SELECT a, a FROM e2 UNION SELECT r.n, e2.b FROM r JOIN e2 ON r.m = e2.a), g AS (SELECT n AS id, min(m) AS group_id FROM r GROUP BY n) SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM g")
def duplicate_groups(spark, sf):
    return sim.duplicate_groups(vectors(spark, sf), 0.4).select("id", "group_id", "size")


@query("canvas_neighbours", f"WITH {VEC}, p AS (SELECT a.id AS id, b.id AS other, {DOT}(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id WHERE {DOT}(a.e, b.e) > 0.35), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM p) SELECT id, other, rank FROM r WHERE rank <= 5", ints=("rank",))
def canvas_neighbours(spark, sf):
    return sim.neighbours(vectors(spark, sf), block_rows=150).select("id", "other", "rank")


@query("hybrid_search", f"WITH {VEC}, k AS (SELECT id FROM v WHERE id % 9 = 0), s AS (SELECT id, {DOT}(e, {ONE}) AS sim FROM v WHERE {DOT}(e, {ONE}) >= 0.1) SELECT coalesce(k.id, s.id) AS id, round(CASE WHEN k.id IS NULL THEN sim WHEN s.id IS NULL THEN 1 ELSE 1 + sim END, 6) AS score, CASE WHEN k.id IS NULL THEN 'semantic' WHEN s.id IS NULL THEN 'keyword' ELSE 'both' END AS match_type FROM k FULL OUTER JOIN s ON k.id = s.id")
def hybrid_search(spark, sf):
    v = vectors(spark, sf)
    semantic = v.select("id", sim.dot(F.col("embedding"), sim.query_literal(query_vector(spark, sf))).alias("similarity")).where("similarity >= 0.1")
    return sim.hybrid_search(v.where("id % 9 = 0"), semantic).select("id", F.round("score", 6).alias("score"), "match_type")


@query("passages", f"WITH {VEC}, r AS (SELECT id % 20 AS doc_id, id, row_number() OVER (PARTITION BY id % 20 ORDER BY {DOT}(e, {ONE}) DESC, id) AS rank FROM v) SELECT doc_id, id, rank FROM r WHERE rank <= 4", ints=("rank",))
def passages(spark, sf):
    chunks = vectors(spark, sf).withColumn("doc_id", F.col("id") % 20)
    return sim.passages(chunks, query_vector(spark, sf)).select("doc_id", "id", "rank")


@query("clusters")
def clusters(spark, sf):
    return sim.clusters(vectors(spark, sf))


@query("candidate_join")
def candidate_join(spark, sf):
    return sim.candidate_join(vectors(spark, sf), 0.4)
