"""Queries of summary provenance: a summary is a sentence lifted from its document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import provenance as pv
from corpusloom.plans.registry import query
from corpusloom.plans.relations import spread, table

PICK = "CASE WHEN doc_id % 4 = 0 THEN 'Nothing zzqx here wholly unrelatedzz qqwv.' ELSE trim(regexp_extract(text, '[A-Z][^.!?\\n]{60,120}\\.')) END"


def picked(spark, sf):
    """Every document with a sentence of its own, or one of no document; no such sentence: an empty summary."""
    pick = F.trim(F.regexp_extract("text", r"[A-Z][^.!?\n]{60,120}\.", 0))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "Nothing zzqx here wholly unrelatedzz qqwv.").otherwise(pick).alias("summary"), F.col("text").alias("source_text"))


#: A summary without sentences has no alignments.
D = f"d AS (SELECT doc_id AS id, {PICK} AS summary FROM documents WHERE {PICK} <> '')"


@query("align_summary", f"WITH {D} SELECT id, CASE WHEN id % 4 = 0 THEN 'none' ELSE 'strong' END AS support, true AS sliced FROM d")
def align_summary(spark, sf):
    p = picked(spark, sf)
    a = pv.alignments(p).join(p.select("id", "source_text"), "id")
    cut = F.expr("substring(source_text, start + 1, end - start)")
    return a.select("id", "support", F.when(F.col("start") < 0, F.col("matched_text") == "").otherwise(cut == F.col("matched_text")).alias("sliced"))


@query("coverage_report", f"WITH {D} SELECT id, CAST(1 AS BIGINT) AS sentences, CASE WHEN id % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage FROM d")
def coverage_report(spark, sf):
    return pv.coverage(pv.alignments(picked(spark, sf))).select("id", "sentences", "coverage")


@query("trace_entries", f"SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 OR coalesce({PICK}, '') = '' THEN 'no_summary' WHEN doc_id % 7 = 0 THEN 'no_source_text' END AS reason, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND {PICK} <> '' THEN CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END END::DOUBLE AS coverage FROM documents")
def trace_entries(spark, sf):
    d = picked(spark, sf).selectExpr("id", "CASE WHEN id % 5 = 0 THEN ' ' ELSE summary END AS summary", "CASE WHEN id % 7 = 0 THEN '' ELSE source_text END AS source_text")
    return pv.trace(d).select("id", "reason", "coverage")


@query("trace_all_entries")
def trace_all_entries(spark, sf):
    """Every document traced in itself, sentence by sentence: the dearest form of ``trace_entries``."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).selectExpr("doc_id AS id", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS summary", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS source_text")
    return pv.trace(d).select("id", "reason", "sentences", "coverage")
