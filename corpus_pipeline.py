"""A training-data pipeline of five stages; each works on all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns the token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import digests
from corpusloom.llm.common import DOC_COLUMNS, read, texts
from corpusloom.llm.decontaminate import find_contamination
from corpusloom.llm.language import identify, model, train, training_rows
from corpusloom.llm.near_dups import keep_one
from corpusloom.llm.pii import sanitise
from corpusloom.operators.graph import checkpointed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without one (no text, no letters) go."""
    trained = model(train(training_rows(docs)))
    found = identify(docs, trained, keep=[F.col(c) for c in DOC_COLUMNS])
    return found.where(F.col("lang_pred") != "und").select(*DOC_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; null and empty texts are one group."""
    return keep_one(docs.select(*DOC_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others any benchmark passage is cut out. Null and empty texts stay as they are."""
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"), keep=DOC_COLUMNS, cut=True).where(~F.col("contaminated"))
    clean = found.withColumn("text", F.col("clean_text"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*DOC_COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that give it away, masked, generalised or removed. Null and empty texts stay as they are."""
    out = sanitise(docs.select(*DOC_COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and their decoding, as digests; null and empty texts have no ids."""
    return digests(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express language ID, SimHash components and tokenising.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
