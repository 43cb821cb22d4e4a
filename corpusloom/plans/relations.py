"""The engine's relations projected from the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL = 4_000_000  # bytes a core, up to which a table may lie in too few pieces


def spread(df: DataFrame) -> DataFrame:
    """A small table, which may be a single piece, dealt to all cores, for what takes long by the row; larger ones have pieces enough. What
    takes long is Python, which gets it in batches of bounded size."""
    bounded(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL * cores else df


PIECE = 8_000_000  # bytes of a stored table


def pieces(df: DataFrame) -> DataFrame:
    """A table's rows in pieces of bounded size, for tasks that hold most of what they make of theirs: a stored piece may have 128 MB or more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE)))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document relation."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id AS id",
        "doc_id % 5 AS user_id",
        "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'article' WHEN doc_id % 4 = 1 THEN 'pdf' WHEN doc_id % 4 = 2 THEN 'youtube' ELSE 'text' END AS source_type",
        "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('https://', source, '.example.com/', CAST(doc_id AS STRING)) END AS source_ref",
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Title ', CAST(doc_id AS STRING)) END AS title",
        "text AS summary",
        "CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS source_text",
        "concat(lang, ', ', upper(source), ',,', lang) AS tags",
        "CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_archived",
        "doc_id % 9 = 0 AS is_pinned",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST((doc_id * 97) % 40000 AS INT), 0) AS created_at",
    )


ENTRIES = """entries AS (SELECT doc_id AS id, doc_id % 5 AS user_id,
 CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'article' WHEN doc_id % 4 = 1 THEN 'pdf' WHEN doc_id % 4 = 2 THEN 'youtube' ELSE 'text' END AS source_type,
 CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('https://', source, '.example.com/', CAST(doc_id AS VARCHAR)) END AS source_ref,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Title ', CAST(doc_id AS VARCHAR)) END AS title,
 text AS summary, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS source_text,
 concat(lang, ', ', upper(source), ',,', lang) AS tags,
 CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_archived, doc_id % 9 = 0 AS is_pinned,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 97) % 40000 AS BIGINT)) AS created_at FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between customers, one per order."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS from_id", "(o_custkey * 7 + o_orderkey) % 150 + 1 AS to_id", "o_orderstatus AS relationship_type", "o_orderkey % 100 / 100.0D AS similarity")


EDGES = "edges AS (SELECT o_orderkey AS id, o_custkey AS from_id, (o_custkey * 7 + o_orderkey) % 150 + 1 AS to_id, o_orderstatus AS relationship_type, CAST(o_orderkey % 100 AS DOUBLE) / 100.0 AS similarity FROM orders)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashcards from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", "1.3D + (event_id % 13) / 10.0D AS ease_factor", "CAST(event_id % 40 AS INT) AS interval_days", "CAST(event_id % 5 AS INT) AS repetitions", "ts AS next_review_at", "CAST(event_id % 6 AS INT) AS quality"
    )


CARDS = "cards AS (SELECT event_id AS id, user_id, 1.3::DOUBLE + CAST(event_id % 13 AS DOUBLE) / 10.0::DOUBLE AS ease_factor, CAST(event_id % 40 AS INT) AS interval_days, CAST(event_id % 5 AS INT) AS repetitions, ts AS next_review_at, CAST(event_id % 6 AS INT) AS quality FROM events)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading sessions from events: one per event, in event order."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", "150.0D + (event_id * 37) % 400 AS wpm", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((event_id * 13) % 101) / 100.0D END AS comprehension", "CAST((event_id * 29) % 900 AS BIGINT) AS words_read", "1000.0D * ((event_id * 53) % 600) AS duration_ms", "event_id % 3 <> 0 AS completed", "ts AS created_at"
    )


SESSIONS = "sessions AS (SELECT event_id AS id, user_id, 150.0::DOUBLE + (event_id * 37) % 400 AS wpm, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id * 13) % 101 AS DOUBLE) / 100.0::DOUBLE END AS comprehension, CAST((event_id * 29) % 900 AS BIGINT) AS words_read, 1000.0::DOUBLE * ((event_id * 53) % 600) AS duration_ms, event_id % 3 <> 0 AS completed, ts AS created_at FROM events)"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicated edits from events: LWW fields, set adds and removes, entity deletes, repeats included."""
    e = table(spark, sf_dir, "events").selectExpr(
        "concat('op', CAST(event_id AS STRING)) AS op_id", "concat('r', CAST(event_id % 5 AS STRING)) AS replica_id", "'note' AS entity", "concat('n', CAST(user_id AS STRING)) AS entity_id",
        "CASE WHEN event_id % 4 < 2 THEN concat('f', CAST(event_id % 3 AS STRING)) ELSE 'tags' END AS field",
        "CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 4 < 2 THEN 'set' WHEN event_id % 4 = 2 THEN 'add' ELSE 'remove' END AS action",
        "concat('v', CAST((event_id * 7) % 11 AS STRING)) AS value", "event_id % 1000 AS lamport", "CAST(unix_timestamp(ts) AS DOUBLE) AS wall_clock",
    )
    return e.unionByName(e.where("lamport % 10 = 0"))


OPERATIONS = """ops0 AS (SELECT concat('op', CAST(event_id AS VARCHAR)) AS op_id, concat('r', CAST(event_id % 5 AS VARCHAR)) AS replica_id, 'note' AS entity, concat('n', CAST(user_id AS VARCHAR)) AS entity_id,
 CASE WHEN event_id % 4 < 2 THEN concat('f', CAST(event_id % 3 AS VARCHAR)) ELSE 'tags' END AS field,
 CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 4 < 2 THEN 'set' WHEN event_id % 4 = 2 THEN 'add' ELSE 'remove' END AS action,
 concat('v', CAST((event_id * 7) % 11 AS VARCHAR)) AS value, event_id % 1000 AS lamport, CAST(floor(epoch(ts)) AS DOUBLE) AS wall_clock FROM events),
 ops AS (SELECT DISTINCT * FROM ops0)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of matters: an order is a record in its customer's matter."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS matter_id", "o_orderpriority AS kind", "o_orderkey % 3 AS asset_key", "CAST(o_totalprice * 10 AS BIGINT) AS byte_size", "o_orderdate AS occurred_at", "concat('rec-', CAST(o_orderkey AS STRING)) AS record_id"
    )


RECORDS = "records AS (SELECT o_orderkey AS id, o_custkey AS matter_id, o_orderpriority AS kind, o_orderkey % 3 AS asset_key, CAST(trunc(o_totalprice * 10) AS BIGINT) AS byte_size, o_orderdate AS occurred_at, concat('rec-', CAST(o_orderkey AS VARCHAR)) AS record_id FROM orders)"
