"""Matters: bundles of records whose content, note and times are sealed in a hash chain each.

Captures are rows (matter_id, reference, user_id, position, record_id, kind, note, text, url, file_hash, filename, mime_type,
byte_size, occurred_at, entered_at, device); a matter's ledger is that of ``ledger.build_chain`` with the matter as its chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ledger import GENESIS, build_chain, chain_heads, merkle_root, verify_chain

# Kinds of records; others count as notes.
KINDS = ("audio", "video", "image", "pdf", "text", "url", "note")


def seal_captures(captures: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Chain records of captures. A capture without a file is its text, or else its address, or else its note."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = lambda c: F.when(held(c) != "", held(c))
    content = F.coalesce(some("file_hash"), F.sha2(F.coalesce(some("text"), some("url"), held("note")), 256))
    entered = F.date_format("entered_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    metadata = F.to_json(
        F.struct(
            F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("note").alias("kind"), F.trim(held("note")).alias("note"), held("filename").alias("filename"), held("mime_type").alias("mime_type"),
            F.coalesce(F.col("byte_size").cast("long"), F.lit(0)).alias("byte_size"), held("url").alias("url"), F.length(held("text")).alias("text_length"), entered.alias("entered_at"),
            F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), entered).alias("occurred_at"), held("user_id").alias("account"), F.left(held("device"), F.lit(200)).alias("device"), held("reference").alias("matter_reference"),
        )
    )
    return captures.select(F.col("matter_id").alias("chain_id"), "position", "record_id", content.alias("content_hash"), metadata.alias("metadata"))


def add_records(entries: DataFrame | None, captures: DataFrame) -> DataFrame:
    """The ledger with the captures at the ends of their matters' chains."""
    fresh = build_chain(seal_captures(captures), heads=None if entries is None else chain_heads(entries))
    return fresh if entries is None else entries.unionByName(fresh)


def verify_matters(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row a matter: entries, problems, valid, affected (sequences with a problem, in order), merkle_root."""
    bad = verify_chain(entries, files).groupBy("chain_id").agg(F.count("*").alias("problems"), F.array_sort(F.collect_set("sequence")).alias("affected"))
    out = entries.groupBy("chain_id").agg(F.count("*").alias("entries")).join(bad, "chain_id", "left").join(merkle_root(entries), "chain_id")
    n = F.coalesce("problems", F.lit(0))
    return out.select(F.col("chain_id").alias("matter_id"), "entries", n.alias("problems"), (n == 0).alias("valid"), F.coalesce("affected", F.array().cast("array<long>")).alias("affected"), "merkle_root")


def seal_matters(matters: DataFrame, entries: DataFrame) -> DataFrame:
    """The state of each matter to publish: record_count, head_hash, merkle_root, the root's first digits for the eye, anchor_text. matters: matter_id, title, reference."""
    h = chain_heads(entries).join(merkle_root(entries), "chain_id").withColumnRenamed("chain_id", "matter_id")
    out = matters.join(h, "matter_id", "left")
    head, root, n = F.coalesce("head_hash", F.lit(GENESIS)), F.coalesce("merkle_root", F.lit(GENESIS)), F.coalesce("count", F.lit(0))
    anchor = F.concat_ws("", F.coalesce(F.col("reference"), F.col("title"), F.lit("")), F.lit(": "), n.cast("string"), F.lit(" records, head "), head, F.lit(", root "), root)
    short = F.concat_ws("-", *(F.upper(F.substring(root, k, 4)) for k in (1, 5, 9, 13)))
    return out.select("matter_id", n.alias("record_count"), head.alias("head_hash"), root.alias("merkle_root"), short.alias("root_fingerprint"), anchor.alias("anchor_text"))
