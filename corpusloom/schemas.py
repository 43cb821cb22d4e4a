"""Record types of the engine's results, and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


S, L, D, B, I = StringType(), LongType(), DoubleType(), BooleanType(), IntegerType()  # noqa: E741

ALIGNMENT = struct(sentence=S, sentence_index=I, start=I, end=I, score=D, matched_text=S, support=S)
COVERAGE = struct(sentences=L, strong=L, partial=L, unsupported=I, coverage=D, unsupported_sentences=ArrayType(S))
OPERATION = struct(op_id=S, replica_id=S, entity=S, entity_id=S, field=S, action=S, value=S, lamport=L, wall_clock=D)
LEDGER_ENTRY = struct(sequence=L, record_id=S, content_hash=S, metadata=S, prev_hash=S, entry_hash=S)
PROBLEM = struct(sequence=L, record_id=S, kind=S, expected=S, found=S)
HASH = struct(rec_id=S, hash=S, time=D)
AUDIO_MATCH = struct(match=B, score=D, common_hashes=L, offset_seconds=D, aligned_hashes=L)
RULE_OUTCOME = struct(rule_id=L, rule_name=S, matched=B, error=S, explain=S, actions=ArrayType(S))
ROOM_EVENT = struct(id=L, type=S, participant_id=S, payload=S, ts=D)


def evolve(df: DataFrame, wanted: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns it lacks, null or with a default; columns are only ever added."""
    have = {c.lower() for c in df.columns}
    for f in wanted.fields:
        if f.name.lower() not in have:
            df = df.withColumn(f.name, F.lit((defaults or {}).get(f.name)).cast(f.dataType))
    return df


def backfill_titles(entries: DataFrame) -> DataFrame:
    """A blank title becomes the reference, if there is one."""
    blank = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("source_ref", F.lit("")) != "")
    return entries.withColumn("title", F.when(blank, F.col("source_ref")).otherwise(F.col("title")))
