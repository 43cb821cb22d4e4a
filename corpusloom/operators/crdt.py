"""Replicated edits as folds over a set of operations.

An operation is (op_id, replica_id, entity, entity_id, field, action, value, lamport, wall_clock). Operations are ordered by
(lamport, replica_id, op_id), never by wall clock; a fold depends on nothing but the set of distinct operations, so repeats and
any order of delivery give the same state.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENTITY = ["entity", "entity_id"]


def key() -> Column:
    return F.struct("lamport", "replica_id", "op_id")


def merge(*logs: DataFrame) -> DataFrame:
    """Union of logs, each op_id once."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["op_id"])


def in_order(ops: DataFrame) -> DataFrame:
    return ops.orderBy("lamport", "replica_id", "op_id")


def vector_clock(ops: DataFrame) -> DataFrame:
    return ops.groupBy("replica_id").agg(F.max("lamport").alias("lamport"))


def merge_clocks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("replica_id").agg(F.max("lamport").alias("lamport"))


def compare_clocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: before, after, equal or concurrent."""
    j = a.select("replica_id", F.col("lamport").alias("la")).join(b.select("replica_id", F.col("lamport").alias("lb")), "replica_id", "full_outer")
    la, lb = F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))
    less, more = F.coalesce(F.bool_or(la < lb), F.lit(False)), F.coalesce(F.bool_or(la > lb), F.lit(False))
    order = F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")
    return j.agg(order.alias("order"))


def next_op(ops: DataFrame) -> DataFrame:
    """replica_id and the lamport its next operation takes: one above all it has seen."""
    return ops.agg((F.coalesce(F.max("lamport"), F.lit(0)) + 1).alias("lamport"))


def author(ops: DataFrame, drafts: DataFrame) -> DataFrame:
    """New operations of replicas: drafts (replica_id, draft_no, ...) get lamports above all that ops hold, in draft order."""
    k = F.row_number().over(Window.partitionBy("replica_id").orderBy("draft_no"))
    seen = next_op(ops).select(F.col("lamport").alias("_next"))  # one row
    return drafts.withColumn("_k", k).join(F.broadcast(seen)).withColumn("lamport", F.col("_next") + F.col("_k") - 1).drop("_k", "_next")


def observed_tags(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tags that a remove of each set member names: its live adds."""
    by = by or [*ENTITY, "field"]
    return orset_members(ops, by).groupBy(*by, "value").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def unseen(ops: DataFrame, clock: DataFrame, limit: int | None = None) -> DataFrame:
    """Operations that a client's clock does not cover, in order; a limit applies after the difference."""
    seen = clock.select("replica_id", F.col("lamport").alias("_seen"))
    out = ops.join(seen, "replica_id", "left").where(F.col("lamport") > F.coalesce("_seen", F.lit(0))).drop("_seen")
    return in_order(out).limit(limit) if limit else out


def ops_since(ops: DataFrame, lamport: int) -> DataFrame:
    return ops.where(F.col("lamport") > lamport)


def push(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: accepted, duplicates and rejected (no id, replica or entity, or no positive lamport) of a push."""
    bad = F.col("op_id").isNull() | (F.col("op_id") == "") | F.col("replica_id").isNull() | F.col("entity").isNull() | F.col("lamport").isNull() | (F.col("lamport") < 1)
    first = F.row_number().over(Window.partitionBy("op_id").orderBy("lamport", "replica_id")) == 1
    marked = incoming.withColumn("bad", bad).withColumn("first", first).join(log.select("op_id", F.lit(True).alias("held")).distinct(), "op_id", "left")
    fresh = ~F.col("bad") & F.col("first") & F.col("held").isNull()
    return marked.agg(F.count_if(fresh).alias("accepted"), F.count_if(~F.col("bad") & ~fresh).alias("duplicates"), F.count_if(F.col("bad")).alias("rejected"))


def field_kind(schema: dict[str, str] | None = None) -> Column:
    """lww, gset or orset: by "entity.field", by "field", else by the action."""
    out = F.when(F.col("action").isin("add", "remove"), "orset").otherwise("lww")
    for name, kind in sorted((schema or {}).items(), key=lambda x: "." in x[0]):
        hit = F.concat_ws(".", "entity", "field") == name if "." in name else F.col("field") == name
        out = F.when(hit, kind).otherwise(out)
    return out


def lww(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last writer's value per entity field."""
    return ops.groupBy(*(by or [*ENTITY, "field"])).agg(F.max_by("value", key()).alias("value"), F.max(key()).alias("key"))


def gset(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Grow-only set per entity field; removes are ignored."""
    return ops.where("action <> 'remove'").groupBy(*(by or [*ENTITY, "field"])).agg(F.array_sort(F.collect_set("value")).alias("value"))


def orset_members(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Live (value, tag) rows of observed-remove sets.

    An add's tag is its op_id. A remove either names tags (column ``tags``) or bounds: it takes every add of its value below it
    in the order.
    """
    by = by or [*ENTITY, "field"]
    adds = ops.where("action = 'add'").select(*by, "value", F.col("op_id").alias("tag"), key().alias("k"))
    removes = ops.where("action = 'remove'")
    if "tags" in ops.columns:
        tombs = removes.where(F.size("tags") > 0).select(*by, F.explode("tags").alias("tag")).distinct()
        adds = adds.join(tombs, [*by, "tag"], "left_anti")
        removes = removes.where(F.coalesce(F.size("tags"), F.lit(0)) <= 0)
    bound = removes.groupBy(*by, "value").agg(F.max(key()).alias("bound"))
    return adds.join(bound, [*by, "value"], "left").where(F.col("bound").isNull() | (F.col("k") > F.col("bound"))).drop("k", "bound")


def orset(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or [*ENTITY, "field"]
    return orset_members(ops, by).groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("value"))


def entities(ops: DataFrame) -> DataFrame:
    """Per entity: whether deleted (for good), its first and last operation's data."""
    return ops.groupBy(*ENTITY).agg(F.bool_or(F.col("action") == "delete").alias("deleted"), F.min_by("op_id", key()).alias("first_op"), F.max("wall_clock").alias("updated_at"), F.count("*").alias("n_ops"))


def resolve(ops: DataFrame, schema: dict[str, str] | None = None, live_only: bool = False) -> DataFrame:
    """State by entity and field: value (of LWW fields) or values (of sets), and the entity's flags."""
    o = merge(ops)
    fields = o.where("action <> 'delete'").withColumn("kind", field_kind(schema))
    one = lww(fields.where("kind = 'lww'")).select(*ENTITY, "field", "value", F.lit(None).cast("array<string>").alias("values"))
    sets = orset(fields.where("kind = 'orset'")).unionByName(gset(fields.where("kind = 'gset'")))
    many = sets.select(*ENTITY, "field", F.lit(None).cast("string").alias("value"), F.col("value").alias("values"))
    out = one.unionByName(many).join(entities(o), ENTITY)
    return out.where(~F.col("deleted")) if live_only else out


def sync_status(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count("*").alias("operations"), F.count_distinct("replica_id").alias("replicas"), F.count_distinct("entity", "entity_id").alias("entities"), F.max("lamport").alias("lamport"))


def canonical_key(value: object, width: int = 128) -> str:
    """Canonical JSON, or #sha256 of it when longer than ``width``."""
    s = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return s if len(s) <= width else "#" + hashlib.sha256(s.encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_key_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: canonical_key(json.loads(x)) if x is not None else None)
