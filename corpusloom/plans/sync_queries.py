"""Queries over replicated edits, ledgers and room events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import crdt, ledger, matters
from corpusloom.plans.registry import query
from corpusloom.plans.relations import OPERATIONS, operations, table

KEY = "lpad(CAST(lamport AS VARCHAR), 9, '0') || replica_id || op_id"


@query("merge_operations", f"WITH {OPERATIONS} SELECT op_id, lamport, replica_id FROM ops")
def merge_operations(spark, sf):
    o = operations(spark, sf)
    return crdt.in_order(crdt.merge(o.where("lamport % 2 = 0"), o)).select("op_id", "lamport", "replica_id")


@query("vector_clock", f"WITH {OPERATIONS} SELECT replica_id, max(lamport) AS lamport FROM ops GROUP BY 1")
def vector_clock(spark, sf):
    o = operations(spark, sf)
    return crdt.merge_clocks(crdt.vector_clock(o.where("lamport < 500")), crdt.vector_clock(o))


@query("compare_clocks", "SELECT unnest(['before', 'after', 'equal', 'concurrent']) AS \"order\", unnest([0, 1, 2, 3]) AS n")
def compare_clocks(spark, sf):
    o = operations(spark, sf)
    full = crdt.vector_clock(o)
    low, left = crdt.vector_clock(o.where("lamport < 500")), crdt.vector_clock(o.where("replica_id <> 'r1'"))
    right = crdt.vector_clock(o.where("replica_id <> 'r2'"))
    out = [crdt.compare_clocks(*p).withColumn("n", F.lit(k)) for k, p in enumerate(((low, full), (full, low), (full, full), (left, right)))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("next_lamport", f"WITH {OPERATIONS} SELECT max(lamport) + 1 AS lamport FROM ops")
def next_lamport(spark, sf):
    return crdt.next_op(operations(spark, sf))


@query("diff_for_sync", f"WITH {OPERATIONS} SELECT op_id FROM ops WHERE lamport > CASE replica_id WHEN 'r0' THEN 300 WHEN 'r1' THEN 900 WHEN 'r2' THEN 5000 ELSE 0 END")
def diff_for_sync(spark, sf):
    clock = spark.createDataFrame([("r0", 300), ("r1", 900), ("r2", 5000)], "replica_id string, lamport long")
    return crdt.unseen(crdt.merge(operations(spark, sf)), clock).select("op_id")


@query("ops_since", f"WITH {OPERATIONS} SELECT op_id FROM ops WHERE lamport > 800")
def ops_since(spark, sf):
    return crdt.ops_since(crdt.merge(operations(spark, sf)), 800).select("op_id")


@query("sync_push", f"WITH {OPERATIONS}, i AS (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY lamport) AS k FROM (SELECT * FROM ops0 UNION ALL SELECT * FROM ops0 WHERE lamport % 10 = 0)) SELECT count(*) FILTER (lamport > 0 AND k = 1 AND lamport % 3 <> 0) AS accepted, count(*) FILTER (lamport > 0 AND NOT (k = 1 AND lamport % 3 <> 0)) AS duplicates, count(*) FILTER (lamport < 1) AS rejected FROM i")
def sync_push(spark, sf):
    o = operations(spark, sf)
    return crdt.push(o.where("lamport % 3 = 0"), o)


@query("sync_status", f"WITH {OPERATIONS} SELECT count(*) AS operations, count(DISTINCT replica_id) AS replicas, count(DISTINCT (entity, entity_id)) AS entities, max(lamport) AS lamport FROM ops")
def sync_status(spark, sf):
    return crdt.sync_status(crdt.merge(operations(spark, sf)))


@query("lww_register", f"WITH {OPERATIONS} SELECT entity_id, field, arg_max(value, {KEY}) AS value FROM ops WHERE action = 'set' GROUP BY 1, 2")
def lww_register(spark, sf):
    return crdt.lww(crdt.merge(operations(spark, sf)).where("action = 'set'")).select("entity_id", "field", "value")


@query("grow_only_set", f"WITH {OPERATIONS} SELECT entity_id, array_to_string(list_sort(list(DISTINCT value)), ',') AS members FROM ops WHERE action = 'add' GROUP BY 1")
def grow_only_set(spark, sf):
    o = crdt.merge(operations(spark, sf)).where("action IN ('add', 'remove')")
    return crdt.gset(o).select("entity_id", F.array_join("value", ",").alias("members"))


ORSET = f"live AS (SELECT a.entity_id, a.value FROM ops a LEFT JOIN (SELECT entity_id, value, max({KEY}) AS b FROM ops WHERE action = 'remove' GROUP BY 1, 2) r ON a.entity_id = r.entity_id AND a.value = r.value WHERE a.action = 'add' AND (b IS NULL OR lpad(CAST(a.lamport AS VARCHAR), 9, '0') || a.replica_id || a.op_id > b))"


@query("observed_remove_set", f"WITH {OPERATIONS}, {ORSET} SELECT entity_id, array_to_string(list_sort(list(DISTINCT value)), ',') AS members FROM live GROUP BY 1")
def observed_remove_set(spark, sf):
    return crdt.orset(crdt.merge(operations(spark, sf))).select("entity_id", F.array_join("value", ",").alias("members"))


@query("entity_flags", f"WITH {OPERATIONS} SELECT entity_id, bool_or(action = 'delete') AS deleted, arg_min(op_id, {KEY}) AS first_op, max(wall_clock) AS updated_at, count(*) AS n_ops FROM ops GROUP BY 1")
def entity_flags(spark, sf):
    return crdt.entities(crdt.merge(operations(spark, sf))).drop("entity")


@query("resolve_state", f"WITH {OPERATIONS}, {ORSET}, del AS (SELECT DISTINCT entity_id FROM ops WHERE action = 'delete') SELECT entity_id, field, value FROM (SELECT entity_id, field, arg_max(value, {KEY}) AS value FROM ops WHERE action = 'set' GROUP BY 1, 2 UNION ALL SELECT entity_id, 'tags', array_to_string(list_sort(list(DISTINCT value)), ',') FROM live GROUP BY 1) WHERE entity_id NOT IN (SELECT entity_id FROM del)")
def resolve_state(spark, sf):
    return crdt.resolve(operations(spark, sf), live_only=True).select("entity_id", "field", F.coalesce("value", F.array_join("values", ",")).alias("value"))


CHAIN = """RECURSIVE r AS (SELECT o_custkey % 50 AS chain_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS sequence, 'rec-' || o_orderkey AS record_id, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash, o_orderstatus AS st FROM orders),
 c AS (SELECT chain_id, CAST(0 AS BIGINT) AS sequence, '' AS record_id, repeat('0', 64) AS entry_hash, '' AS prev_hash FROM (SELECT DISTINCT chain_id FROM r)
 UNION ALL SELECT r.chain_id, r.sequence, r.record_id, sha256('{"content_hash":"' || r.content_hash || '","metadata":{"status":"' || st || '"},"prev_hash":"' || c.entry_hash || '","record_id":"' || r.record_id || '","sequence":' || r.sequence || ',"v":"1"}'), c.entry_hash FROM c JOIN r ON r.chain_id = c.chain_id AND r.sequence = c.sequence + 1)"""


def chain_records(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_custkey % 50 AS chain_id", "o_orderkey AS position", "concat('rec-', CAST(o_orderkey AS STRING)) AS record_id", "sha2(CAST(o_orderkey AS STRING), 256) AS content_hash", "concat('{\"status\": \"', o_orderstatus, '\"}') AS metadata")


@query("build_chain", f"WITH {CHAIN} SELECT chain_id, sequence, record_id, prev_hash, entry_hash FROM c WHERE sequence > 0")
def build_chain(spark, sf):
    return ledger.build_chain(chain_records(spark, sf)).select("chain_id", "sequence", "record_id", "prev_hash", "entry_hash")


@query("verify_chain", "WITH r AS (SELECT o_orderkey, o_custkey % 50 AS chain_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS sequence FROM orders), k AS (SELECT *, lead(sequence) OVER (PARTITION BY chain_id ORDER BY sequence) AS nx FROM r), b AS (SELECT chain_id, sequence, 'altered_entry' AS kind FROM r WHERE sequence % 40 = 5 UNION ALL SELECT chain_id, sequence, unnest(['sequence_gap', 'broken_link']) FROM r WHERE sequence % 60 = 31 UNION ALL SELECT chain_id, sequence, 'missing_file' FROM r WHERE sequence % 60 <> 30 AND o_orderkey % 500 = 0 UNION ALL SELECT chain_id, sequence, 'altered_file' FROM r WHERE sequence % 60 <> 30 AND o_orderkey % 500 <> 0 AND (o_orderkey % 700 = 0) <> (sequence % 40 = 5)) SELECT * FROM b WHERE sequence % 60 <> 30")
def verify_chain(spark, sf):
    """A ledger with altered contents (every 40th), missing rows (every 60th) and files changed or gone."""
    e = ledger.build_chain(chain_records(spark, sf))
    e = e.where("sequence % 60 <> 30").withColumn("content_hash", F.when(F.col("sequence") % 40 == 5, F.lit("x")).otherwise(F.col("content_hash")))
    key = F.expr("CAST(substring(record_id, 5) AS BIGINT)")
    files = chain_records(spark, sf).withColumn("k", key).where("k % 500 <> 0").select("record_id", F.when((F.col("k") % 700 == 0), F.lit("x")).otherwise(F.col("content_hash")).alias("current_hash"))
    return ledger.verify_chain(e, files).select("chain_id", "sequence", "kind")


@query("chain_heads", f"WITH {CHAIN} SELECT chain_id, max(sequence) AS count, arg_max(entry_hash, sequence) AS head_hash FROM c GROUP BY 1")
def chain_heads(spark, sf):
    return ledger.chain_heads(ledger.build_chain(chain_records(spark, sf)))


@query("merkle_root", """WITH RECURSIVE t AS (SELECT 0 AS lvl, c_nationkey AS chain_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, sha256('\\x00'::BLOB || encode(c_name)) AS h, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer
 UNION ALL SELECT * FROM (SELECT lvl + 1, chain_id, i // 2, CASE WHEN count(*) OVER w = 1 THEN h ELSE sha256('\\x01'::BLOB || unhex(first_value(h) OVER o) || unhex(last_value(h) OVER o)) END, (n + 1) // 2 FROM t WHERE n > 1 WINDOW w AS (PARTITION BY chain_id, lvl, i // 2), o AS (PARTITION BY chain_id, lvl, i // 2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY row_number() OVER (PARTITION BY chain_id, lvl, i // 2 ORDER BY i) = 1)) SELECT chain_id, h AS merkle_root FROM t WHERE n = 1""")
def merkle_root(spark, sf):
    leaves = table(spark, sf, "customer").selectExpr("c_nationkey AS chain_id", "c_custkey AS sequence", "c_name AS entry_hash")
    return ledger.merkle_root(leaves)


ROOM = "e AS (SELECT user_id AS room_id, event_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query("sequence_events", f"WITH {ROOM} SELECT room_id, event_id, seq FROM e")
def sequence_events(spark, sf):
    from corpusloom.streaming import rooms

    return rooms.sequence(rooms.room_events(spark, sf)).select("room_id", "event_id", "seq")


@query("replay_ring", f"WITH {ROOM}, k AS (SELECT *, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY room_id ORDER BY seq DESC) AS rk FROM e WHERE event_type <> 'view') SELECT room_id, seq FROM k WHERE rk <= 10")
def replay_ring(spark, sf):
    from corpusloom.streaming import rooms

    return rooms.ring(rooms.sequence(rooms.room_events(spark, sf)), size=10, transient=("view",)).select("room_id", "seq")


@query("replay_from", f"WITH {ROOM}, k AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY seq DESC) AS rk FROM e), g AS (SELECT room_id, max(CASE WHEN rk > 10 THEN seq ELSE 0 END) AS dropped, max(seq) AS top FROM k GROUP BY 1), m AS (SELECT room_id, dropped, least(greatest(room_id % 20, 0), top) AS cur FROM g) SELECT m.room_id, k.seq, cur < dropped AS resync FROM m JOIN k ON k.room_id = m.room_id AND k.rk <= 10 AND k.seq > cur")
def replay_from(spark, sf):
    from corpusloom.streaming import rooms

    e = rooms.sequence(rooms.room_events(spark, sf))
    cursors = e.select("room_id").distinct().withColumn("last_event_id", F.col("room_id") % 20)
    return rooms.replay(rooms.ring(e, size=10), cursors).select("room_id", "seq", "resync")


@query("presence_sessions", f"WITH {ROOM}, g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY room_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY room_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM e), s AS (SELECT *, sum(b) OVER (PARTITION BY room_id ORDER BY ts, event_id) AS k FROM g) SELECT room_id, min(ts) AS joined, max(ts) + INTERVAL 1 HOUR AS pruned, count(*) AS n FROM s GROUP BY room_id, k")
def presence_sessions(spark, sf):
    from corpusloom.streaming import rooms

    return rooms.presence(rooms.room_events(spark, sf))


@query("watch_changes", "WITH h AS (SELECT user_id AS watch_id, event_id, sha256(event_type) AS hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type FROM events) SELECT watch_id, event_id, hash FROM h WHERE p IS NOT NULL AND p <> event_type")
def watch_changes(spark, sf):
    from corpusloom.streaming import watches

    polls = table(spark, sf, "events").selectExpr("user_id AS watch_id", "event_id", "ts AS polled_at", "event_type AS content")
    return watches.changes(polls).select("watch_id", "event_id", "hash")


@query("rate_limit", "SELECT event_id, n > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events)")
def rate_limit(spark, sf):
    from corpusloom.streaming import watches

    return watches.rate_limit(table(spark, sf, "events"), "user_id", "ts", 86400, 2).select("event_id", "limited")


@query("tumbling_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query("append_chain", f"WITH {CHAIN} SELECT chain_id, sequence, entry_hash FROM c WHERE sequence > 0")
def append_chain(spark, sf):
    """A ledger built in two goes equals one built at once."""
    r = chain_records(spark, sf)
    cut = 7000
    first = ledger.build_chain(r.where(F.col("position") < cut))
    more = ledger.build_chain(r.where(F.col("position") >= cut), heads=ledger.chain_heads(first))
    return first.unionByName(more).select("chain_id", "sequence", "entry_hash")


@query("author_operations", f"WITH {OPERATIONS} SELECT c_custkey AS draft_no, (SELECT max(lamport) FROM ops) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS lamport FROM customer")
def author_operations(spark, sf):
    drafts = table(spark, sf, "customer").selectExpr("concat('r', c_nationkey) AS replica_id", "c_custkey AS draft_no")
    return crdt.author(operations(spark, sf), drafts).select("draft_no", "lamport")


@query("observed_tags", f"WITH {OPERATIONS}, live AS (SELECT a.entity_id, a.value, a.op_id FROM ops a LEFT JOIN (SELECT entity_id, value, max({KEY}) AS b FROM ops WHERE action = 'remove' GROUP BY 1, 2) r ON a.entity_id = r.entity_id AND a.value = r.value WHERE a.action = 'add' AND (b IS NULL OR lpad(CAST(a.lamport AS VARCHAR), 9, '0') || a.replica_id || a.op_id > b)) SELECT entity_id, value, string_agg(op_id, ',' ORDER BY op_id) AS tags FROM live GROUP BY 1, 2")
def observed_tags(spark, sf):
    return crdt.observed_tags(crdt.merge(operations(spark, sf))).select("entity_id", "value", F.array_join("tags", ",").alias("tags"))


@query("merkle_proofs", "SELECT o_custkey % 40 AS chain_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS sequence, true AS valid, o_orderkey AS record FROM orders")
def merkle_proofs(spark, sf):
    """Every leaf's proof folds to its chain's root."""
    o = table(spark, sf, "orders").selectExpr("o_custkey % 40 AS chain_id", "o_orderkey AS sequence", "concat('leaf', o_orderkey) AS entry_hash")
    p = ledger.merkle_proofs(o).join(ledger.merkle_root(o), "chain_id")
    place = F.row_number().over(Window.partitionBy("chain_id").orderBy("record")).cast("long")
    checked = p.select("chain_id", F.col("sequence").alias("record"), ledger.verify_proof(F.col("leaf"), F.col("proof"), F.col("merkle_root")).alias("valid"))  # before the window, which moves its rows
    return checked.select("chain_id", place.alias("sequence"), "valid", "record")


@query("verify_matters", """WITH r AS (SELECT o_custkey % 40 AS matter_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS sequence FROM orders), p AS (SELECT matter_id, sequence, CASE WHEN k % 97 = 0 THEN 1 WHEN k % 89 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 83 = 0 THEN 1 ELSE 0 END AS n FROM r)
 SELECT matter_id, count(*) AS entries, CAST(sum(n) AS BIGINT) AS problems, sum(n) = 0 AS valid, coalesce(string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY sequence) FILTER (n > 0), '') AS affected FROM p GROUP BY matter_id""")
def verify_matters(spark, sf):
    """Ledgers of captures, added in two goes; some files are gone (97), some altered (89), and some entries are altered (83)."""
    o = table(spark, sf, "orders").selectExpr("o_custkey % 40 AS matter_id", "'REF' AS reference", "o_custkey AS user_id", "o_orderkey AS position", "CAST(o_orderkey AS STRING) AS record_id", "o_orderpriority AS kind", "o_orderstatus AS note", "'' AS text", "'' AS url", "sha2(CAST(o_orderkey AS STRING), 256) AS file_hash", "'f' AS filename", "'' AS mime_type", "10 AS byte_size", "CAST(o_orderdate AS TIMESTAMP) AS occurred_at", "CAST(o_orderdate AS TIMESTAMP) AS entered_at", "'' AS device")
    entries = matters.add_records(matters.add_records(None, o.where("position < 3000")), o.where("position >= 3000"))
    changed = entries.withColumn("metadata", F.when(F.col("record_id").cast("long") % 83 == 0, F.lit("{}")).otherwise(F.col("metadata")))
    files = o.where("position % 97 <> 0").selectExpr("record_id", "CASE WHEN position % 89 = 0 THEN 'other' ELSE file_hash END AS current_hash")
    return matters.verify_matters(changed, files).select("matter_id", "entries", "problems", "valid", F.array_join(F.col("affected").cast("array<string>"), ",").alias("affected"))


@query("canonical_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN j ELSE '#' || sha256(j) END AS key FROM (SELECT event_id, '{\"a\":' || event_id || ',\"b\":[' || user_id || ',null,true],\"c\":\"' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE repeat(event_type, 40) END || '\"}' AS j FROM events)")
def canonical_keys(spark, sf):
    """Keys of values whose members come in another order and with blanks; long ones are hashed."""
    word = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.repeat("event_type", 40))
    value = F.concat(F.lit('{ "c": "'), word, F.lit('", "b": ['), F.col("user_id").cast("string"), F.lit(', null, true], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", crdt.canonical_key_udf(value).alias("key"))


@query("sse_frames", "SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN ': heartbeat' || chr(10) || chr(10) ELSE 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {\"user_id\":' || user_id || '}' || chr(10) || chr(10) END AS frame FROM events")
def sse_frames(spark, sf):
    from corpusloom.streaming import rooms

    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "heartbeat").otherwise(F.col("event_type")).alias("event_type"), "user_id")
    return rooms.format_sse(e).select("seq", "frame")
