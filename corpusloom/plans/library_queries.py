"""Queries of the document library over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import library as lib
from corpusloom.plans.registry import query
from corpusloom.plans.relations import CARDS, EDGES, ENTRIES, RECORDS, cards, edges, entries, records, table

NOW = "2024-01-20 00:00:00"
TITLE = "coalesce(CASE WHEN trim(title) = '' THEN NULL ELSE title END, CASE WHEN trim(source_ref) = '' THEN NULL ELSE source_ref END, left(trim(string_split(trim(summary), chr(10))[1]), 80))"
TAGS = "list_filter(list_transform(string_split(tags, ','), lambda t: left(lower(trim(t)), 40)), lambda t: t <> '')"
DISTINCT_TAGS = f"list_slice(list_filter({TAGS}, lambda t, i: list_position({TAGS}, t) = i), 1, 25)"
WORDS = "CASE WHEN trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END"


@query("user_scan", f"WITH {ENTRIES} SELECT id, user_id, title FROM entries WHERE user_id = 3")
def user_scan(spark, sf):
    return lib.user_scan(entries(spark, sf), 3).select("id", "user_id", "title")


@query("entry_documents", f"WITH {ENTRIES}, t AS (SELECT id, {TITLE} AS title, CASE WHEN source_text <> '' THEN source_text ELSE summary END AS text, created_at FROM entries WHERE is_archived IS NOT TRUE) SELECT id, title, text, created_at FROM t WHERE trim(text) <> ''")
def entry_documents(spark, sf):
    return lib.entry_documents(entries(spark, sf), limit=None, max_chars=None)


@query("keyword_search", f"WITH {ENTRIES} SELECT id, source_ref, {WORDS.format('summary')} AS n_words FROM entries WHERE summary ILIKE '%tion%' OR source_ref ILIKE '%tion%' ORDER BY id DESC LIMIT 8", ints=("n_words",))
def keyword_search(spark, sf):
    return lib.keyword_search(entries(spark, sf), " tion ").select("id", "source_ref", lib.word_count(F.col("summary")).alias("n_words"))


@query("list_entries", f"WITH {ENTRIES}, k AS (SELECT * FROM entries WHERE (summary ILIKE '%the%' OR source_ref ILIKE '%the%' OR title ILIKE '%the%' OR source_text ILIKE '%the%') AND tags ILIKE '%en%' AND is_archived IS NOT TRUE), t AS (SELECT count(*) AS total FROM k) SELECT id, is_pinned, total, total > 30 AS has_more FROM k, t ORDER BY is_pinned DESC, id DESC LIMIT 20 OFFSET 10")
def list_entries(spark, sf):
    return lib.list_entries(entries(spark, sf), query="the", tag="en", offset=10).select("id", "is_pinned", "total", "has_more")


@query("active_entries", f"WITH {ENTRIES} SELECT id FROM entries WHERE is_archived IS NOT TRUE")
def active_entries(spark, sf):
    return entries(spark, sf).where(lib.active()).select("id")


@query("status_in_list", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def status_in_list(spark, sf):
    jobs = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_orderdate AS created_at")
    return lib.with_status(jobs, ("O", "P")).select("id", "status")


@query("due_cards", f"WITH {CARDS} SELECT id, user_id FROM cards WHERE next_review_at <= TIMESTAMP '{NOW}'")
def due_cards(spark, sf):
    return lib.due_cards(cards(spark, sf), NOW).select("id", "user_id")


def watches(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id AS id", "event_id % 3 <> 0 AS is_active", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS last_checked_at", "CAST(event_id % 20000 AS INT) AS interval_minutes")


@query("due_watches", f"SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 = 0 OR (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 60 >= event_id % 20000)")
def due_watches(spark, sf):
    return lib.due_watches(watches(spark, sf), NOW).select("id")


@query("orphan_assets", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 ORDER BY id DESC LIMIT 50")
def orphan_assets(spark, sf):
    return lib.orphan_assets(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS entry_id")).select("id")


@query("recent_entries", f"WITH {ENTRIES} SELECT id FROM entries WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def recent_entries(spark, sf):
    return lib.recent(entries(spark, sf), NOW, 7).select("id")


@query("derived_columns", f"WITH {ENTRIES} SELECT id, {TITLE} AS display_title, left(summary, 500) AS excerpt, array_to_string({DISTINCT_TAGS}, '|') AS tag_list FROM entries")
def derived_columns(spark, sf):
    return entries(spark, sf).select("id", lib.display_title().alias("display_title"), lib.excerpt().alias("excerpt"), F.array_join(lib.normalise_tags(F.col("tags")), "|").alias("tag_list"))


@query("rule_context", f"WITH {ENTRIES}, t AS (SELECT *, coalesce(CASE WHEN source_text <> '' THEN source_text END, summary, '') AS body FROM entries) SELECT id, lower(regexp_extract(source_ref, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS domain, {WORDS.format('body')} AS word_count, coalesce(is_archived, false) AS archived FROM t", ints=("word_count",))
def rule_context(spark, sf):
    return lib.rule_context(entries(spark, sf)).select("id", "domain", "word_count", "archived")


@query("update_entries", f"WITH {ENTRIES} SELECT id, CASE WHEN id % 2 = 0 THEN 'New ' || id ELSE title END AS title, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'changed' ELSE summary END AS summary FROM entries")
def update_entries(spark, sf):
    e = entries(spark, sf)
    patches = e.where("id % 2 = 0").selectExpr("id", "concat('New ', CAST(id AS STRING)) AS title", "CASE WHEN id % 4 = 0 THEN '  ' ELSE 'changed' END AS summary")
    return lib.update_entries(e, patches).select("id", "title", "summary")


@query("bulk_tag", f"WITH {ENTRIES}, t AS (SELECT id, {DISTINCT_TAGS} AS l FROM entries) SELECT t.id, CASE WHEN t.id % 3 = 0 THEN array_to_string(list_concat(l, ['starred']), ', ') ELSE e.tags END AS tags FROM t JOIN entries e ON t.id = e.id")
def bulk_tag(spark, sf):
    e = entries(spark, sf)
    return lib.bulk_action(e, e.where("id % 3 = 0"), "tag", "Starred").select("id", "tags")


@query("bulk_untag", f"WITH {ENTRIES}, t AS (SELECT id, {DISTINCT_TAGS} AS l FROM entries) SELECT t.id, CASE WHEN t.id % 3 = 0 THEN array_to_string(list_filter(l, lambda x: x <> 'en'), ', ') ELSE e.tags END AS tags FROM t JOIN entries e ON t.id = e.id")
def bulk_untag(spark, sf):
    e = entries(spark, sf)
    return lib.bulk_action(e, e.where("id % 3 = 0"), "untag", "EN").select("id", "tags")


@query("bulk_archive", f"WITH {ENTRIES} SELECT id, CASE WHEN id % 4 = 1 THEN true ELSE is_archived END AS is_archived FROM entries")
def bulk_archive(spark, sf):
    e = entries(spark, sf)
    return lib.bulk_action(e, e.where("id % 4 = 1"), "archive").select("id", "is_archived")


@query("delete_cascade", "SELECT id, entry_id FROM (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS entry_id, 1 AS k FROM orders) UNION ALL SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS entry_id FROM lineitem WHERE l_suppkey % 5 <> 0 AND l_partkey % 5 <> 0")
def delete_cascade(spark, sf):
    """Every fifth entry that anything refers to is deleted."""
    recordings = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS entry_id")
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_suppkey AS from_id", "l_partkey AS to_id")
    referred = recordings.select("entry_id").union(links.select("from_id")).union(links.select("to_id"))
    gone = referred.where("entry_id % 5 = 0").selectExpr("entry_id AS id").distinct()
    out = lib.delete_cascade(gone, {"recordings": (recordings, ("entry_id",), True), "links": (links, ("from_id", "to_id"), False)})
    return out["recordings"].unionByName(out["links"].select("id", F.col("from_id").alias("entry_id")))


@query("merge_duplicates", f"WITH {EDGES}, m AS (SELECT id, CASE WHEN from_id % 10 = 3 THEN from_id - 1 ELSE from_id END AS from_id, CASE WHEN to_id % 10 = 3 THEN to_id - 1 ELSE to_id END AS to_id FROM edges) SELECT * FROM m WHERE from_id <> to_id")
def merge_duplicates(spark, sf):
    mapping = table(spark, sf, "customer").where("c_custkey % 10 = 3").selectExpr("c_custkey AS duplicate", "c_custkey - 1 AS survivor")
    return lib.merge_duplicates(edges(spark, sf), mapping).select("id", "from_id", "to_id")


@query("draft_versions", "SELECT o_orderkey AS id, o_custkey AS entry_id, o_orderstatus AS draft_type, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS version FROM orders", ints=("version",))
def draft_versions(spark, sf):
    return lib.versions(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS entry_id", "o_orderstatus AS draft_type"), ["entry_id", "draft_type"], "id")


@query("next_reference", "SELECT printf('M-%04d', max(c_custkey) + 1) AS reference FROM customer WHERE c_custkey % 3 = 0")
def next_reference(spark, sf):
    return lib.next_reference(table(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN printf('M-%04d', c_custkey) ELSE 'other-9999999' END AS reference"))


@query("retention", f"WITH {ENTRIES} SELECT id FROM entries WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def retention(spark, sf):
    return lib.expire(entries(spark, sf), NOW, 14).select("id")


@query("session_state", f"SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'revoked' WHEN epoch(TIMESTAMP '2024-04-10 00:00:00') - floor(epoch(ts)) > 90 * 86400 THEN 'expired' WHEN (event_id * 7) % 5000 * 60 > CASE WHEN event_id % 2 = 0 THEN 2592000 ELSE 3600 END THEN 'idle' ELSE 'active' END AS state FROM events")
def session_state(spark, sf):
    s = table(spark, sf, "events").selectExpr("event_id AS id", "event_id % 13 = 0 AS revoked", "event_id % 2 = 0 AS remember", "ts AS created_at", "timestamp'2024-04-10 00:00:00' - make_interval(0, 0, 0, 0, 0, CAST((event_id * 7) % 5000 AS INT), 0) AS last_seen_at")
    return lib.session_state(s, "2024-04-10 00:00:00").select("id", "state")


@query("tag_counts", f"WITH {ENTRIES} SELECT tag, count(*) AS n FROM (SELECT unnest({DISTINCT_TAGS}) AS tag FROM entries) GROUP BY tag")
def tag_counts(spark, sf):
    return lib.tag_counts(entries(spark, sf))


@query("source_type_counts", f"WITH {ENTRIES} SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS n FROM entries GROUP BY 1")
def source_type_counts(spark, sf):
    return lib.source_type_counts(entries(spark, sf))


@query("library_stats", f"WITH {ENTRIES} SELECT count(*) AS total, count(*) FILTER (is_archived IS NOT TRUE) AS active, count(*) FILTER (is_archived) AS archived, count(*) FILTER (is_pinned) AS pinned, count(*) FILTER (source_text <> '') AS with_source FROM entries")
def library_stats(spark, sf):
    return lib.library_stats(entries(spark, sf))


@query("storage_usage", f"WITH {RECORDS} SELECT kind, count(*) AS n, CAST(sum(byte_size) AS BIGINT) AS bytes FROM records GROUP BY ROLLUP (kind)")
def storage_usage(spark, sf):
    return lib.storage_usage(table_records(spark, sf))


def table_records(spark, sf):
    return records(spark, sf)


STREAK = "(SELECT count(*) FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM entries WHERE CAST(created_at AS DATE) <= DATE '2024-01-20')) WHERE date_diff('day', day, DATE '2024-01-20') = k - 1)"


@query("analytics", f"WITH {ENTRIES}, {CARDS} SELECT (SELECT count(*) FROM entries) AS entries, (SELECT CAST(sum({WORDS.format('source_text')}) AS BIGINT) FROM entries) AS source_words, (SELECT round(avg({WORDS.format('summary')}), 1) FROM entries) AS mean_summary_words, (SELECT count(*) FROM cards) AS cards, (SELECT round(CAST(count(*) FILTER (repetitions > 0) AS DOUBLE) / count(*), 3) FROM cards) AS retention, {STREAK} AS streak")
def analytics(spark, sf):
    return lib.analytics(entries(spark, sf), cards(spark, sf), "2024-01-20")


@query("daily_counts", f"WITH {ENTRIES} SELECT CAST(d::DATE AS VARCHAR) AS day, (SELECT count(*) FROM entries WHERE CAST(created_at AS DATE) = d::DATE) AS n FROM generate_series(DATE '2024-01-20' - 29, DATE '2024-01-20', INTERVAL 1 DAY) AS t(d)")
def daily_counts(spark, sf):
    return lib.daily_counts(entries(spark, sf), "created_at", "2024-01-20").withColumn("day", F.col("day").cast("string"))


@query("human_size", "SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.1f', n / 1073741824.0::DOUBLE) || ' GB' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 64 AS n FROM orders)")
def human_size(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderkey * o_orderkey * 64 AS n").select("id", lib.human_size(F.col("n")).alias("size"))


NODES = "SELECT c_custkey AS id, c_name AS title FROM customer"


def nodes(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS title")


@query("links_for", f"WITH {EDGES}, n AS ({NODES}) SELECT e.id, node, other, title FROM (SELECT id, from_id AS node, to_id AS other FROM edges WHERE from_id <> to_id UNION ALL SELECT id, to_id, from_id FROM edges WHERE from_id <> to_id) e JOIN n ON n.id = other")
def links_for(spark, sf):
    return lib.links_for(edges(spark, sf), nodes(spark, sf)).select("id", "node", "other", "title")


@query("graph_data", f"WITH {EDGES}, n AS (SELECT id FROM ({NODES}) ORDER BY id DESC LIMIT 1400) SELECT id, from_id, to_id FROM edges WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)")
def graph_data(spark, sf):
    return lib.graph_data(nodes(spark, sf), edges(spark, sf), 1400).select("id", "from_id", "to_id")


@query("circle_layout", "SELECT n_nationkey AS id, round(cos(2 * pi() * (row_number() OVER (ORDER BY n_nationkey) - 1) / 25 - pi() / 2), 6) + 0.0 AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY n_nationkey) - 1) / 25 - pi() / 2), 6) + 0.0 AS y FROM nation")
def circle_layout(spark, sf):
    return lib.circle_layout(table(spark, sf, "nation").selectExpr("n_nationkey AS id")).selectExpr("id", "round(x, 6) + 0.0D AS x", "round(y, 6) + 0.0D AS y")


@query("runs_with_rules", "SELECT o_orderkey AS id, coalesce(c_name, '(deleted rule)') AS rule_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey")
def runs_with_rules(spark, sf):
    rules = table(spark, sf, "customer").where("c_custkey % 4 <> 0").selectExpr("c_custkey AS id", "c_name AS name")
    return lib.runs_with_rules(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS rule_id"), rules).select("id", "rule_name")


@query("digest_items", "SELECT o_orderkey AS id, c_name AS url FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def digest_items(spark, sf):
    w = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "c_name AS url")
    return lib.digest(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS watch_id"), w).select("id", "url")


@query("list_matters", "SELECT c_custkey AS id, count(o_orderkey) AS records, max_by('h' || CAST(o_totalprice AS VARCHAR), o_orderkey) IS NOT NULL AS sealed, max(o_orderkey) AS last_seal FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def list_matters(spark, sf):
    o = table(spark, sf, "orders")
    out = lib.list_matters(table(spark, sf, "customer").selectExpr("c_custkey AS id"), o.selectExpr("o_custkey AS matter_id"), o.selectExpr("o_custkey AS matter_id", "o_orderkey AS id", "o_orderkey AS head_hash"))
    return out.select("id", "records", F.col("last_seal").isNotNull().alias("sealed"), "last_seal")


@query("matter_statistics", f"WITH {RECORDS} SELECT matter_id, kind, count(*) AS n, CAST(sum(CASE WHEN asset_key = 0 THEN 0 ELSE asset_key * 1000 END) AS BIGINT) AS bytes, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM records GROUP BY matter_id, kind")
def matter_statistics(spark, sf):
    assets = spark.range(1, 3).selectExpr("id AS asset_key", "id * 1000 AS byte_size")
    return lib.matter_statistics(records(spark, sf).drop("byte_size"), assets)


@query("result_cache", "SELECT o_orderkey AS id, sha256('ns' || chr(31) || o_orderstatus || chr(31) || o_orderpriority || chr(31) || o_custkey) AS cache_key, o_custkey % 2 = 0 AND o_custkey % 10 < 7 AS hit FROM orders")
def result_cache(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.lit("ns").alias("namespace"), F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("parts"))
    key = F.sha2(F.concat_ws("\u001f", "namespace", F.array_join("parts", "\u001f")), 256)
    held = o.where("o_custkey % 2 = 0").select(key.alias("cache_key"), F.lit("v").alias("value"), (F.lit(1e9) - (F.col("o_custkey") % 10) * 86400.0).alias("created_at")).dropDuplicates(["cache_key"])
    return lib.cached(o, held, 1e9).select("id", "cache_key", "hit")


@query("content_address", "SELECT DISTINCT c_nationkey AS user_id, sha256(c_mktsegment) AS sha256, c_nationkey || '/2024-03/' || left(sha256(c_mktsegment), 16) || '-a_b.txt' AS storage_path FROM customer")
def content_address(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_nationkey AS user_id", "'a b.txt' AS filename", "CAST(c_mktsegment AS BINARY) AS content", "timestamp'2024-03-05 10:00:00' AS stored_at")
    return lib.content_address(a).select("user_id", "sha256", "storage_path")


@query("export_names", f"WITH {ENTRIES}, t AS (SELECT id, coalesce(source_type, 'note') || id % 4 AS name FROM entries) SELECT id, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM t)")
def export_names(spark, sf):
    return lib.export_names(entries(spark, sf), F.concat(F.coalesce("source_type", F.lit("note")), (F.col("id") % 4).cast("string"))).select("id", "file_name")


@query("restore_backup", "SELECT o_orderkey AS id, o_custkey + 5000 AS entry_id FROM orders WHERE o_custkey % 3 = 0")
def restore_backup(spark, sf):
    id_map = table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS old_id", "c_custkey + 5000 AS new_id")
    return lib.restore(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS entry_id"), id_map)


@query("corpus_overview", f"WITH {ENTRIES} SELECT user_id, count(*) AS entries, count(*) FILTER (is_archived) AS archived, count(*) FILTER (is_archived IS NOT TRUE) AS active FROM entries GROUP BY user_id")
def corpus_overview(spark, sf):
    return lib.corpus_overview(entries(spark, sf))
