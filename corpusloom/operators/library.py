"""The document library: search and listing, tags, patches, bulk edits, cascades, statistics.

Every function takes and returns DataFrames; nothing is collected. Entries have the columns of the document relation
(id, user_id, source_type, source_ref, title, summary, source_text, tags, is_archived, is_pinned, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def user_scan(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def active(c: str = "is_archived") -> Column:
    """Three-valued: a missing flag counts as active."""
    return ~F.col(c).eqNullSafe(True)


def entry_documents(entries: DataFrame, limit: int | None = 400, include_archived: bool = False, max_chars: int | None = 200_000) -> DataFrame:
    """The corpus that analyses read: source text, else summary; blank ones dropped; newest first. None lifts a limit."""
    text = F.coalesce(F.when(F.col("source_text") != "", F.col("source_text")), F.col("summary"))
    d = (entries if include_archived else entries.where(active())).select("id", display_title().alias("title"), text.alias("text"), "created_at").where(blank(F.col("text")).isNotNull())
    if max_chars:
        d = d.withColumn("text", F.substring("text", 1, max_chars))
    return d.orderBy(F.desc("id")).limit(limit) if limit else d


def corpus_overview(entries: DataFrame) -> DataFrame:
    """How much material each user's analyses have: entries, archived ones, active ones (a missing flag counts as active)."""
    return entries.groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(F.col("is_archived")).alias("archived"), F.count_if(active()).alias("active"))


def keyword_search(entries: DataFrame, query: str, limit: int | None = 8) -> DataFrame:
    """Case-insensitive match of the trimmed query in summary or reference; ``%`` and ``_`` act as wildcards. Newest first."""
    q = query.strip()
    if not q:
        return entries.limit(0)
    hit = F.col("summary").ilike(f"%{q}%") | F.col("source_ref").ilike(f"%{q}%")
    out = entries.where(hit).orderBy(F.desc("id"))
    return out.limit(limit) if limit else out


def list_entries(entries: DataFrame, query: str = "", tag: str = "", source_type: str = "", archived: bool | None = False, pinned_first: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of entries with ``total`` before paging and ``has_more``."""
    d = entries
    if query.strip():
        like = f"%{query.strip()}%"
        d = d.where(F.col("summary").ilike(like) | F.col("source_ref").ilike(like) | F.col("title").ilike(like) | F.col("source_text").ilike(like))
    if tag:
        d = d.where(F.col("tags").ilike(f"%{tag}%"))
    if source_type:
        d = d.where(F.col("source_type") == source_type)
    if archived is not None:
        d = d.where(F.col("is_archived") if archived else active())
    order = [F.desc("is_pinned"), F.desc("id")] if pinned_first else [F.desc("id")]
    total = d.agg(F.count("*").alias("total"))  # one row
    page = d.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))
    return page.withColumn("has_more", F.col("total") > offset + limit)


def display_title() -> Column:
    """title, else source_ref, else the summary's first line, at most 80 characters."""
    line = F.substring(F.trim(F.split(F.trim("summary"), "\n")[0]), 1, 80)
    return F.coalesce(blank(F.col("title")), blank(F.col("source_ref")), line)


def excerpt(c: str = "summary", n: int = 500) -> Column:
    return F.substring(c, 1, n)


def normalise_tags(raw: Column, most: int = 25, width: int = 40) -> Column:
    """Split at commas, trimmed, lower-cased, cut, distinct in order, the first ``most``."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.substring(F.lower(F.trim(t)), 1, width))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, most)


def word_count(c: Column) -> Column:
    """Words by white space; 0 for null and blank."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def rule_context(entries: DataFrame) -> DataFrame:
    """What rules see of an entry: its fields, domain and word count."""
    text = F.coalesce(F.when(F.col("source_text") != "", F.col("source_text")), F.col("summary"), F.lit(""))
    return entries.select(
        "id", F.coalesce("source_type", F.lit("")).alias("source_type"), F.lower(F.regexp_extract("source_ref", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)).alias("domain"), display_title().alias("title"), text.alias("text"), normalise_tags(F.col("tags")).alias("tags"), word_count(text).alias("word_count"), F.col("is_archived").eqNullSafe(True).alias("archived"), F.coalesce("is_pinned", F.lit(False)).alias("starred"), "created_at"
    )


def update_entries(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (id and any of title, summary, tags, notes): given fields change; a blank summary is ignored."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *(F.col(c).alias(f"_{c}") for c in fields))
    out = entries.join(p, "id", "left")
    for c in fields:
        new = F.substring(f"_{c}", 1, 300) if c == "title" else blank(F.col("_summary")) if c == "summary" else F.array_join(normalise_tags(F.col("_tags")), ", ") if c == "tags" else F.col(f"_{c}")
        out = out.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.coalesce(new, F.col(c))))
    return out.select(*entries.columns)


def bulk_action(entries: DataFrame, ids: DataFrame, action: str, tag: str = "") -> DataFrame:
    """Entries after an action (archive, unarchive, pin, unpin, tag, untag, delete) on the listed ids."""
    if action == "delete":
        return entries.join(ids.select("id").distinct(), "id", "left_anti")
    chosen = entries.join(ids.select("id", F.lit(True).alias("_on")).distinct(), "id", "left")
    on = F.col("_on").eqNullSafe(True)
    tags = normalise_tags(F.col("tags"))
    change = {
        "archive": ("is_archived", F.lit(True)), "unarchive": ("is_archived", F.lit(False)), "pin": ("is_pinned", F.lit(True)), "unpin": ("is_pinned", F.lit(False)),
        "tag": ("tags", F.array_join(F.slice(F.array_distinct(F.concat(tags, normalise_tags(F.lit(tag)))), 1, 25), ", ")),
        "untag": ("tags", F.array_join(F.array_except(tags, normalise_tags(F.lit(tag))), ", ")),
    }
    if action not in change:
        raise ValueError(f"unknown action: {action}")
    column, value = change[action]
    return chosen.withColumn(column, F.when(on, value).otherwise(F.col(column))).select(*entries.columns)


def delete_cascade(deleted: DataFrame, tables: dict[str, tuple[DataFrame, tuple[str, ...], bool]]) -> dict[str, DataFrame]:
    """Delete ids everywhere. tables: name -> (rows, referring columns, whether the reference is set to null instead)."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    out = {}
    for name, (rows, columns, nullify) in tables.items():
        for c in columns:
            if nullify:
                rows = rows.join(gone, F.col(c) == F.col("_gone"), "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
            else:
                rows = rows.join(gone, F.col(c) == F.col("_gone"), "left_anti")
        out[name] = rows
    return out


def merge_duplicates(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Repoint edges from duplicates to survivors (mapping: duplicate, survivor) and drop loops."""
    out = edges
    for c in ("from_id", "to_id"):
        m = mapping.select(F.col("duplicate").alias("_d"), F.col("survivor").alias("_s"))
        out = out.join(m, F.col(c) == F.col("_d"), "left").withColumn(c, F.coalesce("_s", c)).drop("_d", "_s")
    return out.where("from_id <> to_id")


def versions(drafts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Number drafts 1, 2, ... within their keys."""
    return drafts.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def next_reference(matters: DataFrame, column: str = "reference") -> DataFrame:
    """M-%04d one above the greatest numeric suffix."""
    n = F.max(F.expr(f"try_cast(regexp_extract({column}, '^M-([0-9]+)$', 1) AS int)"))
    return matters.agg(F.format_string("M-%04d", F.coalesce(n, F.lit(0)) + 1).alias("reference"))


def tag_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(normalise_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def source_type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n"))


def library_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(active()).alias("active"), F.count_if(F.col("is_archived").eqNullSafe(True)).alias("archived"), F.count_if(F.col("is_pinned").eqNullSafe(True)).alias("pinned"), F.count_if(F.col("source_text") != "").alias("with_source"))


def storage_usage(assets: DataFrame) -> DataFrame:
    """Count and bytes by kind, and of all (kind null)."""
    return assets.rollup("kind").agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


def analytics(entries: DataFrame, cards: DataFrame, today: str) -> DataFrame:
    """One row: totals, words, mean summary words (1 place), words and retention, and the streak of days up to today."""
    words = word_count(F.col("summary"))
    e = entries.agg(F.count("*").alias("entries"), F.sum(word_count(F.col("source_text"))).alias("source_words"), F.round(F.avg(words), 1).alias("mean_summary_words"))
    c = cards.agg(F.count("*").alias("cards"), F.round(F.count_if(F.col("repetitions") > 0) / F.nullif(F.count("*"), F.lit(0).cast("long")), 3).alias("retention"))
    days = entries.select(F.to_date("created_at").alias("day"))
    return e.join(c).join(streak(days, today))


def streak(days: DataFrame, today: str | None = None) -> DataFrame:
    """Length of the run of days that ends today (or on the last day there is, if ``today`` is None)."""
    d = days.where(F.col("day").isNotNull()).distinct()
    last = F.lit(today).cast("date") if today else F.max("day").over(Window.partitionBy())
    if today:
        d = d.where(F.col("day") <= last)
    # the day of rank k counts while it is k - 1 days before the anchor; the distinct days are few
    ranked = d.withColumn("anchor", last).withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("day"))))
    return ranked.agg(F.count_if(F.datediff("anchor", "day") == F.col("k") - 1).alias("streak"))


def daily_counts(df: DataFrame, ts: str, today: str, days: int = 30) -> DataFrame:
    """Rows a day over the last ``days`` days, days without rows included."""
    span = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    n = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return span.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def due_cards(cards: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    out = cards.where(F.col("next_review_at") <= F.lit(now).cast("timestamp")).orderBy("next_review_at", "id")
    return out.limit(limit) if limit else out


def due_watches(watches: DataFrame, now: str) -> DataFrame:
    waited = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_checked_at")) / 60
    return watches.where(F.col("is_active") & (F.col("last_checked_at").isNull() | (waited >= F.col("interval_minutes"))))


def orphan_assets(assets: DataFrame, limit: int = 50) -> DataFrame:
    return assets.where("entry_id IS NULL").orderBy(F.desc("id")).limit(limit)


def recent(df: DataFrame, now: str, days: int, ts: str = "created_at") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def expire(df: DataFrame, now: str, days: int, ts: str = "created_at") -> DataFrame:
    """What retention keeps."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def session_state(sessions: DataFrame, now: str) -> DataFrame:
    """Each session's state: revoked, expired (over 90 days), idle (over 60 minutes, or 30 days if remembered), active."""
    t = F.unix_timestamp(F.lit(now).cast("timestamp"))
    age, idle = t - F.unix_timestamp("created_at"), t - F.unix_timestamp("last_seen_at")
    most = F.when(F.col("remember"), 30 * 86400).otherwise(3600)
    return sessions.withColumn("state", F.when(F.col("revoked"), "revoked").when(age > 90 * 86400, "expired").when(idle > most, "idle").otherwise("active"))


def human_size(n: Column) -> Column:
    unit = lambda k, name: F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def links_for(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Each edge seen from both ends, with the other end's title."""
    ends = edges.select("id", "relationship_type", "similarity", F.explode(F.array(F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("other")))).alias("e")).select("id", "e.node", "e.other", "relationship_type", "similarity")
    return ends.where("node <> other").join(entries.select(F.col("id").alias("other"), "title"), "other")


def graph_data(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """Edges with both ends among the newest ``limit`` nodes."""
    kept = nodes.orderBy(F.desc("id")).limit(limit).select("id")
    return edges.join(kept.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(kept.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def circle_layout(nodes: DataFrame, order: str = "id") -> DataFrame:
    """Node i of n at angle 2 pi i / n - pi / 2 on the unit circle."""
    n = nodes.agg(F.count("*").alias("n"))
    ranked = nodes.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1).join(F.broadcast(n))
    angle = 2 * F.pi() * F.col("i") / F.col("n") - F.pi() / 2
    return ranked.withColumns({"x": F.cos(angle), "y": F.sin(angle)})


def with_status(jobs: DataFrame, statuses: tuple[str, ...] = ("running", "queued"), limit: int | None = 12) -> DataFrame:
    """The newest jobs of some statuses (by created_at, then id)."""
    out = jobs.where(F.col("status").isin(*statuses)).orderBy(F.desc("created_at"), F.desc("id"))
    return out.limit(limit) if limit else out


def digest(items: DataFrame, watches: DataFrame) -> DataFrame:
    """Digest items with the address of their watch, if it is still there. items: watch_id, ...; watches: id, url."""
    return items.join(watches.select(F.col("id").alias("watch_id"), "url"), "watch_id", "left")


def runs_with_rules(runs: DataFrame, rules: DataFrame) -> DataFrame:
    return runs.join(rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name")), "rule_id", "left").withColumn("rule_name", F.coalesce("rule_name", F.lit("(deleted rule)")))


def list_matters(matters: DataFrame, records: DataFrame, seals: DataFrame) -> DataFrame:
    """Matters with their record counts and last seals."""
    n = records.groupBy("matter_id").agg(F.count("*").alias("records"))
    last = seals.groupBy("matter_id").agg(F.max_by("head_hash", "id").alias("last_seal"))
    return matters.join(n, matters.id == n.matter_id, "left").drop("matter_id").join(last, matters.id == last.matter_id, "left").drop("matter_id").withColumn("records", F.coalesce("records", F.lit(0)))


def matter_statistics(records: DataFrame, assets: DataFrame) -> DataFrame:
    """Per matter and kind: records, bytes of their assets, first and last occurrence."""
    return records.join(assets, "asset_key", "left").groupBy("matter_id", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def cached(requests: DataFrame, cache: DataFrame, now: float, ttl: float = 7 * 86400) -> DataFrame:
    """Requests (namespace, parts) with their cache key, value and whether it is a hit."""
    key = F.sha2(F.concat_ws("\u001f", "namespace", F.array_join("parts", "\u001f")), 256)
    held = cache.select("cache_key", "value", F.col("created_at").alias("_at"))
    out = requests.withColumn("cache_key", key).join(held, "cache_key", "left")
    hit = F.coalesce(F.lit(now) - F.col("_at") < ttl, F.lit(False))
    return out.withColumns({"hit": hit, "value": F.when(hit, F.col("value"))}).drop("_at")


def content_address(assets: DataFrame) -> DataFrame:
    """sha256 and storage path of each asset (user_id, filename, content, stored_at); equal bytes of a user once."""
    sha = F.sha2("content", 256)
    safe = F.regexp_replace("filename", r"[^A-Za-z0-9._-]+", "_")
    path = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("stored_at", "yyyy-MM"), F.concat_ws("-", F.substring(sha, 1, 16), safe))
    return assets.withColumns({"sha256": sha, "storage_path": path}).dropDuplicates(["user_id", "sha256"])


def export_names(entries: DataFrame, name: Column) -> DataFrame:
    """File names without collisions: the second of a name gets -2, the third -3."""
    k = F.row_number().over(Window.partitionBy("_name").orderBy("id"))
    return entries.withColumn("_name", name).withColumn("file_name", F.when(k == 1, F.col("_name")).otherwise(F.concat_ws("-", F.col("_name"), k))).drop("_name")


def restore(backup: DataFrame, id_map: DataFrame, orphan: str = "inner") -> DataFrame:
    """Rows of a backup with their entry ids remapped (old_id, new_id); orphans dropped, or kept without entry ("left")."""
    return backup.join(id_map, backup.entry_id == F.col("old_id"), orphan).withColumn("entry_id", F.col("new_id")).drop("old_id", "new_id")
