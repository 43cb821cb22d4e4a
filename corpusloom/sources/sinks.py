"""Sinks: backups, note vaults, evidence packs, graph drawings."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ledger
from corpusloom.operators.library import circle_layout, display_title, export_names, normalise_tags


def write_backup(relations: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per relation."""
    for name, df in relations.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_backup(spark, path: str, schemas: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def vault_notes(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(file_name, body): a Markdown note per entry with front matter and links to its neighbours' notes."""
    safe = F.substring(F.trim(F.regexp_replace(display_title(), r'[\\/:*?"<>|#^\[\]\s]+', " ")), 1, 80)
    named = export_names(entries, safe)
    other = named.select(F.col("id").alias("other"), F.col("file_name").alias("other_name"))
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"))).distinct()
    refs = both.join(other, "other").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "other_name", F.lit("]]")))), "\n").alias("refs"))
    tags = F.array_join(normalise_tags(F.col("tags")), ", ")
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct(display_title().alias("t"))).substr(6, 1000), F.lit("\ntags: ["), tags, F.lit("]\n---\n\n"))
    body = F.concat(head, F.coalesce("summary", F.lit("")), F.when(F.col("refs").isNotNull(), F.concat(F.lit("\n\n## Links\n"), "refs")).otherwise(""))
    return named.join(refs, "id", "left").select(F.concat("file_name", F.lit(".md")).alias("file_name"), body.alias("body"))


def write_notes(notes: DataFrame, path: str) -> None:
    """Each note's name and body, as text files partitioned by nothing but size."""
    notes.write.mode("overwrite").json(path)


def evidence_pack(entries: list[dict], files: dict[str, bytes], name: str) -> bytes:
    """A zip of one matter's sealed manifest, its anchor text and its files, named by sequence. A matter's size, not a corpus's."""
    manifest = ledger.seal_manifest(entries)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", ledger.canonical_json(manifest))
        z.writestr("ANCHOR.txt", ledger.anchor_text(manifest, name))
        for e in entries:
            if e["record_id"] in files:
                z.writestr(f"records/{e['sequence']:03d}-{e['record_id']}", files[e["record_id"]])
    return buf.getvalue()


def verify_pack(pack: bytes) -> list[str]:
    """Problems of a pack: entries that do not rehash, links that do not hold, a head or root that differs."""
    with zipfile.ZipFile(io.BytesIO(pack)) as z:
        m = json.loads(z.read("manifest.json"))
    out, prev = [], ledger.GENESIS
    for e in m["entries"]:
        meta = json.loads(e["metadata"]) if isinstance(e.get("metadata"), str) else e.get("metadata")
        if e["prev_hash"] != prev:
            out.append(f"broken_link {e['sequence']}")
        if ledger.entry_hash(e["sequence"], e["record_id"], e["content_hash"], meta, e["prev_hash"]) != e["entry_hash"]:
            out.append(f"altered_entry {e['sequence']}")
        prev = e["entry_hash"]
    if m["head_hash"] != prev:
        out.append("head")
    if m["merkle_root"] != ledger.merkle_root_of([e["entry_hash"] for e in m["entries"]]):
        out.append("root")
    return out


def graph_svg(nodes: DataFrame, edges: DataFrame, size: int = 800, limit: int = 200) -> str:
    """A circular drawing of the newest ``limit`` nodes."""
    from corpusloom.operators.library import graph_data

    r, c = 0.42 * size, size / 2
    kept = circle_layout(nodes.orderBy(F.desc("id")).limit(limit)).select("id", "title", (c + r * F.col("x")).alias("x"), (c + r * F.col("y")).alias("y"))
    at = {n["id"]: n for n in kept.collect()}  # at most ``limit`` rows
    lines = [f'<line x1="{at[e.from_id].x:.1f}" y1="{at[e.from_id].y:.1f}" x2="{at[e.to_id].x:.1f}" y2="{at[e.to_id].y:.1f}" stroke="#999"/>' for e in graph_data(nodes, edges, limit).limit(limit * limit).collect() if e.from_id in at and e.to_id in at]
    import html

    marks = [f'<circle cx="{n.x:.1f}" cy="{n.y:.1f}" r="6"/><text x="{n.x + 8:.1f}" y="{n.y + 4:.1f}">{html.escape(str(n.title or ""))}</text>' for n in at.values()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">{"".join(lines)}{"".join(marks)}</svg>'
