"""Smaller operators: highlights, participants, layouts, decks, comparisons, shares, model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as tx

# Limits of a room's payloads.
MAX_STRING, MAX_LIST, MAX_NEST = 8000, 200, 6


def highlight_segments(marks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Disjoint segments (start, end, marks) of overlapping highlights (doc_id, mark_id, start, end): every boundary cuts."""
    cuts = marks.where("start < end").select(by, F.explode(F.array("start", "end")).alias("at")).distinct()
    w = Window.partitionBy(by).orderBy("at")
    seg = cuts.withColumn("to", F.lead("at").over(w)).where("to IS NOT NULL")
    m = marks.select(F.col(by).alias("_by"), "mark_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = seg.join(m, (F.col(by) == F.col("_by")) & (F.col("_s") <= F.col("at")) & (F.col("_e") >= F.col("to")))
    return held.groupBy(by, F.col("at").alias("start"), F.col("to").alias("end")).agg(F.array_sort(F.collect_list("mark_id")).alias("marks"))


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


@F.pandas_udf(StringType())
def initials_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda n: "".join(w[0] for w in (n or "").split()[:2]).upper() or "?")


def participants(people: DataFrame) -> DataFrame:
    """Display name, initials and a colour hue (0 to 359) from the name's FNV-1a hash."""
    from pyspark.sql.types import IntegerType

    hue = F.pandas_udf(lambda s: s.map(lambda n: fnv1a(n or "") % 360), IntegerType())
    return people.withColumns({"initials": initials_udf("name"), "hue": hue("name")})


def scrub(value: object, depth: int = 0) -> object:
    """A payload within a room's limits: strings cut, lists and maps shortened, what nests too deeply dropped."""
    if depth > MAX_NEST:
        return None
    if isinstance(value, str):
        return value[:MAX_STRING]
    if isinstance(value, dict):
        return {str(k)[:100]: scrub(v, depth + 1) for k, v in list(value.items())[:MAX_LIST]}
    if isinstance(value, (list, tuple)):
        return [scrub(v, depth + 1) for v in value[:MAX_LIST]]
    return value if value is None or isinstance(value, (bool, int, float)) else str(value)[:MAX_STRING]


def force_layout(n: int, edges: list[tuple[int, int, float]], width: float = 1000.0, height: float = 700.0, rounds: int = 200, seed: int = 1) -> np.ndarray:
    """Positions of a drawing's nodes by Fruchterman and Reingold: a canvas, not a corpus."""
    rng = np.random.default_rng(seed)
    pos = rng.uniform((0, 0), (width, height), (n, 2))
    k, heat = 1.05 * np.sqrt(width * height / max(1, n)), width / 10
    e = np.array([(a, b) for a, b, _ in edges], int).reshape(-1, 2)
    w = np.array([s for *_, s in edges])
    for _ in range(rounds):
        d = pos[:, None] - pos[None]
        dist = np.maximum(np.hypot(*d.transpose(2, 0, 1)), 0.01)
        move = (d / dist[..., None] * (k * k / dist)[..., None]).sum(1)
        pull = pos[e[:, 0]] - pos[e[:, 1]]
        force = pull * (np.hypot(*pull.T) / k * w)[:, None] if len(e) else pull
        np.add.at(move, e[:, 0], -force)
        np.add.at(move, e[:, 1], force)
        move += 0.006 * k * ((width / 2, height / 2) - pos)
        length = np.maximum(np.hypot(*move.T), 0.01)
        pos += move / length[:, None] * np.minimum(length, heat)[:, None]
        heat *= 0.975
    return pos


def align_comparison(rows: DataFrame, labels: list[str], sources: list[str], default: str = "Not stated") -> DataFrame:
    """One row per label in the given order, one column per source; what a source does not say is ``default``.
    rows: label, source, value."""
    key = F.lower(F.trim("label"))
    want = rows.sparkSession.createDataFrame(list(enumerate(labels)), "place int, label string")
    wide = rows.withColumn("_k", key).groupBy("_k").pivot("source", sources).agg(F.first("value"))
    out = want.withColumn("_k", key).join(wide, "_k", "left").drop("_k")
    return out.select("place", "label", *(F.coalesce(F.col(f"`{s}`"), F.lit(default)).alias(s) for s in sources))


def share_tokens(shares: DataFrame, requests: DataFrame) -> DataFrame:
    """A token for each requested entry: the one it has, or a new one. shares: entry_id, token."""
    return requests.select("entry_id").distinct().join(shares.groupBy("entry_id").agg(F.min("token").alias("held")), "entry_id", "left").select("entry_id", F.coalesce("held", F.sha2(F.concat(F.lit("share:"), F.col("entry_id").cast("string")), 256)).alias("token"), F.col("held").isNull().alias("is_new"))


def annotations_of(annotations: DataFrame) -> DataFrame:
    """Annotations with a note, the newest first within each entry, numbered."""
    k = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("id")))
    return annotations.where(F.trim(F.coalesce("note", F.lit(""))) != "").withColumn("k", k)


def vault_stats(items: DataFrame, by: str = "user_id") -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.octet_length("ciphertext").cast("long")).alias("bytes"))


def flashcard_deck(cards: DataFrame) -> DataFrame:
    """Lines of a tab-separated deck: front, back, tags."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")
    return cards.select(F.concat_ws("\t", clean("front"), clean("back"), clean("tags")).alias("value"))


def user_agent(c: Column) -> Column:
    """Browser and system of a user-agent string, in words."""
    browser = F.when(c.contains("Edg/"), "Edge").when(c.contains("OPR/"), "Opera").when(c.contains("Firefox/"), "Firefox").when(c.contains("Chrome/"), "Chrome").when(c.contains("Safari/"), "Safari").otherwise("Unknown browser")
    system = F.when(c.contains("iPhone") | c.contains("iPad"), "iOS").when(c.contains("Android"), "Android").when(c.contains("Windows"), "Windows").when(c.contains("Mac OS X"), "macOS").when(c.contains("Linux"), "Linux").otherwise("unknown system")
    return F.concat(browser, F.lit(" on "), system)


def with_model(df: DataFrame, column: str, out: str, model: Callable[[list[str]], list[str]] | None, fallback: Column, batch: int = 32) -> DataFrame:
    """A column by a text model over batches, or the fallback where there is no model or it fails; ``<out>_degraded`` tells which.

    The hook behind summaries, explanations, drafts, topic labels, change notes and answers.
    """
    if model is None:
        return df.withColumns({out: fallback, f"{out}_degraded": F.lit(True)})

    @F.pandas_udf(StringType())
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            found: list = []
            texts = s.fillna("").tolist()
            for at in range(0, len(texts), batch):
                try:
                    found += list(model(texts[at : at + batch]))
                except Exception:  # the model is the caller's: a failed batch falls back
                    found += [None] * len(texts[at : at + batch])
            yield pd.Series(found)

    tried = df.withColumn("_m", run(column))
    return tried.withColumns({out: F.coalesce("_m", fallback), f"{out}_degraded": F.col("_m").isNull()}).drop("_m")


def subjects_match(a: Column, b: Column) -> Column:
    """Claim subjects (arrays of stems): one within the other, half shared, or single words an edit apart."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    subset = (both == F.size(F.array_distinct(a))) | (both == F.size(F.array_distinct(b)))
    edit = (F.size(a) == 1) & (F.size(b) == 1) & (F.levenshtein(F.element_at(a, 1), F.element_at(b, 1), 1) >= 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & (subset | (2 * both >= either) | edit)


def credibility(text: Column, compound: Column, claims: Column, search: str) -> Column:
    """Struct of the loaded language, tone and readability of a text, and its claims (an array, from a model), each with a link to look it up."""
    sentiment = F.struct(tx.tone(compound).alias("tone"), F.round(compound, 3).alias("compound"))
    links = F.transform(claims, lambda c: F.struct(c.alias("text"), F.concat(F.lit(search), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).alias("search_url")))
    return F.struct(tx.loaded_language(text).alias("loaded_language"), sentiment.alias("sentiment"), tx.readability(text).alias("readability"), links.alias("claims"))
