"""Queries of the smaller operators, sources and streams."""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import quiz
from corpusloom.functions import text as tx
from corpusloom.operators import audio
from corpusloom.operators import extras as ex
from corpusloom.operators.graph import checkpointed
from corpusloom.plans.registry import query
from corpusloom.plans.relations import ENTRIES, entries, spread, table
from corpusloom.plans.text_queries import LOADED, LOADED_TERMS, READ, loaded_text
from corpusloom.sources import readers, sinks


@query("highlight_segments", """WITH m AS (SELECT o_custkey AS doc_id, o_orderkey AS mark_id, o_orderkey % 50 AS s, o_orderkey % 50 + o_orderkey % 13 AS e FROM orders), c AS (SELECT doc_id, s AS p FROM m WHERE s < e UNION SELECT doc_id, e FROM m WHERE s < e),
 g AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS to_ FROM c) SELECT g.doc_id, p AS start, to_ AS "end", count(*) AS n, min(mark_id) AS first_mark FROM g JOIN m ON m.doc_id = g.doc_id AND m.s <= p AND m.e >= to_ GROUP BY 1, 2, 3""")
def highlight_segments(spark, sf):
    m = table(spark, sf, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS mark_id", "o_orderkey % 50 AS start", "o_orderkey % 50 + o_orderkey % 13 AS end")
    return ex.highlight_segments(m).select("doc_id", "start", "end", F.size("marks").cast("long").alias("n"), F.element_at("marks", 1).alias("first_mark"))


@query("participants", "SELECT c_custkey AS id, 'C' AS initials, true AS in_range FROM customer")
def participants(spark, sf):
    p = ex.participants(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name"))
    return p.select("id", "initials", F.col("hue").between(0, 359).alias("in_range"))


@query("align_comparison", "SELECT * FROM (VALUES (0, 'F', 'y', 'Not stated'), (1, 'O', 'Not stated', 'z'), (2, 'none', 'Not stated', 'Not stated')) t(place, label, a, b)")
def align_comparison(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("source"), F.when(F.col("o_orderstatus") == "F", "y").otherwise("z").alias("value")).where("label IN ('F', 'O')").distinct()
    return ex.align_comparison(rows, ["F", "O", "none"], ["a", "b"])


@query("share_tokens", "SELECT c_custkey AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey ELSE sha256('share:' || c_custkey) END AS token, c_custkey % 3 <> 0 AS is_new FROM customer")
def share_tokens(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS entry_id")
    return ex.share_tokens(c.where("entry_id % 3 = 0").selectExpr("entry_id", "concat('t', entry_id) AS token"), c.unionByName(c))


@query("annotations", "SELECT o_orderkey AS id, o_custkey AS entry_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 5 <> 0", ints=("k",))
def annotations(spark, sf):
    return ex.annotations_of(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS entry_id", "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE 'n' END AS note")).select("id", "entry_id", "k")


@query("vault_stats", "SELECT c_nationkey AS user_id, count(*) AS n, CAST(sum(strlen(c_name)) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def vault_stats(spark, sf):
    return ex.vault_stats(table(spark, sf, "customer").selectExpr("c_nationkey AS user_id", "c_name AS ciphertext"))


@query("flashcard_deck", "SELECT o_orderstatus || chr(9) || o_orderpriority || chr(9) || 'a b' AS value FROM orders")
def flashcard_deck(spark, sf):
    return ex.flashcard_deck(table(spark, sf, "orders").selectExpr("o_orderstatus AS front", "o_orderpriority AS back", "'a\\tb' AS tags"))


@query("user_agents", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Firefox on Linux' WHEN 1 THEN 'Chrome on Windows' ELSE 'Safari on iOS' END AS agent FROM events")
def user_agents(spark, sf):
    k = F.col("event_id") % 3
    ua = F.when(k == 0, "Mozilla/5.0 (X11; Linux x86_64) Gecko Firefox/125.0").when(k == 1, "Mozilla/5.0 (Windows NT 10.0) Chrome/124.0 Safari/537.36").otherwise("Mozilla/5.0 (iPhone; CPU OS 17_0 like Mac OS X) Safari/604.1")
    return table(spark, sf, "events").select("event_id", ex.user_agent(ua).alias("agent"))


@query("subjects_match", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS same FROM orders")
def subjects_match(spark, sf):
    k = F.col("o_orderkey") % 4
    arr = lambda *w: F.array(*map(F.lit, w))
    b = F.when(k == 0, arr("user")).when(k == 1, arr("annual", "recur", "revenu")).when(k == 2, arr("kilomet")).otherwise(arr("employe"))
    a = F.when(k == 0, arr("activ", "user")).when(k == 1, arr("recur", "revenu", "total")).when(k == 2, arr("user")).otherwise(arr("employee"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ex.subjects_match(a, b).alias("same"))


@query("model_fallback", f"WITH {ENTRIES} SELECT id, left(summary, 40) AS answer, true AS answer_degraded FROM entries")
def model_fallback(spark, sf):
    return ex.with_model(entries(spark, sf), "summary", "answer", None, F.substring("summary", 1, 40)).select("id", "answer", "answer_degraded")


@query("comment_sentiment", "SELECT user_id AS video_id, count(*) AS n, CASE WHEN avg(c) >= 0.05 THEN 'positive' WHEN avg(c) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT user_id, CAST((event_id * 37 + user_id * 11) % 21 - 10 AS DOUBLE) / 10 AS c FROM events) GROUP BY 1")
def comment_sentiment(spark, sf):
    c = table(spark, sf, "events").selectExpr("user_id AS video_id", "event_id", "((event_id * 37 + user_id * 11) % 21 - 10) / 10.0D AS compound")
    return readers.comment_sentiment(c, order="event_id").select("video_id", "n", "label")


@query("transcripts", "SELECT lpad(CAST(conv_id AS VARCHAR), 11, 'v') AS video_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def transcripts(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("https://youtu.be/"), F.lpad(F.col("conv_id").cast("string"), 11, "v")).alias("url"), F.col("turn").alias("start"), "text")
    return readers.transcripts(c)


@query("article_domains", "SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain FROM pages")
def article_domains(spark, sf):
    return readers.articles(table(spark, sf, "pages")).select("url", "domain")


@query("articles")
def articles(spark, sf):
    return readers.articles(table(spark, sf, "pages"))


@query("vault_notes")
def vault_notes(spark, sf):
    links = entries(spark, sf).where("id % 3 = 0").selectExpr("id AS from_id", "id + 1 AS to_id")
    return sinks.vault_notes(entries(spark, sf), links)


@query("quiz")
def quiz_questions(spark, sf):
    return quiz.questions(spread(table(spark, sf, "documents").select("doc_id", "text")), id_col="doc_id")


@query("word_salience", "WITH s AS (SELECT conv_id AS id, turn AS sentence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS word FROM conversations), n AS (SELECT id, count(DISTINCT sentence) AS n FROM s GROUP BY 1), t AS (SELECT id, word, count(*) AS tf, count(DISTINCT sentence) AS sf FROM s GROUP BY 1, 2) SELECT t.id, word, round((1 + ln(tf)) * ln(1 + n::DOUBLE / sf) * (1 + 0.03::DOUBLE * least(length(word), 14)), 6) AS weight FROM t JOIN n ON t.id = n.id")
def word_salience(spark, sf):
    from corpusloom.functions.reading import salience

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("sentence"), F.explode(tx.ascii_tokens(F.col("text"))).alias("word"))
    return salience(c.withColumn("proper", F.lit(False))).select("id", "word", F.round("weight", 6).alias("weight"))


@query("circuit_breaker", "WITH r AS (SELECT event_id, user_id, ts, event_id % 3 <> 0 AS bad, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM events) SELECT event_id, CAST(sum(bad::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS failures FROM r")
def circuit_breaker(spark, sf):
    from corpusloom.streaming.watches import breaker

    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("service"), F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("ok"))
    return breaker(e).select("event_id", "failures")


@query("cache_hit_rate", "SELECT event_type AS namespace, round(avg((event_id % 3 = 0)::INT), 6) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf):
    from corpusloom.streaming.watches import hit_rate

    return hit_rate(table(spark, sf, "events").select(F.col("event_type").alias("namespace"), (F.col("event_id") % 3 == 0).alias("hit"))).select("namespace", F.round("hit_rate", 6).alias("hit_rate"))


@query("room_state", "WITH l AS (SELECT user_id AS room_id, event_id % 10 AS item_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'highlight.added' WHEN 1 THEN 'highlight.added' ELSE 'highlight.removed' END AS t FROM events) SELECT room_id, item_id FROM (SELECT room_id, item_id, arg_max(t, seq) AS last FROM l GROUP BY 1, 2) WHERE last = 'highlight.added'")
def room_state(spark, sf):
    from corpusloom.streaming import rooms

    e = table(spark, sf, "events").selectExpr("user_id AS room_id", "event_id AS seq", "CASE event_id % 3 WHEN 2 THEN 'highlight.removed' ELSE 'highlight.added' END AS event_type", "event_id % 10 AS item_id", "CAST(value AS STRING) AS payload", "CAST(NULL AS BIGINT) AS anchor")
    return rooms.room_state(e).select("room_id", "item_id")


@query("credibility", f"WITH {LOADED}, {LOADED_TERMS}, {READ} SELECT d.doc_id, level, density AS density_per_100_words, CASE WHEN c >= 0.3 THEN 'Strongly positive' WHEN c >= 0.05 THEN 'Leaning positive' WHEN c <= -0.3 THEN 'Strongly negative' WHEN c <= -0.05 THEN 'Leaning negative' ELSE 'Neutral' END AS tone, CASE WHEN e.n = 0 THEN NULL ELSE round(ease, 1) END AS flesch_reading_ease, 'https://search.example.org/?q=' || replace('claim ' || d.doc_id || ' & more', ' ', '%20').replace('&', '%26') AS search_url FROM (SELECT *, CASE WHEN density >= 3 THEN 'High' WHEN density >= 1 THEN 'Moderate' ELSE 'Low' END AS level, (CAST((doc_id * 37) % 201 AS DOUBLE) - 100) / 100 AS c FROM d) d JOIN e ON d.doc_id = e.doc_id")
def credibility(spark, sf):
    """The panel of loaded language, tone, readability and claims; tone comes from a scorer's number, claims from a model."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", loaded_text().alias("t"), "text", (((F.col("doc_id") * 37) % 201 - 100) / 100.0).alias("c"))
    p = d.select("doc_id", ex.credibility(F.col("t"), F.col("c"), F.array(F.concat(F.lit("claim "), F.col("doc_id").cast("string"), F.lit(" & more"))), "https://search.example.org/?q=").alias("p"), tx.readability(F.col("text")).alias("r"))
    return p.select("doc_id", "p.loaded_language.level", "p.loaded_language.density_per_100_words", "p.sentiment.tone", "r.flesch_reading_ease", F.col("p.claims")[0]["search_url"].alias("search_url"))


def tune(name: str, seconds: int = 20, rate: int = 11_025) -> np.ndarray:
    """A made-up recording: three tones a quarter of a second, by its name."""
    rng = np.random.default_rng(zlib.crc32(name.encode()))
    t = np.arange(seconds * rate) / rate
    x = np.zeros(len(t))
    for k in range(seconds * 4):
        part = slice(k * rate // 4, (k + 1) * rate // 4)
        x[part] = sum(np.sin(2 * np.pi * f * t[part]) for f in rng.integers(300, 4500, 3))
    return x / np.abs(x).max() * 0.8


@query("audio_match", "SELECT concat('clip of ', n_name) AS a, n_name AS b, true AS match, CAST(5 AS BIGINT) AS offset_seconds FROM nation")
def audio_match(spark, sf):
    """From samples to matches: WAV bytes of a recording a nation, and of seven seconds out of it, with noise, from the fifth second on."""

    def wavs(frames):
        for f in frames:
            for name in f["n_name"]:
                x, rng = tune(name), np.random.default_rng(len(name))
                for rec, y in ((name, x), (f"clip of {name}", x[5 * 11_025 : 12 * 11_025] + rng.normal(0, 0.02, 7 * 11_025))):
                    out = io.BytesIO()
                    with wave.open(out, "wb") as w:
                        w.setnchannels(1), w.setsampwidth(2), w.setframerate(11_025)
                        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
                    yield pd.DataFrame({"path": [rec], "content": [out.getvalue()]})

    files = spread(table(spark, sf, "nation").select("n_name")).mapInPandas(wavs, "path string, content binary")
    h = checkpointed(spark, audio.fingerprint_wavs(files))
    clip = F.col("rec_id").startswith("clip of ")
    best = audio.query_index(h.where(clip), h.where(~clip), 1)
    return best.select("a", "b", "match", F.round("offset_seconds").cast("long").alias("offset_seconds"))
