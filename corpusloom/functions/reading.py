"""Speed reading and review scheduling: pivots, display times, pacing, speed control, fitness, spaced repetition."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.batches import bounded, hand_back
from corpusloom.functions.lexicon import ABBREVIATIONS, STOPWORDS
from corpusloom.functions.text import count_syllables

DEFAULT_WPM, WPM_FLOOR, WPM_CEILING, MIN_FRAME_MS = 300, 150, 900, 34
OPEN, CLOSE = "\"'([{«“‘", "\"')]}»”’"
#: Length of a word's core from which on the pivot is the next character.
BANDS = (1, 2, 6, 10, 14)
# More abbreviations, of units and references.
UNITS = frozenset("ca cf dept fl ft lb oz hr min sec".split())
INITIALS = re.compile(r"(?:[A-Za-z]\.)+[A-Za-z]?")
GAP = re.compile(r"\n[ \t\r]*\n")
WORD = re.compile(r"\S+")


def orp_index(word: str | None) -> int:
    """The character to fixate: a third into the word's core at most 4 in, moved on to a letter or digit."""
    word = word or ""
    lead = len(word) - len(word.lstrip(OPEN))
    core = word[lead:].rstrip(CLOSE)
    if not core:
        return 0
    base = sum(len(core) >= b for b in BANDS[1:])
    place = next((i for i in range(base, len(core)) if core[i].isascii() and core[i].isalnum()), base)
    return min(len(word) - 1, lead + place)


def orp_column(word: Column) -> Column:
    """``orp_index`` for plain words (letters and digits only)."""
    n = F.length(word)
    return F.when(n <= 1, 0).when(n <= 5, 1).when(n <= 9, 2).when(n <= 13, 3).otherwise(4)


def ends_sentence(token: str) -> bool:
    core = token.rstrip(CLOSE)
    bare = core.rstrip(".!?").lstrip(OPEN)
    if not core or core[-1] not in ".!?" or not bare or INITIALS.fullmatch(core.lstrip(OPEN)):
        return False
    last = bare.lower().rstrip(".")
    return not (last in ABBREVIATIONS or last in UNITS or (len(last) == 1 and last.isalpha()) or (last.isdigit() and core[-1] == "."))


def delay(token: str, sentence_end: bool, paragraph_end: bool) -> float:
    """Display time against an average word: dearer when long, many-syllabled, numeric or an acronym; pauses add on top."""
    core = token.strip(OPEN + CLOSE + ".,;:!?")
    letters = re.sub("[^A-Za-z']", "", core)
    n = len(core) or len(token)
    tail = token.rstrip(CLOSE)[-1:]
    pause = 2.5 if paragraph_end else 2.0 if sentence_end else 1.5 if tail and tail in ",;:-–—" else 1.0
    cost = 1 + min(0.45, max(0, n - 5) * 0.05) + 0.2 * (n >= 12) + min(0.3, max(0, count_syllables(letters) - 2) * 0.06)
    cost += 0.35 if re.search(r"\d", core) else 0.2 if len(core) >= 3 and core.isupper() else 0
    if pause == 1 and n <= 3 and letters.lower() in STOPWORDS and letters:
        cost = 0.85
    return round(max(0.8, min(3.5, cost + pause - 1)), 3)


def prepare_words(text: str | None) -> list[dict]:
    """The words of a text with pivot, display time, boundaries and offset."""
    text = text or ""
    found = list(re.finditer(r"\S+", text))
    out = []
    for i, m in enumerate(found):
        last = i + 1 == len(found)
        para = last or bool(GAP.search(text, m.end(), found[i + 1].start()))
        stop = para or ends_sentence(m.group())
        out.append({"word": m.group(), "orp": orp_index(m.group()), "delay_multiplier": delay(m.group(), stop, para), "is_sentence_end": stop, "is_paragraph_end": para, "index": i, "char_offset": m.start()})
    return out


WORD_SCHEMA = "word string, orp int, delay_multiplier double, is_sentence_end boolean, is_paragraph_end boolean, index int, char_offset int"


@lru_cache(100_000)
def shape(word: str) -> tuple[int, bool, tuple[float, ...]]:
    """Pivot, whether it ends a sentence by itself, and display time inside one, at the end of one, and of a paragraph."""
    return orp_index(word), ends_sentence(word), (delay(word, False, False), delay(word, True, False), delay(word, True, True))


def word_columns(text: str | None, wanted: frozenset[str]) -> dict[str, list]:
    """``prepare_words`` by column, of those wanted. Word forms repeat, so what hangs on the word alone is worked out once each."""
    text = text or ""
    if wanted <= {"index"}:
        return {"index": range(len(text.split()) if text.isascii() else sum(1 for _ in WORD.finditer(text)))}
    found = list(WORD.finditer(text))
    words = [m[0] for m in found]
    starts = [m.start() for m in found]
    paras = [False] * len(words)
    if words:
        paras[-1] = True
        for g in GAP.finditer(text):
            k = bisect.bisect_left(starts, g.end()) - 1
            if k >= 0:
                paras[k] = True
    shapes = [shape(w) for w in words]
    stops = [p or s[1] for p, s in zip(paras, shapes, strict=True)]
    out = {"word": words, "orp": [s[0] for s in shapes], "delay_multiplier": [s[2][p + e] for p, e, s in zip(paras, stops, shapes, strict=True)], "is_sentence_end": stops, "is_paragraph_end": paras, "index": range(len(words)), "char_offset": starts}
    return {c: v for c, v in out.items() if c in wanted}


def rsvp(docs: DataFrame, id_col: str = "id", text_col: str = "text", wpm: float | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per word of each document, with its milliseconds on display (``ms``) if a pace is given. ``columns``: those that are read, if
    not all; the others are not worked out. Documents stream through; nothing is shuffled."""
    src = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = [c.split() for c in (WORD_SCHEMA + ", ms int" * bool(wpm)).split(", ")]
    kept = [c for c in every if columns is None or c[0] in columns]
    wanted = frozenset(c for c, _ in kept) - {"ms"} | ({"delay_multiplier"} if any(c == "ms" for c, _ in kept) else set())
    schema = to_arrow_schema(T._parse_datatype_string(", ".join(f"{c} {k}" for c, k in kept)))
    ids = to_arrow_schema(src.select("id").schema).field(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([ids.with_nullable(True), *schema])
        for b in batches:
            for i, t in enumerate(b.column(1)):
                made = word_columns(t.as_py(), wanted)
                if "ms" in schema.names:
                    made["ms"] = pacing_plan(made["delay_multiplier"], wpm)
                n = len(next(iter(made.values())))
                for at in range(0, n, 20_000):
                    size = min(20_000, n - at)
                    key = b.column(0).slice(i, 1).take(pa.array(np.zeros(size, "i4"))).cast(ids.type)
                    yield pa.RecordBatch.from_arrays([key, *(pa.array(np.arange(at, at + size) if f.name == "index" else made[f.name][at : at + size], f.type) for f in schema)], schema=out)
        hand_back()

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in kept))


def pacing_plan(multipliers: list[float], wpm: float = DEFAULT_WPM) -> list[int]:
    """Milliseconds a word: multipliers scaled to a mean of 1, rounding errors carried on, at least one frame."""
    wpm = max(50.0, min(1500.0, wpm))
    if not multipliers:
        return []
    unit = 60_000 / wpm / (sum(multipliers) / len(multipliers))
    out, carry = [], 0.0
    for m in multipliers:
        exact = m * unit + carry
        ms = max(MIN_FRAME_MS, round(exact))
        carry = exact - ms
        out.append(ms)
    return out


def adapt_wpm(wpm: Column, comprehension: Column, floor: int = WPM_FLOOR, ceiling: int = WPM_CEILING) -> dict[str, Column]:
    """new_wpm and change: a proportional step outside the band from .60 to .85, at most 12 % and 60 wpm, in steps of 5."""
    current = F.least(F.greatest(F.floor(F.coalesce(wpm, F.lit(DEFAULT_WPM))), F.lit(floor)), F.lit(ceiling))
    score = F.when(comprehension.isNotNull(), F.least(F.greatest(comprehension, F.lit(0.0)), F.lit(1.0)))
    raw = F.when(score >= 0.85, current * 0.45 * (score - 0.85)).when(score <= 0.60, current * 1.30 * (score - 0.60)).otherwise(0.0)
    most = F.least(F.lit(60.0), current * 0.12)
    step = F.rint(F.least(F.greatest(raw, -most), most) / 5.0) * 5
    new = F.least(F.greatest(current + F.coalesce(step, F.lit(0.0)), F.lit(floor)), F.lit(ceiling)).cast("int")
    return {"new_wpm": new, "change": new - current.cast("int")}


def slopes(sessions: DataFrame, by: str) -> DataFrame:
    """Slope of ``effective`` by session of each reader (``_reader``, ``slope``): covariance over variance by running means, in the order of
    the sessions, the covariance's products added unrounded. The SQL's engine works so (DuckDB's ``regr_slope``), and where the slope is
    exactly 2 the last digit decides the trend. A reader's sessions stream through their sorted partition."""
    keys = [F.asc_nulls_last("day"), F.col("id")]
    scored = sessions.where("effective IS NOT NULL").select(by, "day", "id", "effective")
    scored = scored.withColumn("x", F.count("*").over(Window.partitionBy(by).orderBy(*keys)))
    src = bounded(scored.sortWithinPartitions(by, *keys).select(F.col(by).alias("_reader"), F.col("x").cast("double"), F.col("effective").cast("double")))
    ids = to_arrow_schema(src.select("_reader").schema).field(0)
    out = pa.schema([ids.with_nullable(True), pa.field("slope", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, reader, mx, my, cov, var = 0, None, 0.0, 0.0, 0.0, 0.0
        made: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([r for r, _ in made], ids.type), pa.array([v for _, v in made], pa.float64())], schema=out)
        for b in batches:
            for r, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n and r != reader:
                    made.append((reader, cov / n / (var / n) if var else None))
                    n, mx, my, cov, var = 0, 0.0, 0.0, 0.0, 0.0
                reader, n = r, n + 1
                dx, my = x - mx, my + (y - my) / n
                mx += dx / n
                cov, var = math.fma(dx, y - my, cov), var + (x - mx) * dx
            yield packed()
            made = []
        if n:
            made.append((reader, cov / n / (var / n) if var else None))
            yield packed()
        hand_back()

    return src.mapInArrow(run, f"_reader {src.schema['_reader'].dataType.simpleString()}, slope double")


def fitness(sessions: DataFrame, by: str = "user_id") -> DataFrame:
    """Per reader: totals, means, effective and best sustained speed, streak, and trend of the effective speed by session."""
    s = sessions.where("wpm > 0").withColumns({"score": F.when(F.col("comprehension").isNotNull(), F.least(F.greatest("comprehension", F.lit(0.0)), F.lit(1.0))), "day": F.to_date("created_at")})
    s = s.withColumn("effective", F.when(F.col("score").isNotNull(), F.rint(F.col("wpm") * F.col("score"))))
    held = (F.col("words_read") >= 200) & (F.col("score") >= 0.70)
    out = s.groupBy(by).agg(
        F.count("*").alias("session_count"), F.sum("words_read").alias("total_words"), (F.sum("duration_ms") / 60000).alias("total_minutes"), F.rint(F.avg("wpm")).cast("int").alias("average_wpm"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_comprehension"), F.coalesce(F.rint(F.avg("effective")), F.lit(0)).cast("int").alias("effective_wpm"),
        F.coalesce(F.rint(F.max(F.when(held, F.col("wpm")))), F.lit(0)).cast("int").alias("best_sustained_wpm"), F.count("effective").alias("scored"),
    )
    trend = F.when(F.col("scored") < 4, "too_early").when(F.col("slope") > 2, "improving").when(F.col("slope") < -2, "declining").otherwise("steady")
    days = s.select(by, "day").where("day IS NOT NULL").distinct()
    w = Window.partitionBy(by)
    k = F.row_number().over(w.orderBy(F.desc("day")))
    runs = days.withColumns({"last": F.max("day").over(w), "k": k}).groupBy(by).agg(F.count_if(F.datediff("last", "day") == F.col("k") - 1).alias("streak_days"))
    out = out.join(runs, by, "left").join(slopes(s, by), F.col(by).eqNullSafe(F.col("_reader")), "left").drop("_reader")
    return out.withColumn("slope", F.when(F.col("scored") >= 4, F.col("slope")).otherwise(0.0)).withColumns({"trend": trend, "streak_days": F.coalesce("streak_days", F.lit(0))})


def sm2(ease: Column, interval: Column, repetitions: Column, quality: Column) -> dict[str, Column]:
    """ease_factor, interval_days and repetitions after a review of quality 0 to 5 (the interval grows by the ease before it)."""
    q = F.least(F.greatest(quality, F.lit(0)), F.lit(5))
    held = F.when(F.coalesce(interval, F.lit(0)) == 0, 1).otherwise(interval)
    days = F.when(q < 3, 1.0).when(repetitions == 0, 1.0).when(repetitions == 1, 6.0).otherwise(F.round(held * ease, 2))
    new = F.greatest(F.lit(1.3), ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    return {"ease_factor": F.round(new, 3), "interval_days": days, "repetitions": F.when(q < 3, 0).otherwise(repetitions + 1)}


def salience(tokens: DataFrame) -> DataFrame:
    """Weight of each word of a document. tokens: id, sentence, word, proper (whether it is capitalised inside a sentence)."""
    n = tokens.groupBy("id").agg(F.count_distinct("sentence").alias("n"))
    t = tokens.groupBy("id", "word").agg(F.count("*").alias("tf"), F.count_distinct("sentence").alias("sf"), F.bool_or("proper").alias("proper"))
    w = (1 + F.ln("tf")) * F.ln(1 + F.col("n") / F.col("sf")) * (1 + 0.03 * F.least(F.length("word"), F.lit(14))) * F.when(F.col("proper"), 1.35).otherwise(1.0)
    return t.join(n, "id").select("id", "word", w.alias("weight"))
