"""Provenance: where in a source each sentence of a summary comes from.

Shared n-grams nominate a few windows of the source; a local alignment with affine gaps picks the span. The alignment
works row by row in NumPy: within a row, a gap that skips source words is a running maximum, so no cell waits for its
neighbour. Spans are offsets into the source as given.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lexicon import STOPWORDS
from corpusloom.functions.text import porter_stem, split_sentences, tokenize

# Thresholds, scores and limits of the alignment.
STRONG, PARTIAL = 0.60, 0.28
MATCH, NEAR, MISMATCH, MISMATCH_FLOOR = 2.0, 0.9, -0.9, 0.35
OPEN, SOURCE_EXTEND, SUMMARY_EXTEND = -1.0, -0.08, -0.35
WINDOWS, WINDOWS_LONG, LONG, WIDEST = 4, 2, 60, 240
ALIGNED_SHARE, CONTEXT = 0.65, 0.5
COMMON = 200
WORD = re.compile(r"[^\W_]+(?:['‘’][^\W_]+)*")
ASCII_WORD = re.compile(r"[A-Za-z0-9]+")


def words_with_offsets(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens and their spans; a word that folds to several tokens gives each its own place where it can be found."""
    if text.isascii() and "'" not in text:  # every match is a plain word
        found = list(ASCII_WORD.finditer(text))
        return [m[0].lower() for m in found], [m.span() for m in found]
    words: list[str] = []
    spans: list[tuple[int, int]] = []
    for m in WORD.finditer(text):
        raw, (a, b) = m.group(), m.span()
        parts = [raw.lower()] if raw.isascii() and raw.isalnum() else tokenize(raw)
        low, at = raw.lower(), 0
        for p in parts:
            k = low.find(p, at) if len(parts) > 1 else -1
            spans.append((a + k, a + k + len(p)) if k >= 0 else (a, b))
            words.append(p)
            at = k + len(p) if k >= 0 else at
    return words, spans


class Source:
    """A source's tokens, their rarity within it, and the postings of their n-grams (of all, or of those ``wanted``)."""

    def __init__(self, text: str, wanted: set[tuple[str, ...]] | None = None) -> None:
        self.text = text
        self.words, self.spans = words_with_offsets(text)
        self.stems = [porter_stem(w) for w in self.words]
        n = max(1, len(self.stems))
        counts = Counter(self.stems)
        self.rarity = {s: math.log((n + 1) / (c + 1)) / (math.log(n + 1) or 1.0) for s, c in counts.items()}
        often = max(40, int(0.004 * n))
        self.postings: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for size in (1, 2, 3):
            for k, gram in enumerate(zip(*(self.stems[i:] for i in range(size)), strict=False)):
                if (wanted is None or gram in wanted) and (size > 1 or (gram[0] not in STOPWORDS and counts[gram[0]] <= often)):
                    self.postings[gram].append(k)

    def lifted(self, stems: list[str]) -> list[int]:
        """Where all of these stems stand one after another, by the rarest of their n-grams; none for fewer than two stems."""
        size = min(3, len(stems))
        if size < 2:
            return []
        grams = (self.postings.get(tuple(stems[k : k + size]), ()) for k in range(len(stems) - size + 1))
        k, places = min(enumerate(grams), key=lambda x: len(x[1]))
        return [p - k for p in places if p >= k and self.stems[p - k : p - k + len(stems)] == stems]

    def weight(self, word: str, stem: str) -> float:
        """Rarity, halved for function words, between .1 and 1; words the source lacks are rarest."""
        return min(1.0, max(0.1, self.rarity.get(stem, 1.0) * (0.5 if word in STOPWORDS else 1.0)))

    def windows(self, stems: list[str]) -> list[tuple[int, int]]:
        """Token windows by votes of shared n-grams, longer ones weighing more; no two side by side."""
        stride = max(6, min(WIDEST, max(20, 2 * len(stems) + 12)) // 3)
        votes: dict[int, float] = defaultdict(float)
        for size in (1, 2, 3):
            for gram in dict.fromkeys(tuple(stems[k : k + size]) for k in range(len(stems) - size + 1)):
                places = self.postings.get(gram, ())
                if size > 1 and len(places) > COMMON:
                    continue
                weight = size * sum(self.rarity.get(s, 1.0) for s in gram)
                for p in places:
                    b = p // stride
                    votes[b] += weight
                    votes[b + 1] += weight / 2
                    if b:
                        votes[b - 1] += weight / 2
        chosen: list[int] = []
        for b in sorted(votes, key=lambda b: (-votes[b], b)):
            if len(chosen) == (WINDOWS if len(stems) <= LONG else WINDOWS_LONG):
                break
            if all(abs(b - c) > 1 for c in chosen):
                chosen.append(b)
        found = ((max(0, (b - 1) * stride), min(len(self.stems), (b + 2) * stride)) for b in chosen)
        return [(a, z) for a, z in found if a < z]


def one_edit(a: str, b: str) -> bool:
    """Longer words with the same first letter, one edit apart."""
    if a == b or min(len(a), len(b)) < 4 or a[0] != b[0] or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def pair_scores(stems: list[str], weights: np.ndarray, window: list[str]) -> np.ndarray:
    """(sentence, window) table of what matching each pair of words brings."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(s, len(number)) for s in window])
    heads: dict[str, list[str]] = defaultdict(list)
    for w in number:
        heads[w[:1]].append(w)
    out = np.repeat((MISMATCH * (MISMATCH_FLOOR + (1 - MISMATCH_FLOOR) * weights))[:, None], len(window), axis=1)
    for i, s in enumerate(stems):
        near = [number[w] for w in heads.get(s[:1], ()) if one_edit(s, w)]
        if near:
            out[i, np.isin(ids, near)] = NEAR * weights[i]
        if s in number:
            out[i, ids == number[s]] = MATCH * weights[i]
    return out


def local_alignment(pairs: np.ndarray) -> tuple[float, int, int] | None:
    """Value of the matched pairs on the best local alignment, and its first and last column."""
    rows, cols = pairs.shape
    best_at = np.zeros((rows + 1, cols + 1))
    skip_source = np.full((rows + 1, cols + 1), -np.inf)
    skip_summary = np.full((rows + 1, cols + 1), -np.inf)
    ramp = SOURCE_EXTEND * np.arange(cols + 1)
    for i in range(1, rows + 1):
        f = skip_summary[i] = np.maximum(best_at[i - 1] + OPEN, skip_summary[i - 1] + SUMMARY_EXTEND)
        h = np.zeros(cols + 1)
        h[1:] = np.maximum(np.maximum(best_at[i - 1, :-1] + pairs[i - 1], f[1:]), 0)
        # to open a gap from a gap is never better than to go on with it, so gaps start from h alone
        e = skip_source[i]
        e[1:] = (np.maximum.accumulate(h - ramp) + ramp)[:-1] + OPEN
        best_at[i] = np.maximum(h, e)
        best_at[i, 0] = 0
    i, j = np.unravel_index(int(np.argmax(best_at)), best_at.shape)
    if best_at[i, j] <= 0:
        return None
    value, first, last, state = 0.0, -1, -1, "pair"
    near = lambda a, b: abs(a - b) < 1e-9
    while i and j:
        if state == "pair":
            if best_at[i, j] <= 0:
                break
            if near(best_at[i, j], best_at[i - 1, j - 1] + pairs[i - 1, j - 1]):
                i, j = i - 1, j - 1
                if pairs[i, j] > 0:
                    value += pairs[i, j]
                    first, last = j, j if last < 0 else last
            else:
                state = "source" if near(best_at[i, j], skip_source[i, j]) else "summary"
        elif state == "source":
            state = "pair" if near(skip_source[i, j], best_at[i, j - 1] + OPEN) else state
            j -= 1
        else:
            state = "pair" if near(skip_summary[i, j], best_at[i - 1, j] + OPEN) else state
            i -= 1
    return (value, int(first), int(last)) if first >= 0 else None


def overlap(stems: list[str], weights: np.ndarray, window: list[str]) -> float:
    """Weighted share of the sentence's words that the window has, each as often as the window has it."""
    left = Counter(window)
    found = 0.0
    for s, w in zip(stems, weights, strict=True):
        if left[s] > 0:
            left[s] -= 1
            found += w
    return min(1.0, found / weights.sum())


def align(sentence: str, index: int, source: Source, min_score: float = PARTIAL) -> dict:
    """A sentence of function words alone, whose words meet anywhere, is only held to be lifted from where it stands letter by letter."""
    out = {"sentence": sentence, "sentence_index": index, "start": -1, "end": -1, "score": 0.0, "matched_text": "", "support": "none"}
    words, _ = words_with_offsets(sentence)
    if not source.stems or not words:
        return out
    if not any(w not in STOPWORDS and len(w) > 1 for w in words):
        at = source.text.find(sentence)
        return out if at < 0 else out | {"start": at, "end": at + len(sentence), "score": 1.0, "matched_text": sentence, "support": "strong"}
    stems = [porter_stem(w) for w in words]
    weights = np.array([source.weight(w, s) for w, s in zip(words, stems, strict=True)])
    around = max(3, int(CONTEXT * len(stems)))
    best: tuple[float, int, int] | None = None
    windows = source.windows(stems)
    # a window with the whole sentence has the greatest value that there is, on the first such place: no other needs to be aligned
    places = source.lifted(stems)
    whole = next((p for a, z in windows if (k := bisect.bisect_left(places, a)) < len(places) and (p := places[k]) + len(stems) <= z), None)
    if whole is not None:
        value = sum((MATCH * w for w in weights[::-1]), 0.0)
        best = ALIGNED_SHARE * value / (MATCH * weights.sum()) + (1 - ALIGNED_SHARE) * overlap(stems, weights, stems), whole, whole + len(stems) - 1
        windows = []
    for a, z in windows:
        if found := local_alignment(pair_scores(stems, weights, source.stems[a:z])):
            value, first, last = found[0], a + found[1], a + found[2]
            near = source.stems[max(0, first - around) : last + 1 + around]
            score = ALIGNED_SHARE * value / (MATCH * weights.sum()) + (1 - ALIGNED_SHARE) * overlap(stems, weights, near)
            if best is None or score > best[0]:
                best = score, first, last
    if best is None or best[0] < min_score:
        return out
    score = min(1.0, best[0])
    start, end = source.spans[best[1]][0], source.spans[best[2]][1]
    end += source.text[end : end + 1] in (".", "!", "?")
    return out | {"start": start, "end": end, "score": round(score, 4), "matched_text": source.text[start:end], "support": "strong" if score >= STRONG else "partial"}


def align_summary(summary: str | None, source: str | None, min_score: float = PARTIAL) -> list[dict]:
    """One record per sentence of the summary."""
    sentences = split_sentences(summary)
    stems = [[porter_stem(w) for w in words_with_offsets(s)[0]] for s in sentences]
    wanted = {gram for x in stems for size in (1, 2, 3) for gram in zip(*(x[i:] for i in range(size)), strict=False)}
    indexed = Source(source or "", wanted) if sentences else None
    return [align(s, k, indexed, min_score) for k, s in enumerate(sentences)]


SCHEMA = "sentence string, sentence_index int, start int, end int, score double, matched_text string, support string"


def alignments(docs: DataFrame, id_col: str = "id", summary_col: str = "summary", source_col: str = "source_text", min_score: float = PARTIAL) -> DataFrame:
    """One row per summary sentence of each document. Documents stream through; nothing is shuffled."""
    src = docs.select(F.col(id_col).alias("id"), F.col(summary_col).alias("a"), F.col(source_col).alias("b"))
    kind = src.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *(r[k] for k in names)) for i, a, b in zip(f["id"], f["a"], f["b"], strict=True) for r in align_summary(a, b, min_score)]
            yield pd.DataFrame(rows, columns=["id", *names])

    return src.mapInPandas(run, f"id {kind}, {SCHEMA}")


def coverage(aligned: DataFrame) -> DataFrame:
    """Per document: sentences, strong, partial, unsupported, coverage (4 places), and the unsupported sentences in order."""
    none = F.array_sort(F.collect_list(F.when(F.col("support") == "none", F.struct("sentence_index", "sentence"))))
    g = aligned.groupBy("id").agg(F.count("*").alias("sentences"), F.count_if(F.col("support") == "strong").alias("strong"), F.count_if(F.col("support") == "partial").alias("partial"), none.alias("u"))
    return g.select("id", "sentences", "strong", "partial", F.size("u").alias("unsupported"), F.round((F.col("strong") + F.col("partial")) / F.col("sentences"), 4).alias("coverage"), F.transform("u", lambda s: s["sentence"]).alias("unsupported_sentences"))


def trace(entries: DataFrame, min_score: float = PARTIAL) -> DataFrame:
    """Coverage of each entry's summary in its source, with the reason where there is nothing to trace."""
    e = entries.select("id", F.trim("summary").alias("summary"), F.trim("source_text").alias("source_text"))
    reason = F.when(F.coalesce("summary", F.lit("")) == "", "no_summary").when(F.coalesce("source_text", F.lit("")) == "", "no_source_text")
    found = coverage(alignments(e.where(reason.isNull()), min_score=min_score))
    return e.select("id", reason.alias("reason")).join(found, "id", "left")
