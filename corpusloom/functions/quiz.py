"""Comprehension questions from a text: cloze, numbers, order of events, who said it. The same text and seed give the same quiz."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.batches import bounded, hand_back
from corpusloom.functions.lexicon import STOPWORDS
from corpusloom.functions.text import normalize, split_sentences

WORD = re.compile(r"[A-Za-z][A-Za-z'-]+")
NUMBER = re.compile(r"(?<![\w.,])\d+(?:,\d{3})*(?:\.\d+)?(?![\w,]|\.\d)")
SAID = re.compile(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (said|says|argued|noted|claimed|wrote|reported|warned|explained|added)\b(?: that)? ([^.!?]{20,})")
KINDS = ("cloze", "numeric", "ordering", "attribution")


def salience(sentences: list[str]) -> dict[str, float]:
    """Weight of each content word: often, in few sentences, long, or proper."""
    tf, sf, proper = Counter(), Counter(), set()
    for s in sentences:
        words = WORD.findall(s)
        tf.update(w.lower() for w in words)
        sf.update({w.lower() for w in words})
        proper |= {w.lower() for w in words[1:] if w[0].isupper()}
    n = len(sentences)
    return {w: (1 + math.log(c)) * math.log(1 + n / sf[w]) * (1 + 0.03 * min(len(w), 14)) * (1.35 if w in proper else 1) for w, c in tf.items() if w not in STOPWORDS and len(w) > 3}


def _options(answer: str, others: list[str], rng: random.Random) -> tuple[list[str], int] | None:
    wrong = list(dict.fromkeys(o for o in others if o.lower() != answer.lower()))[:3]
    if len(wrong) < 3:
        return None
    options = [answer, *wrong]
    rng.shuffle(options)
    return options, options.index(answer)


def _cloze(sentences, weights, rng):
    ranked = sorted(weights, key=lambda w: (-weights[w], w))
    for s in rng.sample(sentences, len(sentences)):
        words = [w for w in WORD.findall(s) if w.lower() in weights]
        if len(words) < 3:
            continue
        answer = max(words, key=lambda w: (weights[w.lower()], w))
        # wrong words are of like shape first, then any
        pool = sorted((w for w in ranked if w != answer.lower() and w not in s.lower()), key=lambda w: (abs(len(w) - len(answer)) > 2, w[-2:] != answer[-2:].lower(), ranked.index(w)))
        made = _options(answer, [w.capitalize() if answer[0].isupper() else w for w in pool], rng)
        if made:
            yield {"question": re.sub(rf"\b{re.escape(answer)}\b", "_____", s, count=1), "options": made[0], "answer_index": made[1], "kind": "cloze", "evidence": s}


def _numeric(sentences, weights, rng):
    for s in rng.sample(sentences, len(sentences)):
        m = NUMBER.search(s)
        if not m:
            continue
        raw = m.group()
        places = len(raw.partition(".")[2])
        value = float(raw.replace(",", ""))
        year = "," not in raw and not places and 1500 <= value <= 2100
        shifts = [value + d for d in (1, -1, 2, -3, 5, -10)] if year or value < 10 else [value * f for f in (1.1, 0.9, 1.5, 0.5, 2, 0.75)]
        shown = [f"{v:,.{places}f}" if "," in raw else f"{v:.{places}f}" for v in rng.sample(shifts, len(shifts)) if v >= 0]
        made = _options(raw, shown, rng)
        if made:
            yield {"question": s[: m.start()] + "_____" + s[m.end() :], "options": made[0], "answer_index": made[1], "kind": "numeric", "evidence": s}


def _ordering(sentences, weights, rng):
    if len(sentences) < 4:
        return
    for _ in range(3):
        chosen = sorted(rng.sample(range(len(sentences)), 4))
        heads = [" ".join(sentences[k].split()[:9]) for k in chosen]
        if len(set(heads)) == 4:
            made = _options(heads[0], heads[1:], rng)
            yield {"question": "Which of these comes first in the text?", "options": made[0], "answer_index": made[1], "kind": "ordering", "evidence": sentences[chosen[0]]}


def _attribution(sentences, weights, rng):
    found = [(m, s) for s in sentences if (m := SAID.search(s))]
    names = list(dict.fromkeys(m[1] for m, _ in found)) + sorted({n for s in sentences for n in re.findall(r"(?<=[a-z,] )[A-Z][a-z]+(?: [A-Z][a-z]+)*", s)})
    for m, s in found:
        made = _options(m[1], names, rng)
        if made:
            yield {"question": f"Who {m[2]} that {m[3].strip()}?", "options": made[0], "answer_index": made[1], "kind": "attribution", "evidence": s}


def comprehension_questions(text: str | None, count: int = 4, seed: int | None = None) -> list[dict]:
    """Up to ``count`` questions, the kinds taking turns; the seed comes from the text if none is given."""
    t = normalize(text)
    sentences = [s for s in split_sentences(t) if 5 <= len(s.split()) <= 60]
    if not sentences:
        return []
    rng = random.Random(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") if seed is None else seed)
    weights = salience(sentences)
    makers = [f(sentences, weights, rng) for f in (_cloze, _numeric, _ordering, _attribution)]
    out: list[dict] = []
    used: set[str] = set()
    while makers and len(out) < count:
        for m in list(makers):
            q = next((q for q in m if q["evidence"] not in used), None)
            if q is None:
                makers.remove(m)
            elif len(out) < count:
                used.add(q["evidence"])
                out.append(q)
    return out


SCHEMA = "question string, options array<string>, answer_index int, kind string, evidence string"


def questions(docs: DataFrame, count: int = 4, seed: int | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per question of each document. Nothing is shuffled."""
    src = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            rows = [(i, *(q[k] for k in names)) for i, t in zip(f["id"], f["text"], strict=True) for q in comprehension_questions(t, count, seed)]
            yield pd.DataFrame(rows, columns=["id", *names])
        hand_back()

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, {SCHEMA}")
