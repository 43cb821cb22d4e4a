"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Rows with the same votes are alike, so the
votes of the whole corpus are counted by pattern (at most 3 to the number of labellers), and expectation-maximisation over
the patterns estimates each labeller's accuracy on good and on bad documents and each pattern's posterior. The posteriors
label a bounded sample (``sample`` rows, those of the lowest hashed text, so that the choice does not depend on order or
partitions; half of them of each likelier class where there are as many) on which a linear scorer over hashed word shapes is
trained; it then scores every document.

Null and empty texts score 0 and are not kept. Repeated rows count as often as they occur and get equal results; a sample
holds texts of equal hash once; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import checkpointed

from .common import DIGIT, LOWER, N_CLASSES, OTHER_LETTER, PUNCT, SPACE, SYMBOL, UPPER, WORD, char_classes, code_points, map_rows, texts

DIM = 1 << 12
GOOD, NONE, BAD = 1, 0, -1
SHAPES = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿĀ-\U0010ffff]+"), re.compile(r"[0-9]+"))
ODD_END = re.compile(r"(?:[^\w.,;:?!'\")\]]|!!)\Z")


def vote(low: float, high: float, x: float) -> int:
    """Good below ``low``, bad from ``high`` on, nothing between."""
    return GOOD if x < low else BAD if x >= high else NONE


#: Each labeller: name and function from the measures of a text to a vote.
LABELLERS = (
    ("symbols", lambda m: vote(0.01, 0.05, m["symbol"])),
    ("capitals", lambda m: NONE if m["words"] < 8 else vote(0.15, 0.4, m["upper"])),
    ("digits", lambda m: NONE if m["words"] < 8 else vote(0.05, 0.3, m["digit"])),
    ("repetition", lambda m: NONE if m["words"] < 20 else vote(0.08, 0.2, m["top_pair"])),
    ("variety", lambda m: NONE if m["words"] < 20 else BAD if m["distinct"] < 0.2 else GOOD if m["distinct"] > 0.35 else NONE),
    ("short_words", lambda m: NONE if m["words"] < 40 else BAD if m["short"] < 0.1 else GOOD if m["short"] > 0.2 else NONE),
    ("lines", lambda m: NONE if m["lines"] < 4 else vote(0.2, 0.5, m["dup_lines"])),
    ("ends", lambda m: NONE if m["words"] < 8 else vote(0.05, 0.3, m["odd_ends"])),
    ("same_next", lambda m: NONE if m["words"] < 8 else vote(0.05, 0.3, m["same"])),
)


def shape(word: str) -> str:
    for rx, to in zip(SHAPES, ("A", "a", "0"), strict=True):
        word = rx.sub(to, word)
    return word


#: Shapes of plain words, in lower case or with a capital, and the sign that ends them.
PLAIN = {(k, end): (zlib.crc32((head + end).encode()) & 0xFFFFFF) << 2 for k, head in enumerate(("a", "Aa")) for end in ("", ",", ".", ";", ":", "?")}


class Reader:
    """Measures and hashed word shapes of a text; remembers words up to a bound."""

    def __init__(self, bound: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def code(self, w: str) -> int:
        """The word's hash, its shape's hash (24 bits), whether it is short and whether it ends oddly."""
        low, body = w.lower(), w[:-1] if w[-1] in ",.;:?" else w
        if body.isalpha() and (kind := 1 if body == low[: len(body)] else 2 if body[1:] == low[1 : len(body)] else 0):  # most words
            mark = PLAIN[kind - 1, w[len(body) :]]
        else:
            mark = (zlib.crc32(shape(w).encode()) & 0xFFFFFF) << 2 | bool(ODD_END.search(w))
        c = zlib.crc32(low.encode()) << 26 | mark | (len(w) <= 3) << 1
        self.known[w] = c
        return c

    def __call__(self, text: str | None) -> tuple[dict[str, float], np.ndarray]:
        words = WORD.findall(text or "")
        n = len(words)
        if not n:
            return {"words": 0}, np.zeros(0, np.int64)
        known = self.known
        if len(known) > self.bound:
            known.clear()
        get = known.get
        codes = np.array([c if (c := get(w)) is not None else self.code(w) for w in words], np.int64)
        c = np.bincount(char_classes()[code_points(text)], minlength=N_CLASSES)
        visible = max(1, len(text) - int(c[SPACE]))
        ids = codes >> 26
        pairs = np.unique(ids[:-1] * 0x10001 + ids[1:], return_counts=True)[1] if n > 1 else np.zeros(1)
        lines = [x for y in text.split("\n") if (x := y.strip())] if "\n" in text else [text]
        parts = [len(np.unique(ids[at : at + 400])) / len(ids[at : at + 400]) for at in range(0, n, 400)] if n > 400 else [len(np.unique(ids)) / n]
        measures = {
            "words": n,
            "symbol": int(c[SYMBOL]) / visible,
            "upper": int(c[UPPER]) / max(1, int(c[LOWER] + c[UPPER] + c[OTHER_LETTER])),
            "digit": int(c[DIGIT]) / visible,
            "punct": int(c[PUNCT]) / visible,
            "distinct": sum(parts) / len(parts),  # of blocks of 400 words, so that long texts compare with short ones
            "top_pair": int(pairs.max()) / n,
            "short": int((codes >> 1 & 1).sum()) / n,
            "lines": len(lines),
            "dup_lines": 1 - len(set(lines)) / len(lines),
            "odd_ends": int((codes & 1).sum()) / n,
            "same": int((ids[1:] == ids[:-1]).sum()) / n,
        }
        return measures, (codes >> 2) & 0xFFFFFF


def votes(m: dict[str, float]) -> str:
    """One letter a labeller: + good, - bad, 0 nothing; a text without words has no vote."""
    return "".join("0+-"[f(m)] for _, f in LABELLERS) if m["words"] else "0" * len(LABELLERS)


def em(patterns: dict[str, int], *, prior_good: float = 0.85, false_alarm: float = 0.03, alarm: float = 0.4, rounds: int = 300, smooth: float = 1.0) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good by pattern, each labeller's rate of bad votes (labeller, class: bad and good) where it votes, and the
    share of good. At first every labeller raises a ``false_alarm`` on good documents and an ``alarm`` on bad ones."""
    keys = sorted(patterns)
    v = np.array([["0+-".index(x) for x in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    k = v.shape[1]
    rate = np.tile([alarm, false_alarm], (k, 1))
    good, post = prior_good, np.full(len(keys), prior_good)
    for _ in range(rounds):
        odds = np.log(good) - np.log1p(-good) + ((v == 1) @ np.log((1 - rate[:, 1]) / (1 - rate[:, 0]))) + ((v == 2) @ np.log(rate[:, 1] / rate[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved = np.abs(new - post).max()
        post = new
        weight = np.stack([n * (1 - post), n * post])
        bad = weight @ (v == 2)
        rate = ((bad + smooth * np.array([[alarm], [false_alarm]])) / (weight @ (v > 0) + smooth)).T
        good = float(np.clip((weight[1].sum() + smooth * prior_good) / (n.sum() + smooth), 0.01, 0.99))
        if moved < 1e-6:
            break
    return dict(zip(keys, post.tolist(), strict=True)), rate, good


def features(m: dict[str, float], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: hashed shapes of words and of pairs, and its measures."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = (codes[:-1] * 31 + codes[1:] * 7 + 1) & 0xFFFFFF
    counts = np.bincount(np.concatenate([codes, pairs]) % (DIM - 32), minlength=DIM - 32)
    bins = np.flatnonzero(counts)
    dense = np.array([m["symbol"] * 5, m["upper"] * 2, m["digit"] * 5, m["punct"] * 5, m["distinct"], m["top_pair"] * 5, m["short"], m["dup_lines"], m["odd_ends"], m["same"], min(n, 100) / 100, 1.0])
    return np.concatenate([bins, DIM - 32 + np.arange(len(dense))]), np.concatenate([counts[bins] / n, dense])


def train(rows: list[tuple[tuple[np.ndarray, np.ndarray], float]], *, epochs: int = 25, rate: float = 0.5, decay: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Logistic weights from (features, posterior of good), by minibatch AdaGrad."""
    w, g = np.zeros(DIM), np.full(DIM, 1e-6)
    x = [f for f, _ in rows]
    y = np.array([p for _, p in rows])
    rng = np.random.default_rng(seed)
    size = 64
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            rowsum = np.zeros(DIM)
            for i in part:
                b, v = x[i]
                p = 1 / (1 + np.exp(-np.clip(w[b] @ v, -30, 30)))
                rowsum[b] += (p - y[i]) * v
            rowsum = rowsum / len(part) + decay * w
            g += rowsum**2
            w -= rate * rowsum / np.sqrt(g)
    return w


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """Per document: votes, weak_label (posterior of good), score (0 to 1), kept (score >= ``threshold``)."""
    spark = docs.sparkSession

    def make():
        reader = Reader()
        return lambda texts: [[votes(reader(t)[0]) for t in texts]]

    voted = checkpointed(spark, map_rows(docs, [F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col)], make, "votes string", 1))
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).toLocalIterator()}
    post, _, _ = em(patterns) if patterns else ({}, None, 0.0)
    label: dict[int, float] = {}
    for likely in (True, False):
        names = [k for k, p in post.items() if (p >= 0.5) == likely]
        side = voted.where(F.col("votes").isin(names)).groupBy("h").agg(F.min("votes").alias("votes"))
        label |= {r["h"]: post[r["votes"]] for r in side.orderBy("h").limit(sample // 2).collect()}
    rows = []
    if label:
        picked = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
        wanted = F.broadcast(spark.createDataFrame([(h,) for h in label], "h long"))  # at most ``sample`` numbers
        chosen = picked.join(wanted, "h", "left_semi").dropDuplicates(["h"])

        def describe():
            reader = Reader()

            def fn(texts):
                x = [features(*reader(t)) for t in texts]
                return [[b for b, _ in x], [v for _, v in x]]

            return fn

        # a row's features are at most DIM numbers, however long its text
        found = {r["h"]: (np.array(r["bins"], np.int64), np.array(r["values"])) for r in map_rows(chosen, [F.col("h"), F.col("t")], describe, "bins array<int>, values array<double>", 1).toLocalIterator()}
        rows = [(found[h], label[h]) for h in sorted(found)]
    weights = train(rows)

    def score():
        reader = Reader()

        def fn(texts):
            vs, out = [], []
            for t in texts:
                m, codes = reader(t)
                b, v = features(m, codes)
                vs.append(votes(m))
                out.append(float(1 / (1 + np.exp(-np.clip(weights[b] @ v, -30, 30)))) if len(b) else 0.0)
            return [vs, [float(post.get(v, 0.0)) for v in vs], out, [s >= threshold for s in out]]

        return fn

    return map_rows(docs, [F.col(id_col), F.col(text_col)], score, "votes string, weak_label double, score double, kept boolean", 1)


def op6_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    return classify(texts(spark, sf_dir))
