"""Toxicity: maximal scoring passages over token log-odds, with extreme-value calibration.

Training counts the documents with each word, by label, over all training rows, and takes log-odds with an informative
Dirichlet prior (the whole corpus's counts). Counts are kept by hashed word (``BINS``), which bounds the model whatever the
vocabulary is. A word whose log-odds are sure scores them, any other word is a step down, so that scores fall on ordinary
text. One scan in linear time then finds every maximal scoring passage of a document.

A passage of score S in n words of ordinary text comes up by chance K n exp(-lambda S) times: lambda solves
sum p(w) exp(lambda s(w)) = 1 over the ordinary (label 0) words, and K is set so that ordinary training documents have
that expectation. A document's evidence is the sum, over its passages, of -ln of the passage's chance. Evidence is
turned into a score from 0 to 1 by the label shares of its levels in all training rows, made monotone.

Null and empty texts have no passages, and the score of evidence 0. Rows without a label, and documents without an id
match (null), are not learned from. If there is no label at all every score is 0. A document with several labels counts once for each.
Repeated rows get equal results; ties between passages keep page order; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import checkpointed

from .common import WORD, bounded, bucket, fold_rows, map_rows, read, texts

BINS = 1 << 18
EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_"
LEVELS = 64
LABEL_BITS, MOST_BITS = 1 << 23, 1 << 26


class Hasher:
    """Bin of each word, in one spelling; remembers words up to a bound."""

    def __init__(self, bound: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def bins(self, text: str | None) -> list[int]:
        out = []
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in WORD.findall(text or ""):
            if (b := known.get(w)) is None:
                b = known[w] = zlib.crc32(w.strip(EDGE).lower().encode()) % BINS
            out.append(b)
        return out


def pack(bins: list[int]) -> bytes:
    """A document's bins, compressed: byte planes of 32-bit integers, first all low bytes, then the next."""
    return zlib.compress(np.array(bins, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def with_bins(rows: DataFrame, *, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Packed bins and label of texts with a label."""

    def make():
        hasher = Hasher()
        return lambda texts: [[pack(hasher.bins(t)) for t in texts]]

    rows = rows.where(F.col(label_col).isNotNull())
    return map_rows(rows, [F.col(label_col).cast("int").alias("label"), F.col(text_col)], make, "bins binary", 1)


def count_words(rows: DataFrame) -> np.ndarray:
    """(2, BINS): documents with the word, by label, over all rows; the table's size is fixed."""

    def make():
        total = np.zeros((2, BINS), np.int64)

        def take(packed, labels):
            for x, y in zip(packed, labels, strict=True):
                total[1 if y else 0, np.unique(unpack(x))] += 1
            yield from ()

        def finish():
            for y in (0, 1):
                for b in np.nonzero(total[y])[0].tolist():
                    yield y, b, int(total[y, b])

        return take, finish

    counted = fold_rows(rows, [F.col("bins"), F.col("label")], make, "y int, bin int, n long").groupBy("y", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BINS), np.int64)
    for y, b, n in counted.toLocalIterator():
        out[y, b] = n
    return out


def word_scores(counts: np.ndarray, *, prior: float = 1000.0, flat: float = 0.5, sure: float = 3.0, least: float = 1.0, step: float = 0.05) -> np.ndarray:
    """Score of each bin: its log-odds of label 1 less one standard error, where they are above ``sure`` standard errors and
    above ``least``; -``step`` elsewhere. The Dirichlet prior is ``prior`` words (a tenth of the corpus at most) dealt as in the whole corpus, and ``flat`` each."""
    both = counts.sum(0).astype(float)
    if not both.any():
        return np.full(len(both), -step, np.float32)
    prior = min(prior, 0.1 * both.sum())
    alpha = prior * both / max(1.0, both.sum()) + flat
    n0, n1 = counts[0].astype(float), counts[1].astype(float)
    odds = lambda n: np.log((n + alpha) / (n.sum() + prior - n - alpha + flat))
    delta = odds(n1) - odds(n0)
    error = np.sqrt(1 / (n1 + alpha) + 1 / (n0 + alpha))
    good = (delta > sure * error) & (delta - error > least) & (n1 > 0)
    return np.where(good, delta - error, -step).astype(np.float32)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal scoring passage (start, end, score), by one scan in linear time.

    Candidates lie on a stack with the running sums before and after them; a new one swallows those that it
    extends to a higher sum from a lower start. Each candidate keeps a link to the next one below with a lower start, so that
    none is looked at twice.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for k, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        start = k
        low = before
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, low = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
        stack.append((start, k + 1, low, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum w exp(x s) = 1."""
    w = weights / weights.sum()
    f = lambda x: float((w * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if not (scores[w > 0] > 0).any() or float((w * scores).sum()) >= 0:
        return 1.0
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def evidence(bins: list[int] | np.ndarray, scores: np.ndarray, lam: float, log_k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -ln chance over the significant passages, and those passages (word positions)."""
    if not len(bins):
        return 0.0, []
    s = scores[bins]
    if not (s > 0).any():
        return 0.0, []
    found, total = [], 0.0
    for a, b, x in segments(s.astype(float).tolist()):
        e = math.exp(min(50.0, log_k + math.log(len(bins)) - lam * x))
        chance = -math.expm1(-e)
        if chance < 0.5:
            total -= math.log(max(chance, 1e-300))
            found.append((a, b, x))
    return total, found


def fit(rows: DataFrame, *, text_col: str = "text", label_col: str = "toxic", **options) -> dict:
    """The model: word scores, lambda, K and the calibrated levels. rows: all of the training rows, as text and label or as ``labelled``
    gives them."""
    if "bins" not in rows.columns:
        rows = with_bins(rows, text_col=text_col, label_col=label_col)
    counts = count_words(rows)
    scores = word_scores(counts, **options)
    lam = solve_lambda(scores, counts[0].astype(float) + 1e-12)

    def gather():
        tops: dict[int, int] = {}

        def take(packed, labels):
            for x, y in zip(packed, labels, strict=True):
                b = unpack(x)
                if len(b) and not y:
                    best = max((top for _, _, top in segments(scores[b].astype(float).tolist())), default=0.0)
                    tops[level(lam * best - math.log(len(b)))] = tops.get(level(lam * best - math.log(len(b))), 0) + 1
            yield from ()

        def finish():
            yield from tops.items()

        return take, finish

    # of a Gumbel variable exp(-x) is exponential, so the mean of exp(-(lambda S - ln n)) over ordinary documents gives 1 / K
    tops = fold_rows(rows, [F.col("bins"), F.col("label")], gather, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in tops)
    log_k = -math.log(sum(r["n"] * math.exp(-r["level"] / 4) for r in tops) / n) if n else 0.0
    model = {"scores": scores, "lam": lam, "log_k": log_k, "levels": np.zeros(LEVELS)}

    def levels():
        seen = np.zeros((2, LEVELS), np.int64)

        def take(packed, labels):
            for x, y in zip(packed, labels, strict=True):
                seen[1 if y else 0, place(evidence(unpack(x), scores, lam, log_k)[0])] += 1
            yield from ()

        def finish():
            yield from ((y, k, int(seen[y, k])) for y in (0, 1) for k in range(LEVELS) if seen[y, k])

        return take, finish

    table = np.zeros((2, LEVELS))
    for r in fold_rows(rows, [F.col("bins"), F.col("label")], levels, "y int, level int, n long").groupBy("y", "level").agg(F.sum("n").alias("n")).collect():
        table[r["y"], r["level"]] = r["n"]
    if table.sum():
        model["levels"] = monotone(table)
    return model


def level(x: float) -> int:
    return round(4 * max(-60.0, min(60.0, x)))


def place(e: float) -> int:
    """Level of an evidence: 0 for none, then finer at the low end."""
    return 0 if e <= 0 else min(LEVELS - 1, 1 + int(8 * math.log1p(e)))


def monotone(table: np.ndarray) -> np.ndarray:
    """Share of label 1 by level, made non-decreasing (pool adjacent violators). Levels of some evidence lend their counts to
    those beside them first, and every level has a tenth of an observation at the overall share."""
    overall = table[1].sum() / table.sum()
    reach = np.arange(-6, 7)
    table = np.concatenate([table[:, :1], np.stack([np.convolve(np.pad(t[1:], 6), 1.0 / (1 + reach**2) ** 2, "valid") for t in table])], axis=1)
    blocks: list[list[float]] = []
    for k in range(LEVELS):
        blocks.append([table[1, k] + 0.1 * overall, table[:, k].sum() + 0.1, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.repeat([a / b for a, b, _ in blocks], [int(c) for *_, c in blocks])


def score(docs: DataFrame, model: dict, *, text_col: str = "text", keep=None) -> DataFrame:
    """``keep`` columns (doc_id), score, predicted, and passages: character spans with their log-odds score."""
    scores, lam, log_k, by_level = model["scores"], model["lam"], model["log_k"], model["levels"]

    def make():
        hasher = Hasher()

        def fn(texts):
            out, preds, passages = [], [], []
            for t in texts:
                e, found = evidence(hasher.bins(t), scores, lam, log_k)
                k = place(e)
                p = float(by_level[k])
                out.append(p), preds.append(int(p >= 0.5))
                if found:
                    at = [m.span() for m in WORD.finditer(t)]
                    passages.append([{"start": at[a][0], "end": at[b - 1][1], "odds": x} for a, b, x in found])
                else:
                    passages.append([])
            return [out, preds, passages]

        return fn

    keep = keep or [F.col("doc_id")]
    return map_rows(docs, [*keep, F.col(text_col).alias("_text")], make, "score double, predicted int, passages array<struct<start:int,end:int,odds:double>>", len(keep))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Packed bins and label of the documents that have one, as a checkpoint that the training scans share.

    A bitmap over the labels' hashed ids (16 bits a label, up to ``MOST_BITS``) drops documents without label before the join, so that hardly
    anything else is shuffled, and no text at all; the join itself is exact.
    """
    labels = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label"))
    n = min(MOST_BITS, max(LABEL_BITS, 1 << (16 * labels.count()).bit_length()))
    slot = F.pmod(F.xxhash64(id_col), F.lit(n)).alias("slot")
    words = np.zeros(n // 64, np.uint64)
    found = labels.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()  # n / 64 rows at most
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    src = bounded(docs).select(id_col, slot, F.col(text_col).alias("text"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            at = b.column(1).to_numpy().astype(np.uint64)
            held = words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            may_be = b.filter(pa.array(held.astype(bool)))
            packed = pa.array([pack(hasher.bins(t)) for t in may_be.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([may_be.column(0), packed], names=[id_col, "bins"])

    rows = src.mapInArrow(run, f"{id_col} {kind}, bins binary").join(labels, id_col)
    return checkpointed(docs.sparkSession, rows.select("bins", "label"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text")
    held_out = bucket(F.col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(labelled(docs.where(~held_out), labels.where(~held_out)))
    return score(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")]).drop("passages")
