"""Quality rules: fixed counts, and divergence from language references.

A language's reference is learned from all documents of that ``lang``, in one scan: the shares of character classes, and the
shares of its common words (hashed to ``BINS`` bins; those with ``common`` of its words or more, and all other words as one
further share). A document is compared with each reference by Jensen-Shannon distance, and the nearest counts. Histograms of
few draws lie far from any reference by chance, so word shares are compared from ``min_words`` words on and characters from
``min_chars`` on; below that a document is not judged by that histogram.

Null and empty texts have no words and fail the base rules. If no row has a language there is no reference, and the
base rules alone decide. Ties between references do not matter (only the distance is used). Repeated rows count as often
as they occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import N_CLASSES, WORD, char_classes, code_points, fold_rows, map_rows, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
EDGE = ".,;:!?\"'()"
#: Bins of hashed words: far more than a language has common words, and a fixed size whatever the vocabulary is.
BINS = 1 << 16


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = np.zeros(n, bool)
    at[order[1:][same]] = at[order[:-1][same]] = True
    # windows that agree by hash are compared in full
    rows = np.flatnonzero(at)
    grams = np.stack([ids[rows + k] for k in range(window)], axis=1)
    _, inverse, count = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
    rows = rows[count[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, rows, 1)
    np.add.at(edge, rows + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str | None, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, 0, 0
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else []
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def class_counts(text: str) -> np.ndarray:
    return np.bincount(char_classes()[code_points(text)], minlength=N_CLASSES)


class WordBins:
    """Bin of each word, its case and the punctuation about it aside; remembers words up to a bound."""

    def __init__(self, bound: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def add(self, w: str) -> int:
        b = self.known[w] = zlib.crc32(w.strip(EDGE).lower().encode()) % BINS
        return b

    def __call__(self, words: list[str]) -> list[int]:
        if len(self.known) > self.bound:
            self.known.clear()
        get = self.known.get
        return [b if (b := get(w)) is not None else self.add(w) for w in words]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of p from each row of q."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(-1)

    return np.sqrt(np.clip((kl(np.broadcast_to(p, q.shape)) + kl(q)) / 2, 0, 1))


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", common: float = 0.004) -> list[dict]:
    """One per language: its class shares, its common bins and their shares. At most 1 / common bins a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count():
        bins = WordBins()
        words_of: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}

        def take(texts, langs):
            for t, lang in zip(texts, langs, strict=True):
                if lang not in words_of and len(words_of) == 50:  # few languages at a time, however many there are
                    yield from finish()
                words_of.setdefault(lang, Counter()).update(bins(WORD.findall(t)))
                chars[lang] = chars.get(lang, 0) + class_counts(t)

        def finish():
            for lang, c in words_of.items():
                yield from ((lang, "w", b, n) for b, n in c.items())
                yield from ((lang, "c", k, int(n)) for k, n in enumerate(chars[lang]) if n)
            words_of.clear()
            chars.clear()

        return take, finish

    counted = fold_rows(rows, [F.col(text_col), F.col(lang_col)], count, "lang string, kind string, k int, n long").groupBy("lang", "kind", "k").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "kind"))  # at most BINS rows a language
    kept = counted.withColumn("total", total).where((F.col("kind") == "c") | (F.col("n") >= common * F.col("total")))
    by: dict[str, dict] = {}
    for lang, kind, k, n, whole in kept.toLocalIterator():
        by.setdefault(lang, {"c": {}, "w": {}})[kind][k] = n / whole
    refs = []
    for lang in sorted(by):
        classes = np.array([by[lang]["c"].get(k, 0.0) for k in range(N_CLASSES)])
        if by[lang]["w"] and classes.sum():
            refs.append({"lang": lang, "classes": classes, "words": dict(sorted(by[lang]["w"].items()))})
    return refs


def judge(docs: DataFrame, refs: list[dict], *, id_col: str = "doc_id", text_col: str = "text", max_class_distance: float = 0.33, max_word_distance: float = 0.22, slack: float = 1.0, min_words: int = 40, min_chars: int = 100) -> DataFrame:
    """Per document: the base counts, class_distance and word_distance (null if guarded), base_failed, kept.

    The word distance of n words may be ``max_word_distance + slack / sqrt(n)``: chance alone moves a histogram by about
    the root of its draws.
    """

    def make():
        classes = np.stack([r["classes"] for r in refs]) if refs else None
        shares = [np.array([max(0.0, 1 - sum(r["words"].values())), *r["words"].values()]) for r in refs]
        places = np.zeros((len(refs), BINS), np.int32)  # of each bin in a reference's shares; 0 for words that are not common
        for place, r in zip(places, refs, strict=True):
            place[list(r["words"])] = np.arange(1, len(r["words"]) + 1)
        bins = WordBins()

        def fn(texts):
            cols: list[list] = [[] for _ in range(9)]
            for t in texts:
                words = WORD.findall(t) if t else []
                n = len(words)
                base = base_counts(t, words)
                failed = n < 20 or 100 * base[3] > 30 * n
                c_dist = w_dist = None
                if refs and t and len(t) >= min_chars:
                    h = class_counts(t)
                    c_dist = float(distance(h / h.sum(), classes).min())
                if refs and n >= min_words:
                    own = np.array(bins(words))
                    dists = [float(distance(np.bincount(place[own], minlength=len(share)) / n, share[None, :])[0]) for place, share in zip(places, shares, strict=True)]
                    w_dist = min(dists)
                kept = not failed and (c_dist is None or c_dist <= max_class_distance) and (w_dist is None or w_dist <= max_word_distance + slack / n**0.5)
                for c, v in zip(cols, (n, *base, failed, kept, c_dist, w_dist), strict=True):
                    c.append(v)
            return cols

        return fn

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return map_rows(docs, [F.col(id_col), F.col(text_col)], make, schema, 1)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return judge(docs, references(docs))
