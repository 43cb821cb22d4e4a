"""Language identification by multilingual mixture inference.

Training counts hashed character trigrams by language over all training rows. A document is then a mixture of
languages: expectation-maximisation estimates the proportions from the trigrams' likelihoods, and the set of
languages is chosen by penalised likelihood, leaving out one language after the other while that does not cost more
than ``penalty`` times half the logarithm of the document's trigrams (a BIC term) a language.

Null and empty texts and texts without a letter are ``und`` with score 0; so is everything if no training row has a
language. Ties between languages go to the first by name. Repeated rows count as often as they occur, other
columns are ignored; an empty table gives an empty result. A null doc_id counts as the empty text for the fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, code_points, fold_rows, map_rows, texts

BINS = 1 << 16
SMOOTHING = 0.5
CHUNK = 1 << 20


def letters(text: str) -> np.ndarray:
    """Lower-case code points; everything but letters is a blank. What a character becomes depends on nothing but it."""
    cp = code_points(text.lower())
    known = _is_letter()
    keep = known[np.minimum(cp, len(known) - 1)]
    cp = np.where(keep, cp, 32).astype(np.uint64)
    cp[cp == 0x3C2] = 0x3C3  # lower case of a sigma depends on its neighbours
    return cp


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x33480)] + [False]))
    return _LETTER[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins and counts of the text's trigrams, with a blank before and after it and runs of blanks as one; None if it has no letter.

    Long texts come in chunks; each begins with the last two characters of what came before.
    """
    if not text:
        return None
    seen, whole = np.full(1, 32, np.uint64), len(text) <= CHUNK
    total = None if whole else np.zeros(BINS, np.int64)
    any_letter = False
    for at in range(0, len(text), CHUNK):
        cp = letters(text[at : at + CHUNK])
        any_letter = any_letter or bool((cp != 32).any())
        cp = np.concatenate([seen, cp, np.full(int(at + CHUNK >= len(text)), 32, np.uint64)])
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
        h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (cp[2:] * np.uint64(0x165667B19E3779F9))
        h = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
        if total is not None:
            total += np.bincount(h, minlength=BINS)
        seen = cp[-2:]
    if not any_letter:
        return None
    return np.unique(h, return_counts=True) if total is None else (np.flatnonzero(total), total[total > 0])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bin, n: trigram counts over all rows with a language."""

    def make():
        counts: dict[str, np.ndarray] = {}

        def take(texts, langs):
            for t, lang in zip(texts, langs, strict=True):
                if (g := trigrams(t)) is not None:
                    counts.setdefault(lang, np.zeros(BINS, np.int64))[g[0]] += g[1]
                    if len(counts) > 200:
                        yield from finish()
                        counts.clear()

        def finish():
            for lang, c in counts.items():
                for b in np.nonzero(c)[0].tolist():
                    yield lang, b, int(c[b])

        return take, finish

    rows = fold_rows(docs.where(F.col(lang_col).isNotNull()), [F.col(text_col), F.col(lang_col)], make, "lang string, bin int, n long")
    return rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-probability of each bin in each. Its size is languages x BINS."""
    by: dict[str, np.ndarray] = {}
    for lang, b, n in counts.toLocalIterator():
        by.setdefault(lang, np.zeros(BINS))[b] = n
    langs = sorted(by)
    if not langs:
        return [], np.zeros((BINS, 0), np.float32)
    table = np.stack([by[k] for k in langs], axis=1) + SMOOTHING
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def mixture(bins: np.ndarray, counts: np.ndarray, logp: np.ndarray, penalty: float = 2.0, rounds: int = 30, tol: float = 1e-4) -> np.ndarray:
    """Proportions of the languages (0 for those left out)."""
    lp = logp[bins].astype(np.float64)
    top = lp.max(1)
    p = np.exp(lp - top[:, None])
    c = counts.astype(np.float64)
    total = c.sum()
    chosen = np.arange(p.shape[1])

    def em(langs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        q = p[:, langs]
        for _ in range(rounds if len(langs) > 1 else 0):
            new = w * (q.T @ (c / np.maximum(q @ w, 1e-300))) / total
            moved = np.abs(new - w).max()
            w = new
            if moved < tol:
                break
        return w, float(c @ np.log(np.maximum(q @ w, 1e-300)))

    w, fit = em(chosen, np.full(len(chosen), 1 / len(chosen)))
    cost = penalty * 0.5 * np.log(total + 1)
    while len(chosen) > 1:
        k = int(np.argmin(w))
        rest = np.delete(w, k)
        langs = np.delete(chosen, k)
        w2, fit2 = em(langs, rest / max(rest.sum(), 1e-300))
        if fit2 < fit - cost:
            break
        chosen, w, fit = langs, w2, fit2
    out = np.zeros(p.shape[1])
    out[chosen] = w
    return out


def identify(docs: DataFrame, trained: tuple[list[str], np.ndarray], *, text_col: str = "text", keep: list[Column] | None = None, penalty: float = 2.0) -> DataFrame:
    """``keep`` columns (doc_id), lang_pred, score and mixture: map of language to proportion."""
    langs, logp = trained

    def make():
        def fn(texts):
            preds, scores, mixes = [], [], []
            for t in texts:
                g = trigrams(t) if langs else None
                if g is None:
                    preds.append("und"), scores.append(0.0), mixes.append([])
                    continue
                w = mixture(*g, logp, penalty)
                k = int(np.argmax(w))
                preds.append(langs[k]), scores.append(float(min(max(w[k], 0.0), 1.0)))
                mixes.append([(langs[i], float(x)) for i, x in enumerate(w) if x > 0])
            return [preds, scores, mixes]

        return fn

    keep = keep or [F.col("doc_id")]
    schema, names = "lang_pred string, score double, mixture map<string,double>", docs.select(*keep).columns
    if text_col in names:
        return map_rows(docs, keep, make, schema, len(keep), (names.index(text_col),))
    return map_rows(docs, [*keep, F.col(text_col).alias("_text")], make, schema, len(keep))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(bucket(F.col(id_col), 3) != 1)


def op4_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    trained = model(train(training_rows(docs)))
    held_out = bucket(F.col("doc_id"), 3) == 1
    return identify(docs, trained, keep=[F.col("doc_id"), held_out.alias("held_out")]).drop("mixture")
