"""PII: fixed patterns, and information-theoretic sanitisation of the terms that give a protected value away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. Each distinct value is a
protected entity e; a term t is a word outside the base spans. Over the whole corpus the entity occurs in df(e) documents,
the term in df(t), both in the same document in df(e, t) of n. The information e carries is IC(e) = -log(df(e) / n); t
discloses PMI(e; t) = log(P(t | e) / P(t)) of it, with P(t) = df(t) / n and P(t | e) = (df(e, t) + prior P(t)) / (df(e) +
prior), so that values seen once or twice count, with less certainty. Where that share reaches ``remove`` the term is
removed, where it reaches ``generalise`` it is generalised to its shape, in every document that has both.

Entities that occur in the same documents have the same shares and count as one class, named by two xors of row hashes;
a class of one document needs no count of pairs. Terms are 64-bit hashes. df(t) is counted over all documents, for the
terms of documents with entities: a bitmap of fixed size (``BITS``) over their hashes tells the scan which words to count;
others whose bits collide are counted too and fall out of the exact join.

Null and empty texts have no spans. Repeated rows count as documents and get equal results; ties between spans are
broken by the order of kinds; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import checkpointed

from .common import WORD, fold_rows, map_rows, row_key, spans_text, texts

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("._%+-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = re.compile(r"[0-9]")
BITS = 1 << 22
EDGE = ".,;:!?()[]{}\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, kind) of the base patterns, leftmost and without overlap within a kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):  # from the sign outwards, so that long runs without one cost nothing
            at = m.start()
            if at < done:
                continue
            start = at
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, 0, m.end(), "email"))
                done = m.end()
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end(), "phone"))
    return out


def entity(kind: str, value: str) -> str:
    """The protected value in one spelling."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


def term_hash(word: str) -> int | None:
    """Signed 64-bit hash of a word's term (without edges, in lower case); None without a letter."""
    term = word.strip(EDGE).lower()
    if not any(c.isalpha() for c in term):
        return None
    h = xxhash.xxh64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


def document_terms(text: str, spans: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int], list[int]]:
    """(hashes, starts, ends) of the terms of a whole text, in order; words that overlap a span are none."""
    hashes, starts, ends = [], [], []
    covered = sorted((s, e) for s, _, e, _ in spans)
    k, reach = 0, 0
    for m in WORD.finditer(text):
        w = m.group()
        a = m.start() + len(w) - len(w.lstrip(EDGE))
        b = a + len(w.strip(EDGE))
        while k < len(covered) and covered[k][0] < b:
            reach = max(reach, covered[k][1])
            k += 1
        if a < reach or (h := term_hash(w)) is None:
            continue
        hashes.append(h), starts.append(a), ends.append(b)
    return hashes, starts, ends


def document_counts(docs: DataFrame, text_col: str, slots: np.ndarray) -> DataFrame:
    """term, df_term over all documents, for the terms whose hash has a slot in ``slots`` at least."""
    held = np.zeros(BITS, bool)
    held[slots] = True
    bitmap = np.packbits(held, bitorder="little").tobytes()

    def make():
        total: Counter = Counter()
        known: dict[str, int | None] = {}

        def candidate(w: str) -> int | None:
            if len(known) > 150_000:
                known.clear()
            h = term_hash(w)
            known[w] = h = h if h is not None and bitmap[(h % BITS) >> 3] >> (h & 7) & 1 else None
            return h

        def take(texts):
            for t in texts:
                here = {h for w in set(WORD.findall(t)) if (h := known[w] if w in known else candidate(w)) is not None} if t else ()
                total.update(here)
                if len(total) > 100_000:
                    yield from total.items()
                    total.clear()

        def finish():
            yield from total.items()

        return take, finish

    return fold_rows(docs, [F.col(text_col)], make, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))


def assess(docs: DataFrame, id_col: str, text_col: str, prior: float, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """(base, told). base, one row per input row: row (a number), _id and _digest (its key), doc_id, base spans, and the terms of texts
    with entities, with their places. told, for rows with disclosing terms: row, told (terms), actions."""
    spark = docs.sparkSession

    def make():
        def fn(texts):
            cols: list[list] = [[] for _ in range(6)]
            for t in texts:
                found = base_spans(t)
                cols[0].append(b"" if t is None else hashlib.sha256(t.encode()).digest())
                cols[1].append([{"start": s, "end": e, "kind": k} for s, _, e, k in found])
                cols[2].append(sorted({entity(k, t[s:e]) for s, _, e, k in found}))
                for c, x in zip(cols[3:], document_terms(t, found) if found else ([], [], []), strict=True):
                    c.append(x)
            return cols

        return fn

    schema = "_digest binary, base array<struct<start:int,end:int,kind:string>>, entities array<string>, terms array<long>, starts array<int>, ends array<int>"
    base = map_rows(docs, [F.col(id_col), F.col(text_col)], make, schema, 1)
    key = row_key(id_col, id_col, F.col("_digest"))[0]
    base = checkpointed(spark, base.select(F.monotonically_increasing_id().alias("row"), key, "_digest", F.col(id_col), "base", "entities", "terms", "starts", "ends"))
    n_docs = base.count()
    here = base.where(F.size("entities") > 0)
    slots = here.select(F.explode("terms").alias("term")).select(F.pmod("term", F.lit(BITS)).alias("slot")).distinct()
    df_term = checkpointed(spark, document_counts(docs, text_col, slots.toArrow().column(0).to_numpy()))  # BITS slots at most

    occurs = here.select("row", F.explode("entities").alias("entity"))
    signs = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"sign{k}") for k in (0, 1)]
    named = occurs.groupBy("entity").agg(F.count("*").alias("df"), *signs)
    of = ["df", "sign0", "sign1"]
    classes = occurs.join(named.where(F.col("df") < n_docs), "entity").select("row", *of).distinct()
    pairs = here.select("row", F.array_distinct("terms").alias("terms")).join(classes, "row").select("row", *of, F.explode("terms").alias("term"))
    n = F.lit(float(max(n_docs, 1)))
    p = F.col("df_term") / n
    share = F.log((F.col("both") + prior * p) / (F.col("df") + prior) / p) / F.log(n / F.col("df"))
    action = F.when(share >= remove, "remove").when(share >= generalise, "generalise")
    # a class of one document has each of its terms once
    once = pairs.where("df = 1").withColumn("both", F.lit(1)).join(df_term, "term").select("row", "term", action.alias("action")).where("action IS NOT NULL")
    often = pairs.where("df > 1")
    joint = often.groupBy(*of, "term").agg(F.count("*").alias("both")).join(df_term, "term").select(*of, "term", action.alias("action")).where("action IS NOT NULL")
    told = once.unionByName(often.join(checkpointed(spark, joint), [*of, "term"]).select("row", "term", "action"))
    return base, told.groupBy("row").agg(F.collect_list("term").alias("told"), F.collect_list("action").alias("actions"))


def place(base: list[dict], places: tuple[list[int], list[int], list[int]], told: list[int] | None, actions: list[str] | None) -> list[dict]:
    """A text's spans: its base spans, masked, and those of its terms that are told, by their strongest action."""
    do: dict[int, str] = {}
    for h, x in zip(told or (), actions or (), strict=True):
        do[h] = max(x, do.get(h, x))
    spans = [s | {"action": "mask"} for s in base]
    return spans + [{"start": s, "end": e, "kind": "term", "action": do[h]} for h, s, e in zip(*places, strict=True) if h in do] if do else spans


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5, generalise: float = 0.75, remove: float = 0.95, make=None, schema: str = "") -> DataFrame:
    """doc_id and spans: array of (start, end, kind, action), one row per input row.

    ``make`` and ``schema``, if given, turn the lists of spans to other columns, in the same map.
    """
    base, told = assess(docs, id_col, text_col, prior, generalise, remove)

    def spans_of():
        then = make() if make else lambda lists: [lists]
        return lambda bases, terms, starts, ends, tolds, actions: then([place(b, p, t, a) for b, *p, t, a in zip(bases, terms, starts, ends, tolds, actions, strict=True)])

    columns = [F.col(c) for c in (id_col, "base", "terms", "starts", "ends", "told", "actions")]
    return map_rows(base.join(told, "row", "left"), columns, spans_of, schema or "spans array<struct<start:int,end:int,kind:string,action:string>>", 1)


def redact(text: str, spans: list) -> str:
    """Base values become [KIND]; generalised terms their shape (letters x, digits 0); removed terms go."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        start, end = max(s["start"], at), s["end"]
        if end <= at:
            continue
        out.append(text[at:start])
        if s["action"] == "mask":
            out.append("" if start > s["start"] else f"[{s['kind'].upper()}]")
        elif s["action"] == "generalise":
            out.append("".join("0" if c.isdigit() else "x" if c.isalpha() else c for c in text[start:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


#: Every text with a base span matches one of these (regular expressions of the JVM).
MAY_HOLD = (r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9]([ -]?[0-9]){11}", r"\+[0-9][ ().0-9-]{7}")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """docs with its texts redacted; all other columns stay. Null and empty texts stay as they are.

    Texts that no pattern can match stay where they are; the others are joined with their told terms by id and text digest.
    """
    base, told = assess(docs, id_col, text_col, prior, generalise, remove)
    told = base.select("row", "_id", "_digest").join(told, "row").groupBy("_id", "_digest").agg(F.first(F.struct("told", "actions")).alias("told"))
    may = F.lit(False)
    for rx in MAY_HOLD:
        may = may | F.col(text_col).rlike(rx)
    may = F.coalesce(may, F.lit(False))
    names = [c for c in docs.columns if c != text_col]

    def make():
        def clean(t, said):
            found = base_spans(t)
            spans = [{"start": s, "end": e, "kind": k} for s, _, e, k in found]
            return redact(t, place(spans, document_terms(t, found) if said else ((), (), ()), *(said or {"told": None, "actions": None}).values())) if found else t

        return lambda texts, tolds: [[clean(t, x) for t, x in zip(texts, tolds, strict=True)]]

    row = F.struct(*map(F.col, names)) if names else F.lit(0)
    held = docs.where(may).select(row.alias("rest"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    held = held.join(told, ["_id", "_digest"], "left")
    out = map_rows(held, [F.col("rest"), F.col("text"), F.col("told")], make, "text string", 1)
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return docs.where(~may).unionByName(out.select(*columns))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    order = {k: i for i, k in enumerate(KINDS)}

    def make():
        def fn(lists):
            cols: list[list] = [[] for _ in range(7)]
            for spans in lists:
                all_ = [(s["start"], order[s["kind"]], s["end"], s["kind"]) for s in spans]
                base = [s for s in all_ if s[1] < 4]
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                cols[5].append(spans_text(all_))
                cols[6].append(len(all_) - len(base))
            return cols

        return fn

    return find_pii(texts(spark, sf_dir), make=make, schema="n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")
