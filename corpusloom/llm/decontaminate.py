"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Each distinct benchmark word stands for one code point, so a text becomes one symbol a word (a fixed symbol for
words that no item has) and is scanned once. The patterns are the windows of 13 consecutive item words, or the
whole of an item with fewer words. Hits are word positions and so lead back to offsets of the original text.

The automaton is made from the benchmark, which is an evaluation set and small by nature; its size is checked first. Above
``max_benchmark_bytes`` of text the windows are taken in groups of that size: each group has its own automaton and its own
scan, whose hits are written down by document before the next group is read, so that driver and executors hold one group at
a time and nothing is dropped. The scans then count with the benchmark's size.

Null and empty texts and items have no words: no hits, no windows. Repeated rows give repeated results; equal
windows of several items count for each item; other columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import checkpointed

from .common import lower_ascii, map_rows, read, row_key, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13


class Matcher:
    """Automaton over word symbols. items: (item_id as text, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.symbols: dict[str, str] = {}
        patterns: dict[str, set[str]] = {}
        for item, text in items:
            words = WORDS.findall(lower_ascii(text or ""))
            coded = "".join(self.symbol(w) for w in words)
            for k in range(max(1, len(coded) - window + 1)) if coded else ():
                patterns.setdefault(coded[k : k + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for p, owners in patterns.items():
            self.automaton.add_word(p, (len(p), sorted(owners)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def symbol(self, word: str) -> str:
        if word not in self.symbols:
            k = len(self.symbols) + 1
            self.symbols[word] = chr(k if k < 0xD800 else k + 0x800)  # surrogates aside; 0 stands for all other words
        return self.symbols[word]

    def match(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, merged runs of hit words (first, end), and the items found."""
        words = WORDS.findall(lower_ascii(text or ""))
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        if words and not self.empty:
            get = self.symbols.get
            for last, (n, owners) in self.automaton.iter("".join([get(w, "\0") for w in words])):
                found.update(owners)
                start, end = last - n + 1, last + 1
                while runs and start <= runs[-1][1]:  # hits come by their ends
                    s, e = runs.pop()
                    start, end = min(s, start), max(e, end)
                runs.append((start, end))
        return len(words), runs, found


GROUP_WORDS = 500_000  # symbols are code points, of which there are about twice as many


def groups(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of at most ``max_bytes`` of text and ``GROUP_WORDS`` words, one at a time (one for an ordinary benchmark).
    A longer item comes in parts that share all but one word of a window, which have the windows of the whole."""
    group: list[tuple[str, str]] = []
    size = words_in = 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        words = WORDS.findall(lower_ascii(text or ""))
        at = 0
        while at < len(words):
            end, held = at, 0
            while end < len(words) and (held < max_bytes and end - at < GROUP_WORDS or end - at < window):
                held += len(words[end]) + 1
                end += 1
            if group and (size + held > max_bytes or words_in + end - at > GROUP_WORDS):
                yield group
                group, size, words_in = [], 0, 0
            group.append((item, " ".join(words[at:end])))
            size, words_in = size + held, words_in + end - at
            at = end if end == len(words) else end - window + 1
    yield group


def scan(items: list[tuple[str, str]], window: int, finish: Callable[[str | None, int, list[tuple[int, int]], set[str]], tuple], width: int):
    """``make`` of a map: each text against the items' automaton, then to ``finish``'s columns."""

    def make():
        m = Matcher(items, window)

        def fn(texts):
            cols: list[list] = [[] for _ in range(width)]
            for t in texts:
                for c, v in zip(cols, finish(t, *m.match(t)), strict=True):
                    c.append(v)
            return cols

        return fn

    return make


def character_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words (first, end) as places in the original text."""
    at = [w.span() for w in WORDS.finditer(lower_ascii(text))] if runs else []
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


def merged(runs: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(map(tuple, runs)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = 0.05, keep: tuple[str, ...] | None = None, cut: bool = False, max_benchmark_bytes: int = 4_000_000) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted), hits (character spans of the original text), contaminated.

    A document is contaminated if hit words are ``share`` of its words or more. ``keep`` names the columns to
    carry along (the id alone if none). With ``cut`` there is also clean_text: the text without its hits, null if contaminated.
    """
    keep = keep or (id_col,)
    columns = [F.col(c) for c in keep]
    if text_col not in keep:
        columns.append(F.col(text_col).alias("_text"))
    place = keep.index(text_col) if text_col in keep else len(keep)
    schema = "n_words long, n_hit long, items array<string>, hits array<struct<start:int,end:int>>, contaminated boolean" + ", clean_text string" * cut

    def verdict(text, n, runs, found):
        n_hit = sum(e - s for s, e in runs)
        spans = character_spans(text, runs)
        bad = n_hit > 0 and n_hit >= share * n
        out = [n, n_hit, sorted(found), [{"start": s, "end": e} for s, e in spans], bad]
        if cut:
            for s, e in [] if bad else reversed(spans):
                text = text[:s] + text[e:]
            out.append(None if bad else text)
        return out

    each = groups(benchmark, item_col, item_text_col, window, max_benchmark_bytes)
    first = next(each)
    more = next(each, None)
    if more is None:
        return map_rows(docs, columns, scan(first, window, verdict, 5 + cut), schema, len(keep), (place,))

    # several scans: the hits of each are written down by the rows' keys, then united and joined with the rows
    hits = None
    while first is not None:
        rows = docs.select(F.col(id_col), F.col(text_col), *row_key(id_col, text_col)).select("_id", "_digest", F.col(text_col).alias("_text"))
        one = map_rows(rows, [F.col("_id"), F.col("_digest"), F.col("_text")], scan(first, window, lambda t, n, runs, found: (runs, sorted(found)), 2), "runs array<array<int>>, found array<string>", 2)
        one = checkpointed(docs.sparkSession, one.where(F.size("runs") > 0).dropDuplicates(["_id", "_digest"]))
        hits = one if hits is None else hits.unionByName(one)
        first, more = more, next(each, None)
    told = hits.groupBy("_id", "_digest").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    row = F.struct(*(F.col(c) for c in keep)).alias("row")
    held = docs.select(row, F.col(text_col).alias("_text"), *row_key(id_col, text_col)).join(told, ["_id", "_digest"], "left")

    def unite():
        def fn(texts, runs, found):
            out = [verdict(t, len(WORDS.findall(lower_ascii(t or ""))), merged(r or []), f or []) for t, r, f in zip(texts, runs, found, strict=True)]
            return [list(c) for c in zip(*out, strict=True)]

        return fn

    out = map_rows(held, [F.col("row"), F.col("_text"), F.col("runs"), F.col("found")], unite, schema, 1)
    return out.select("row.*", *out.columns[1:])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(texts(spark, sf_dir), read(spark, sf_dir, "benchmark"), share=0.0)
    ids = F.array_join("items", ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.rid, dw.k, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
