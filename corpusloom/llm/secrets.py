"""Secret scan: fixed patterns, and a password guess-cost programme over credential-context values.

Every match of the base patterns is a span. Values that stand in a credential context (``pwd=``,
``Bearer``, ``user:value@host``) get a guess cost: the minimum over all segmentations into dictionary words,
dates, repeats, keyboard walks or alphabet runs, and brute-force characters, as log10 of the guesses an
attacker needs. Costly ones are secrets of kind ``guess``.

Null and empty texts have no spans. Repeated rows give repeated results; ties between spans are broken by
the order of the kinds; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spans_text, texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX16 = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Contexts in which a value is a credential: a name and a sign, an authorisation scheme, or a URL's user part.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\x20*(?:=>|:=|[:=])\x20*["']?|\b(?:bearer|basic)\x20+|://[^\s:/@]+:)([^\s"'`<>,;]+)""",
    re.I | re.A,
)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATES = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d)|(?:19|20)\d\d")
LEET = str.maketrans("0134578@$!", "oieastbasi")
SHORTEST = 3  # of words, walks and runs, in characters, and of repeats, in copies
WALK_STEP = 0.4
UNITS = (1, 2, 3, 4)  # lengths of what is repeated


@lru_cache(4)
def word_ranks(path: str) -> tuple[dict[str, float], int]:
    """log10 rank of each word of a public vocabulary (its whole lower-case words of three letters or more, in file order), and the length of
    the longest."""
    import base64

    ranks: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            if token.startswith(b" ") and token[1:].isalpha() and token.isascii() and len(token) > SHORTEST:
                word = token[1:].decode().lower()
                if word not in ranks:
                    ranks[word] = math.log10(len(ranks) + 2)
    for i, word in enumerate(("password", "passwd", "admin", "letmein", "welcome", "secret", "changeme", "root", "login", "token", "test", "example")):
        ranks[word] = math.log10(i + 2)
    return ranks, max(map(len, ranks))


@lru_cache(1)
def neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near[key] = {ROWS[y][x] for y, x in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)) if 0 <= y < len(ROWS) and 0 <= x < len(ROWS[y])}
    return near


def char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def walk_cost(size: int) -> float:
    return math.log10(47 * size) + WALK_STEP * (size - 2)


def run_cost(size: int) -> float:
    return math.log10(36 * size)


def repeat_cost(copies: int) -> float:
    """What copies add to the cost of the unit."""
    return math.log10(copies) + 0.3


class Starts:
    """Places from which a span of a kind may reach the present place, with the cheapest costs up to them.

    The cost of a span is the logarithm of its length and ``slope`` a character, so that what an earlier start is dearer than a
    later one shrinks as the span grows, down to the difference of their costs at equal slope. A start goes once an earlier
    one undercuts it, for that stays so, and once a later one is no dearer at equal slope, for then it never will undercut it.
    """

    def __init__(self, slope: float = 0.0) -> None:
        self.slope = slope
        self.held: list[tuple[int, float]] = []

    def add(self, i: int, before: float) -> None:
        key = before - self.slope * i
        while self.held and self.held[-1][1] - self.slope * self.held[-1][0] >= key:
            self.held.pop()
        self.held.append((i, before))

    def cheapest(self, j: int, cost) -> float:
        """The least of the cost up to a start and ``cost`` (of the length from there to j)."""
        best, kept = math.inf, []
        for i, before in self.held:
            if (x := before + cost(j - i)) < best:
                best = x
                kept.append((i, before))
        self.held = kept
        return best


def guess_cost(value: str, words: tuple[dict[str, float], int]) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    ranks, longest = words
    low, n, near = value.lower(), len(value), neighbours()
    if len(low) != n:  # a few letters have a longer lower case
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    walk = run = 1  # lengths of the walk and of the alphabet run that end here
    step, same = 0, [0] * (UNITS[-1] + 1)
    walks, runs = Starts(WALK_STEP), Starts()
    repeats = {(unit, r): Starts() for unit in UNITS for r in range(unit)}
    for j in range(1, n + 1):
        c = low[j - 1]
        # brute force: a span costs a start and each of its characters
        brute[j] = min(brute[j - 1], best[j - 1] + 0.5) + char_cost(value[j - 1])
        cost = brute[j]
        for size in range(SHORTEST, min(longest, j) + 1):
            i = j - size
            if (rank := ranks.get(low[i:j])) is not None:
                cost = min(cost, best[i] + rank + 0.3 * (value[i:j] != low[i:j]) + 0.3)
            elif (rank := ranks.get(plain[i:j])) is not None:
                cost = min(cost, best[i] + rank + 1.0)
        if j > 1:
            walk = walk + 1 if c in near.get(low[j - 2], ()) else 1
            d = ord(c) - ord(low[j - 2])
            run = run + 1 if d == step and d in (-1, 1) else 2 if d in (-1, 1) else 1
            step = d
            for starts, size, price in ((walks, walk, walk_cost), (runs, run, run_cost)):
                if size < SHORTEST:
                    starts.held.clear()
                    continue
                starts.add(j - SHORTEST, best[j - SHORTEST])
                cost = min(cost, starts.cheapest(j, price))
        for unit in UNITS:
            same[unit] = same[unit] + 1 if j > unit and c == low[j - 1 - unit] else 0
            if not same[unit]:
                for r in range(unit):
                    repeats[unit, r].held.clear()
            if same[unit] >= (SHORTEST - 1) * unit:
                starts, i = repeats[unit, j % unit], j - SHORTEST * unit
                starts.add(i, best[i])
                cost = min(cost, sum(map(char_cost, low[j - unit : j])) + starts.cheapest(j, lambda size, unit=unit: repeat_cost(size // unit)))
        if c.isdigit():
            for size in (4, 6, 7, 8, 9, 10):
                if j >= size and value[j - size].isdigit() and DATES.fullmatch(value, j - size, j):
                    cost = min(cost, best[j - size] + (2.1 if size == 4 else 4.6) + 0.3)
        best[j] = cost
    return best[n]


def scan(text: str | None, ranks: tuple[dict[str, float], int], min_length: int = 8, threshold: float = 10.0) -> tuple[list, list]:
    """(base spans, added spans), each (start, kind's place, end, kind)."""
    if not text:
        return [], []
    base = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            base.append((m.start(), 0, m.end(), "assign"))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            base.append((m.start(), 1, m.end(), "access"))
    for m in HEX16.finditer(text):  # a run of 16+ characters with no such character before it is a whole leftmost match
        base.append((m.start(), 2, m.end(), "hex"))
    more = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m.group(1)
        if m.group().startswith("://"):
            value = value.partition("@")[0] if "@" in value else ""
        value = value.rstrip(".)]}:!?")
        end = start + len(value)
        if len(value) >= min_length and not any(s < end and start < e for s, _, e, _ in base) and guess_cost(value, ranks) >= threshold:
            more.append((start, 3, end, "guess"))
    return base, more


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, min_length: int = 8, threshold: float = 10.0, finish=None, schema: str = "") -> DataFrame:
    """One row per document with its spans as an array of (kind, start, end, base); offsets are code points, end exclusive.

    ``vocabulary`` is a file of ranked tokens whose words form the dictionary; a value of ``min_length``
    characters or more whose guess cost reaches ``threshold`` (log10) is a secret. ``finish`` and ``schema``, if given, turn the
    base and the added spans of a text to other columns, in the same map.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def spans(base, more):
        return ([{"kind": k, "start": s, "end": e, "base": o < 3} for s, o, e, k in sorted(base + more)],)

    def make():
        ranks, then = word_ranks(path), finish or spans
        return lambda texts: [list(c) for c in zip(*(then(*scan(t, ranks, min_length, threshold)) for t in texts), strict=True)]

    return map_rows(docs, [F.col(id_col), F.col(text_col)], make, schema or "spans array<struct<kind:string,start:int,end:int,base:boolean>>", 1)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    def digests(base, more):
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        return *counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + more), len(more)

    return find_secrets(texts(spark, sf_dir), finish=digests, schema="n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
