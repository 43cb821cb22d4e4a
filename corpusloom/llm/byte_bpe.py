"""Byte-level BPE by merge replay over a vocabulary of distinct pieces.

A text is cut into pieces by the tokenizer's pattern; a piece's ids depend on nothing but the piece. Each task
therefore gathers the distinct pieces it has not seen, and replays the merges over all of them at once: an
inverted index leads from a pair of tokens to the (piece, position) places where it stands, merges are taken in
rank order, and a merge looks again only at the two neighbours it touched. Pieces merge independently of
each other, so replaying a corpus by blocks gives the same ids as one replay over the whole corpus. (One replay for
all would need every occurrence of a piece joined with its ids: a shuffle of all tokens of the corpus.) The store of known
pieces is bounded; when full, it lets go of those that have not come up for longest.

Null and empty texts have no ids. Repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

LONG = 4_000_000  # characters of a text from which on it is taken in blocks
BLOCK, MANY = 30_000, 100  # pieces of one replay; places of a merge from which on it takes many pieces at once
STORE = 150_000  # distinct pieces, and pairs of tokens, that a task keeps in each of two generations


#: The public pattern for ASCII texts, which the standard library's engine cuts faster.
ASCII_PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^\\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


@lru_cache(2)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return ranks, tokens


class Merges:
    """A vocabulary's merges by the ids of the two tokens; an id is the token's rank."""

    def __init__(self, path: str) -> None:
        self.ranks, self.tokens = load_ranks(path)
        self.known: dict[int, int] = {}
        self.single = np.array([self.ranks[bytes((b,))] for b in range(256)], np.int64)
        self.pairs = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64)

    def look(self, key: int) -> int:
        """Id of the token that the pair (key >> 20, key's low 20 bits) merges to, or -1."""
        r = self.known[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        return r

    def rank_of(self, key: int) -> int:
        return self.known[key] if key in self.known else self.look(key)


def replay(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each piece, packed as little-endian unsigned 32-bit integers. Pieces are not empty."""
    # All pieces lie behind one another: the id of the token that starts at a byte (-1 if merged into an earlier
    # one), and the places of the tokens after and before it (-1 at a piece's ends).
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    starts = np.concatenate([[0], ends[:-1]])
    n = len(flat)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = before[starts] = -1
    part = merges.single[flat]
    rank, key = np.full(n, -1), np.zeros(n, np.int64)
    rank[:-1] = merges.pairs[flat[:-1] << 8 | flat[1:]]
    rank[ends - 1] = -1
    key[:-1] = part[:-1] << 20 | part[1:]
    # the index: pair of tokens -> places of the left one; and the pairs that wait under the rank of their merge
    index: dict[int, list] = {}
    waiting: dict[int, list[int]] = {}
    heap: list[int] = []

    def note(pair: int, m: int, places: list[int]) -> None:
        """A pair that merges to m stands at these places."""
        if pair in index:
            index[pair] += places
        else:
            index[pair] = places
            if m in waiting:
                waiting[m].append(pair)
            else:
                waiting[m] = [pair]
                heapq.heappush(heap, m)

    def note_all(keys: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order].tolist()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j and (m := merges.rank_of(int(keys[i]))) >= 0:
                note(int(keys[i]), m, places[i:j])

    found = np.flatnonzero(rank >= 0)
    note_all(key[found], found)
    owner = np.repeat(np.arange(len(pieces)), ends - starts)
    views = memoryview(part), memoryview(after), memoryview(before)  # for what goes place by place
    while heap:
        r = heapq.heappop(heap)
        pairs = waiting.pop(r)
        found = index.pop(pairs[0]) if len(pairs) == 1 else [p for pair in pairs for p in index.pop(pair)]
        if len(found) < MANY:
            found.sort()
            _one_by_one(found, r, *views, merges, note)
            continue
        # a common merge takes all pieces at once in which it applies at one place
        places = np.unique(np.array(found))
        places = places[(part[places] >= 0) & (after[places] >= 0)]
        key = part[places] << 20 | part[after[places]]
        places = places[key == pairs[0] if len(pairs) == 1 else np.isin(key, pairs)]
        whose = owner[places]
        lone = np.ones(len(places), bool)
        lone[1:] &= whose[1:] != whose[:-1]
        lone[:-1] &= whose[1:] != whose[:-1]
        p = places[lone]
        q = after[p]
        z, a = after[q], before[p]
        part[p], part[q], after[p] = r, -1, z
        before[z[z >= 0]] = p[z >= 0]
        left = a[a >= 0]
        note_all(np.concatenate([r << 20 | part[z[z >= 0]], part[left] << 20 | r]), np.concatenate([p[z >= 0], left]))
        if len(p) < len(places):
            _one_by_one(places[~lone].tolist(), r, *views, merges, note)
    alive = part >= 0
    upto = np.concatenate([[0], np.cumsum(alive)])
    packed = part[alive].astype("<u4").tobytes()
    return [packed[i:j] for i, j in zip((4 * upto[starts]).tolist(), (4 * upto[ends]).tolist(), strict=True)]


def _one_by_one(places: list[int], r: int, part: memoryview, after: memoryview, before: memoryview, merges: Merges, note: Callable) -> None:
    """The merge of rank r at its places, from left to right; pairs that make the same token count as one merge."""
    known, look = merges.known, merges.look
    held = -1  # end of a piece in which a merge of this rank or a lower one has come up: its later places wait their turn
    for p in places:
        left, q = part[p], after[p]
        if left < 0 or q < 0:
            continue
        pair = left << 20 | part[q]
        if (known[pair] if pair in known else look(pair)) != r:
            continue
        if p <= held:
            note(pair, r, [p])
            continue
        z, a = after[q], before[p]
        part[p], part[q], after[p] = r, -1, z
        soon = False
        if z >= 0:
            before[z] = p
            pair = r << 20 | part[z]
            m = known[pair] if pair in known else look(pair)
            if m >= 0:
                soon = m <= r
                note(pair, m, [p])
        if a >= 0:
            pair = part[a] << 20 | r
            m = known[pair] if pair in known else look(pair)
            if m >= 0:
                soon = soon or m <= r
                note(pair, m, [a])
        if soon:
            held = p
            while after[held] >= 0:
                held = after[held]


class Encoder:
    """Encodes texts; keeps up to twice ``store`` distinct pieces from one call to the next."""

    def __init__(self, path: str, pattern: str, store: int = STORE) -> None:
        self.merges = Merges(path)
        self.ranks, self.tokens = self.merges.ranks, self.merges.tokens
        self.pattern, self.store = regex.compile(pattern), store
        self.plain = re.compile(ASCII_PATTERN, re.A).findall if pattern == public_tokenizers.PATTERN else self.pattern.findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, fresh: set[str]) -> None:
        todo, known, old, ranks = [], self.known, self.old, self.ranks
        for w in fresh:
            if (ids := old.get(w)) is not None:
                known[w] = ids
                continue
            b = w.encode()
            if (r := ranks.get(b)) is not None:
                known[w] = r.to_bytes(4, "little")
            else:
                todo.append((w, b))
        for at in range(0, len(todo), BLOCK):
            block = todo[at : at + BLOCK]
            for (w, _), ids in zip(block, replay([b for _, b in block], self.merges), strict=True):
                known[w] = ids

    def bound(self) -> None:
        """Let go of the pieces that have not come up since the store was last full."""
        if len(self.known) > self.store:
            self.old, self.known = self.known, {}
        if len(self.merges.known) > STORE:
            self.merges.known.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; learns the pieces of the texts in groups of about a million characters."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t or "")
            size += len(t or "")
            if size > 1_000_000:
                out += self.encode_group(group)
                group, size = [], 0
        return out + self.encode_group(group)

    def encode_group(self, texts: list[str]) -> list[bytes]:
        self.bound()
        get = self.known.get
        held: list = []
        fresh: set[str] = set()
        for t in texts:
            if len(t) > LONG:  # the pieces of a very long text come in blocks
                held.append(t)
                continue
            pieces = self.plain(t) if t.isascii() else self.pattern.findall(t)
            ids = list(map(get, pieces))
            if None in ids:
                fresh.update(w for w, x in zip(pieces, ids, strict=True) if x is None)
                held.append(pieces)
            else:
                held.append(b"".join(ids))
        self.learn(fresh)
        known = self.known.__getitem__
        done = [b"".join(map(known, x)) if isinstance(x, list) else x for x in held]
        return [b"".join(self.blocks(x)) if isinstance(x, str) else x for x in done]

    def blocks(self, text: str, size: int = 200_000) -> Iterator[bytes]:
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, size)):
            self.bound()
            self.learn(set(block).difference(self.known))
            yield b"".join(map(self.known.__getitem__, block))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids: array<int>, the text's token ids without special tokens."""
    path, pat = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def make():
        enc = Encoder(path, pat)
        return lambda texts: [[np.frombuffer(b, "<u4").astype("i4") for b in enc.encode(texts)]]

    return map_rows(docs, [F.col(id_col), F.col(text_col)], make, "ids array<int>", 1)


def decode_documents(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id and bytes: the tokens' bytes, joined. Null ids give null; an id the vocabulary lacks is an error."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def make():
        _, tokens = load_ranks(path)
        return lambda lists: [[None if x is None else b"".join(tokens[i] for i in x) for x in lists]]

    return map_rows(encoded, [F.col(id_col), F.col(ids_col)], make, "bytes binary", 1)


def digests(docs: DataFrame) -> DataFrame:
    path, pat = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def make():
        enc = Encoder(path, pat)

        def fn(texts):
            packed = enc.encode(texts)
            return [[len(b) // 4 for b in packed], [hashlib.sha256(b).hexdigest() for b in packed], [hashlib.sha256(enc.decode(b)).hexdigest() for b in packed]]

        return fn

    return map_rows(docs, [F.col("doc_id"), F.col("text")], make, "n_tokens long, ids_sha256 string, decoded_sha256 string", 1)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(texts(spark, sf_dir))
