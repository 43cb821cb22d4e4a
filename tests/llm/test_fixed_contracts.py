"""Brute-force versions of the queries whose results are fixed."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from corpusloom.llm import byte_bpe, near_dups, pii, secrets
from corpusloom.llm.common import read
from corpusloom.llm.decontaminate import WINDOW, find_contamination
from corpusloom.llm.queries import QUERIES

BASE1 = (
    ("assign", re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0


BASE10 = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def brute(base, text):
    return [(m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(base) for m in rx.finditer(text or "") if ok(m)]


def noise(rng, n):
    parts = ["a@b.c", "@", ".", "x.y@z-1.q.r", "+1 (212) 555-0100", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "é", "\U0001f600", "token = \"", "Password:", "api_key=", "AKIA", "ABCDEF0123456789", "deadbeefdeadbeef", "0", "00001.2.3.4", "+", "%", "a", "\n", "ſecret=abcdefabcdefabc", "toKen='"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_equal_plain_regexes():
    rng = random.Random(5)
    ranks = secrets.word_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _ in range(4000):
        t = noise(rng, rng.randint(0, 25))
        assert sorted(secrets.scan(t, ranks)[0]) == sorted(brute(BASE1, t)), t
        assert sorted(pii.base_spans(t)) == sorted(brute(BASE10, t)), t


@pytest.mark.parametrize("op,base", [("op1_secret_scan", BASE1), ("op10_pii", BASE10)])
def test_base_columns_on_the_table(spark, sf, op, base):
    got = {r["doc_id"]: r for r in QUERIES[op](spark, sf).collect()}
    rows = read(spark, sf, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = sorted(brute(base, r["text"]))
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(g["spans"].split(","))
        for kind, *_ in base:
            assert g[f"n_{kind}"] == sum(s[3] == kind for s in spans)


def test_guess_costs():
    ranks = secrets.word_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    cost = lambda v: secrets.guess_cost(v, ranks)
    assert cost("") == 0
    for easy in ("password", "password1990", "qwertyuiop", "abcdefghij", "zzzzzzzzzzzz", "abcabcabcabc", "P@ssword", "2019-04-12", "welcomehome"):
        assert cost(easy) < 9, (easy, cost(easy))
    for hard in ("x9Kq!7vLp2#m", "hT6vbQ0zWm3R", "Zr8$kPq2Lx"):
        assert cost(hard) > 11, (hard, cost(hard))
    assert cost("a" * 5000) < cost("x9Kq!7vLp2#m" * 3)


def slow_cost(value, words):
    """The least cost over all segmentations, each span priced by its definition."""
    ranks, _ = words
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)

    def span(i, j):
        v, c, n = value[i:j], low[i:j], j - i
        out = [0.5 + sum(map(secrets.char_cost, v))]
        if n >= 3 and c in ranks:
            out.append(ranks[c] + 0.3 * (v != c) + 0.3)
        if n >= 3 and c not in ranks and (p := c.translate(secrets.LEET)) in ranks:
            out.append(ranks[p] + 1.0)
        steps = {ord(b) - ord(a) for a, b in zip(c, c[1:], strict=False)}
        if n >= 3 and steps in ({1}, {-1}):
            out.append(secrets.run_cost(n))
        if n >= 3 and all(b in secrets.neighbours().get(a, ()) for a, b in zip(c, c[1:], strict=False)):
            out.append(secrets.walk_cost(n))
        out += [sum(map(secrets.char_cost, c[:u])) + secrets.repeat_cost(n // u) for u in secrets.UNITS if n % u == 0 and n // u >= 3 and c == c[:u] * (n // u)]
        if v[0].isdigit() and v[-1].isdigit() and secrets.DATES.fullmatch(v):
            out.append((2.1 if n == 4 else 4.6) + 0.3)
        return min(out)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + span(i, j) for i in range(j)))
    return best[-1]


def test_guess_cost_is_the_minimum():
    ranks = secrets.word_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(11)
    parts = ["hello", "ab", "abab", "ghjk", "banana", "qwer", "a", "nan", "1987", "2019-04-12", "0", "abcde", "cba", "P@ss", "Z", "x9", "!", "İ", "aaaa", "qwqwqw"]
    values = ["helloababababghjk", "a" * 40, "qw" * 20, "İİİ"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(600)] + ["".join(rng.choice("abqwn12-") for _ in range(rng.randint(1, 25))) for _ in range(600)]
    for v in values:
        assert secrets.guess_cost(v, ranks) == pytest.approx(slow_cost(v, ranks)), v


def test_guess_cost_of_long_values_is_linear():
    import time

    ranks = secrets.word_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for unit in ("a", "qw", "abc", "banana", "x9Kq"):
        began = time.time()
        secrets.guess_cost((unit * 60_000)[:60_000], ranks)
        assert time.time() - began < 20, unit


def test_guessed_values_are_added_beside_the_base(spark, docs):
    texts = ["pwd: x9Kq!7vLp2#m and so on", "pwd: password1990", "https://joe:hT6vbQ0zWm3R@host/", "Authorization: Bearer hT6vbQ0zWm3R.zz", None, "", "secret=abcdefghijklmnop"]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(docs(*texts)).collect()}
    assert rows == {0: [("guess", 5, 17)], 1: [], 2: [("guess", 12, 24)], 3: [("guess", 22, 37)], 4: [], 5: [], 6: [("assign", 0, 23)]}


@pytest.fixture(scope="module")
def tik():
    ranks, _ = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("many", [1, 4, 100, 10**9])
def test_replay_equals_the_library(tik, many, monkeypatch):
    """Merges that take many pieces at once, and those that go place by place."""
    monkeypatch.setattr(byte_bpe, "MANY", many)
    rng = random.Random(1)
    enc = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, store=50)
    texts = [None, "", " ", "a" * 3000, "ab" * 500, "é" * 77, "日本語テキスト" * 9, "<|endoftext|>", "\u0000\n\n  x", "don't  DON'T 12345 !!!"]
    texts += ["".join(rng.choice(["a", "aa", "the", " ", "ß", "\U0001f600", "er", "ion", "0", ".", "\n", "х", "ing"]) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(t or ""), t
        assert enc.decode(ids) == (t or "").encode()


def test_ascii_pieces_are_those_of_the_pattern():
    rng = random.Random(4)
    enc = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(3000):
        t = "".join(rng.choice([chr(rng.randrange(128)), " ", "'", "s", "ll", "a", "1", "\n", "\x1c"]) for _ in range(rng.randint(0, 30)))
        assert enc.plain(t) == enc.pattern.findall(t), repr(t)


def test_long_texts_in_blocks(tik, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 500)
    enc = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, store=50)
    t = "It's a long text with  blanks, 123 numbers\n\n and ünïcode. " * 40
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(["x", t, None])] == [tik.encode_ordinary("x"), tik.encode_ordinary(t), []]
    assert np.frombuffer(b"".join(enc.blocks(t, 7)), "<u4").tolist() == tik.encode_ordinary(t)


def test_bpe_table_and_round_trip(spark, sf, tik, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_byte_bpe"](spark, sf).collect()}
    for r in read(spark, sf, "documents").collect():
        ids = np.array(tik.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[r["doc_id"]]["n_tokens"] == len(ids) // 4
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs("Grüße an alle", None, "")))
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == [(0, "Grüße an alle".encode()), (1, b""), (2, b"")]


def test_contamination_against_plain_windows(spark, docs):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(12)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 13, 14, 30]))) for _ in range(12)] + ["", None, "É é-B"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [a[: rng.randint(0, 90)] + ", " + (b or "").upper() + "!" for a, b in zip(texts, items * 4, strict=False)] + [None, "", "é b É É b"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in find_contamination(docs(*texts), bench).collect()}
    parted = find_contamination(docs(*texts), bench, max_benchmark_bytes=400, keep=("doc_id", "text"), cut=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["hits"], r["contaminated"]) for r in parted} == {d: (r["n_words"], r["n_hit"], r["items"], r["hits"], r["contaminated"]) for d, r in got.items()}
    for r in parted:
        rest = r["text"]
        for h in reversed(r["hits"]):
            rest = rest[: h["start"]] + rest[h["end"] :]
        assert r["clean_text"] == (None if r["contaminated"] else rest)
    wins = {}
    for k, t in enumerate(items):
        w = words(t)
        for i in range(max(1, len(w) - WINDOW + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + WINDOW]), set()).add(str(k))
    for d, t in enumerate(texts):
        w = words(t)
        hit, found = set(), set()
        for i in range(len(w)):
            for g, owners in wins.items():
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= owners
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == (len(w), len(hit), sorted(found))
        assert sum(len(words(t[h["start"] : h["end"]])) for h in got[d]["hits"]) == len(hit)
    none = find_contamination(docs("a b"), bench.limit(0)).collect()
    assert none[0]["n_hit"] == 0 and not none[0]["contaminated"]


def test_benchmark_groups_have_every_window(spark, monkeypatch):
    """Items longer than a group come in parts that lose no window."""
    from corpusloom.llm import decontaminate

    monkeypatch.setattr(decontaminate, "GROUP_WORDS", 50)
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(n)) for n in (1, 12, 13, 14, 51, 300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (1, 90, 4_000_000):
        wins = set()
        for group in decontaminate.groups(bench, "item_id", "text", WINDOW, size):
            assert sum(len(t.split()) for _, t in group) <= 50 or len(group) == 1
            wins |= {(k, tuple(w[i : i + WINDOW])) for k, t in group for w in [t.split()] for i in range(max(1, len(w) - WINDOW + 1))}
        assert wins == {(str(k), tuple(w[i : i + WINDOW])) for k, t in enumerate(items) for w in [t.split()] for i in range(max(1, len(w) - WINDOW + 1))}


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_table(spark, sf):
    rows = read(spark, sf, "documents").collect()
    prints = [slow_print(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], slow_components([r["doc_id"] for r in rows], prints), strict=True))
    got = QUERIES["op9_simhash"](spark, sf).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == {r["doc_id"]: p for r, p in zip(rows, prints, strict=True)}


@pytest.mark.parametrize("shard_rows,one_block", [(20_000, near_dups.ONE_BLOCK), (40, near_dups.ONE_BLOCK), (40, 1)])
def test_links_join_every_pair(spark, shard_rows, one_block):
    """Random fingerprints and dense clusters, in small shards (one tree) and in shards of several vantage points."""
    rng = random.Random(7)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        c = rng.getrandbits(64)
        for _ in range(250):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 9)):
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    rows = near_dups.links(spark.createDataFrame([(p,) for p in signed], "fp long"), shard_rows=shard_rows, one_block=one_block)
    roots = {r["node"]: r["root"] for r in near_dups.components(spark, rows).collect()}
    want = slow_components(signed, points)
    assert [roots.get(p, p) for p in signed] == want


def test_trees_prune():
    """A tree finds every pair within the radius, and takes the distance of far fewer."""
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1 << 63, 6000, np.int64).view(np.uint64))
    near = points[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    tree = near_dups.Tree(points)
    found = {(int(min(a, b)), int(max(a, b))) for x, y in tree.links(4) for a, b in zip(x, y, strict=True) if a != b}
    want = {(a, int(b) + a + 1) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points[a + 1 :] ^ points[a]) <= 4)}
    assert found == want and len(want) >= 500
    assert tree.compared < 0.5 * len(points) ** 2


def test_dense_family(spark):
    """Very many fingerprints within eight bits of one: links end, and join what is linked by hand."""
    rng = np.random.default_rng(5)
    flips = np.zeros(30_000, np.uint64)
    for _ in range(8):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
    points = np.unique(flips ^ np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    rows = near_dups.links(spark.createDataFrame([(int(p),) for p in points], "fp long"), shard_rows=1000)
    roots = {r["node"]: r["root"] for r in near_dups.components(spark, rows).collect()}
    u = points.view(np.uint64)
    for k in range(0, len(u), 500):
        mates = np.flatnonzero(np.bitwise_count(u ^ u[k]) <= 4)
        assert {roots.get(int(points[m]), int(points[m])) for m in mates} == {roots.get(int(points[k]), int(points[k]))}


def test_keep_one_tells_nulls_and_repeats_apart(spark):
    """Ids of text, nulls on either side, equal rows, and columns with clashing names."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(None, texts[0]), (texts[0], None), ("b", texts[1]), ("a", texts[1]), ("a", texts[1]), ("c", "alone here"), (None, None), ("d", "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id string, text string, slot int")
    for c in ("_id", "_digest", "_word", "_bits", "row", "id", "fp"):
        docs = docs.withColumn(c, near_dups.F.lit("x"))
    kept = near_dups.keep_one(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted([("None", texts[0]), ("a", texts[1]), ("c", "alone here"), ("d", "")])
    clean = pii.sanitise(docs.withColumn("text", near_dups.F.when(near_dups.F.col("slot") == 0, "mail a@b.com now").otherwise(near_dups.F.col("text"))).withColumn("doc_id", near_dups.F.when(near_dups.F.col("slot") == 1, "mail a@b.com now").otherwise(near_dups.F.col("doc_id"))))
    got = {r["slot"]: r for r in clean.collect()}
    assert len(got) == len(rows) and "[EMAIL]" in got[0]["text"] and got[1]["text"] is None and got[2]["text"] == texts[1] and clean.columns == docs.columns


def test_every_text_with_a_span_may_hold_one():
    rng = random.Random(12)
    hit = 0
    for _ in range(6000):
        t = noise(rng, rng.randint(0, 12))
        if pii.base_spans(t):
            hit += 1
            assert any(re.search(rx, t) for rx in pii.MAY_HOLD), t
    assert hit > 1000


def test_simhash_edge_cases(spark, docs):
    rows = [(5, None, None), (3, "", "en"), (None, "  ", "en"), (7, "a b c d e f g h", "en"), (7, "a b c d e f g h", "en"), (None, "only one here", "en")]
    got = near_dups.near_duplicates(docs(*rows).withColumn("fp", near_dups.F.lit(1)).withColumn("key", near_dups.F.lit(2))).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("5", "3"), ("7", "7"), ("7", "7"), ("None", "3"), ("None", "None")]
    kept = near_dups.keep_one(docs(*rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("3", ""), ("7", "a b c d e f g h"), ("None", "only one here")]
    assert near_dups.near_duplicates(docs(*rows).limit(0)).count() == 0


def test_disclosing_terms_go(spark, docs):
    common = "the report was sent to all of them on monday by the office and "
    texts = [common + f"Zebediah wrote from zeb@corp.example.com to the office number {k}" for k in range(6)]
    texts += [common + f"someone wrote from other{k}@corp.example.com to the office" for k in range(30)] + [common] * 30 + [None, ""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(*texts)).collect()}
    assert "Zebediah" not in clean[0] and "[EMAIL]" in clean[0] and "zeb@" not in clean[0]
    assert "wrote from [EMAIL] to the office" in clean[10]
    assert clean[40] == common and clean[66] is None and clean[67] == ""
    empty = pii.sanitise(docs("x").limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_values_seen_once_or_twice_have_disclosing_terms(spark, docs):
    """Against the shares counted in plain Python; the name stands far from its value, in one document or two."""
    rng = random.Random(3)
    common = [f"word{k}x" for k in range(40)]
    texts = [" ".join(rng.sample(common, 30)) for _ in range(400)]
    texts[7] = "Zebediah Quux, " + texts[7] + " zeb@corp.example.com"
    texts[8] = "Ottoline " + texts[8] + " 10.1.2.3 and " + texts[9] + " ott@corp.example.com"
    texts[9] = "ott@corp.example.com " + texts[9] + " (ottoline)"
    texts += [None, ""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(*texts)).collect()}
    assert "Zebediah" not in clean[7] and "Quux" not in clean[7] and "[EMAIL]" in clean[7]
    assert "ttoline" not in clean[8] and "ttoline" not in clean[9] and "[IP]" in clean[8]
    assert all(clean[k] == t for k, t in enumerate(texts) if k not in (7, 8, 9))

    seen = [(pii.base_spans(t), {w.strip(pii.EDGE).lower() for w in (t or "").split()}) for t in texts]
    values = [{pii.entity(k, t[s:e]) for s, _, e, k in spans} for t, (spans, _) in zip(texts, seen)]
    n = len(texts)
    for r in pii.find_pii(docs(*texts)).collect():
        t, want = texts[r["doc_id"]], {}
        for e in values[r["doc_id"]]:
            for m in re.finditer(r"\S+", t):
                w = m[0].strip(pii.EDGE)
                df_e, p = sum(e in v for v in values), sum(w.lower() in ws for _, ws in seen) / n
                both = sum(e in v and w.lower() in ws for v, (_, ws) in zip(values, seen))
                share = np.log((both + 0.5 * p) / (df_e + 0.5) / p) / np.log(n / df_e)
                if re.search("[a-z]", w) and "@" not in w and share >= 0.75:
                    at = t.index(w, m.start()), w
                    want[at] = max(want.get(at, ""), "remove" if share >= 0.95 else "generalise")
        got = {(s["start"], t[s["start"] : s["end"]]): s["action"] for s in r["spans"] if s["kind"] == "term"}
        assert got == want
