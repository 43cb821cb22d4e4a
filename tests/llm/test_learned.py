"""Learned and rule operators: brute-force counts, held-out accuracy, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import language, pages, quality_classifier, quality_rules, toxicity
from corpusloom.llm.common import read
from corpusloom.llm.queries import QUERIES

EDGE = [None, "", " \n\t", "!!! ... 123", "a", "the " * 5000, "x" * 100_000, "é" * 50, "日本語 テキスト", "퟿\U0001f600"]


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {i for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_quality_counts():
    rng = random.Random(9)
    for _ in range(800):
        t = "".join(rng.choice(["a ", "b ", "c\n", "a b a b a b a b ", "#", " ", "\x1c", "\n", "| "]) for _ in range(rng.randint(0, 60)))
        words = quality_rules.WORD.findall(t)
        assert (len(words), *quality_rules.base_counts(t, words)) == slow_counts(t), repr(t)


def test_quality_rules_table(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    rows = read(spark, sf, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        want = slow_counts(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g["base_failed"] and g["kept"])
    clean = [d for d, q in labels.items() if q == 1 and not got[d]["base_failed"]]
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(got[d]["kept"] for d in clean) >= 0.98 * len(clean)
    assert sum(not got[d]["kept"] for d in junk) >= 0.8 * len(junk)


def test_divergence_is_symmetric_and_bounded():
    p, q = np.array([0.5, 0.5, 0]), np.array([[0.0, 0.5, 0.5]])
    d = quality_rules.distance(p, q)[0]
    assert d == pytest.approx(quality_rules.distance(q[0], p[None, :])[0]) and 0 < d < 1
    assert quality_rules.distance(p, p[None, :])[0] == 0
    assert quality_rules.distance(np.array([1.0, 0]), np.array([[0, 1.0]]))[0] == pytest.approx(1)


def test_language_held_out(spark):
    """Languages of documents that the model has not learned from."""
    rows = QUERIES["op4_language_mixture"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and len(rows) == len(truth)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixtures_and_edges(spark, docs):
    trained = language.model(language.train(read(spark, "/root/testdata/sf0.01", "documents")))
    by = {r["lang"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").where("n_chars between 1500 and 4000").collect()}
    mixed = by["en"][:1200] + "\n" + by["fr"][:1200]
    got = {r["doc_id"]: r for r in language.identify(docs(*EDGE, mixed), trained).collect()}
    assert [got[k]["lang_pred"] for k in range(4)] == ["und"] * 4 and got[0]["score"] == 0
    assert set(got[len(EDGE)]["mixture"]) == {"en", "fr"}
    none = language.model(language.train(docs((1, "abc", None))))
    assert language.identify(docs("some text"), none).first()["lang_pred"] == "und"
    assert language.identify(docs("x").limit(0), trained).count() == 0


def test_trigrams_of_long_texts_are_those_of_one_piece(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", " ", "1", "  ", "é", "ΑΣ", "İ", "\U0001f600", ".", "z"]) for _ in range(rng.randint(0, 60)))
        want = language.trigrams(t)
        with monkeypatch.context() as m:
            m.setattr(language, "CHUNK", rng.randint(1, 9))
            got = language.trigrams(t)
        assert (want is None) == (got is None)
        if want is not None:
            assert all((a == b).all() for a, b in zip(want, got, strict=True))


def slow_mixture(bins, counts, logp):
    """Proportions by EM over all languages, row by row in plain Python."""
    n = logp.shape[1]
    w = [1 / n] * n
    for _ in range(400):
        new = [0.0] * n
        for b, c in zip(bins, counts, strict=True):
            p = [w[k] * float(np.exp(logp[b, k])) for k in range(n)]
            for k in range(n):
                new[k] += c * p[k] / sum(p)
        w = [x / sum(counts) for x in new]
    return w


def test_mixture_against_plain_em():
    """The chosen set's proportions, and ties of two equal languages."""
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.full(60, 0.2), 4).T + 1e-5)
    counts = rng.multinomial(900, (0.6 * np.exp(logp[:, 1]) + 0.4 * np.exp(logp[:, 3])) / (0.6 * np.exp(logp[:, 1]) + 0.4 * np.exp(logp[:, 3])).sum())
    bins = np.flatnonzero(counts)
    w = language.mixture(bins, counts[bins], logp)
    assert w[0] == w[2] == 0
    assert np.allclose(w[[1, 3]], slow_mixture(bins.tolist(), counts[bins].tolist(), logp[:, [1, 3]]), atol=5e-3)
    same = np.repeat(logp[:, :1], 2, axis=1)
    assert language.mixture(bins, counts[bins], same).sum() == pytest.approx(1)


def test_mixture_finds_proportions():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.full(400, 0.1), 3).T + 1e-6)
    draws = np.concatenate([rng.choice(400, 1400, p=np.exp(logp[:, 0]) / np.exp(logp[:, 0]).sum()), rng.choice(400, 600, p=np.exp(logp[:, 2]) / np.exp(logp[:, 2]).sum())])
    w = language.mixture(*np.unique(draws, return_counts=True), logp)
    assert w[1] == 0 and abs(w[0] - 0.7) < 0.06 and w.sum() == pytest.approx(1)


def slow_segments(s):
    """Every maximal scoring passage, by recursion on the best one."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-12):
                    top = (i, j + 1, total)
        return top

    def go(a, b):
        t = best(a, b)
        return [] if t is None else [*go(a, t[0]), t, *go(t[1], b)]

    return go(0, len(s))


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 24))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in slow_segments(s)]


def test_lambda_solves_its_equation():
    s, w = np.array([2.0, -1.0]), np.array([0.1, 0.9])
    x = toxicity.solve_lambda(s, w)
    assert (w * np.exp(x * s)).sum() == pytest.approx(1)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = [r for r in read(spark, sf, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    right = sum(rows[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    caught = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"]]
    assert right >= 0.97 * len(labels) and sum(caught) >= 0.85 * len(caught)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_toxicity_edges(spark, docs):
    rows = docs(*["you idiot scum go away now"] * 30, *["a nice day in the park with friends"] * 90).selectExpr("doc_id", "text", "CAST(text LIKE '%idiot%' AS INT) AS toxic")
    model = toxicity.fit(rows)
    got = {r["doc_id"]: r for r in toxicity.score(docs(*EDGE, "hello you idiot scum go away now"), model).collect()}
    assert got[len(EDGE)]["predicted"] == 1 and got[len(EDGE)]["passages"] and all(got[k]["predicted"] == 0 for k in range(len(EDGE)))
    none = toxicity.fit(rows.limit(0))
    assert toxicity.score(docs("x", None), none).agg({"score": "max"}).first()[0] == 0


def test_weak_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op6_weak_label_quality"](spark, sf).collect()}
    labels = read(spark, sf, "labels").collect()
    assert sum(rows[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels) >= 0.95 * len(labels)


def test_weak_label_em_recovers_accuracies():
    rng = random.Random(8)
    alarm, false = [0.7, 0.5, 0.9], [0.02, 0.05, 0.01]
    n = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        n["".join("-" if rng.random() < (false[j] if good else alarm[j]) else "+" for j in range(3))] += 1
    post, rate, share = quality_classifier.em(n)
    assert abs(share - 0.8) < 0.02 and np.allclose(rate[:, 0], alarm, atol=0.05) and np.allclose(rate[:, 1], false, atol=0.02)
    assert post["---"] > 0.99 or post["---"] < 0.01


def test_weak_label_edges(spark, docs):
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs(*EDGE)).collect()}
    assert len(got) == len(EDGE) and not got[0]["kept"] and got[1]["score"] == 0
    assert quality_classifier.classify(docs("x").limit(0)).count() == 0


def test_mixture_of_more_than_twelve_languages():
    """Every language of a mixed text is found, whatever their number; those it lacks are not."""
    shares = np.full((20, 400), 1e-6)
    for k in range(20):
        shares[k, 20 * k : 20 * k + 20] = 1
    logp = np.log(shares / shares.sum(1, keepdims=True)).T.astype(np.float32)
    counts = np.where(np.arange(320) < 300, 20, 4)  # fifteen languages, and a sixteenth as the smallest part
    w = language.mixture(np.arange(320), counts, logp)
    assert np.allclose(w[:15], 400 / 6080, atol=1e-3) and np.isclose(w[15], 80 / 6080, atol=1e-3) and not w[16:].any()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header">Site name <nav><a href=/>Home</a></nav></header><div id="cookie-notice">We use cookies.</div>
<div class="wrap"><aside>Related links</aside>
<article class="post"><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>&nbsp;text<br>goes on.<p>Second
   one &lt;b&gt;.</p><ul><li>item one<li>item two</ul><div class="ad">Buy now</div><script>var a="</p>";</script>
<section id="comments"><p>First!</p></section><div class="share-buttons">Share</div><form><p>Mail us</p></form></article></div>
<footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert pages.extract(PAGE) == "Head & line\n\nFirst bold text goes on.\n\nSecond one <b>.\n\nitem one\n\nitem two"
    plain = "<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>%s</p><p>%s</p></div><div>(c)</div></body>" % ("Long text here. " * 20, "More text there. " * 20)
    assert pages.extract(plain).startswith("Long text here.") and "(c)" not in pages.extract(plain) and "One" not in pages.extract(plain)
    for odd in (None, "", "<", "<p", "plain words", "<p>a<table><tr><td>b", "</div></p>x", "<!-- <p>no</p> -->", "<script>x", "&#0;&#xD800;&bogus;"):
        assert isinstance(pages.extract(odd), str)
    assert pages.extract("plain words") == "plain words"
    wrapped = '<div class="page with-sidebar"><div class="social-layout"><main><p>Main part.</p><div class="social">x</div></main></div><div class="sidebar"><article><p>Other.</p></article></div><section class="comments"><article class="comment"><p>Me!</p></article><article><p>Me too!</p></article></section></div>'
    assert pages.extract(wrapped) == "Main part."


def test_main_text_in_several_places():
    """Sibling articles, a lead or a heading outside the body, and forms around the page."""
    para = "A sentence of the story that goes on for a while, as sentences do. " * 4
    menu = "<ul>" + "<li><a href=/>Some link</a></li>" * 8 + "</ul>"
    split = "".join(f"<article><p>Part {k}. {para}</p></article>" for k in range(4))
    assert [f"Part {k}." in pages.extract(f"<body>{menu}{split}</body>") for k in range(4)] == [True] * 4
    lead = pages.extract(f"<body>{menu}<article><p>Lead. {para}</p></article><div><p>Body one. {para}</p><p>Body two. {para}</p></div><div>(c)</div></body>")
    assert all(x in lead for x in ("Lead.", "Body one.", "Body two.")) and "Some link" not in lead and "(c)" not in lead
    body = "".join(f"<p>Text {k}. {para}</p>" for k in range(9))
    headed = pages.extract(f"<body>{menu}<div><h1>The heading</h1><p>Lead. {para}</p></div><div>{body}</div></body>")
    assert headed.startswith("The heading\n\nLead.") and "Text 8." in headed and "Some link" not in headed
    assert pages.extract(f"<body><form>{menu}<article><p>{para}</p></article></form></body>") == para.strip()
    assert pages.extract(f"<body><form><div><p>{para}</p></div></form></body>") == para.strip()
    assert pages.extract(f"<body><article><p>{para}</p><form><p>Mail us</p></form></article></body>") == para.strip()


def test_main_text_follows_the_clusters():
    """Pages without article, main or telling names: the threshold decides."""
    para = "A sentence of the story that goes on for a while, as sentences do. " * 4
    menu = "<div>" + "<div><a href=/>Some link</a> <a href=/>Other</a></div>" * 8 + "</div>"
    body = f"<div><h2>Head</h2><p>Lead. {para}</p><p>Short.</p><p>More. {para}</p><p>End.</p></div>"
    page = f"<body>{menu}{body}{menu}</body>"
    assert pages.extract(page) == f"Head\n\nLead. {para.strip()}\n\nShort.\n\nMore. {para.strip()}\n\nEnd."
    assert "Some link" in pages.extract(page, threshold=0) and pages.extract(page, threshold=50) == ""
    flat = f"<body><p>Lead. {para}</p><p>Short.</p><p>More. {para}</p>{menu}</body>"
    assert pages.extract(flat) == f"Lead. {para.strip()}\n\nShort.\n\nMore. {para.strip()}"
    assert pages.extract(flat, sigma=9, threshold=3) != pages.extract(flat)


def test_main_text_of_malformed_pages_in_linear_time():
    import time

    for odd in ("<![foo[x]]><p>a", "<p>a</p><![ x", "<![CDATA[<p>a", "<!-- x <p>a", "<p>a<!---- -- >", "<p>a <b", "<!DOCTYPE [<p>a", "<?php <p>a", "</ <p>a"):
        assert "a" in pages.extract(odd), odd
    for bit in ("<div>x", "<div class=ad>x", "<div class=ad><article>x", "<p><span>", "<b><div>", "</b>x", "<a ", '<a href="', "<!--", "<!---- ", "<![ x", "<"):
        began = time.time()
        pages.extract("<b>" + bit * 50_000 + "</i>" * 1000)
        assert time.time() - began < 15, bit


def test_main_text_table(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op5_main_text"](spark, sf).collect()}
    import html

    for r in read(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_whole_pipeline(spark, sf):
    """Each stage against its own brute force, on what the one before kept."""
    import corpus_pipeline as cp

    d = read(spark, sf, "documents")
    cols = list(cp.DOC_COLUMNS)
    seen = [d]
    for _, stage in cp.STAGES[:-1]:
        seen.append(cp.checkpointed(spark, stage(spark, seen[-1], sf)))
        assert seen[-1].columns == cols
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert ids[1] == {r["doc_id"] for r in d.collect() if any(c.isalpha() for c in r["text"] or "")}
    from corpusloom.llm.near_dups import near_duplicates

    comp = near_duplicates(seen[1]).collect()
    assert ids[2] == {r["component_id"] for r in comp}
    from corpusloom.llm.decontaminate import find_contamination

    hit = {r["doc_id"] for r in find_contamination(seen[2], read(spark, sf, "benchmark")).where("contaminated").collect()}
    assert ids[3] == ids[2] - hit
    assert find_contamination(seen[3], read(spark, sf, "benchmark")).where("contaminated").count() == 0
    from corpusloom.llm.pii import base_spans

    assert not any(k in ("email", "phone") for r in seen[4].collect() for *_, k in base_spans(r["text"]))
    assert ids[4] == ids[3]
    out = cp.STAGES[-1][1](spark, seen[4], sf).collect()
    assert len(out) == len(ids[4])
    assert cp.run(spark, sf).count() == len(out)


def test_toxicity_against_plain_loops(spark):
    """The whole operator on the smallest table: counts, scores, passages, chance, levels and scores, a document at a time."""
    import math
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    labels = [(r["doc_id"], r["toxic"]) for r in read(spark, sf, "labels").collect() if r["toxic"] is not None and not held[r["doc_id"]]]
    bins = {d: [zlib.crc32(w.strip(toxicity.EDGE).lower().encode()) % toxicity.BINS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for d, t in texts.items()}
    n = [Counter(), Counter()]
    for d, y in labels:
        n[y].update(set(bins[d]))
    both = n[0] + n[1]
    whole = sum(both.values())
    prior = min(1000.0, 0.1 * whole)

    def score(b):
        a = prior * both[b] / whole + 0.5
        odds = [math.log((n[y][b] + a) / (sum(n[y].values()) + prior - n[y][b] - a + 0.5)) for y in (0, 1)]
        error = math.sqrt(1 / (n[1][b] + a) + 1 / (n[0][b] + a))
        d = odds[1] - odds[0]
        return d - error if d > 3 * error and d - error > 1 and n[1][b] else -0.05

    scores = {b: score(b) for b in {x for v in bins.values() for x in v}}
    dense = np.array([scores.get(b, -0.05) for b in range(toxicity.BINS)], np.float32)
    lam = toxicity.solve_lambda(dense, np.array([n[0][b] for b in range(toxicity.BINS)], float) + 1e-12)
    passages = {d: toxicity.segments([float(dense[x]) for x in v]) for d, v in bins.items()}
    draws = [math.exp(-toxicity.level(lam * max((s for *_, s in passages[d]), default=0.0) - math.log(len(bins[d]))) / 4) for d, y in labels if not y and bins[d]]
    k = len(draws) / sum(draws)

    def evidence(d):
        out = 0.0
        for *_, s in passages[d]:
            chance = 1 - math.exp(-math.exp(min(50.0, math.log(k) + math.log(len(bins[d])) - lam * s)))
            out -= math.log(max(chance, 1e-300)) if chance < 0.5 else 0
        return out

    table = np.zeros((2, toxicity.LEVELS))
    for d, y in labels:
        table[y, toxicity.place(evidence(d))] += 1
    by_level = toxicity.monotone(table)
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    assert len(got) == len(texts)
    for d in texts:
        assert got[d]["held_out"] == held[d] and got[d]["score"] == pytest.approx(by_level[toxicity.place(evidence(d))], abs=1e-9)


def test_weak_labels_against_plain_loops(spark):
    """The whole operator on the smallest table: votes by pattern, posteriors by plain EM, and the scores of the scorer they train."""
    import math

    sf = "/root/testdata/sf0.001"
    qc = quality_classifier
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    votes = {d: qc.votes(qc.Reader()(t)[0]) for d, t in texts.items()}
    patterns = Counter(votes.values())
    k = len(qc.LABELLERS)
    rate = [[0.4, 0.03] for _ in range(k)]  # of bad votes on bad and on good documents
    good, post = 0.85, dict.fromkeys(patterns, 0.85)
    for _ in range(300):
        new = {}
        for p in patterns:
            side = [1 - good, good]
            for j, v in enumerate(p):
                for y in (0, 1):
                    side[y] *= {"0": 1.0, "+": 1 - rate[j][y], "-": rate[j][y]}[v]
            new[p] = side[1] / sum(side)
        moved = max(abs(new[p] - post[p]) for p in patterns)
        post = new
        weight = {p: (n * (1 - post[p]), n * post[p]) for p, n in patterns.items()}
        for j in range(k):
            for y, first in ((0, 0.4), (1, 0.03)):
                rate[j][y] = (sum(w[y] for p, w in weight.items() if p[j] == "-") + first) / (sum(w[y] for p, w in weight.items() if p[j] != "0") + 1)
        good = min(0.99, max(0.01, (sum(w[1] for w in weight.values()) + 0.85) / (len(texts) + 1)))
        if moved < 1e-6:
            break
    got = {r["doc_id"]: r for r in QUERIES["op6_weak_label_quality"](spark, sf).collect()}
    assert len(got) == len(texts)
    for d in texts:
        assert got[d]["votes"] == votes[d] and got[d]["weak_label"] == pytest.approx(post[votes[d]], abs=1e-6)
    # fewer rows than the sample: every distinct text trains, in the order of its hash
    hashed = {r["h"]: r["text"] for r in read(spark, sf, "documents").selectExpr("xxhash64(text) AS h", "text").collect()}
    rows = [(qc.features(*qc.Reader()(hashed[h])), post[qc.votes(qc.Reader()(hashed[h])[0])]) for h in sorted(hashed)]
    weights = qc.train(rows)
    for d, t in texts.items():
        b, v = qc.features(*qc.Reader()(t))
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] * x for i, x in zip(b, v, strict=True)))))) if len(b) else 0.0
        assert got[d]["score"] == pytest.approx(want, abs=1e-4) and got[d]["kept"] == (got[d]["score"] >= 0.5)


def test_quality_verdicts_against_plain_loops(spark):
    """Distances of every document of the smallest table from references counted word by word."""
    import math
    import unicodedata
    import zlib

    sf = "/root/testdata/sf0.001"
    rows = read(spark, sf, "documents").collect()
    group = {"Ll": 0, "Lu": 1, "Lt": 1, "L": 2, "M": 2, "Nd": 3, "N": 3, "Zs": 4, "Zl": 4, "Zp": 4, "P": 5, "S": 6}

    def kind(c):
        name = unicodedata.category(c)
        return 6 if c in "#*$%&|<>" else 4 if "\t" <= c <= "\r" else group.get(name, group.get(name[0], 7))

    def shares(c):
        total = sum(c.values())
        return {k: v / total for k, v in c.items()}

    def js(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        kl = lambda a: sum(x * math.log2(x / m[k]) for k, x in a.items() if x > 0)
        return math.sqrt(min(1, max(0, (kl(p) + kl(q)) / 2)))

    words = lambda t: [zlib.crc32(w.strip(quality_rules.EDGE).lower().encode()) % quality_rules.BINS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    refs = []
    for lang in sorted({r["lang"] for r in rows} - {None}):
        mine = [r["text"] for r in rows if r["lang"] == lang and r["text"] is not None]
        w = shares(Counter(b for t in mine for b in words(t)))
        common = {b: x for b, x in w.items() if x >= 0.004}
        refs.append((shares(Counter(kind(c) for t in mine for c in t)), common | {None: max(0.0, 1 - sum(common.values()))}))
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, sf).collect()}
    for r in rows:
        g, t, w = got[r["doc_id"]], r["text"], words(r["text"])
        chars = min(js(shares(Counter(map(kind, t))), c) for c, _ in refs) if t and len(t) >= 100 else None
        apart = min(js(shares(Counter(b if b in ref else None for b in w)), ref) for _, ref in refs) if len(w) >= 40 else None
        assert g["class_distance"] == (None if chars is None else pytest.approx(chars, abs=1e-9))
        assert g["word_distance"] == (None if apart is None else pytest.approx(apart, abs=1e-9))
        assert g["kept"] == (not g["base_failed"] and (chars is None or chars <= 0.33) and (apart is None or apart <= 0.22 + 1 / math.sqrt(len(w))))
