"""Readers and sinks."""

import json

import numpy as np
import pytest

from corpusloom import schemas
from corpusloom.operators import ledger
from corpusloom.operators import library as lib
from corpusloom.operators import similarity as sim
from corpusloom.operators.extras import force_layout, scrub, with_model
from corpusloom.sources import readers, sinks


def test_texts_files_media(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two")
    (tmp_path / "b.wav").write_bytes(b"x" * 10)
    (tmp_path / "c.png").write_bytes(b"y")
    assert readers.texts(spark, str(tmp_path / "a.txt")).first()["text"] == "line one\nline two"
    assert readers.files(spark, str(tmp_path), "*.wav").count() == 1
    assert [r["byte_size"] for r in readers.media(spark, str(tmp_path), "audio").collect()] == [10]

    def extract(b: bytes) -> str:
        if b == b"y":
            raise ValueError("bad")
        return f" {len(b)} bytes "

    got = {r["text"]: r["text_error"] for r in readers.extract_with(readers.files(spark, str(tmp_path)).select("content"), "content", extract).collect()}
    assert got == {"17 bytes": None, "10 bytes": None, None: "ValueError"}


def test_article_text():
    assert readers.article_text("<nav><p>menu</p></nav><h1>T</h1><p>a &amp; b</p><script>p</script>") == "T\na & b"
    assert readers.article_text("<nav><p>menu</p></nav>") is None and readers.article_text(None) is None


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    sinks.write_backup({"notes": df}, str(tmp_path / "b"))
    back = sinks.read_backup(spark, str(tmp_path / "b"), {"notes": df.schema})["notes"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def entries(spark):
    return spark.createDataFrame([(1, 7, "Same", "", "one", "x", "A, b"), (2, 7, "Same", "", "two", "y", None), (3, 7, "", "", "Third one\nmore", "z", "")], "id long, user_id long, title string, source_ref string, summary string, source_text string, tags string")


def test_vault_notes_and_svg(spark):
    links = spark.createDataFrame([(10, 1, 2), (11, 2, 3)], "id long, from_id long, to_id long")
    notes = {r["file_name"]: r["body"] for r in sinks.vault_notes(entries(spark), links).collect()}
    assert set(notes) == {"Same.md", "Same-2.md", "Third one.md"}
    assert "- [[Same]]" in notes["Same-2.md"] and "- [[Third one]]" in notes["Same-2.md"] and "tags: [a, b]" in notes["Same.md"]
    svg = sinks.graph_svg(entries(spark).select("id", "title"), links)
    assert svg.count("<circle") == 3 and svg.count("<line") == 2


def test_evidence_pack(spark):
    rows = [("m", k, f"r{k}", f"h{k}", json.dumps({"note": f"n{k}"})) for k in range(1, 5)]
    chain = ledger.build_chain(spark.createDataFrame(rows, "chain_id string, position long, record_id string, content_hash string, metadata string"))
    got = [r.asDict() for r in chain.orderBy("sequence").collect()]
    pack = sinks.evidence_pack(got, {"r1": b"data"}, "M-0001")
    assert sinks.verify_pack(pack) == []
    bad = [dict(e) for e in got]
    bad[1]["content_hash"] = "changed"
    assert sinks.verify_pack(sinks.evidence_pack(bad, {}, "x")) == ["altered_entry 2"]
    assert ledger.verify_chain(chain).count() == 0
    gone = ledger.verify_chain(chain.where("sequence <> 2")).collect()
    assert {r["kind"] for r in gone} == {"sequence_gap", "broken_link"} and len(gone) == 2


def test_schema_evolution(spark):
    df = spark.createDataFrame([(1, "", "ref"), (2, "t", "ref"), (3, None, "")], "id long, title string, source_ref string")
    more = schemas.evolve(df, schemas.struct(id=schemas.L, starred=schemas.B), {"starred": False})
    assert more.columns == ["id", "title", "source_ref", "starred"] and more.where("starred = false").count() == 3
    assert [r["title"] for r in schemas.backfill_titles(df).orderBy("id").collect()] == ["ref", "t", None]


def test_model_hook(spark):
    df = entries(spark)
    up = with_model(df, "summary", "said", lambda xs: [x.upper() for x in xs], df["summary"])
    assert {r["said"] for r in up.collect()} == {"ONE", "TWO", "THIRD ONE\nMORE"} and not up.where("said_degraded").count()

    def broken(xs):
        raise RuntimeError

    assert with_model(df, "summary", "said", broken, df["summary"]).where("said_degraded AND said = summary").count() == 3


def test_candidate_join_recall(spark):
    """Near-duplicate vectors that the exact join finds, by hyperplanes."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    x = np.concatenate([x, x[:150] + rng.normal(size=(150, 64)) * 0.08])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    exact = {(r["a"], r["b"]) for r in sim.similarity_join(df, 0.92, block_rows=100).collect()}
    near = {(r["a"], r["b"]) for r in sim.candidate_join(df, 0.92).collect()}
    assert len(exact) >= 150 and near <= exact and len(near) >= 0.95 * len(exact)
    groups = sim.duplicate_groups(df, 0.92).collect()
    assert all(r["group_id"] == r["id"] % 300 for r in groups if r["size"] == 2)


def test_candidate_join_recall_below_near_duplicates(spark):
    """The registered query has every pair of the exact join; middle thresholds get the tables that they need."""
    from corpusloom.plans import registry

    registry.load()
    sf = "/root/testdata/sf0.01"
    exact = {(r["a"], r["b"]): r["similarity"] for r in registry.QUERIES["similarity_join"](spark, sf).collect()}
    near = {(r["a"], r["b"]): round(r["similarity"], 6) for r in registry.QUERIES["candidate_join"](spark, sf).collect()}
    assert exact and near == exact
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.75])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    want = {(r["a"], r["b"]) for r in sim.similarity_join(df, 0.77).collect()}
    got = {(r["a"], r["b"]) for r in sim.candidate_join(df, 0.77).collect()}
    assert len(want) >= 200 and got <= want and len(got) >= 0.95 * len(want)


def test_small_helpers(spark):
    assert scrub({"a": "x" * 9000, "b": list(range(500))}) == {"a": "x" * 8000, "b": list(range(200))}
    pos = force_layout(5, [(0, 1, 1.0), (1, 2, 0.5)])
    assert pos.shape == (5, 2) and np.isfinite(pos).all()
    with pytest.raises(ValueError):
        lib.bulk_action(entries(spark), entries(spark), "explode")


def test_delete_cascade_reaches_every_key(spark, tmp_path):
    """Entries above a million are deleted too."""
    from corpusloom.plans import registry

    registry.load()
    spark.createDataFrame([(1, 5), (2, 7), (3, 2_000_005), (4, 2_000_006)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 2_000_000, 3), (2, 1, 3, 2_000_005), (3, 1, 3, 2_000_007)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, registry.QUERIES["delete_cascade"](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == [(1, None), (2, 7), (3, None), (4, 2_000_006), (31, 3)]


def test_comment_means_are_added_in_order(spark):
    """However the rows are dealt, the mean is that of the scores added one by one."""
    rows = [(v, k, ((k * 37 + v * 11) % 21 - 10) / 10) for v in range(60) for k in range(62)]
    comments = spark.createDataFrame(rows, "video_id long, k long, compound double").orderBy(sinks.F.xxhash64("k")).repartition(5)
    got = {r["video_id"]: r["mean"] for r in readers.comment_sentiment(comments, order="k").collect()}
    want = {}
    for v, _, x in rows:
        want[v] = want.get(v, 0.0) + x
    assert got == {v: x / 62 for v, x in want.items()}
