"""Every operator over nulls, empty and long texts, repeats, clashing columns and empty tables: a defined row for each input row."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontaminate, language, near_dups, pages, pii, quality_classifier, quality_rules, secrets, toxicity

ROWS = [(None, None, None), (1, "", "en"), (2, " \n\t ", None), (3, "word", "en"), (3, "word", "en"), (4, "x" * 300_000, "en"), (5, "a b " * 60_000, "de"), (6, "é\U0001f600 日本 " * 50, "de"), (7, "1234 5678 +++ @@ password= AKIA token:", "en"), (8, "the quick brown fox jumps over the lazy dog again and again today", "en"), (-(2**63), "<p>", "en")]


def ops(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox"), (None, None), (2, "")], "item_id long, text string")
    return {
        "secrets": secrets.find_secrets,
        "rules": lambda d: quality_rules.judge(d, quality_rules.references(d)),
        "bpe": byte_bpe.encode_documents,
        "language": lambda d: language.identify(d, language.model(language.train(d))),
        "pages": lambda d: pages.extract_pages(d.withColumn("url", F.lit(None).cast("string")), id_col="doc_id", html_col="text"),
        "classifier": quality_classifier.classify,
        "decontaminate": lambda d: decontaminate.find_contamination(d, bench),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d.withColumn("toxic", F.lit(0)))),
        "near_dups": near_dups.near_duplicates,
        "pii": pii.find_pii,
    }


NAMES = ["secrets", "rules", "bpe", "language", "pages", "classifier", "decontaminate", "toxicity", "near_dups", "pii"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_in_rows_out(spark, docs, name):
    clash = docs(*ROWS)
    for c in ("key", "fp", "spans", "score", "kept", "n_words", "_text", "votes", "hits", "term"):
        clash = clash.withColumn(c, F.lit("clash"))
    out = ops(spark)[name](clash).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    same = [r for r in out if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert ops(spark)[name](docs(*ROWS).limit(0)).count() == 0


def test_pipeline_stages_on_edges(spark, docs):
    import corpus_pipeline as cp

    d = docs(*ROWS).withColumn("extra", F.lit(1))
    for name, stage in cp.STAGES:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.count() <= len(ROWS), name
        assert stage(spark, d.limit(0), "/root/testdata/sf0.001").count() == 0, name
    kept = cp.near_dedup(spark, d, "")
    assert kept.where("doc_id = 3").count() == 1
