"""Every query with SQL gives the SQL's rows on the smallest tables; every other one is held against plain Python."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest

from corpusloom.functions import text as tx
from corpusloom.functions.quantities import extract_quantities
from corpusloom.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_other_query_has_its_check():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(CHECKS)


def documents(spark) -> dict:
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def check_articles(spark, got):
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()


def check_vault_notes(spark, got):
    assert len(got) > 0 and all(r[0] is not None for r in got)


def check_quiz(spark, got):
    texts = documents(spark)
    assert len(got) > 50
    for r in got:
        assert len(r["options"]) == len(set(r["options"])) and 0 <= r["answer_index"] < len(r["options"])
        assert r["evidence"] in tx.normalize(texts[r["id"]])


def check_keywords(spark, got):
    texts = documents(spark)
    assert len(got) == len(texts)
    for r in got:
        words = [w for k in r["keywords"] or [] for w in k.split()]
        assert len(words) == len(set(words)) and all(w in texts[r["doc_id"]].lower() for w in words)


def check_extractive_summary(spark, got):
    texts = documents(spark)
    for r in got:
        whole = tx.simple_split(texts[r["doc_id"]])
        want = [s for s in whole if s in set(r["sentences"])]
        assert r["sentences"] == want[: len(r["sentences"])] or set(r["sentences"]) <= set(whole)
        assert len(r["sentences"]) == (len(whole) if len(whole) <= 3 else min(max(3, round(0.4 * len(whole))), len(whole)))


def check_sentence_split(spark, got):
    assert {r["doc_id"]: r["n"] for r in got} == {k: len(tx.split_sentences(t)) for k, t in documents(spark).items()}


def check_distinct_stems(spark, got):
    words = {w for t in documents(spark).values() for w in re.findall(r"[a-z0-9]+(?:'[a-z]+)?", (t or "").lower())}
    assert {r["token"]: r["stem"] for r in got} == {w: tx.porter_stem(w) for w in words}


def check_document_quantities(spark, got):
    want = sum(len(extract_quantities(t)) for t in documents(spark).values())
    assert len(got) == want > 0


def check_clusters(spark, got):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(got) == vectors == len({r["id"] for r in got})


def check_candidate_join(spark, got):
    exact = {(r["a"], r["b"]) for r in registry.QUERIES["similarity_join"](spark, SF).collect()}
    found = {(r["a"], r["b"]) for r in got}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def check_audio_repeats(spark, got):
    assert len(got) > 0


def check_trace_all_entries(spark, got):
    texts = documents(spark)
    assert {r["id"] for r in got} == set(texts)
    for r in got:
        if r["reason"] is None:
            assert r["sentences"] == len(tx.split_sentences(texts[r["id"]].strip())) and 0 <= r["coverage"] <= 1


CHECKS = {name.removeprefix("check_"): fn for name, fn in list(globals().items()) if name.startswith("check_")}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_plain_python(spark, name):
    CHECKS[name](spark, registry.QUERIES[name](spark, SF).collect())


#: Readers, as the ids of their sessions, whose trend has a slope of exactly 2 or -2 and is steady or not by the last digit of it.
AT_THE_LIMIT = [
    [152, 3764, 10827, 18681, 35551, 64153, 82276, 87302], [11143, 13698, 25787, 34775, 40235, 43077, 43301, 56734, 83341], [209514, 222891, 254153, 268951, 283959, 294620],
    [304835, 320410, 325198, 347143, 355879, 366092, 370320], [310673, 328670, 328852, 333493, 345722, 386350], [300847, 333642, 365303, 366234, 380241], [443448, 460913, 473863, 478119, 481794, 490866],
    [421974, 425635, 461286, 475370, 481985, 484582, 495957], [406706, 410948, 443358, 459255, 465219, 467634, 480997, 498014], [3118829, 3122623, 3130106, 3151281], [3818829, 3822623, 3830106, 3851281],
]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_trends_at_the_limit_are_those_of_the_sql(spark, tmp_path, batch):
    sessions = [(i, pd.Timestamp("2024-01-01"), user) for user, ids in enumerate(AT_THE_LIMIT) for i in ids]
    pd.DataFrame(sessions, columns=["event_id", "ts", "user_id"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = registry.QUERIES["reading_fitness"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set(key, before)
    want = c.sql(registry.ORACLE_SQL["reading_fitness"]).df()
    assert set(want["trend"]) == {"improving", "declining", "steady"}
    assert rows(got) == rows(want)
