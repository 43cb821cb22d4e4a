"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from corpusloom.streaming import rooms


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_sequence_numbers(spark, tmp_path):
    src = spark.range(200).selectExpr("id % 7 AS room_id", "id AS event_id", "'note' AS event_type")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(rooms.stream_sequence(stream), "numbered")
    for r in spark.table("numbered").groupBy("room_id").agg(F.count("*").alias("n"), F.max("seq").alias("top"), F.count_distinct("seq").alias("d")).collect():
        assert r["n"] == r["top"] == r["d"]


def test_operations_once(spark, tmp_path):
    src = spark.range(50).selectExpr("concat('op', id % 20) AS op_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,CAST(id % 20 AS INT)) AS at")
    src.write.parquet(str(tmp_path / "ops"))
    run(rooms.stream_operations(spark.readStream.schema(src.schema).parquet(str(tmp_path / "ops"))), "once")
    assert spark.table("once").count() == 20


def test_room_state_and_frames(spark):
    log = spark.createDataFrame([(1, 1, "highlight.added", "h1", "x", None), (1, 2, "comment.added", "c1", "hi", "h1"), (1, 3, "comment.added", "c2", "yo", "h2"), (1, 4, "highlight.added", "h2", "y", None), (1, 5, "highlight.removed", "h2", None, None)], "room_id int, seq int, event_type string, item_id string, payload string, anchor string")
    got = {r["item_id"]: r["anchor"] for r in rooms.room_state(log).collect()}
    assert got == {"h1": None, "c1": "h1", "c2": None}
    frames = {r["seq"]: r["frame"] for r in rooms.format_sse(log.select("seq", "event_type", "payload")).collect()}
    assert frames[2] == 'id: 2\nevent: comment.added\ndata: {"payload":"hi"}\n\n'


def test_stream_changes_equal_batch(spark, tmp_path):
    from corpusloom.streaming import watches

    src = spark.range(300).selectExpr("id % 5 AS watch_id", "id AS event_id", "CAST(id * id % 7 % 2 AS STRING) AS content", "id AS polled_at")
    src.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "polls"))
    run(watches.stream_changes(spark.readStream.schema(src.schema).parquet(str(tmp_path / "polls"))), "changed")
    want = {r["event_id"] for r in watches.changes(src).collect()}
    assert {r["event_id"] for r in spark.table("changed").collect()} == want and want


def test_fetched_comments(spark):
    from corpusloom.sources import fetched

    spark.dataSource.register(fetched.FetchedSource)
    df = spark.read.format("fetched").option("fetcher", "tests.test_streaming:fake_comments").option("keys", "a,b").schema("key string, value string").load()
    assert sorted((r["key"], r["value"]) for r in df.collect()) == [("a", "a0"), ("a", "a1"), ("b", "b0"), ("b", "b1")]


def fake_comments(key):
    return [f"{key}{k}" for k in range(2)]
