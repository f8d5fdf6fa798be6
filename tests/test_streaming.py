"""Streams over files against the same rules on a table."""

from pyspark.sql import functions as F

from lodestar.streaming import live, state


def source(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    return events, events.schema


def finished(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()


def test_live_hourly(spark, small, tmp_path):
    events, schema = source(spark, small)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    finished(state.live_hourly(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "hours", "update")
    got = spark.table("hours").groupBy("hour", "event_type").agg(F.max("n").alias("n")).collect()
    assert {tuple(r) for r in got} == {(r["hour"], r["event_type"], r["n"]) for r in state.hourly(events).collect()}


def test_live_sessions(spark, small, tmp_path):
    events, schema = source(spark, small)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    finished(state.live_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "live", "update")
    rows = spark.table("live").collect()
    most = {}
    for r in rows:
        most[r["user_id"]] = max(most.get(r["user_id"], 0), r["events"])
    assert most == {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_cooldown_and_deadline(spark):
    rows = [(1, "2024-01-01 00:00:00", "error"), (2, "2024-01-01 00:01:59", "view"), (3, "2024-01-01 00:02:30", "view"), (4, "2024-01-01 00:03:00", "error"), (5, "2024-01-01 00:05:00", "view")]
    events = spark.createDataFrame([(i, 7, t, k, 1.0) for i, t, k in rows], "event_id bigint, user_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["event_id"]: r["cooling"] for r in state.cooldowns(events).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert {(r["kept"], r["dropped"]) for r in state.within_deadline(events).collect()} == {(1, 0)}
    assert [tuple(r) for r in state.sessions(events).collect()] == [(7, 1, 5, "scraping_done")]


def test_live_search_tells_its_stages(spark, tmp_path):
    hits = [(1, "https://a.org/x", "google", 1, 200), (1, "https://A.org/x/", "bing", 1, 60), (2, "https://www.reddit.com/r", "google", 1, 20)]
    spark.createDataFrame(hits, "query_id int, url string, engine string, rank_position int, n_bytes int").coalesce(1).write.parquet(str(tmp_path / "in"))
    queries = spark.createDataFrame([(1, "latest news", "lite"), (2, "cats", "reddit"), (3, "not asked", None)], "query_id int, query string, focus string")
    order = [F.col("rank_position"), F.col("engine")]
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start has nothing to tell
        live.follow(stream, queries, order, "2026", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    told = {(r["query_id"], r["seq"]): (r["kind"], r["n"], r["text"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert told[1, 2] == ("info", None, "searching: latest news 2026") and told[2, 2][2] == "searching: cats site:reddit.com"
    assert told[1, 3][1] == 2 and told[1, 4][1] == 1 and told[1, 5][1] == 2 and told[1, 6] == ("ranked_chunks", 1, None) and told[1, 7][1] == 1
    assert told[2, 4][1] == 1 and told[2, 7][1] == 1 and (2, 6) not in told and (3, 1) not in told
