"""State on streams: order, restarts, timers; each processor against its table form or a plain one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import keyed, state

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def rows(times, user=7, kind="view", first=1):
    return [(first + i, START + timedelta(seconds=s), user, kind if isinstance(kind, str) else kind[i]) for i, s in enumerate(times)]


def follow(spark, parts, processor, folder, late="10 minutes", word="event_type"):
    """What is told of parts, each after a start of the query on the same checkpoint; a far later row ends them."""
    spark.conf.set(*keyed.PROVIDER)
    parts = [*parts[:-1], [*parts[-1], (-1, START + timedelta(days=900), -1, "view")]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        told = keyed.kept(stream, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col(word), processor, late)
        told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return [r.asDict() for r in spark.read.parquet(f"{folder}/out").where("key >= 0").collect()]


def test_sessions_of_rows_out_of_order_over_restarts(spark, tmp_path):
    parts = [rows([0, 1300, 90, 700]), rows([1250, 1900, 5000, 4000], first=10)]  # 1250 comes after 1300, within the delay
    told = follow(spark, parts, keyed.Sessions(600), str(tmp_path), "30 minutes")
    last = max(told, key=lambda r: r["seq"])
    want = state.sessions(spark.createDataFrame(parts[0] + parts[1], SCHEMA), 600).first()
    assert (last["sessions"], last["longest"], last["last_status"], last["seq"]) == (want.sessions, want.longest, want.last_status, 8)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    told = follow(spark, [rows([0, 5000]), rows([10, 6000], first=10)], keyed.Sessions(600), str(tmp_path), "10 seconds")
    assert max(r["seq"] for r in told) == 3


def test_store_creates_updates_gets_wipes_and_sweeps(spark, tmp_path):
    words = ["update x", "get", "create a", "get", "update b", "get", "wipe", "get", "update c", "create d", "get", "get"]
    times = [0, 1, 10, 11, 20, 21, 30, 31, 32, 100, 699, 701]
    told = follow(spark, [rows(times[:6], kind=words[:6]), rows(times[6:], kind=words[6:], first=7)], keyed.Store(600), str(tmp_path), "1 second")
    got = {r["id"]: (r["found"], r["status"], r["updates"]) for r in told if r["id"] is not None}
    assert got == {2: (False, None, None), 4: (True, "a", 0), 6: (True, "b", 1), 8: (False, None, None), 11: (True, "d", 0), 12: (False, None, None)}
    assert [(r["status"], r["updates"]) for r in told if r["id"] is None] == [("d", 0)]  # swept once, though nothing came


@pytest.mark.parametrize("most", [3, 100])
def test_batches_are_those_of_the_table(spark, tmp_path, most):
    times = [0, 1, 2, 3, 4, 9, 9, 9, 9, 9, 15, 20, 21, 26, 27, 40]
    parts = [rows(times[:7]), rows(times[7:], first=8)]
    told = follow(spark, parts, keyed.Batches(most, 5), str(tmp_path), "1 second")
    want = state.count_or_timeout(spark.createDataFrame(parts[0] + parts[1], SCHEMA), most, 5).collect()
    assert sorted((r["batch"], r["n"], r["start"]) for r in told) == sorted((r.batch, r.n, r.start) for r in want)


def test_a_search_closes_at_its_deadline_and_late_rows_are_told(spark, tmp_path):
    told = follow(spark, [rows([0, 6, 3]), rows([7, 30], first=10)], keyed.Deadline(6), str(tmp_path), "2 seconds")
    assert [r["kept"] for r in told if r["late"] is None] == [3] and sorted(r["late"] for r in told if r["late"] is not None) == [10, 11]


def test_first_addresses_stop_at_their_number(spark, tmp_path):
    kinds = ["a", "b", "a", "c", "d", "b"]
    told = follow(spark, [rows(range(3), kind=kinds[:3]), rows(range(3, 6), kind=kinds[3:], first=4)], keyed.FirstAddresses(3), str(tmp_path), "1 second")
    assert sorted((r["seq"], r["id"]) for r in told) == [(1, 1), (2, 2), (3, 4)]


def test_cooldowns_are_those_of_the_table(spark, tmp_path):
    part = rows([0, 10, 119, 130, 140, 400], kind=["error", "error", "view", "view", "error", "view"])
    told = follow(spark, [part[:3], part[3:]], keyed.Cooldowns(120), str(tmp_path), "1 second")
    want = state.cooldowns(spark.createDataFrame(part, SCHEMA)).collect()
    assert {r["id"]: r["cooling"] for r in told} == {r.event_id: r.cooling for r in want}


def test_rows_without_key_or_time_are_left_out(spark, tmp_path):
    part = [*rows([0, 1]), (5, None, 7, "view"), (6, START, None, "view")]
    told = follow(spark, [part], keyed.Sessions(), str(tmp_path))
    assert [r["seq"] for r in told] == [2]
