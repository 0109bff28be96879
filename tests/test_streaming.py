import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding as em
from tessera.streaming import streams as st

T0 = datetime(2024, 1, 1, 12)
SCHEMA = ("event_id long, task_uuid string, worker_id string, created_at timestamp_ntz, to_status string, "
          "duration_s double, batch_checksum string")


def event(i, minutes, status="SUCCEEDED", worker="w1", task="t1", checksum=None):
    return (i, task, worker, T0 + timedelta(minutes=minutes), status, 1.0, checksum or f"c{i}")


def until(done, running, seconds=120):
    end = time.monotonic() + seconds
    while not done():
        assert running.exception() is None and time.monotonic() < end
        time.sleep(0.2)


class Feed:
    """A directory that grows by one file per call, and a stream over it."""

    def __init__(self, spark, directory):
        self.spark, self.directory = spark, str(directory / "in")

    def add(self, *rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.directory)

    def stream(self):
        return st.stream_files(self.spark, self.directory, self.spark.createDataFrame([], SCHEMA).schema, max_files=1)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_late_rows_are_dropped_and_windows_come_out_once(feed, path):
    feed.add(event(1, 0), event(2, 0.5), event(3, 30))
    first = st.run_to_table(st.progress_per_minute(feed.stream()), path)
    assert [(r["minute"], r["finished"]) for r in first.collect()] == [(T0, 2)]
    feed.add(event(4, 0.2), event(5, 60))  # event 4 is behind the watermark of minute 20
    rows = st.run_to_table(st.progress_per_minute(feed.stream()), path).orderBy("minute").collect()
    assert [(r["minute"], r["finished"]) for r in rows] == [(T0, 2), (T0 + timedelta(minutes=30), 1)]


def test_failure_alerts(feed, path):
    feed.add(event(1, 0, "FAILED"), event(2, 0.1, "FAILED"), event(3, 0.7), event(4, 0, worker="w2"), event(5, 90))
    alerts = st.run_to_table(st.failure_alerts(feed.stream()), path).collect()
    assert {r["worker_id"] for r in alerts} == {"w1"}
    # one window ends before the success at 0:42, nineteen hold all three; from 0:30 on only the success is left
    assert sorted(round(r["failure_ratio"], 4) for r in alerts) == [0.6667] * 19 + [1.0]


def test_sessions_and_stalls(feed, path, tmp_path):
    feed.add(event(1, 0), event(2, 3), event(3, 20), event(4, 90, worker="w2"))
    alerts = st.run_sessions(st.stall_alerts(feed.stream()), path).orderBy("last_seen").collect()
    at = lambda m: T0 + timedelta(minutes=m)
    assert [(r["worker_id"], r["last_seen"], r["alert_at"]) for r in alerts] == [("w1", at(3), at(8)), ("w1", at(20), at(25))]
    batch = st.worker_sessions(feed.spark.read.parquet(feed.directory), "5 minutes").where("worker_id = 'w1'")
    assert sorted((r["alive_from"], r["events"]) for r in batch.collect()) == [(at(0), 2), (at(20), 1)]


def test_silence_is_noticed_without_further_events(feed, path):
    feed.add(event(1, 0), event(2, 3), event(3, 1), event(4, 90, worker="w2"), event(5, 1, worker=None))
    seen = lambda: sorted((r["worker_id"] or "", r["last_seen"]) for r in st.read_silence_alerts(feed.spark, path).collect())
    at = lambda m: T0 + timedelta(minutes=m)
    running = st.start_silence_alerts(feed.stream(), path, gap_seconds=2, every="200 milliseconds")
    try:
        st.wait_for_silence(running, 120)
        assert seen() == [("", at(1)), ("w1", at(3)), ("w2", at(90))]
        feed.add(event(6, 7))  # heard of again: the timer is set once more, and goes off once more
        until(lambda: len(seen()) == 4, running)
        assert seen() == [("", at(1)), ("w1", at(3)), ("w1", at(7)), ("w2", at(90))]
        st.wait_for_silence(running, 120)
    finally:
        running.stop()
    assert len(seen()) == 4


def test_a_timer_is_set_anew_by_each_event_and_outlives_a_restart(feed, path):
    feed.add(event(1, 0))
    running = st.start_silence_alerts(feed.stream(), path, gap_seconds=6, every="200 milliseconds")
    until(lambda: any(p["numInputRows"] for p in running.recentProgress), running)
    running.stop()
    feed.add(event(2, 5), event(3, -5))
    running = st.start_silence_alerts(feed.stream(), path, gap_seconds=6, every="200 milliseconds")
    try:
        st.wait_for_silence(running, 120)
    finally:
        running.stop()
    rows = st.read_silence_alerts(feed.spark, path).collect()
    assert max(r["last_seen"] for r in rows) == T0 + timedelta(minutes=5)
    assert all(r["alert_at"] is not None for r in rows)
    with pytest.raises(ValueError):
        st.silence_alerts(feed.stream(), 0)


def test_task_trail_goes_on_across_batches(feed, path):
    feed.add(event(1, 0, "PENDING"), event(3, 2, "SUCCEEDED"), event(2, 1, "RUNNING"), event(9, 0, "FAILED", task="t2"))
    st.run_task_trail(feed.stream(), path)
    feed.add(event(4, 3, "RUNNING"), event(10, 5, "PENDING", task="t2"))
    got = {r["event_id"]: (r["from_status"], r["legal"]) for r in st.run_task_trail(feed.stream(), path).collect()}
    assert got == {1: (None, True), 2: ("PENDING", True), 3: ("RUNNING", True), 4: ("SUCCEEDED", False),
                   9: (None, True), 10: ("FAILED", True)}


def test_upserts_drop_repeated_batches(feed, path):
    feed.add(event(1, 0, task="a"), event(2, 1, task="b"))
    go = lambda: st.upsert_batches(
        feed.stream().withColumn("p", F.col("task_uuid")), path, key="task_uuid", checksum="batch_checksum",
        order_by="created_at", partition_col="p", event_time="created_at")
    go()
    feed.add(event(7, 2, task="a", checksum="c1"), event(3, 3, task="b"), event(4, 2.5, task="b"))
    go()
    rows = feed.spark.read.parquet(f"{path}/rows").collect()
    assert sorted((r["task_uuid"], r["event_id"]) for r in rows) == [("a", 1), ("b", 3)]


def test_embed_on_insert(feed, path):
    feed.add(event(1, 0), event(2, 1))
    rows = st.run_to_table(st.embed_on_insert(feed.stream(), F.col("task_uuid"), "v", em.hash_encoder(8)), path)
    assert rows.where(F.size("v") == 8).count() == 2


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with st.session_conf(spark, spark__sql__streaming__stateStore__providerClass=st.ROCKSDB):
        assert spark.conf.get(name) == st.ROCKSDB
    assert spark.conf.get(name) == before


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path, path):
    table = str(tmp_path / "events.parquet")
    spark.createDataFrame([event(i, i) for i in range(8)], SCHEMA).repartition(3).write.parquet(table)
    stream = st.stream_table(spark, table, spark.createDataFrame([], SCHEMA).schema)
    assert st.run_to_table(stream, path).count() == 8
