from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import ts
from tessera.operators import metrics as mt, scalar_index as si, text_index as tx
from tessera.operators.windows import hot_keys, with_previous

START = datetime(2024, 1, 1)


def hot_events(spark, n=3000):
    """One task holds a third of all events; stamps repeat and cross hours and days."""
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 3 * 86400, n))
    at[::5] = at[::5] // 3600 * 3600
    frame = pd.DataFrame({
        "event_id": np.arange(n), "task_uuid": [f"t{0 if i % 3 == 0 else i % 40}" for i in range(n)],
        "created_at": [START + timedelta(seconds=int(s)) for s in at],
        "to_status": rng.choice(["PENDING", "RUNNING", "FAILED"], n), "worker_id": "w",
    })
    df = spark.createDataFrame(frame).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return df.repartition(6), frame


@pytest.mark.parametrize("hot_rows", [10, 500, 1 << 20])
def test_state_durations_of_a_hot_task_match_a_plain_lag(spark, hot_rows):
    df, frame = hot_events(spark)
    if hot_rows == 500:
        assert [r[0] for r in hot_keys(df, ["task_uuid"], hot_rows).collect()] == ["t0"]
    want = frame.sort_values(["task_uuid", "created_at", "event_id"])
    by_task = want.groupby("task_uuid")
    want["seconds"] = by_task["created_at"].diff().dt.total_seconds()
    want["from_status"] = by_task["to_status"].shift()
    want = want.dropna(subset=["seconds"]).set_index("event_id")
    got = mt.state_durations(df, hot_rows).toPandas().set_index("event_id")
    assert len(got) == len(want)
    assert (got["seconds"].sort_index() == want["seconds"].sort_index()).all()
    assert (got["from_status"].sort_index() == want["from_status"].sort_index()).all()


def test_latest_event(spark):
    df, frame = hot_events(spark)
    want = frame.sort_values(["created_at", "event_id"]).groupby("task_uuid")["event_id"].last().to_dict()
    assert {r["task_uuid"]: r["event_id"] for r in mt.latest_event(df).collect()} == want


def test_stalls_look_across_hours(spark):
    rows = [(1, "a", START), (2, "a", START + timedelta(minutes=4)), (3, "a", START + timedelta(hours=2)), (4, "b", START)]
    df = spark.createDataFrame(rows, "event_id long, worker_id string, created_at timestamp_ntz")
    for hot_rows in (1, 1 << 20):
        got = mt.stalls(df, "worker_id", hot_rows=hot_rows).collect()
        assert [(r["worker_id"], r["gap_seconds"]) for r in got] == [("a", 6960.0)]


def test_rows_without_a_key_can_be_hot_too(spark):
    rows = [(i, None if i % 3 else "a", START + timedelta(minutes=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, worker_id string, created_at timestamp_ntz")
    got = with_previous(df, ["worker_id"], ["created_at"], F.date_trunc("hour", "created_at"), ["event_id"], at_least=5)
    found = {r["event_id"]: r["previous"]["event_id"] if r["previous"] else None for r in got.collect()}
    assert found == {i: i - 3 if i % 3 == 0 and i else None if i in (0, 1) else i - (1 if i % 3 == 2 else 2) for i in range(3000)}


def test_histogram_and_quantile(spark):
    values = [0.01, 0.05, 0.2, 0.2, 3.0, 700.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "g string, v double")
    hist = mt.histogram(df, "g", "v")
    counts = {r["le"]: r["bucket_count"] for r in hist.where("g = 'g'").collect()}
    assert len(counts) == 14 and counts[0.05] == 2 and counts[0.25] == 4 and counts[600.0] == 5 and counts[float("inf")] == 6
    quantile = lambda q: {r["g"]: r["quantile"] for r in mt.histogram_quantile(hist, "g", q).collect()}
    assert quantile(0.5)["g"] == pytest.approx(0.1 + 0.15 * 0.5)
    assert quantile(0.99)["g"] == 600.0       # beyond the last finite bound
    assert quantile(0.5)["h"] == pytest.approx(0.75)


def test_quantile_lies_in_the_bucket_of_the_exact_percentile(spark):
    df = spark.range(10000).select(F.lit("g").alias("g"), (F.rand(5) * 100).alias("v"))
    estimate = mt.histogram_quantile(mt.histogram(df, "g", "v"), "g", 0.95).first()["quantile"]
    exact = df.select(F.percentile("v", F.lit(0.95))).first()[0]
    assert 60.0 < exact <= 120.0 and 60.0 < estimate <= 120.0


def test_ratio_and_unknown_type(spark):
    tasks = spark.createDataFrame([("a", "SUCCEEDED"), ("a", "FAILED"), ("a", "RUNNING"), (None, "FAILED")], "task_type string, status string")
    assert {r[0]: r[1] for r in mt.success_ratio(tasks, "task_type").collect()} == {"a": 0.5, None: 0.0}
    assert ("UNKNOWN", "FAILED", 1) in [tuple(r) for r in mt.task_status_counts(tasks).collect()]
    assert [r[0] for r in mt.failure_ratio(tasks, "task_type", above=0.5).collect()] == [None]


def test_claim_order_is_priority_then_age(spark):
    rows = [("x", "t1", 5, START), ("x", "t2", 1, START + timedelta(1)), ("x", "t3", 1, START), ("y", "t4", 9, START)]
    df = spark.createDataFrame(rows, "task_type string, task_uuid string, priority int, created_at timestamp_ntz")
    got = mt.claim_order(df, 2).orderBy("task_type", "claim_rank")
    assert [r["task_uuid"] for r in got.collect()] == ["t3", "t2", "t4"]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_workers(spark):
    workers = spark.createDataFrame([("a", 1, "ALIVE", START), ("b", 4, "DEAD", START), ("c", 2, "DRAINING", START + timedelta(seconds=31))],
                                    "worker_id string, capacity int, status string, last_heartbeat_at timestamp_ntz")
    tasks = spark.createDataFrame([("t1", "a", "RUNNING"), ("t2", "a", "RUNNING"), ("t3", "b", "RUNNING"), ("t4", "c", "PENDING")],
                                  "task_uuid string, worker_id string, status string")
    load = {r["worker_id"]: (r["in_flight"], r["free_slots"]) for r in mt.worker_load(workers, tasks).collect()}
    assert load == {"a": (2, 0), "b": (1, 3), "c": (0, 2)}
    now = ts((START + timedelta(seconds=31)).isoformat(sep=" "))
    assert sorted(r["task_uuid"] for r in mt.stale_leases(workers, tasks, now).collect()) == ["t1", "t2"]


# --- text and scalar indexes -----------------------------------------------------------

def test_bm25_matches_a_plain_count(spark, path):
    texts = ["the cat and the dog", "The dog!", "", "cat cat cat", "nothing here", None, "Dog-cat 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    index = tx.TextIndex.build(df, path, key="id", column="body", buckets=4)
    got = [(r["id"], round(r["score"], 9)) for r in index.search(["Cat", "dog"], "id").collect()]
    docs = {i: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()] for i, t in enumerate(texts)}
    average = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in ("cat", "dog"):
        df_of = sum(term in d for d in docs.values())
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                idf = np.log(1 + (len(docs) - df_of + 0.5) / (df_of + 0.5))
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
    assert got == [(i, round(s, 9)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]
    plan = index.search(["cat"], "id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    with pytest.raises(ValueError, match="terms"):
        index.search([], "id")


def test_sorted_index_opens_overlapping_files_only(spark, path):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("v"))
    index = si.SortedIndex.build(df, path, column="v", key="id", files=6)
    files = index.files().collect()
    assert sum(r["n"] for r in files) == 3000 and max(r["n"] for r in files) < 1500  # the hot value is cut
    got = index.lookup(90, 95)
    assert got.count() == df.where("v BETWEEN 90 AND 95").count()
    assert len(got.inputFiles()) < len(files)
    assert index.lookup(500, 600).count() == 0


@pytest.mark.parametrize("first", [0, 1, 32768, 100_000])
def test_bitmaps_give_the_ids_back(spark, first):
    df = spark.range(first, first + 70_000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("v"))
    bitmaps = si.build_bitmaps(df, "v", "id")
    got = sorted(r[0] for r in si.bitmap_rows(si.bitmap_any(bitmaps, "v", ["x"])).collect())
    assert got == [i for i in range(first, first + 70_000) if i % 3 == 0]
    assert {r["v"]: r["row_count"] for r in si.bitmap_counts(bitmaps, "v").collect()} == {
        r["v"]: r["n"] for r in df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
