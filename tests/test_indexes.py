"""Indexes of every type through appends, deletes, optimize and merge."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import bitmap_index as bm, index_catalog as ic, text_index as tx, upkeep as up
from tessera.plans.tasks import run_task
from tessera.sources import tables as tb

WORDS = ["red", "green", "blue", "red red", "blue green", "", None, "red blue blue"]


def rows_of(spark, ids):
    return spark.createDataFrame([(i, WORDS[i % 8], "abc"[i % 3] if i % 7 else None, i % 2) for i in ids],
                                 "id long, body string, kind string, half int")


def scores(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def rebuilt(table, folder):
    """Scores of a fresh index over the live table."""
    return scores(tx.TextIndex.build(table, folder, key="id", column="body").search(["red", "green"], k=200))


def test_a_text_index_follows_its_table(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(80)).repartition(3), path, version=1)
    root = str(tmp_path / "idx")
    run_task(spark, "INDEX_BUILD", {"path": path, "index_path": f"{root}/text", "key": "id", "column_name": "body",
                                    "index_name": "t", "index_type": "FTS", "params": {"buckets": 4}})
    index = ic.open_index(spark, f"{root}/text")
    tb.write_append(rows_of(spark, range(80, 120)), path, version=2)
    up.delete_from_table(spark, path, tb.VERSION, "id % 5 = 0 AND ingest_version = 1")
    tb.write_append(rows_of(spark, range(200, 201)).where("false"), path, version=3)
    table = spark.read.parquet(path)
    want = rebuilt(table, str(tmp_path / "fresh"))
    assert len(want) > 50 and scores(index.search(["red", "green"], k=200, table=table)) == want
    report = run_task(spark, "INDEX_OPTIMIZE", {"path": path, "index_root": root})["indexes"]
    assert [(r["index_name"], r["rows"]) for r in report] == [("t", table.count())]
    assert scores(index.search(["red", "green"], k=200, table=table)) == want
    assert index.optimize(table) == 0 and index.meta().delta_count == 1
    assert run_task(spark, "INDEX_MERGE", {"path": path, "index_root": root})["indexes"][0]["rows"] == 1
    assert scores(index.search(["red", "green"], k=200)) == want  # dead rows are gone from the segments themselves
    assert run_task(spark, "INDEX_CLEANUP", {"index_path": f"{root}/text"})["generations_dropped"] == 1
    assert scores(index.search(["red", "green"], k=200, table=table)) == want
    assert index.search(["absent"], k=5, table=table).count() == 0


def test_an_empty_table_has_an_index(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(5)).where("false"), path, version=1)
    tb.write_append(rows_of(spark, range(2)).where("id < 0"), path, version=2)
    empty = rows_of(spark, range(1)).where("false")
    index = tx.TextIndex.build(empty, str(tmp_path / "i"), key="id", column="body")
    assert index.search(["red"]).count() == 0 and index.meta().covered_version == 0


def test_types_are_told_apart(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(10)), path, version=1)
    table = spark.read.parquet(path)
    with pytest.raises(ValueError, match="BTREE is not built"):
        ic.build_index(table, str(tmp_path / "b"), index_type="BTREE", key="id", column="kind", index_name="x")
    with pytest.raises(ValueError, match="unknown index type"):
        ic.build_index(table, str(tmp_path / "b"), index_type="ROPE", key="id", column="kind", index_name="x")
    with pytest.raises(ValueError, match="read from files"):
        bm.BitmapIndex.build(rows_of(spark, range(3)), str(tmp_path / "b"), column="kind")
    for kind, column in (("FTS", "body"), ("BITMAP", "kind")):
        built = ic.build_index(table, str(tmp_path / kind), index_type=kind, key="id", column=column, index_name=kind)
        assert type(ic.open_index(spark, str(tmp_path / kind))) is type(built) and built.meta().index_type == kind
    assert {type(i).__name__ for i in ic.indexes_below(spark, str(tmp_path))} == {"TextIndex", "BitmapIndex"}


def test_bitmaps_meet_over_several_columns(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(70_000)).repartitionByRange(2, "id"), path, version=1)
    table = spark.read.parquet(path)
    kind, half = (bm.BitmapIndex.build(table, str(tmp_path / c), column=c) for c in ("kind", "half"))
    tb.write_append(rows_of(spark, range(70_000, 70_500)), path, version=2)
    up.delete_from_table(spark, path, tb.VERSION, "id >= 70400")

    def ids(*clauses):
        return sorted(r[0] for r in bm.lookup(spark.read.parquet(path), *clauses).select("id").collect())

    def want(where):
        return sorted(r[0] for r in spark.read.parquet(path).where(where).select("id").collect())

    for _ in range(3):  # not yet covered, covered by deltas, merged
        assert ids([bm.OneOf(kind, ["a"])], [bm.OneOf(half, [1])]) == want("kind = 'a' AND half = 1")
        assert ids([bm.OneOf(kind, ["a", "b"]), bm.OneOf(half, [0])]) == want("kind IN ('a', 'b') OR half = 0")
        assert ids([bm.OneOf(kind, ["a"], negate=True)]) == want("kind <> 'a'")
        assert ids([bm.OneOf(kind, ["none"])]) == []
        if half.meta().delta_count:
            for index in (kind, half):
                index.merge(spark.read.parquet(path))
        kind.optimize(spark.read.parquet(path))
        half.optimize(spark.read.parquet(path))
    counts = {r["value"]: r["row_count"] for r in kind.counts(spark.read.parquet(path)).collect()}
    assert counts == {r["kind"]: r["count"] for r in spark.read.parquet(path).groupBy("kind").count().collect()}


def test_only_files_with_hits_are_opened(spark, path, tmp_path):
    tb.write_append(spark.range(4000).select("id", (F.col("id") >= 100).alias("rest")).repartitionByRange(4, "id"), path, version=1)
    table = spark.read.parquet(path)
    index = bm.BitmapIndex.build(table, str(tmp_path / "i"), column="rest")
    first = table.where("id = 5").select("_metadata.file_path").first()[0]
    for uri in table.inputFiles():
        if os.path.basename(uri) != os.path.basename(first):
            with open(uri.removeprefix("file://"), "wb") as broken:
                broken.write(b"not a table")
    found = bm.lookup(table, [bm.OneOf(index, [False])])
    assert sorted(r["id"] for r in found.select("id").collect()) == list(range(100))
    with pytest.raises(Exception):
        table.agg(F.sum("id")).collect()
