import hashlib
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.operators import embedding as em
from tessera.plans.tasks import run_task
from tessera.sources import tables as tb


def recipe(text: str, dim: int) -> list[float]:
    raw = b"".join(hashlib.sha256(text.encode() + struct.pack(">I", n)).digest() for n in range(-(-dim // 8)))
    half = (2 ** 32 - 1) / 2
    return [(w - half) / half for w in struct.unpack(f">{dim}I", raw[:4 * dim])]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.sampled_from([4, 8, 12, 32, 384]))
def test_hash_vectors_follow_the_recipe(text, dim):
    got = hs.hash_vectors([text], dim)[0]
    assert got.tolist() == [struct.unpack("f", struct.pack("f", x))[0] for x in recipe(text, dim)]
    assert abs(got).max() <= 1


@pytest.mark.parametrize("dim", [0, -4, 385])
def test_bad_dimensions(dim):
    with pytest.raises(ValueError, match="dim"):
        hs.hash_vectors(["a"], dim)


def test_no_texts_and_wrong_texts():
    assert hs.hash_vectors([], 8).shape == (0, 8)
    with pytest.raises(TypeError, match="str"):
        hs.hash_vectors([3], 8)


def test_arrow_and_built_in_forms_agree(spark):
    texts = [("hello world",), ("alpha",), ("beta",), ("",), ("žluťoučký 🐎",), (None,)]
    df = spark.createDataFrame(texts, "text string")
    for row in df.select(hs.hash_embedding("text", 24).alias("a"), hs.hash_embedding_expr(F.col("text"), 24).alias("b")).collect():
        assert row["a"] is None or row["a"] == row["b"]
    assert df.select(F.size(hs.hash_embedding(F.lit("x"))).alias("n")).first()["n"] == 384


def test_concat_skips_nulls_and_keeps_empty_strings(spark):
    rows = [("hello", "body text"), ("world", None), (None, "only body"), (None, None), ("", "x")]
    df = spark.createDataFrame(rows, "title string, body string")
    got = [r[0] for r in df.select(em.concat_sources(df, ["title", "body"])).collect()]
    assert got == ["hello body text", "world", "only body", "", " x"]
    assert df.select(em.concat_sources(df, ["title", "body"], " | ")).first()[0] == "hello | body text"


def test_source_columns_must_be_strings(spark):
    df = spark.range(1).withColumn("t", F.lit("x"))
    with pytest.raises(ValueError, match="id.*bigint"):
        em.concat_sources(df, ["t", "id"])
    with pytest.raises(ValueError, match="nope"):
        em.concat_sources(df, ["nope"])


def test_incremental_fills_open_rows_only(spark):
    df = spark.createDataFrame([(1, "a", [9.0] * 8), (2, "b", None)], "id long, t string, v array<float>")
    got = {r["id"]: r["v"] for r in em.embed_incremental(df, ["t"], "v", em.hash_encoder(8)).collect()}
    assert got[1] == [9.0] * 8 and got[2] == hs.hash_vectors(["b"], 8)[0].tolist()
    assert em.null_target(df, "v").count() == 1 and em.null_target(df, "absent").count() == 2


def test_vectorize_task_rewrites_open_partitions_only(spark, path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id long, t string, p int").withColumn(
        "v", F.when(F.col("p") == 0, hs.hash_embedding("t", 8)))
    tb.write_overwrite(df, path, partition_by=("p",))
    kept = spark.read.parquet(path).where("p = 0").select("_metadata.file_path").first()[0]
    params = {"path": path, "partition_col": "p", "source_columns": ["t"], "target_column": "v", "dim": 8}
    assert run_task(spark, "VECTORIZE", params) == {"task_type": "VECTORIZE", "rows_processed": 1, "status": "completed"}
    assert run_task(spark, "VECTORIZE", params)["status"] == "no_new_rows"
    after = spark.read.parquet(path)
    assert after.where("v IS NULL").count() == 0
    assert after.where("p = 0").select("_metadata.file_path").first()[0] == kept


def test_write_back_keeps_old_values(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None), (3, None)], "id long, v array<float>")
    new = spark.createDataFrame([(2, [2.0])], "id long, v array<float>")
    assert sorted((r["id"], r["v"]) for r in em.write_back(df, new, "id", "v").collect()) == [
        (1, [1.0]), (2, [2.0]), (3, None)]


def test_model_vectors_must_have_one_length(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    ok = em.with_model(df, F.col("t"), "v", "sizes", lambda: lambda ts: [[float(len(t)), 0.0] for t in ts])
    assert sorted(r["v"] for r in ok.collect()) == [[1.0, 0.0], [2.0, 0.0]]
    bad = em.with_model(df, F.col("t"), "v", "ragged", lambda: lambda ts: [[0.0] * (2 if t == "bb" else 5) for t in ts])
    with pytest.raises(Exception, match="length 5"):
        bad.collect()


def test_a_failed_endpoint_batch_leaves_its_rows_open(spark):
    def post(payload, headers):
        assert headers["Authorization"] == "Bearer k" and payload["model"] == "m"
        if "bad" in payload["input"]:
            raise RuntimeError("boom")
        return {"data": [{"embedding": [float(len(t))]} for t in payload["input"]]}

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",), ("dd",)], "t string").coalesce(1)
    got = em.with_endpoint(df, F.col("t"), "r", post, "m", batch_size=2, headers=em.auth_headers("k"))
    rows = {r["t"]: r["r"] for r in got.collect()}
    assert rows["ccc"]["vector"] == [3.0] and rows["dd"]["error"] is None
    assert rows["a"]["vector"] is None and "boom" in rows["bad"]["error"]
    counts = em.embed_summary(got, "r", F.lit(0)).first()
    assert (counts["succeeded"], counts["failed"], counts["total_unvectorized"]) == (2, 2, 4)


def test_headers():
    assert em.auth_headers() == {"Content-Type": "application/json"}
    assert em.auth_headers("k", "authorization")["Authorization"] == "Bearer k"
    assert em.auth_headers("k", "Api-Key")["Api-Key"] == "k"


def test_items_of_other_kinds_become_errors(spark):
    items = spark.createDataFrame([
        ("a", ("TEXT", "hi", None, None)), ("b", ("IMAGE", None, bytearray(b"x"), None)),
        ("c", ("AUDIO", None, None, "s3://x")), ("d", ("TEXT", None, None, None)), ("e", ("IMAGE", None, None, None)),
    ], "id string, payload struct<modality string, text string, binary binary, uri string>")
    got = {r["id"]: (r["values"] is not None, r["error_code"]) for r in em.embed_items(items, 8).collect()}
    assert got == {"a": (True, None), "b": (False, "UNSUPPORTED_MODALITY"), "c": (False, "UNSUPPORTED_MODALITY"),
                   "d": (False, "EMPTY_PAYLOAD"), "e": (False, "EMPTY_PAYLOAD")}


def test_auto_index(spark):
    rules = spark.createDataFrame([
        ("d1", "v", None), ("d2", "v", '{"index_config":{"auto_build":false}}'),
        ("d3", "v", '{"index_config":{"auto_build":true}}'),
        ("d4", "v", '{"index_config":{"auto_build":true,"index_name":"mine","index_type":"IVF_FLAT"}}'),
        ("d5", "v", '{"index_config":{"auto_build":true}}'), ("d6", "v", "not json"),
    ], "dataset_uuid string, target_column string, extra string")
    taken = spark.createDataFrame([("d5", "idx_v")], "dataset_uuid string, index_name string")
    got = sorted(tuple(r) for r in em.auto_index_requests(rules, taken).collect())
    assert got == [("d3", "idx_v", "v", "IVF_PQ", "BUILDING"), ("d4", "mine", "v", "IVF_FLAT", "BUILDING")]


def test_rules(spark):
    rules = spark.createDataFrame([
        (1, "d", "v", ["a"], "SCHEDULED", None), (2, "d", "w", ["a", " "], "MANUAL", None),
        (3, "d", "v", ["a"], "SCHEDULED", "0 * * * *"), (4, "e", "v", [], "ON_INSERT", None), (5, "f", "v", ["a"], "MANUAL", None),
    ], "rule_id long, dataset_uuid string, target_column string, source_columns array<string>, trigger_type string, cron_expr string")
    got = sorted(tuple(r) for r in em.rule_violations(rules).collect())
    assert got == [(1, "cron_missing"), (1, "duplicate_target"), (2, "blank_source"), (3, "duplicate_target"), (4, "blank_source")]
