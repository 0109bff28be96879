"""Arrow batches end at a number of bytes, and a text crosses to the worker once."""

import pyarrow as pa
import pytest

from tessera.llm import decontaminate, token_files
from tessera.llm.common import BATCH_BYTES, LEFT_OVER, bound_batches, release_memory

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
PASSAGE = " ".join(f"w{i}" for i in range(13))


@pytest.fixture
def fresh(spark):
    """The session without a bound of its own."""
    before = spark.conf.getAll.get(NAME)
    spark.conf.unset(NAME)
    yield spark
    spark.conf.unset(NAME) if before is None else spark.conf.set(NAME, before)


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "n": [batch.num_rows]})


def test_stages_bound_the_bytes_of_a_batch(fresh):
    docs = fresh.range(400).selectExpr("id AS doc_id", "repeat('abcdefgh ', 10000) AS text", "'en' AS lang").coalesce(1)
    benchmark = fresh.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    decontaminate.contamination(docs, benchmark)
    got = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 400 and max(r.bytes for r in got) < BATCH_BYTES + (1 << 20)  # 36 MB in one batch before


def test_a_bound_of_the_session_stays(fresh):
    fresh.conf.set(NAME, "1000000")
    bound_batches(fresh)
    assert fresh.conf.get(NAME) == "1000000"


@pytest.mark.parametrize("text_col", ["text", "TEXT", "items"])
def test_text_is_sent_once(fresh, text_col):
    rows = [(1, "en", PASSAGE), (2, None, None), (3, "de", ""), (3, "de", "x " + PASSAGE)]
    docs = fresh.createDataFrame(rows, f"doc_id long, lang string, {'text' if text_col == 'TEXT' else text_col} string")
    benchmark = fresh.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    found = decontaminate.contamination(docs, benchmark, text_col=text_col)
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in found.collect())
    assert got == [(1, 13, 13, ["a"]), (2, 0, 0, []), (3, 0, 0, []), (3, 14, 13, ["a"])]
    assert found.columns == [c for c in docs.columns if c != "items"] + ["n_words", "n_hit", "items"]
    if text_col == "text":
        assert "_text" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.text or "" for r in found.collect()) == sorted(r[2] or "" for r in rows)


def test_steps_drop_what_others_left_over(monkeypatch):
    dropped = []
    assert {decontaminate.__name__, token_files.__name__} <= set(LEFT_OVER)
    for name in LEFT_OVER:
        monkeypatch.setitem(LEFT_OVER, name, lambda name=name: dropped.append(name))
    release_memory(decontaminate.__name__)
    assert token_files.__name__ in dropped and decontaminate.__name__ not in dropped
