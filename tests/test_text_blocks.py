"""Text searches that skip postings: the same rows and scores as the full sum."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import text_index as tx, upkeep as up
from tessera.operators.text_index import Cell, TextIndex, skippable
from tessera.sources import tables as tb

SEARCHES = [["the"], ["the", "of"], ["the", "rare3"], ["the", "of", "rare1", "mid2"], ["mid1", "mid2", "mid0"], ["rare0", "nowhere"]]


def corpus(spark, ids, seed=5):
    dice = random.Random(seed)
    rows = []
    for i in ids:
        words = ["the"] * dice.randint(0, 6) + ["of"] * dice.choice([0, 1, 1, 2, 9])
        words += [f"mid{dice.randint(0, 4)}" for _ in range(dice.randint(0, 4))]
        words += [f"rare{dice.randint(0, 5)}"] * (dice.random() < 0.02) * dice.randint(1, 3)
        words += [f"w{dice.randint(0, 400)}" for _ in range(dice.choice([1, 5, 20, 80, 300]))]
        rows.append((i, " ".join(words) if i % 50 else None))
    rows.append((-1, ""))
    return spark.createDataFrame(rows, "id long, body string")


def result(frame):
    return [(r["id"], round(r["score"], 9)) for r in frame.collect()]


def full_sum(rows, terms, k):
    """BM25 in plain Python over (id, text)."""
    import math
    import re
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in terms:
        having = {i: w.count(term) for i, w in docs.items() if term in w}
        idf = math.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
        for i, tf in having.items():
            scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg))
    best = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
    return [(i, -s) for s, i in best]


def close(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-7 for (_, a), (_, b) in zip(got, want))


@pytest.mark.parametrize("k", [1, 7])
def test_skipping_changes_nothing(spark, path, tmp_path, k, monkeypatch):
    tb.write_append(corpus(spark, range(1, 3000)).repartition(2), path, version=1)
    index = TextIndex.build(spark.read.parquet(path), str(tmp_path / "i"), key="id", column="body", buckets=4)
    tb.write_append(corpus(spark, range(3000, 3300), 6).where("id > 0"), path, version=2)
    up.delete_from_table(spark, path, tb.VERSION, "id % 9 = 0 AND ingest_version = 1")
    tb.write_append(corpus(spark, range(4000, 4100), 7).where("id > 0"), path, version=3)
    table = spark.read.parquet(path)
    index.optimize(table)
    tb.write_append(corpus(spark, range(5000, 5050), 8).where("id > 0"), path, version=4)
    table = spark.read.parquet(path)
    rows = [(r["id"], r["body"]) for r in table.collect()]
    skips = []
    plain = TextIndex._skipped
    monkeypatch.setattr(TextIndex, "_skipped", lambda self, *a: skips.append(plain(self, *a)) or skips[-1])
    for terms in SEARCHES:
        close(result(index.search(terms, k=k, table=table, seed_rows=20)), full_sum(rows, terms, k))
    assert sum(bool(cells) for cells, _ in skips) >= 4
    index.optimize(table)
    index.merge(table)
    close(result(index.search(["the", "rare3"], k=k, seed_rows=20)), full_sum(rows, ["the", "rare3"], k))
    blocks = index._table("blocks", index.meta()).agg(F.sum("n"), F.sum("sum_tf")).first()
    assert tuple(blocks) == tuple(index.postings().agg(F.count(F.lit(1)), F.sum("tf")).first())


def test_equal_scores_are_kept(spark, tmp_path):
    """All rows weigh the same, so no cell may go."""
    rows = spark.createDataFrame([(i, "red blue" if i % 2 else "blue red") for i in range(60)], "id long, body string")
    index = TextIndex.build(rows, str(tmp_path / "i"), key="id", column="body", buckets=2)
    assert [i for i, _ in result(index.search(["red", "blue"], k=5, seed_rows=1))] == [0, 1, 2, 3, 4]


def test_what_may_be_skipped():
    cells = [Cell("a", 1, 100, 1.0), Cell("a", 2, 5, 3.0), Cell("b", 1, 50, 0.5), Cell("b", 2, 9, 0.9), Cell("c", 1, 1, 9.0)]
    assert skippable(cells, 0.0) == set() and skippable(cells, 0.4) == set()
    for least in (0.6, 1.0, 1.5, 1.95, 4.0, 9.0, 14.0):
        out = skippable(cells, least)
        most = {t: max((c.bound for c in out if c.token == t), default=0) for t in "abc"}
        assert sum(most.values()) < least
    assert {c.token for c in skippable(cells, 1.95)} == {"a", "b"} and skippable(cells, 14.0) == set(cells)


def test_a_single_term_reads_only_cells_that_matter(spark, tmp_path):
    index = TextIndex.build(corpus(spark, range(1, 2000)), str(tmp_path / "i"), key="id", column="body", buckets=1)
    frame = index.search(["the"], k=3, seed_rows=5)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell," in plan or "EqualTo(cell," in plan
    assert frame.count() == 3 and tx.SEED_ROWS > 0


def test_text_is_tokenised_in_pieces_of_bounded_size():
    texts = ["ab c"] * 5 + [None, ""] + ["x y " * 8] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "id"])
    pieces = list(tx.text_pieces(batch, 40))
    assert [r for p in pieces for r in p.to_pylist()] == batch.to_pylist()
    assert all(sum(len(t or "") for t in p.column(0).to_pylist()[:-1]) < 40 for p in pieces) and len(pieces) > 2
    schema = pa.schema([("token", pa.string()), ("tf", pa.int64()), ("dl", pa.int64()), ("id", pa.int64())])
    whole = tx.token_counts(batch.filter(pa.array([t is not None for t in texts])), schema).to_pylist()
    parts = [r for p in pieces for r in tx.token_counts(p.filter(p.column(0).is_valid()), schema).to_pylist()]
    order = lambda rows: sorted(rows, key=lambda r: (r["id"], r["token"]))
    assert order(parts) == order(whole)
