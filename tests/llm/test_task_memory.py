"""What a task holds at once doesn't follow the rows of a batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, jaccard
from tessera.llm.common import parts_of, release_memory

FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def peak_of(batches):
    tracemalloc.start()
    try:
        for _ in batches:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_decontamination_holds_the_words_of_one_document(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(2000)) for _ in range(400)]
    window = tuple(w.encode() for w in texts[7].split()[100:113])
    monkeypatch.setitem(decontaminate._TABLES, ("memory-test", 0), [decontaminate.WuManber({window: ["a"]}, 13)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in decontaminate._search(iter([batch]), "memory-test", [0], FOUND) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(400)) and {r["n_words"] for r in got} == {2000}
    assert [(r["doc_id"], r["n_hit"], r["items"]) for r in got if r["n_hit"]] == [(7, 13, ["a"])]
    assert peak_of(decontaminate._search(iter([batch]), "memory-test", [0], FOUND)) < 3 << 20  # 32 MB with the words of all


def test_every_table_meets_every_document(monkeypatch):
    texts = ["one two three", None, "", "two three four one two", "x"]
    tables = {0: [decontaminate.WuManber({(b"one", b"two"): ["a"]}, 2), decontaminate.WuManber({(b"x",): ["c"]}, 1)],
              1: [decontaminate.WuManber({(b"two", b"three"): ["b"], (b"three", b"four"): ["a"]}, 2)]}
    monkeypatch.setattr(decontaminate, "_tables", lambda folder, block: tables[block])
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for blocks, want in (([0, 1], [(3, 3, ["a", "b"]), (0, 0, []), (0, 0, []), (5, 5, ["a", "b"]), (1, 1, ["c"])]),
                         ([], [(3, 0, []), (0, 0, []), (0, 0, []), (5, 0, []), (1, 0, [])])):
        got = [tuple(r.values()) for b in decontaminate._search(iter([batch, batch]), "", blocks, FOUND) for r in b.to_pylist()]
        assert got == want * 2


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_parts_are_all_rows_in_order(size):
    rng = random.Random(size)
    texts = [None if rng.random() < 0.2 else "é" * rng.randrange(9) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), pa.array(texts[::-1])], ["n", "a", "b"])
    parts = list(parts_of(batch, size))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for r in p.to_pylist()[1:] for t in (r["a"], r["b"])) <= size for p in parts)
    assert list(parts_of(batch.slice(0, 0), size)) == [] or sum(p.num_rows for p in parts_of(batch.slice(0, 0), size)) == 0
    release_memory()


def test_verification_holds_a_part_of_a_batch():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 9, 4000))) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts), pa.array(range(1, 1001)), pa.array(texts)], list("axby"))
    pairs = [(r["a"], r["b"]) for b in jaccard._verify(iter([batch])) for r in b.to_pylist()]
    assert pairs == [(i, i + 1) for i in range(1000)]
    assert peak_of(jaccard._verify(iter([batch]))) < 40 << 20  # 48 MB and more with all rows
