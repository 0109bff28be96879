"""All links of the similarity join, against brute force and against SQL."""

import random
from collections import Counter

import pytest

from tessera.llm import jaccard
from tests.compare import connect
from tests.conftest import SMALL

SHAPE = "doc_id long, text string, a string, node int"


def brute(rows):
    """Rows (id, text) to sets of word sequences, and links between different sequences."""
    words = [tuple((t or "").lower().split()) for _, t in rows]

    def grams(w):
        return {w[i:i + 5] for i in range(max(1, len(w) - 4))} if w else set()

    kinds = sorted({w for w in words if w})
    sets = {w: grams(w) for w in kinds}
    found = {(v, w) for i, v in enumerate(kinds) for w in kinds[i + 1:]
             if 100 * len(sets[v] & sets[w]) >= 75 * len(sets[v] | sets[w])}
    return words, sets, found


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SHAPE)
    documents, pairs = jaccard.linked(docs)
    words, sets, found = brute(rows)
    copies, low = Counter(w for w in words if w), {}
    for (i, _), w in zip(rows, words):
        low[w] = min(low.get(w, (True, float("inf"))), (i is not None, i or 0))
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        w = words[i]
        n = copies[w] - 1 + sum(copies[y if x == w else x] for x, y in found if w in (x, y)) if w else 0
        want[doc, len(sets.get(w, ())), n, None if not w or not low[w][0] else low[w][1]] += 1
    got = documents.collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.class_id) for r in got) == want
    links = pairs.collect()
    assert len(links) == len(found) == len({(r.class_a, r.class_b) for r in links}) and all(r.class_a < r.class_b for r in links)
    assert sorted(sorted((r.copies_a, r.copies_b)) for r in links) == sorted(sorted((copies[v], copies[w])) for v, w in found)
    near = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert Counter((r.doc_id, r.component_id) for r in got) == near
    return links


def family(rnd, base, n):
    """Near copies of ``base`` with one to a few words changed, so that only some pairs are similar."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def test_all_links_of_random_near_copies(spark):
    rnd = random.Random(5)
    texts = []
    for f in range(6):
        texts += family(rnd, [f"f{f}w{i}" for i in range(rnd.randint(40, 90))], 40 if f else 200)
    texts += ["One  two", "one two", "", None, " \n", "a b c d e", "A b c d e", "lonely words of no other text here"]
    rnd.shuffle(texts)
    links = check(spark, list(enumerate(texts)))
    assert len(links) > len(texts)  # a tree over the families has fewer


def test_ids_that_repeat_or_are_null(spark):
    rnd = random.Random(6)
    near = family(rnd, [f"w{i}" for i in range(60)], 12)
    other = family(rnd, [f"v{i}" for i in range(60)], 6)
    rows = [(i % 5, t) for i, t in enumerate(near)] + [(i, t) for i, t in enumerate(other, 3)] + [(None, t) for t in near[:3]]
    check(spark, [*rows, *rows[:4], (None, None), (None, "")])


def test_frequent_shingles_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 20)
    rnd = random.Random(7)
    check(spark, list(enumerate(family(rnd, [f"w{i}" for i in range(50)], 150))))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x"), (2, "x"), (2, "x")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_links_of_the_given_documents(spark):
    documents, pairs = jaccard.linked(spark.read.parquet(f"{SMALL}/documents.parquet"))
    with connect(SMALL) as con:
        rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    words, _, found = brute(rows)
    copies = Counter(w for w in words if w)
    assert pairs.count() == len(found)
    want = sum(n * (n - 1) for n in copies.values()) + 2 * sum(copies[v] * copies[w] for v, w in found)
    assert sum(r.n_links for r in documents.collect()) == want > 0
