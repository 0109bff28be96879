"""The trie against brute force: borrowed starts, copies over many shards, odd rows."""

import hashlib
import random
import re
import zlib

from tessera.llm import prefix_trie as trie

SHAPE = "conv_id long, turn long, role string, text string, key string, parent int, turns int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2) for r in rows], SHAPE)


def brute(seqs):
    """Rows of the trie of {id: [(role, text), ...]}."""
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(own) if len(seqs[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves),
                 sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(df):
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def sequences(rows):
    seqs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        seqs.setdefault(c, []).append((role or "", text or ""))
    return seqs


def test_small_shards_give_the_same_trie(spark):
    rng = random.Random(4)
    rows = []
    for c in range(400):
        text = []
        for d in range(rng.randrange(1, 7)):
            text.append(rng.choice(["same words here"] * 4 + [f"other\t{rng.randrange(3)}", "", None]))
            rows.append((c * 7 - 500, d, "user", text[-1]))
    rows += [(10_000 + c, d, "user", "same words here") for c in range(150) for d in range(3)]
    given = trie.turn_lists(rows_of(spark, rows))
    want = brute(sequences(rows))
    assert result(trie.prefix_trie(given)) == want
    assert result(trie.prefix_trie(given.repartition(5), shard_convs=7)) == want


def test_borrowed_starts(spark):
    rows = [(c, d, r, f"turn {d} of {c}") for c in [0, 1, 2, 3, 4, 5, 19, 20, 21, 47, 48, 60, 61, 62] for d in range(c % 5)
            for r in ["user"] if c != 20] + [(20, None, "a", "first"), (20, -1, None, None), (0, 0, "x", "lent")]
    own = sequences(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert result(trie.prefix_trie(trie.with_borrowed_starts(trie.turn_lists(rows_of(spark, rows))))) == brute(want)


def test_odd_rows(spark):
    odd = [(1, None, None, None), (1, None, None, None), (None, 0, "user", "lost"), (2, 0, "us", "er:x"), (3, 0, "user", "x"),
           (4, 0, "", " \x0b "), (5, 1, "u", "w " * 200_000), (-3, 0, "user", "x"), (2**62, 0, "user", "x")]
    seqs = sequences([r for r in odd if r[0] is not None])
    assert result(trie.prefix_trie(trie.turn_lists(rows_of(spark, odd)))) == brute(seqs)
    assert trie.prefix_trie(trie.turn_lists(rows_of(spark, []))).count() == 0
