"""Shared beginnings of conversations as a trie, found by intersecting bitsets of conversations."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import batches_of, given, saved

#: Conversations of one shard, the length of its bitsets.
SHARD_CONVS = 4096
#: A shard also ends after so many turns, so that long conversations come in small shards.
SHARD_TURNS = 200_000
#: Words as the saved tokens are counted.
WORD = r"[^\x20\x09-\x0D]+"

NODE_SCHEMA = ("key binary, parent binary, depth long, words long, conv_id long, parent_conv_id long, n_convs long, "
               "n_children long, leaves long, member_words long, node_words long, ends_sha256 string, ends binary")
_NODES = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("leaves", pa.int64()),
    ("member_words", pa.int64()), ("node_words", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary())])
ROOT = hashlib.md5(b"").digest()
NO_END = hashlib.sha256(b"").hexdigest()


def turn_lists(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: an array of (``digest`` of role and text, ``words`` of the text) in order of turn.

    NULL turn first; turns of one number in order of their digests, repeated rows included. NULL role or text: empty.
    Rows with NULL id belong to no conversation and are left out. Only digests (16 bytes) travel, so a text may be of
    any length; the digests of one conversation must fit a task. Empty table: no rows.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    turns = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), words.alias("words")).alias("turn"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


class _Node:
    __slots__ = ("key", "parent", "depth", "words", "start", "least", "convs", "children", "leaves", "member_words",
                 "node_words", "ends")

    def __init__(self, key: bytes, parent: _Node | None, depth: int, words: int, start: bytes | None):
        self.key, self.parent, self.depth, self.words, self.start = key, parent, depth, words, start
        self.children = self.leaves = 0
        self.node_words = words


class _Shard:
    """The trie of one run of conversations: postings of (position, turn) as integers, one bit a conversation."""

    def __init__(self, ids: list[int], turns: list[list[tuple[bytes, int]]]):
        self.ids, self.turns = ids, turns
        bits: dict[tuple[int, bytes], list[int]] = {}
        ended: dict[int, list[int]] = {}
        for at, own in enumerate(turns):
            for position, (digest, _) in enumerate(own):
                bits.setdefault((position, digest), []).append(at)
            ended.setdefault(len(own), []).append(at)
        self.postings = {k: self._bitset(v) for k, v in bits.items()}
        self.ended = {k: self._bitset(v) for k, v in ended.items()}

    @staticmethod
    def _bitset(places: list[int]) -> int:
        raw = bytearray((places[-1] >> 3) + 1)
        for p in places:
            raw[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(raw, "little")

    @staticmethod
    def _places(bitset: int) -> Iterator[int]:
        raw = bitset.to_bytes((bitset.bit_length() + 7) >> 3, "little")
        for base, byte in enumerate(raw):
            while byte:
                low = byte & -byte
                yield (base << 3) + low.bit_length() - 1
                byte ^= low

    def rows(self, open_starts: set[bytes | None]) -> Iterator[tuple]:
        """One row a node, children after parents; sums of a subtree are added up on the way back.

        Nodes below a first turn of ``open_starts`` (and the root) may go on in other shards and carry their end lists.
        """
        nodes: list[_Node] = []
        stack = [(_Node(ROOT, None, 0, 0, None), (1 << len(self.ids)) - 1)]
        while stack:
            node, members = stack.pop()
            nodes.append(node)
            # bits are in order of (first turn, id): the lowest is the smallest id but for the root
            node.least = self.ids[(members & -members).bit_length() - 1] if node.depth else min(self.ids)
            node.convs = members.bit_count()
            node.member_words = node.words * node.convs
            ends = members & self.ended.get(node.depth, 0)
            node.ends = ",".join(str(self.ids[p]) for p in self._places(ends)).encode()
            left = members ^ ends
            while left:
                one = (left & -left).bit_length() - 1
                digest, words = self.turns[one][node.depth]
                child = left & self.postings[node.depth, digest]  # the parent's conversations that go on with this turn
                left ^= child
                node.children += 1
                start = node.start if node.depth else digest
                stack.append((_Node(hashlib.md5(node.key + digest).digest(), node, node.depth + 1, words, start), child))
        for node in reversed(nodes):  # children stand after their parents
            node.leaves = node.leaves or 1
            if node.parent:
                node.parent.leaves += node.leaves
                node.parent.member_words += node.member_words
                node.parent.node_words += node.node_words
        for node in nodes:
            spread = node.ends if node.ends and (not node.depth or node.start in open_starts) else None
            yield (node.key, node.parent and node.parent.key, node.depth, node.words, node.least, node.parent and node.parent.least,
                   node.convs, node.children, node.leaves, node.member_words, node.node_words,
                   hashlib.sha256(node.ends).hexdigest(), spread)


def _shards(batches: Iterator[pa.RecordBatch], shard_convs: int) -> Iterator[pa.RecordBatch]:
    """Tries of runs of conversations that come in order of (first turn, id)."""
    def runs() -> Iterator[tuple[list[int], list[list[tuple[bytes, int]]]]]:
        ids, turns, size = [], [], 0
        for batch in batches:
            names = batch.column("conv_id").to_pylist()
            column = batch.column("turns")
            flat = column.flatten()
            pairs = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
            at = 0
            for conv, n in zip(names, pc.list_value_length(column).to_pylist()):
                ids.append(conv)
                turns.append(pairs[at:at + n])
                at, size = at + n, size + n + 1
                if len(ids) >= shard_convs or size >= SHARD_TURNS:
                    yield ids, turns
                    ids, turns, size = [], [], 0
        if ids:
            yield ids, turns

    for ids, turns in runs():
        # first turns inside a run are whole here; those at its ends may go on next door
        edge = {own[0][0] if own else None for own in (turns[0], turns[-1])}
        yield from batches_of(_NODES, _Shard(ids, turns).rows(edge))


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the end lists of each key, which come one after another in order; only the running digest is held."""
    schema = pa.schema([("key", pa.binary()), ("sha", pa.string())])

    def rows() -> Iterator[tuple]:
        key, digest = None, None
        for batch in batches:
            for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        yield key, digest.hexdigest()
                    key, digest = k, hashlib.sha256(part)
                else:
                    digest.update(b"," + part)
        if key is not None:
            yield key, digest.hexdigest()

    yield from batches_of(schema, rows())


def _below(shared: DataFrame, depths: int) -> DataFrame:
    """``key``, ``d_leaves``, ``d_words``: corrections of ``shared`` nodes summed over their shared subtrees.

    Every round adds the sums of the nodes 1, 2, 4, ... steps below and doubles how far each node looks up.
    """
    now = shared.select("key", F.col("parent").alias("up"), "d_leaves", "d_words")
    for _ in range(max(depths, 1).bit_length()):
        now = saved(now, "trie-sums")
        lift = now.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(
            F.sum("d_leaves").alias("more_leaves"), F.sum("d_words").alias("more_words"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        now = now.join(lift, "key", "left").join(above, "up", "left").select(
            "key", F.col("next").alias("up"),
            (F.col("d_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("d_leaves"),
            (F.col("d_words") + F.coalesce("more_words", F.lit(0))).alias("d_words"))
    return now.select("key", "d_leaves", "d_words")


def prefix_trie(convs: DataFrame, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The trie of ``convs`` (``conv_id``, ``turns`` as :func:`turn_lists` gives them), one row a node.

    Columns: ``key`` and ``parent`` (digests of the turns from the start; the root has no parent), ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Conversations are ordered by (first turn, id) over the cluster and cut into shards of at most ``shard_convs``. A
    shard indexes (position, turn) to a bitset of its conversations; from the root down, a parent's bitset meets the
    postings of the next position, which gives the children, their counts and those that end there. A first turn of very
    many conversations is cut into several shards by id. Nodes that several shards hold (all below such first turns, and
    the root) are added up by key; what was counted more than once in a subtree (a node's own words, leaves) is taken
    back from all nodes above by :func:`_below`, in a number of rounds that grows with the logarithm of the depth. End
    lists of such nodes are digested in one pass in order of id that holds one part at a time.

    Ids must not be NULL and come once, as :func:`turn_lists` gives them. A conversation without turns is a member of
    the root alone. No conversations: no rows, not even a root.
    """
    start = F.get("turns", F.lit(0))["digest"]
    placed = convs.select("conv_id", "turns", start.alias("start")).repartitionByRange("start", "conv_id")
    parts = placed.sortWithinPartitions("start", "conv_id").select("conv_id", "turns").mapInArrow(functools.partial(_shards, shard_convs=shard_convs), NODE_SCHEMA)
    parts = saved(parts, "trie-shards")
    nodes = parts.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("member_words").alias("member_words"),
        F.sum("node_words").alias("node_words"), F.count(F.lit(1)).alias("shards"),
        F.min((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("shard_leaves"),
        F.max(F.when(F.col("ends_sha256") != NO_END, F.col("ends_sha256"))).alias("sha"),
        F.sum((F.col("ends_sha256") != NO_END).cast("long")).alias("end_parts"))
    nodes = saved(nodes, "trie-nodes")
    several = nodes.where("shards > 1")
    shared = saved(several.select(
        "key", "parent", "conv_id", "end_parts", "depth", (F.col("leaf") - F.col("shard_leaves")).alias("d_leaves"),
        ((1 - F.col("shards")) * F.col("words")).alias("d_words"),
        (F.col("shards") - 1).alias("again")), "trie-shared")
    deepest = shared.agg(F.max("depth")).first()[0]
    total = _below(shared, deepest or 0)
    fewer = shared.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.sum("again").alias("again"))
    many = shared.where("end_parts > 1").select("key")
    ends = parts.where("ends IS NOT NULL").join(many, "key").select("key", "ends")
    # shards of one first turn are disjoint ranges of ids, so their first ids put the parts in order
    ends = ends.withColumn("least", F.substring_index(F.col("ends").cast("string"), ",", 1).cast("long"))
    ends = ends.repartition("key").sortWithinPartitions("key", "least").select("key", "ends")
    ends = ends.mapInArrow(_joined_ends, "key binary, sha string").withColumnRenamed("sha", "long_sha")
    extra = saved(shared.select("key", F.col("conv_id").alias("least")).join(total, "key").join(fewer, "key", "left").join(ends, "key", "left"),
                  "trie-extra")
    above = extra.select(F.col("key").alias("parent"), F.col("least").alias("above"))
    out = nodes.join(extra.drop("least"), "key", "left").join(above, "parent", "left")
    zero = F.lit(0)
    return out.select(
        "key", "parent", "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs",
        (F.col("n_children") - F.coalesce("again", zero)).alias("n_children"),
        (F.col("leaves") + F.coalesce("d_leaves", zero)).alias("n_leaves"),
        (F.col("member_words") - F.col("node_words") - F.coalesce("d_words", zero)).alias("saved_tokens"),
        F.coalesce("long_sha", "sha", F.lit(NO_END)).alias("ends_sha256"))


def crc32_of(number: Column) -> Column:
    return F.crc32(number.cast("string"))


def with_borrowed_starts(convs: DataFrame, every: int = 20, at_most: int = 4) -> DataFrame:
    """Each conversation begun with the first h turns of conversation ``c - c % every`` in place of its own first h.

    h is crc32 of the decimal id modulo ``at_most``. A lender that is absent lends nothing; a shorter one lends all.
    """
    h = F.pmod(crc32_of(F.col("conv_id")), F.lit(at_most)).cast("int")
    lenders = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("lender"), F.slice("turns", 1, at_most).alias("lent"))
    own = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    begun = F.slice(F.coalesce("lent", none), F.lit(1), F.col("h"))
    rest = F.when(F.col("h") < F.size("turns"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return own.join(lenders, "lender", "left").select("conv_id", F.concat(begun, rest).alias("turns"))


_CRC = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda b, y: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)),
  4294967295::BIGINT), 4294967295)"""


@query("op13_prefix_trie", f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT c, turn, md5(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM m),
h AS (SELECT DISTINCT c, {_CRC} % 4 AS h, c - c % 20 AS lender FROM t),
r AS MATERIALIZED (
  SELECT h.c, n.pos, n.d, n.w FROM h JOIN n ON n.c = h.lender WHERE n.pos <= h.h
  UNION ALL
  SELECT h.c, (SELECT count(*) FROM n l WHERE l.c = h.lender AND l.pos <= h.h) + n.pos - h.h, n.d, n.w FROM h JOIN n ON n.c = h.c WHERE n.pos > h.h
),
p AS (SELECT c, pos AS depth, w, string_agg(d, ',') OVER (PARTITION BY c ORDER BY pos) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM h),
z AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
g AS MATERIALIZED (SELECT path, depth, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth), '') AS ends FROM p JOIN z USING (c) GROUP BY path, depth),
k AS MATERIALIZED (SELECT path, depth, lag(path) OVER (PARTITION BY c ORDER BY depth) AS parent FROM p),
e AS MATERIALIZED (SELECT DISTINCT path, depth, parent FROM k),
ch AS (SELECT parent AS path, count(*) AS n FROM e WHERE parent IS NOT NULL GROUP BY parent),
sub AS (SELECT DISTINCT a.path, b.path AS below, b.depth FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth),
tot AS (SELECT sub.path, count(*) FILTER (WHERE ch.n IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.w)::BIGINT AS saved_tokens
  FROM sub JOIN g ON g.path = sub.below LEFT JOIN ch ON ch.path = sub.below GROUP BY sub.path)
SELECT g.conv_id, g.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n_convs, coalesce(ch.n, 0) AS n_children, tot.n_leaves,
  tot.saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN e ON e.path = g.path LEFT JOIN g up ON up.path = e.parent LEFT JOIN ch ON ch.path = g.path JOIN tot ON tot.path = g.path
""")
def op13_prefix_trie(spark, sf_dir):
    convs = with_borrowed_starts(turn_lists(given(spark, sf_dir, "conversations")))
    return prefix_trie(saved(convs, "trie-convs")).drop("key", "parent")
