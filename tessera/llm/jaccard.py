"""Near-duplicate documents by a set similarity join on word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import NO_ID, batch_of, binary_values, bitmap_filter, components, given, id_or_none, none_or_id, parts_of, release_memory, saved

SHINGLE_WORDS = 5
#: Similarity as a fraction of whole numbers, so that the comparison is exact: 100 * common >= 75 * union.
SIMILARITY = (75, 100)
#: Shingle counts are kept by hash in so many cells (4 MB): they only order shingles, so shared cells cost speed alone.
COUNT_BITS = 20
#: Keys per document under which near copies are first drawn together, and rounds of that.
KEYS, ROUNDS = 6, 2
#: Prefix entries that one group of the join should hold, and documents of one frequent shingle in a group.
CELL_ENTRIES, CHUNK_DOCS = 250_000, 2_000
#: Bytes of text hashed at once.
PIECE = 1 << 20

_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = _numbers(256, 1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = _numbers(SHINGLE_WORDS, 2) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base & _M, np.uint64)]).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of at most ``PIECE`` bytes, and where they start."""
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _UP[:len(data)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)), start


def _long_text(raw: bytes) -> np.ndarray:
    """Word hashes of a text of any length, piece by piece; a word longer than a piece is hashed over its pieces."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            cut = max(raw.rfind(bytes([b]), at, end) for b in (9, 10, 11, 12, 13, 32))
            if cut > at:
                end = cut + 1
            else:  # one word fills the piece
                stop = min((p for p in (raw.find(bytes([b]), end) for b in (9, 10, 11, 12, 13, 32)) if p >= 0), default=len(raw))
                parts = [_word_hashes(raw[i:min(i + PIECE, stop)])[0] for i in range(at, stop, PIECE)]
                out.append(_mix(np.array([np.concatenate(parts).cumsum(dtype=np.uint64)[-1]], np.uint64)))
                at = stop
                continue
        out.append(_word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if not len(words):
        return words
    if len(words) < SHINGLE_WORDS:
        return _mix(np.array([(words * _PLACES[:len(words)]).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(words)))
    n = len(words) - SHINGLE_WORDS + 1
    total = words[:n] * _PLACES[0]
    for k in range(1, SHINGLE_WORDS):
        total += words[k:k + n] * _PLACES[k]
    return np.unique(_mix(total))


def _documents(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text; short texts are hashed together, up to ``PIECE`` bytes at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end] or b"") + 1 <= PIECE:
            size += len(texts[end] or b"") + 1
            end += 1
        if end == at:
            yield _long_text(texts[at])
            at += 1
            continue
        group = [t or b"" for t in texts[at:end]]
        words, start = _word_hashes(b" ".join(group))
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in group]))
        for i in range(len(group)):
            yield words[bounds[i]:bounds[i + 1]]
        at = end


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for words in _documents(texts):
        yield _shingles(words)


# Pass 1: a profile of each document, and how frequent shingles are -------------------------------------------------------

_PROFILE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("seq", pa.binary()), ("keys", pa.list_(pa.int64())),
                      ("cell", pa.int32()), ("counts", pa.binary())])
_PROFILE_SHAPE = "id long, n long, seq binary, keys array<long>, cell int, counts binary"
_SLICE = 1 << 14


def _sequence(words: np.ndarray) -> bytes:
    """A digest of a document's word sequence."""
    order = np.arange(1, len(words) + 1, dtype=np.uint64)
    sums = _mix(words + order).sum(dtype=np.uint64), _mix(words ^ (order * np.uint64(_BASE))).sum(dtype=np.uint64)
    return np.array([len(words), *sums], "<u8").tobytes()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    counts, seeds = np.zeros(1 << COUNT_BITS, np.int64), _numbers(KEYS, 3)[:, None]
    for batch in (part for whole in batches for part in parts_of(whole)):
        rows, cells = [], []
        for doc, words in zip(batch.column(0).to_pylist(), _documents(binary_values(batch.column(1)))):
            grams = _shingles(words)
            if not len(grams):
                rows.append((doc, 0, None, None, None, None))
                continue
            cells.append(grams >> np.uint64(64 - COUNT_BITS))
            keys = _mix(grams[None, :] ^ seeds).min(axis=1).view(np.int64).tolist()
            rows.append((doc, len(grams), _sequence(words), keys, None, None))
        if cells:
            np.add.at(counts, np.concatenate(cells).astype(np.intp), 1)
        yield batch_of(_PROFILE, rows)
    if counts.any():
        yield batch_of(_PROFILE, [(None, 0, None, None, i, counts[i * _SLICE:(i + 1) * _SLICE].tobytes())
                                  for i in range(len(counts) // _SLICE)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, raw in zip(batch.column(0).to_pylist(), binary_values(batch.column(1))):
            counts = np.frombuffer(raw, "<i8")
            total[cell] = total[cell] + counts if cell in total else counts
    schema = pa.schema([("cell", pa.int32()), ("counts", pa.binary())])
    if total:
        yield batch_of(schema, [(c, v.astype("<i8").tobytes()) for c, v in sorted(total.items())])


def _frequencies(profiles: DataFrame) -> np.ndarray:
    """Summed counts by cell: slices are dealt over tasks and summed as they stream in; 8 MB reach the driver."""
    slices = profiles.where("cell is not null").select("cell", "counts")
    summed = slices.repartition("cell").mapInArrow(_summed, "cell int, counts binary").collect()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for row in summed:
        out[row.cell * _SLICE:(row.cell + 1) * _SLICE] += np.frombuffer(bytes(row.counts), "<i8")
    return out


# Verification -----------------------------------------------------------------------------------------------------------

def overlap_needed(a: int, b: int) -> int:
    """Least common size of sets of a and b elements that are similar."""
    p, q = SIMILARITY
    return -(-p * (a + b) // (p + q))


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the number of elements that only one of two sorted sets has; stops once it exceeds ``most``."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    at, here = int(np.searchsorted(x, middle)), len(y) // 2
    same = at < len(x) and x[at] == middle
    after = at + 1 if same else at
    low, high = abs(at - here), abs((len(x) - after) - (len(y) - here - 1))
    bound = low + high + (not same)
    if bound > most:
        return bound
    low = suffix_bound(x[:at], y[:here], most - high - (not same), depth - 1)
    if low + high + (not same) > most:
        return low + high + (not same)
    return low + suffix_bound(x[after:], y[here + 1:], most - low - (not same), depth - 1) + (not same)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar: length filter, suffix filter, then the exact overlap."""
    need = overlap_needed(len(x), len(y))
    if min(len(x), len(y)) < need:
        return False
    most = len(x) + len(y) - 2 * need
    if suffix_bound(x, y, most) > most:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    release_memory()
    last, kept = None, None
    for batch in (part for whole in batches for part in parts_of(whole)):
        rows, a, b = [], batch.column(0).to_pylist(), batch.column(2).to_pylist()
        left, right = binary_values(batch.column(1)), binary_values(batch.column(3))
        for i, j, x, y in zip(a, b, left, shingle_sets(right)):
            if (i, x) != last:
                last, kept = (i, x), next(shingle_sets([x]))
            if similar(kept, y):
                rows.append((i, j))
        if rows:
            yield batch_of(schema, rows)


def _links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose whole texts are similar. Each pair is verified once.

    Texts meet the pairs by two joins on ids; a document in very many pairs is left to skew handling. A bitmap of the
    ids in question spares the other texts the shuffle.
    """
    left = bitmap_filter(texts, "id", pairs.select("a")).select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = bitmap_filter(texts, "id", pairs.select("b")).select(F.col("id").alias("b"), F.col("text").alias("y"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "x", "b", "y")
    return saved(rows.mapInArrow(_verify, "a long, b long").distinct(), "links")


# Pass 2: prefix entries, dealt by shingle ------------------------------------------------------------------------------

def prefix_length(n: int) -> int:
    p, q = SIMILARITY
    return n - -(-p * n // q) + 1


_ENTRY = np.dtype([("gram", "<u8"), ("id", "<i8"), ("label", "<i8"), ("n", "<u4"), ("at", "<u4")])
_PACKED = pa.schema([("cell", pa.int32()), ("i", pa.int32()), ("entries", pa.binary())])


def _columns(entries: np.ndarray) -> bytes:
    """Entries column by column: like bytes lie together, so the shuffle compresses them."""
    return b"".join(entries[name].tobytes() for name in _ENTRY.names)


def _entries(raw: bytes) -> np.ndarray:
    n, at = len(raw) // _ENTRY.itemsize, 0
    out = np.empty(n, _ENTRY)
    for name in _ENTRY.names:
        kind = _ENTRY[name]
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], shared, cells: int, noise: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, chunk pair, entries). A shingle of many documents is cut into chunks by id; each pair of chunks is a cell."""
    release_memory()
    counts, held, size = None, [], 0

    def deal() -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(held)
        held.clear()
        often = counts[(entries["gram"] >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] - noise
        chunks = np.maximum(1, np.ceil(often / CHUNK_DOCS)).astype(np.int64)
        home = (entries["gram"] % np.uint64(cells)).astype(np.int64)
        rows = []

        def add(some: np.ndarray, cell: np.ndarray, chunk: int) -> None:
            order = np.argsort(cell, kind="stable")
            some, cell = some[order], cell[order]
            edge = np.flatnonzero(np.diff(cell, prepend=-1))
            for low, high in zip(edge, [*edge[1:], len(cell)]):
                rows.append((int(cell[low]), chunk, _columns(some[low:high])))

        plain = chunks == 1
        if plain.any():
            add(entries[plain], home[plain], 0)
        for k in np.unique(chunks[~plain]):
            many = entries[chunks == k]
            base = home[chunks == k]
            own = (_mix(many["id"].view(np.uint64)) % np.uint64(k)).astype(np.int64)
            for other in range(int(k)):
                low, high = np.minimum(own, other), np.maximum(own, other)
                spread = _mix((base * (int(k) * int(k)) + low * int(k) + high).astype(np.uint64)) % np.uint64(cells)
                for side in (0, 1):  # chunk 1: entries of the lower chunk number; 2: of the higher; 3: both in one chunk
                    mine = (own < other) if side == 0 else (own > other)
                    if mine.any():
                        add(many[mine], spread[mine].astype(np.int64), 1 + side)
                same = own == other
                if same.any():
                    add(many[same], spread[same].astype(np.int64), 3)
        yield batch_of(_PACKED, rows)

    for batch in (part for whole in batches for part in parts_of(whole)):
        counts = shared.value if counts is None else counts
        labels = batch.column(2).to_pylist()
        for doc, label, grams in zip(batch.column(0).to_pylist(), labels, shingle_sets(binary_values(batch.column(1)))):
            n = len(grams)
            if not n:
                continue
            often = counts[(grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            k = prefix_length(n)
            grams = grams[np.argsort(often, kind="stable")[:k]]  # rarest first; equal counts by hash
            out = np.empty(k, _ENTRY)
            out["gram"], out["id"], out["label"], out["n"], out["at"] = grams, doc, label, n, np.arange(k)
            held.append(out)
            size += k
            if size > 500_000:
                yield from deal()
                size = 0
    if held:
        yield from deal()


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs_of_group(e: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of different labels in the entries of one shingle that pass the length and positional filters."""
    p, q = SIMILARITY
    order = np.lexsort((e["id"], e["n"]))
    e, side = e[order], side[order]
    n, at = e["n"].astype(np.int64), e["at"].astype(np.int64)
    last = np.searchsorted(n, n * q // p, side="right")  # a set of n only matches up to n * q / p elements
    rows = max(1, (1 << 20) // max(1, len(e)))
    for low in range(0, len(e), rows):
        high = min(low + rows, len(e))
        i = np.arange(low, high)
        width = last[i] - i - 1
        first = np.repeat(i, width)
        second = np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width) + first + 1
        need = -(-p * (n[first] + n[second]) // (p + q))
        room = 1 + np.minimum(n[first] - at[first], n[second] - at[second]) - 1
        fits = (e["label"][first] != e["label"][second]) & (room >= need)
        fits &= (side[first] == 0) | (side[first] == 3) | (side[first] != side[second])
        if fits.any():
            x, y = e["id"][first[fits]], e["id"][second[fits]]
            yield np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one cell after the other; rows arrive sorted by cell."""
    def cell_pairs(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate([_entries(raw) for _, raw in parts])
        side = np.repeat(np.array([s for s, _ in parts], np.int8), [len(raw) // _ENTRY.itemsize for _, raw in parts])
        kind = np.where(side == 0, 0, np.where(side == 3, 2, 1)).astype(np.int8)
        order = np.lexsort((kind, entries["gram"]))
        entries, side, kind = entries[order], side[order], kind[order]
        new = (entries["gram"][1:] != entries["gram"][:-1]) | (kind[1:] != kind[:-1])
        edge = np.flatnonzero(np.concatenate([[True], new, [True]]))
        mixed = np.add.reduceat(np.concatenate([[0], (entries["label"][1:] != entries["label"][:-1]) & ~new]), edge[:-1])
        seen: set[tuple[int, int]] = set()
        for g in np.flatnonzero(mixed):
            part = slice(edge[g], edge[g + 1])
            for pairs in _pairs_of_group(entries[part], side[part]):
                seen.update(map(tuple, pairs.tolist()))
                if len(seen) > 200_000:
                    yield batch_of(_PAIRS, list(seen))
                    seen.clear()
        if seen:
            yield batch_of(_PAIRS, list(seen))

    release_memory()
    cell, parts = None, []
    for batch in batches:
        for c, s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))):
            if c != cell and parts:
                yield from cell_pairs(parts)
                parts = []
            cell = c
            parts.append((s, raw))
    if parts:
        yield from cell_pairs(parts)


# The operator -----------------------------------------------------------------------------------------------------------

def _star_round(texts: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Links between each document and one chosen document per key that they share, where their labels differ.

    ``docs`` has ``id``, ``n``, ``copies``, ``label`` and ``keys``. The chosen one has most links so far, then most exact
    copies: it lies in the middle of a group of near copies, so that most others are similar to it. It is found by an
    aggregate that combines before the shuffle; a key shared by a third of all documents gives one pair for each.
    """
    p, q = SIMILARITY
    degree = links.select(F.col("a").alias("_id")).unionByName(links.select(F.col("b").alias("_id"))).groupBy("_id").agg(
        F.count(F.lit(1)).alias("degree"))
    docs = docs.join(degree, docs.id == degree._id, "left")
    rank = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.col("copies")).alias("c"), F.xxhash64("id").alias("r"),
                    "id", "n", "label")
    keyed = docs.select("id", "n", "label", rank.alias("rank"), F.posexplode("keys").alias("k", "key"))
    chosen = keyed.groupBy("k", "key").agg(F.min("rank").alias("c"), F.count(F.lit(1)).alias("many")).where("many > 1")
    pairs = keyed.join(chosen.select("k", "key", F.col("c.id").alias("cid"), F.col("c.n").alias("cn"), F.col("c.label").alias("cl")),
                       ["k", "key"])
    pairs = pairs.where(F.col("label") != F.col("cl"))
    pairs = pairs.where((F.least("n", "cn") * q >= F.greatest("n", "cn") * p))
    pairs = pairs.select(F.col("cid").alias("a"), F.col("id").alias("b")).distinct()
    return _links(texts, saved(pairs, "star-pairs"))


def _relabel(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` with the labels that all links so far give."""
    found = components(links, "a", "b")
    return docs.drop("label").join(found, docs.id == found.node, "left").select(
        *[docs[c] for c in docs.columns if c != "label"], F.coalesce("label", "id").alias("label"))


def _profiled(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of the first pass, and those that are documents."""
    profiles = saved(texts.mapInArrow(_profiles, _PROFILE_SHAPE), "profiles")
    return profiles, profiles.where("cell is null").select("id", "n", "seq", "keys")


def _prefix_column() -> Column:
    return F.col("n") - F.ceil(F.col("n") * SIMILARITY[0] / SIMILARITY[1]) + 1


def _candidates(texts: DataFrame, profiles: DataFrame, entries: int) -> DataFrame:
    """Pairs ``a``, ``b`` of the texts (``id``, ``text``, ``label``) that share a prefix shingle, have different labels
    and pass the length and positional filters; ``entries`` is the number of prefix shingles of all of them."""
    counts = _frequencies(profiles)
    middle = float(np.median(counts))
    noise = max(0.0, middle - 6 * math.sqrt(middle))  # what other shingles add to a cell, at least
    cells = max(8, math.ceil(entries / CELL_ENTRIES))
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    packed = texts.mapInArrow(lambda b: _prefixes(b, shared, cells, noise), "cell int, i int, entries binary")
    packed = packed.repartition(cells, "cell").sortWithinPartitions("cell")
    return saved(packed.mapInArrow(_cross, "a long, b long").distinct(), "pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are parted by ASCII white space with A-Z lowered; a document's set holds its distinct five-word shingles as
    64-bit hashes (one shingle of all words, if fewer). Two documents link at Jaccard similarity 0.75 or more.

    1. Documents of one word sequence form a class; the smallest id stands for it.
    2. Near copies are drawn together: in each group of one min-hash key, documents are verified against one chosen
       document, in two rounds. This only saves work: links found this way unite documents that step 3 need not compare.
    3. The join: each set is ordered rarest shingle first, by counts over all documents; two similar sets share one of
       the first ``prefix_length`` shingles. These entries are dealt by shingle, and within each shingle pairs whose
       labels still differ pass the length and positional filters, are made distinct and verified once, with a suffix
       filter before the exact overlap. A shingle of very many documents is cut into chunks by id, and every pair of
       chunks is dealt on its own, so no task holds a group that grows with the data.
    4. Components over all links.

    NULL or empty text, or no word: empty set, a component of its own. NULL id: shown as NULL, below all other ids.
    Repeated rows: a row each, one class. Rows of one id with different texts: one node with the links of all its texts.
    Empty table: no rows.
    """
    texts = docs.select(id_or_none(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    profiles, rows = _profiled(texts)
    classes = rows.where("n > 0").groupBy("seq").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes, "classes")
    members = saved(rows.drop("keys").join(classes.drop("copies"), "seq", "left"), "members")

    # ids with several texts tie their classes together
    several = members.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    ties = members.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = [saved(ties.distinct(), "ties")]

    own = classes.select(F.col("seq").alias("_seq"), F.col("rep").alias("_rep"), "copies")
    reps = rows.where("n > 0").join(own, [F.col("seq") == F.col("_seq"), F.col("id") == F.col("_rep")])
    nodes = reps.groupBy("id", "n").agg(F.first("keys").alias("keys"), F.max("copies").alias("copies"), F.first("id").alias("label"))
    nodes = saved(nodes, "nodes")
    labelled = nodes
    for _ in range(ROUNDS):
        links.append(_star_round(texts, labelled, _union(links)))
        labelled = saved(_relabel(nodes, _union(links)), "labelled")

    entries = nodes.agg(F.sum(_prefix_column())).first()[0] or 0
    where = labelled.select("id", "label").distinct()
    pairs = _candidates(texts.join(where, "id").select("id", "text", "label"), profiles, entries)
    links.append(_links(texts, pairs))

    found = components(_union(links), "a", "b")
    out = members.join(found, members.rep == found.node, "left")
    return out.select(none_or_id(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"),
                      none_or_id(F.coalesce("label", "rep", "id")).alias("component_id"))


def _with_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each text the digest of its word sequence, as the first pass has it; texts without words go."""
    for batch in batches:
        seqs = [_sequence(words) if len(words) else None for words in _documents(binary_values(batch.column(1)))]
        seq = pa.array(seqs, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seq], ["id", "text", "seq"]).filter(seq.is_valid())


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: a row per document, and all links between different texts.

    Documents: id, ``n_shingles``, ``class_key`` (of its word sequence, NULL without words), ``class_id`` (smallest id of
    that class), ``n_links`` (other documents that are similar: those of its class and of every linked class) and
    ``component_id``, which is that of :func:`near_duplicates`.

    Links: ``class_a`` < ``class_b`` with ``id_a``, ``id_b`` and the number of documents of each, ``copies_a`` and
    ``copies_b``. Each unordered pair of classes whose sets are similar comes once; copies aren't expanded.

    Unlike :func:`near_duplicates` no pair is left out because its documents are known to be connected: every candidate of
    the prefix join is verified, so the cost grows with the links between different texts.

    NULL or empty text, or no word: no class and no links. NULL id: shown as NULL. Repeated rows: a document each, linked
    with each other. Rows of one id with different texts: a class each with links of its own, one component. Empty table:
    no rows in either.
    """
    texts = docs.select(id_or_none(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    profiles, rows = _profiled(texts)
    rows = rows.drop("keys")
    classes = rows.where("n > 0").groupBy("seq").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay

    one = classes.select("seq", F.col("rep").alias("id"), "node")
    kept = texts.mapInArrow(_with_sequence, "id long, text string, seq binary").join(one, ["seq", "id"])
    kept = saved(kept.select(F.col("node").alias("id"), "text"), "class-texts")
    entries = classes.agg(F.sum(_prefix_column())).first()[0] or 0
    links = _links(kept, _candidates(kept.withColumn("label", F.col("id")), profiles, entries))

    members = saved(rows.join(classes.drop("n"), "seq", "left"), "members")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("node").alias("b"), F.col("copies").alias("others"))
    beside = ends.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("beside"))

    # an id with several texts ties its classes together, in the component alone
    several = members.where("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    ties = members.join(several, "id").where("node <> a").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(ties), "a", "b")
    tops = found.join(classes.select("node", "rep"), "node")
    tops = saved(tops.join(tops.groupBy("label").agg(F.min("rep").alias("top")), "label").select("node", "top"), "tops")

    out = members.join(beside, "node", "left").join(tops, "node", "left")
    n_links = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("beside", F.lit(0)))
    documents = out.select(
        none_or_id(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), F.hex("seq").alias("class_key"),
        none_or_id(F.col("rep")).alias("class_id"), n_links.cast("long").alias("n_links"),
        none_or_id(F.coalesce("top", "rep", "id")).alias("component_id"))

    def side(c: str) -> DataFrame:
        return classes.select(F.col("node").alias(c), F.hex("seq").alias(f"class_{c}"), none_or_id(F.col("rep")).alias(f"id_{c}"),
                              F.col("copies").alias(f"copies_{c}"))

    pairs = links.join(side("a"), "a").join(side("b"), "b")
    low = F.col("class_a") < F.col("class_b")
    columns = [F.when(low, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}")
               for c in ("class", "id", "copies") for x, y in ("ab", "ba")]
    return documents, pairs.select(*columns)


def _union(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


@query("op8_jaccard", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * m >= 75 * (na.n + nb.n - m)
),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(reach) FROM r WHERE r.node = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op8_jaccard(spark, sf_dir):
    return near_duplicates(given(spark, sf_dir, "documents"))
