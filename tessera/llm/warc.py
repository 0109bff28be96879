"""WARC archives of pages, and a two-level capture index over them."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm import query
from tessera.llm.common import NO_ID, batch_of, filesystem, given, id_or_none, new_file, new_folder, saved

#: Index lines per compressed block, and blocks per index file.
BLOCK_LINES = 500
FILE_BLOCKS = 4000
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20

_MAGIC = b"CAPIDX01"


# Records ---------------------------------------------------------------------------------------------------------------

def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(url: str, page: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record in a gzip member of its own. A revisit keeps the HTTP headers and leaves the payload out."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = http if revisit else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {clean}",
             f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z",
             "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _urn(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(member: bytes) -> dict:
    """Headers and payload of one record. ``payload`` is None for a revisit; ``payload_bytes`` is of the full payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = headers["WARC-Type"] == "revisit"
    return {
        "page": _urn(headers["WARC-Record-ID"]), "type": headers["WARC-Type"], "url": headers["WARC-Target-URI"],
        "digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(sizes["Content-Length"]),
        "refers_to": _urn(headers["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


#: Characters that part lines and fields of the index, and how a key spells them.
_ESCAPES = str.maketrans({"\0": "%00", "\t": "%09", "\n": "%0A", "\r": "%0D"})


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels in reverse order, then port, path and query; no scheme, user or fragment.

    A URL that can't be split is its own key in lower case. No key holds a control character of the index.
    """
    return _key_of(url or "").translate(_ESCAPES)


def _key_of(url: str) -> str:
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed([x for x in host.split(".") if x]))
    place = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{labels}{f':{port}' if port else ''}){place}"


@F.arrow_udf(StringType())
def url_keys(urls: pa.Array) -> pa.Array:
    return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())


# Writing ---------------------------------------------------------------------------------------------------------------

_CAPTURES = pa.schema([("key", pa.string()), ("page", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs = filesystem(folder)[0]
    name, out, at = "", None, 0
    try:
        for batch in batches:
            rows = []
            for page, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = new_file(folder, "pages", ".warc.gz"), 0
                    out = fs.open_output_stream(filesystem(name)[1], compression=None)
                revisit = page is not None and page != first
                member = record_bytes(url or "", page, html or b"", base32_digest(sha1), first if revisit else None, revisit)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                yield batch_of(_CAPTURES, rows)
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write a WARC record per page; returns the captures ``key``, ``page``, ``file``, ``start``, ``length``.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response, the others
    revisit it; smaller payloads are all responses. Digests and ids alone are grouped; payloads move once, by page id.

    NULL html: empty payload. NULL url: an empty URL. NULL id: a response, never revisited. Repeated rows: a record
    each, of the same type. Empty table: no archives. A lost task leaves archives that no capture names.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    base = base.withColumn("sha1", F.sha1("html"))
    facts = base.where(F.octet_length("html") >= min_bytes).select("page", "sha1")
    first = facts.groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").drop("n")
    again = facts.join(first, "sha1").where("page <> first").groupBy("page", "sha1").agg(F.min("first").alias("first"))
    again = again.withColumnsRenamed({"page": "_page", "sha1": "_sha1"})
    rows = base.join(again, (base.page == again._page) & (base.sha1 == again._sha1), "left")
    rows = rows.select("page", "url", "html", "sha1", F.coalesce("first", "page").alias("first"))
    return saved(rows.mapInArrow(lambda b: _write(b, folder), "key string, page long, file string, start long, length long"),
                 "captures")


# Index -----------------------------------------------------------------------------------------------------------------

_SHARDS = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("lines", pa.int64())])


def _sort_key(key: str, page: int) -> str:
    """Keys first, then pages in number order."""
    return f"{key}\t{page + 2**63:020d}"


def sort_key(key: Column, page: Column) -> Column:
    """:func:`_sort_key` as an expression; a NULL page is below all."""
    number = id_or_none(page).cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return F.concat(key, F.lit("\t"), F.lpad(number.cast("string"), 20, "0"))


def _write_index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """An index file: compressed blocks of sorted lines, then the sparse directory (each block's first key, place, size)."""
    fs = filesystem(folder)[0]
    lines: list[str] = []
    blocks: list[tuple[str, bytes]] = []
    state = {"last": "", "n": 0}

    def block() -> None:
        blocks.append((lines[0].split("\n", 1)[0], zlib.compress("\0".join(lines).encode())))
        state["n"] += len(lines)
        lines.clear()

    def close() -> pa.RecordBatch:
        name, at, entries = new_file(folder, "captures", ".idx"), len(_MAGIC), []
        with fs.open_output_stream(filesystem(name)[1], compression=None) as out:
            out.write(_MAGIC)
            for first, packed in blocks:
                out.write(packed)
                entries.append((first, at, len(packed)))
                at += len(packed)
            tail = zlib.compress(json.dumps(entries).encode())
            out.write(tail + struct.pack("<QQ", at, len(tail)))
        row = (blocks[0][0], state["last"], name, state["n"])
        blocks.clear()
        state["n"] = 0
        return batch_of(_SHARDS, [row])

    for batch in batches:
        for sort, file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            if len(lines) >= BLOCK_LINES:
                block()
                if len(blocks) >= FILE_BLOCKS:
                    yield close()
            lines.append(f"{sort}\n{file}\n{start}\n{length}")
            state["last"] = sort
    if lines:
        block()
    if blocks:
        yield close()


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by reversed-host key, store them in compressed blocks; returns the list of index files.

    Spark range-partitions and sorts the captures; a host with a third of all pages is cut by path and page. The
    upper level is this list (``first``, ``last``, ``file``, ``lines``), the lower level each file's block directory.

    A NULL page id sorts below all ids of its key. Captures of one key and page: a line each, by archive and place.
    Control characters in a URL are spelt out in its key. Very long URLs: a line of that length. No captures: no files.
    """
    rows = captures.select(sort_key(F.col("key"), F.col("page")).alias("sort"), "file", "start", "length")
    rows = rows.repartitionByRange("sort", "file", "start").sortWithinPartitions("sort", "file", "start")
    return saved(rows.mapInArrow(lambda b: _write_index(b, folder), "first string, last string, file string, lines long"), "shards")


@lru_cache(maxsize=4)
def _directory(file: str) -> tuple[list[str], list[tuple[int, int]]]:
    fs, path = filesystem(file)
    with fs.open_input_file(path) as source:
        size = source.size()
        source.seek(size - 16)
        at, length = struct.unpack("<QQ", source.read(16))
        source.seek(at)
        entries = json.loads(zlib.decompress(source.read(length)))
    return [e[0] for e in entries], [(e[1], e[2]) for e in entries]


@lru_cache(maxsize=8)
def _block(file: str, number: int) -> tuple[list[str], list[str]]:
    fs, path = filesystem(file)
    start, length = _directory(file)[1][number]
    with fs.open_input_file(path) as source:
        source.seek(start)
        lines = zlib.decompress(source.read(length)).decode().split("\0")
    return [line.split("\n", 1)[0] for line in lines], lines


def find(file: str, low: str, high: str) -> Iterator[tuple[str, int, int]]:
    """(archive, start, length) of the captures of one index file whose sort key lies in [low, high]."""
    firsts, _ = _directory(file)
    number = max(0, bisect.bisect_left(firsts, low) - 1)
    while number < len(firsts) and firsts[number] <= high:
        keys, lines = _block(file, number)
        for line in lines[bisect.bisect_left(keys, low):bisect.bisect_right(keys, high)]:
            _, archive, start, length = line.split("\n")
            yield archive, int(start), int(length)
        number += 1


def lookup(spark: SparkSession, shards: DataFrame, queries: DataFrame, url_col: str, page_col: str | None = None) -> DataFrame:
    """Records of the captures of each queried URL (and page id, if ``page_col`` is given), read from the archives.

    Queries are made distinct, sorted by the same key and dealt by range, so a task touches neighbouring blocks. A task
    bisects the list of index files, then a file's block directory, then a block, and reads the record's byte range.
    The list of files is held by every task: ``BLOCK_LINES * FILE_BLOCKS`` captures make one row of it.
    Returns ``key``, ``page``, ``type``, ``digest``, ``payload_bytes``, ``refers_to``, ``payload`` and ``intact``: whether
    a response's payload has the recorded size and digest (true for revisits, which hold none).

    NULL url: the captures without a URL. NULL page id, where ids are asked for: captures without an id. Queries asked
    several times are answered once; captures of one key and page are all returned. Unknown URLs: no rows. No queries or
    an empty index: no rows. Other columns of ``queries`` are not looked at.
    """
    listed = shards.collect()
    files = sorted((r.first, r.last, r.file) for r in listed)
    tasks = max(1, sum(r.lines for r in listed) // (10 * BLOCK_LINES))  # a query is few bytes, a record is not
    highest = [f[1] for f in files]
    page = id_or_none(F.col(page_col)) if page_col else F.lit(None).cast("long")
    asked = queries.select(url_keys(F.col(url_col)).alias("key"), page.alias("page")).distinct()
    asked = asked.repartitionByRange(tasks, "key", "page").sortWithinPartitions("key", "page")
    schema = pa.schema([("key", pa.string()), ("page", pa.int64()), ("type", pa.string()), ("digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows, size = [], 0
            for name, number in zip(*(c.to_pylist() for c in batch.columns)):
                low = _sort_key(name, NO_ID if number is None else number)
                high = _sort_key(name, 2**63 - 1 if number is None else number)
                at = bisect.bisect_left(highest, low)
                while at < len(files) and files[at][0] <= high:
                    for archive, start, length in find(files[at][2], low, high):
                        if archive not in opened:
                            if len(opened) >= 8:
                                opened.pop(next(iter(opened))).close()
                            fs, path = filesystem(archive)
                            opened[archive] = fs.open_input_file(path)
                        record = parse_record(opened[archive].read_at(length, start))
                        body = record["payload"]
                        intact = body is None or (
                            len(body) == record["payload_bytes"] and base32_digest(hashlib.sha1(body).hexdigest()) == record["digest"])
                        rows.append((name, record["page"], record["type"], record["digest"], record["payload_bytes"],
                                     record["refers_to"], body, intact))
                        size += len(body or b"")
                        if size > 8 << 20:
                            yield batch_of(schema, rows)
                            rows, size = [], 0
                    at += 1
            if rows:
                yield batch_of(schema, rows)
        for source in opened.values():
            source.close()

    return asked.mapInArrow(read, "key string, page long, type string, digest string, payload_bytes long, refers_to long, "
                                  "payload binary, intact boolean")


def _base32_sql(value: str) -> str:
    return (f"array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
            f"1 + ((('0x' || substr({value}, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')")


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, strlen(h) AS payload_bytes, {_base32_sql('d')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS intact
FROM p JOIN f USING (d)
""")
def op1_warc(spark, sf_dir):
    pages = given(spark, sf_dir, "pages")
    captures = write_archives(pages, new_folder(spark, "archives"))
    shards = build_index(captures, new_folder(spark, "capture-index"))
    found = lookup(spark, shards, pages, "url", "page_id")
    return found.select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                        F.col("type").alias("record_type"), "refers_to", "intact")
