"""Every query with SQL against DuckDB; the others against brute force on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import html
import pytest

from tessera import llm
from tests.compare import connect, difference, from_spark, from_sql
from tests.conftest import SMALL

llm.load_all()


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, name):
    with connect(SMALL) as con:
        assert difference(from_spark(llm.QUERIES[name](spark, SMALL)), from_sql(con, llm.SQL[name])) is None


def test_media_reads_back_every_text(spark):
    got = {r.doc_id: r for r in llm.QUERIES["op2_media"](spark, SMALL).collect()}
    rows = table("documents", "doc_id, text")
    assert len(got) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_languages_of_documents_that_training_never_saw(spark):
    got = {r.doc_id: r for r in llm.QUERIES["op6_langid"](spark, SMALL).collect()}
    lang = dict(table("documents", "doc_id, lang"))
    assert got.keys() == lang.keys()
    out = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in out) and 0 <= got[d].score <= 1 for d in lang)
    assert sum(got[d].lang_pred == lang[d] for d in out) >= 0.97 * len(out)


def test_page_text_is_the_article(spark):
    got = {r.page_id: r for r in llm.QUERIES["op9_html_text"](spark, SMALL).collect()}
    for page, url, raw in table("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*?)</article>", raw, re.S).group(1).replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(x for x in blocks if x)
        assert (got[page].text, got[page].url, got[page].n_chars) == (text, url, len(text))


def brute_tokens(rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_are_the_librarys(spark):
    got = llm.QUERIES["op10_token_files"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == brute_tokens(table("documents", "doc_id, text"))
