"""The pipeline against the same decisions made by brute force on the smallest documents."""

from collections import Counter

import duckdb

import corpus_pipeline
from tessera import llm
from tests.compare import connect
from tests.conftest import SMALL
from tests.llm.test_queries import brute_tokens

llm.load_all()


def test_pipeline(spark):
    """Groups and contamination come from the operators' SQL, draws from the mixing SQL over the kept rows."""
    with connect(SMALL) as con:
        groups = con.execute(llm.SQL["op8_jaccard"]).fetchall()
        hit = {r[0] for r in con.execute(f"SELECT doc_id FROM ({llm.SQL['op5_decontaminate']}) WHERE contaminated").fetchall()}
        kept = [g[0] for g in groups if g[0] == g[2] and g[0] not in hit]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SMALL}/documents.parquet' WHERE doc_id IN ({','.join(map(str, kept))}) "
                "AND regexp_matches(coalesce(text, ''), '\\p{L}')")
    rows = con.execute(f"SELECT doc_id, text FROM ({llm.SQL['op7_mixing']})").fetchall()
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == brute_tokens(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
