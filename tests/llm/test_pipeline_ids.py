"""Stages on rows that share an id, rows without one, and tables without languages."""

import corpus_pipeline

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def rows(spark, pairs, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in pairs], SHAPE)


def test_only_similar_rows_go(spark):
    near = text("a") + " more"
    given = [(1, text("a")), (2, near), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d").upper()), (3, text("c")),
             (None, text("e")), (None, text("f")), (None, text("e")), (None, text("b") + " more"), (5, text("g")), (6, text("g"))]
    got = corpus_pipeline.near_duplicates(spark, rows(spark, given), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d").upper()), (None, text("e")), (None, text("f")), (5, text("g"))}
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_one_row_without_an_id_beside_unique_ids(spark):
    given = [(1, text("a")), (2, text("a") + " more"), (3, text("b")), (None, text("c"))]
    got = corpus_pipeline.near_duplicates(spark, rows(spark, given), "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, text("a")), (3, text("b")), (None, text("c"))}


def test_texts_stay_without_any_language(spark):
    given = rows(spark, [(1, "some words"), (2, "12 34 !"), (3, None), (4, "日本語"), (5, "")], None)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, given, "").collect()) == [1, 4]
