"""What is computed beside the stored ids and texts agrees with them."""

import zlib

from tessera.llm import langid, token_files
from tessera.llm.common import new_folder, saved


def test_digests_are_those_of_the_ids_read_back(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(3, "a b c"), (1, None), (2, ""), (None, "x"), (3, "a b c"), (9, "é " * 5000)],
                                 "doc_id long, text string")
    files = saved(token_files.write_tokens(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")), "files")
    want = [(r.id, r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in token_files.read_tokens(spark, files).collect()]
    got = [tuple(r) for r in token_files.token_digests(spark, files).collect()]
    assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1]) and len(got) == 6
    empty = docs.where("doc_id = 100")
    assert token_files.tokens_of(spark, empty).collect() == []


def test_languages_keep_the_columns_asked_for(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 0.5), (2, "der hund und die katze", "de", "s", 0.5),
                                  (3, None, None, "s", 0.5), (4, "12 34", None, None, 0.5)],
                                 "doc_id long, text string, lang string, _text string, score double")
    model = langid.train(docs)
    whole = langid.identify(docs, model)
    assert whole.columns == ["doc_id", "text", "lang", "_text", "lang_pred", "score"]
    rows = {r.doc_id: r for r in whole.collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert [rows[i].text for i in (1, 2, 3, 4)] == ["the cat and the dog", "der hund und die katze", None, "12 34"]
    few = langid.identify(docs, model, keep=["doc_id"])
    assert few.columns == ["doc_id", "lang_pred", "score"]
    assert {(r.doc_id, r.lang_pred, r.score) for r in few.collect()} == {(r.doc_id, r.lang_pred, r.score) for r in rows.values()}
