"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import random

import numpy as np
import pytest

from tessera.llm import decontaminate, html_text, jaccard, langid, licenses, line_dedup, media, mixing, token_files, warc
from tessera.llm.common import components, new_folder

SHAPE = "doc_id long, text string, lang string, source string, n_words string, lang_pred int, mix_key int, row int, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "own", 1, 2, 3, 4) for i, t, lang, s in rows], SHAPE)


LONG = " ".join(f"w{i}" for i in range(300_000))
LINE = "this line is long enough to be looked at by the operator"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "a"), (None, "some words here", "fr", None),
       (4, "\n\n", None, "b"), (5, "\x00 1 2 3", "en", "b"), (6, LONG, "en", "a"), (7, "日本語 Ωmega ² <|endoftext|>", "xx", "b"),
       *[(10 + i, f"{LINE}\nown {i}\n  {LINE.upper()} \t", "en", "a") for i in range(6)]]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_no_operator_fails_or_loses_rows(spark, rows):
    given, n = docs(spark, rows), len(rows)
    bench = spark.createDataFrame([(1, "x"), (None, "some words here"), (2, None), (3, ""), (3, "x")], "item_id int, text string")
    assert line_dedup.line_dedup(given).count() == n
    assert licenses.license_scan(given).count() == len({r[0] for r in rows})
    found = decontaminate.contamination(given, bench)
    assert found.count() == n and found.where("size(items) > 0").count() == (3 if n else 0)
    assert decontaminate.contamination(given, bench.limit(0)).where("n_hit > 0").count() == 0
    said = langid.identify(given, langid.train(given)).collect()
    assert len(said) == n and all(0 <= r.score <= 1 for r in said)
    assert {r.doc_id for r in said if r.lang_pred == "und"} == ({1, 2, 4, 5} if n else set())
    assert mixing.mix(given).select(given.columns[:4]).count() >= 0
    assert mixing.mix(given, weights={}).count() == 0
    assert jaccard.near_duplicates(given).count() == n
    assert media.describe(media.store_texts(given)).count() == n
    got = token_files.tokens_of(spark, given).collect()
    assert len(got) == n and sum(r.n_tokens for r in got) == max((r.start + r.n_tokens for r in got), default=0)
    pages = given.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "row", "label AS lost")
    assert html_text.main_text(pages).count() == n
    shards = warc.build_index(warc.write_archives(pages, new_folder(spark, "a")), new_folder(spark, "i"))
    assert warc.lookup(spark, shards, pages, "url", "page_id").count() == n


def test_language_without_labels(spark):
    assert langid.identify(docs(spark, ODD), langid.train(docs(spark, ODD).where("lang IS NULL"))).where("lang_pred <> 'und'").count() == 0


def test_lines_stay_in_the_largest_document(spark):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, ODD[-6:])).collect()}
    assert [got[i].text for i in (10, 14, 15)] == ["own 0", "own 4", ODD[-1][1]]
    assert (got[10].n_lines, got[10].n_dropped, got[15].n_dropped) == (3, 2, 0)


def test_archives_keep_payloads_and_all_captures_of_a_url(spark):
    rows = [(1, "http://a.b/x?q=1", "one"), (2, "HTTP://A.B/x?q=1#f", "two"), (3, "http://c.a.b/", "one"), (None, "http://a.b/x?q=1", "one"),
            (5, None, None), (6, "http://[bad", ""), (3, "http://c.a.b/", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages, new_folder(spark, "a"), min_bytes=1)
    shards = warc.build_index(captures, new_folder(spark, "i"))
    found = warc.lookup(spark, shards, pages.where("page_id = 2"), "url").collect()
    assert {(r.page, r.type, bytes(r.payload)) for r in found} == {(1, "response", b"one"), (2, "response", b"two"), (None, "response", b"one")}
    every = warc.lookup(spark, shards, pages, "url", "page_id").collect()
    assert len(every) == 7 and all(r.intact for r in every)
    assert sorted((r.page, r.refers_to, r.payload_bytes) for r in every if r.type == "revisit") == [(3, 1, 3), (3, 1, 3)]
    assert sorted(r.page for r in every if not r.payload_bytes) == [5, 6]


def test_archives_find_urls_with_control_characters(spark):
    urls = ["http://[bad\nx", "http://[bad\tx", "http://[bad\0x", "http://a.b/\0\n\t\r", "http://a.b/c\0", "\0", "\n", "", None]
    pages = spark.createDataFrame([(i, u, f"text {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for some in [pages] + [pages.where(f"page_id = {i}") for i in (0, 2, 5)]:
        shards = warc.build_index(warc.write_archives(some, new_folder(spark, "a")), new_folder(spark, "i"))
        found = warc.lookup(spark, shards, some, "url", "page_id").collect()
        assert sorted((r.page, bytes(r.payload)) for r in found) == sorted((r.page_id, r.html.encode()) for r in some.collect())


def test_contamination_of_a_table_with_any_column_names(spark):
    given = spark.createDataFrame([(1, "some words here", "own", 5)], "doc_id long, text string, _text string, _text_ int")
    bench = spark.createDataFrame([(1, "some words here")], "item_id int, text string")
    got = decontaminate.contamination(given, bench).first()
    assert (got._text, got._text_, got.n_hit) == ("own", 5, 3)


def test_frames_without_an_article_lose_repeated_runs(spark):
    note = "we use small files on this site to remember what you chose when you came last"
    pages = [(i, "http://h.example/%d" % i, f"<body><div>{note}</div><p>page {i} tells of thing number {i} and of nothing else at all &amp; ends</p>")
             for i in range(3)] + [(9, "http://other.example/", f"<body><div>{note}</div>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "page 1 tells of thing number 1 and of nothing else at all & ends" and got[9] == note


def test_parts_of_a_page():
    page = ("<header><h1>Site</h1></header><nav>menu</nav><article><header><h2>Title</h2>by me</header><p class=x>A<br>b <i>c</i>d<p>two"
            "<div class='share-box'>tell</div><ul><li>i<li>j</ul><section id=comments><article class=comment>no</article></section></article>"
            "<aside>side</aside><footer>foot</footer><script>a</p></script><p")
    assert [t for k, t in html_text.blocks_of(page) if k == html_text.MAIN] == ["Title", "A b cd", "two", "i", "j"]


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in texts}


def test_components_of_random_near_copies(spark):
    rng = random.Random(5)
    texts, n = {}, 0
    for _ in range(6):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(14):
            copy = [w if rng.random() > 0.02 else "new" + str(rng.random()) for w in base]
            texts[n] = " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)
            n += 1
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(given).collect()}
    assert got == brute_components(texts)


def test_chunked_shingles_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for k in rng.choice(60, 2, replace=False):
            copy[k] = f"n{rng.random()}"
        texts.append(" ".join(copy).encode())

    class Shared:
        value = np.zeros(1 << jaccard.COUNT_BITS, np.int64)

    for grams in jaccard.shingle_sets(texts):
        np.add.at(Shared.value, (grams >> np.uint64(64 - jaccard.COUNT_BITS)).astype(np.intp), 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([t.decode() for t in texts]), pa.array(range(40), pa.int64())],
                                       names=["id", "text", "label"])

    def pairs():
        rows = [r for b in jaccard._prefixes(iter([batch]), Shared, 8, 0.0) for r in b.to_pylist()]
        rows.sort(key=lambda r: r["cell"])
        packed = [pa.RecordBatch.from_pylist(rows, schema=jaccard._PACKED)]
        return {(r["a"], r["b"]) for b in jaccard._cross(iter(packed)) for r in b.to_pylist()}

    whole = pairs()
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 5)
    assert whole and pairs() == whole


def test_suffix_bound_never_exceeds_the_truth():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 80, rng.integers(1, 60))) for _ in range(2))
        assert jaccard.suffix_bound(x, y, 10**9) <= len(np.setxor1d(x, y))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.label for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_mixing_follows_the_weights(spark):
    given = docs(spark, [(i, "t", "en", "a" if i % 4 else "b") for i in range(4000)])
    got = mixing.mix(given, weights={"a": 1, "b": 3}, total=400_000)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["b"] / 300_000 - 1) < 0.01 and abs(counts["a"] / 100_000 - 1) < 0.02
    assert got.select("mix_key").distinct().count() == sum(counts.values())


def test_codes_of_every_length():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3 + [7], np.uint32)
    assert (token_files.unpack(*token_files.pack(values), len(values)) == values).all()
    with pytest.raises(ValueError):
        token_files.file_parts(token_files.file_bytes([1], np.array([2]), np.array([5, 6]))[:-1])


def test_window_search_finds_every_occurrence():
    rng = random.Random(3)
    for length in (1, 2, 3, 13):
        text = [bytes([97 + rng.randrange(3)]) for _ in range(400)]
        wanted = {tuple(text[i:i + length]): ["i"] for i in (0, 50, 400 - length)}
        got = [at for at, _ in decontaminate.WuManber(wanted, length).search(text)]
        assert got == [i for i in range(400 - length + 1) if tuple(text[i:i + length]) in wanted]


def test_many_search_tables_give_the_same_result(spark):
    given = docs(spark, [(1, LONG, "en", "a"), (2, "w5 w6 w7 zz", "en", "a")])
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 20))) for i in range(0, 900, 30)], "item_id long, text string")
    one = decontaminate.contamination(given, bench).orderBy("doc_id").collect()
    assert one == decontaminate.contamination(given, bench, table_bytes=5000).orderBy("doc_id").collect()
    assert one[0].n_hit == 600 and len(one[0].items) == 30
