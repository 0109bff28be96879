"""Languages of very different sizes, and many of them."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

from tessera import llm
from tessera.llm import langid
from tests.conftest import SMALL

llm.load_all()

SHAPE = "doc_id long, lang string, text string"


def language(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8))) for _ in range(n)]


def test_a_tiny_label_draws_no_other_texts_and_keeps_its_own(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORD_SHARE", 1500)  # known from one word in 500
    rng = random.Random(1)
    words = {lang: language(lang, n) for lang, n in (("big", 300), ("tiny", 12), ("other", 300))}

    def text(lang, n):
        return " ".join(rng.choices(words[lang], k=n))

    rows = [(i, "big", text("big", 100)) for i in range(150)] + [(200 + i, "other", text("other", 100)) for i in range(20)]
    rows.append((400, "tiny", " ".join(words["tiny"])))
    model = langid.train(spark.createDataFrame(rows, SHAPE))
    assert model["langs"] == ["big", "other", "tiny"] and set(words["tiny"]) <= set(model["words"][0])
    assert len(model["words"][2]) <= 1500
    # half of the words are in no labelled text
    fresh = language("fresh", 4000)
    asked = [(i, lang, " ".join(rng.sample(fresh, 15)) + " " + text(lang, 15)) for i, lang in enumerate(["big", "other", "tiny"] * 30)]
    got = langid.identify(spark.createDataFrame(asked, SHAPE), model).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got]


def test_languages_beyond_five_hundred(spark):
    rows = [(i, f"l{i:04d}", " ".join(language(i, 6))) for i in range(520)]
    given = spark.createDataFrame(rows, SHAPE)
    got = langid.identify(given, langid.train(given)).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got]


def test_what_is_known_does_not_depend_on_how_many_texts_there_are(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORD_SHARE", 100)
    rows = [(0, "a", "often " * 60 + "rarely " + "x " * 39), (1, "b", "else " * 9 + "once")]
    for times in (1, 5):
        model = langid.train(spark.createDataFrame(rows * times, SHAPE))
        assert set(model["words"][0]) == {"often", "x", "else", "once"}  # known from one word in 50
        assert len(model["words"][2]) == 4


def test_forgotten_words_score_as_before(spark, monkeypatch):
    given = spark.createDataFrame([(i, f"l{i}", " ".join(language(i, 40))) for i in range(3)], SHAPE)
    model = langid.train(given)
    texts = [language(f"t{i}", 30) for i in range(20)]
    whole = [langid.Scorer(model).scores([t])[0] for t in texts]
    monkeypatch.setattr(langid, "REMEMBERED", 31)
    for chunk in (7, 50_000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        scorer = langid.Scorer(model)
        assert np.allclose(scorer.scores(texts[:3] + [[]] + texts[3:]), whole[:3] + [np.zeros(3)] + whole[3:])
        assert all(np.allclose(scorer.scores([t])[0], w) for t, w in zip(texts, whole))


def test_predictions_are_those_of_plain_python(spark):
    """The scorer written again without tables: frequencies, longest known n-grams, means."""
    rows = duckdb.sql(f"SELECT doc_id, lang, text FROM '{SMALL}/documents.parquet'").fetchall()
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for doc, lang, text in rows:
        if lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                words[lang][w] += 1
                for n in range(1, 6):
                    for i in range(len(w) + 3 - n):
                        grams[lang, n][f"<{w}>"[i:i + n]] += 1
    langs = sorted(words)

    def value(tables, lang, item, share):
        n = tables[lang][item]
        total = tables[lang].total()
        if n * share < total * len(langs) or not n:
            return 0.0
        mean = sum(tables[x].total() for x in langs) / len(langs)
        return math.log1p(n * mean / total / 0.5)

    def score(word):
        known = [value(words, x, word, 2_000_000) for x in langs]
        if any(known):
            return known
        for n in range(5, 0, -1):
            tables = {x: grams[x, n] for x in langs}
            found = [[value(tables, x, f"<{word}>"[i:i + n], 400_000) for x in langs] for i in range(len(word) + 3 - n)]
            found = [f for f in found if any(f)]
            if found:
                return [sum(f) / len(found) for f in zip(*found)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in llm.QUERIES["op6_langid"](spark, SMALL).collect()}
    for doc, _, text in rows:
        said = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not said:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        means = [sum(f) / len(said) for f in zip(*map(score, said))]
        share = [math.exp(m - max(means)) for m in means]
        assert got[doc].lang_pred == langs[means.index(max(means))]
        assert abs(got[doc].score - max(share) / sum(share)) < 1e-4
