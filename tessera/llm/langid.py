"""Language of a text: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import given, release_memory, saved

MAX_GRAM = 5
#: A word is known in a language if at least ``languages / WORD_SHARE`` of the language's words are it; an n-gram if at least
#: ``languages * MAX_GRAM / GRAM_SHARE`` of the language's n-grams of its length are. Both are frequencies, so what is known
#: doesn't depend on how many texts there are, and no table can hold more than ``WORD_SHARE`` and ``GRAM_SHARE`` rows: a
#: language has at most 1 / f items of frequency f. Texts hold about a tenth of that (some 15 MB in a worker).
WORD_SHARE = 2_000_000
GRAM_SHARE = 2_000_000
SMOOTH = 0.5
#: Words (and n-grams) that a task counts before it passes its counts on.
FLUSH = 300_000
#: Unseen words whose scores a task remembers.
REMEMBERED = 200_000
#: Words that are scored at a time.
CHUNK = 50_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; empty if no character is a letter."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if not any(w.isalpha() for w in found) and not any(c.isalpha() for c in text):
        return []
    return found


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


_COUNTS = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])


class _Counts:
    """Counts of items, a counter for each language."""

    def __init__(self):
        self.by_lang: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, items: list[str], times: int = 1) -> None:
        own = self.by_lang.setdefault(lang, Counter())
        before = len(own)
        if times == 1:
            own.update(items)
        else:
            for item, n in Counter(items).items():
                own[item] += n * times
        self.size += len(own) - before

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.by_lang.items():
            items, counts = list(own), list(own.values())
            for at in range(0, len(items), 50_000):
                part = items[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                                                  pa.array(counts[at:at + 50_000], pa.int64())], schema=_COUNTS)
        self.by_lang, self.size = {}, 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.add(lang, words_of(text))
            if counts.size > FLUSH:
                yield from counts.flushed()
    yield from counts.flushed()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each word, as often as the word; words of one count are taken together."""
    counts = _Counts()
    for batch in batches:
        for at in range(0, len(batch), 2000):
            some = batch.slice(at, 2000)
            alike: dict[tuple[str, int], list[str]] = {}
            for lang, word, n in zip(*(some.column(i).to_pylist() for i in range(3))):
                marked = f"<{word}>"
                end = len(marked) + 1
                alike.setdefault((lang, n), []).extend(
                    [marked[i:i + k] for k in range(1, MAX_GRAM + 1) for i in range(end - k)])
            for (lang, n), grams in alike.items():
                counts.add(lang, grams, n)
            if counts.size > FLUSH:
                yield from counts.flushed()
    yield from counts.flushed()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """A model from all rows with a language: how much words, and n-grams up to ``MAX_GRAM``, speak for each language.

    Counts are summed by Spark over every text; the model holds the words and n-grams frequent enough to be known
    (``WORD_SHARE``, ``GRAM_SHARE``). An item's value is the logarithm of its frequency over that of an
    absent item. Counts are first brought to one total per kind of item, the languages' mean, so the same smoothing,
    vocabulary and total hold for all languages and an absent item costs each the same, however small it is.
    NULL languages and texts add nothing. No labelled row: a model without languages.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_col)
    shape = "lang string, item string, n long"

    def summed(df: DataFrame, name: str) -> DataFrame:
        return saved(df.groupBy("lang", "item").agg(F.sum("n").alias("n")), name)

    words = summed(labelled.mapInArrow(_count_words, shape), "lang-words")
    grams = summed(words.mapInArrow(_count_grams, shape), "lang-grams")

    def sizes_of(df: DataFrame, order) -> dict[tuple[str, int], tuple[int, int]]:
        found = df.groupBy("lang", order.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        return {(r.lang, r.k): (r.n, r.kinds) for r in found.collect()}

    word_sizes, gram_sizes = sizes_of(words, F.lit(0)), sizes_of(grams, F.length("item"))
    langs = sorted({lang for lang, _ in word_sizes})
    place = {lang: i for i, lang in enumerate(langs)}

    def table(df: DataFrame, sizes: dict, share: float, order, kind) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        least = [(lang, k, n * len(langs) / share) for (lang, k), (n, _) in sizes.items()]
        if least:
            bounds = df.sparkSession.createDataFrame(least, "lang string, kind int, least double")
            df = df.withColumn("kind", kind.cast("int")).join(F.broadcast(bounds), ["lang", "kind"]).where("n >= least")
        found = df.select("lang", "item", "n").toArrow()
        items, said = found.column("item").to_pylist(), found.column("lang").to_pylist()
        index: dict[str, int] = {}
        row = np.array([index.setdefault(item, len(index)) for item in items], np.int64)
        lang = np.array([place[x] for x in said], np.int32)
        mean = {k: sum(n for (_, o), (n, _) in sizes.items() if o == k) / len(langs) for k in {o for _, o in sizes}}
        scale = {key: mean[key[1]] / n for key, (n, _) in sizes.items()}
        count = found.column("n").to_numpy() * np.array([scale[x, order(item)] for x, item in zip(said, items)])
        by_row = np.lexsort((lang, row))
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(index)))])
        return index, start, lang[by_row], np.log1p(count[by_row] / SMOOTH).astype(np.float32)

    return {"langs": langs, "words": table(words, word_sizes, WORD_SHARE, lambda item: 0, F.lit(0)),
            "grams": table(grams, gram_sizes, GRAM_SHARE / MAX_GRAM, len, F.length("item"))}


def _entries(start: np.ndarray, rows) -> np.ndarray:
    """Places of the entries of ``rows``, one row after the other."""
    rows = np.asarray(rows, np.int64)
    low = start[rows]
    n = start[rows + 1] - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class Scorer:
    """Scores of words per language; scores of unseen words are remembered up to a bound.

    Only languages in which an item is known have an entry for it, so the tables don't grow with languages times items.
    """

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, start, lang, value = model["words"]
        self.known, self.known_entries = len(self.words), len(lang)
        self.grams, self.gram_start, self.gram_lang, self.gram_value = model["grams"]
        self.start = np.concatenate([start, np.zeros(REMEMBERED + CHUNK, np.int64)])
        self.lang = np.concatenate([lang, np.zeros(4 * REMEMBERED, np.int32)])
        self.value = np.concatenate([value, np.zeros(4 * REMEMBERED, np.float32)])
        self.forget()

    def forget(self) -> None:
        self.index, self.used = dict(self.words), self.known

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean value per word and language of the longest n-grams of the word that the model knows."""
        wide, get = len(self.langs), self.grams.get
        out = np.zeros((len(words), wide))
        left = range(len(words))
        for n in range(MAX_GRAM, 0, -1):
            found, sizes, missed = [], [], []
            for i in left:
                rows = [r for r in map(get, grams_of(words[i], n)) if r is not None]
                if rows:
                    found += rows
                    sizes.append((i, len(rows)))
                else:
                    missed.append(i)
            if found:
                word, size = np.array(sizes).T
                entries = _entries(self.gram_start, found)
                of = np.repeat(np.repeat(np.arange(len(word)), size), np.diff(self.gram_start)[found])
                sums = np.bincount(of * wide + self.gram_lang[entries], self.gram_value[entries], len(word) * wide)
                out[word] = sums.reshape(-1, wide) / size[:, None]
            left = missed
        return out

    def remember(self, words: list[str]) -> None:
        step = max(1, (1 << 22) // max(1, len(self.langs)))
        for at in range(0, len(words), step):
            part = words[at:at + step]
            score = self.unseen(part)
            of, some = np.nonzero(score)
            low = self.start[self.used]
            ends = low + np.cumsum(np.bincount(of, minlength=len(part)))
            if ends[-1] > len(self.lang):
                self.lang = np.concatenate([self.lang, np.zeros(ends[-1], np.int32)])
                self.value = np.concatenate([self.value, np.zeros(ends[-1], np.float32)])
            self.lang[low:ends[-1]], self.value[low:ends[-1]] = some, score[of, some]
            self.start[self.used + 1:self.used + 1 + len(part)] = ends
            self.index.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Mean word score per text and language, all texts together; 0 for a text without words."""
        total = np.zeros(len(texts) * len(self.langs))
        sizes = np.array([len(t) for t in texts], np.int64)

        def add(words: list[str], text: np.ndarray) -> None:
            if self.start[self.used] > self.known_entries + 4 * REMEMBERED or self.used > self.known + REMEMBERED:
                self.forget()
            new = list(set(words).difference(self.index))
            if new:
                self.remember(new)
            rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            place = np.repeat(text, self.start[rows + 1] - self.start[rows])
            found = _entries(self.start, rows)
            low = int(text[0])  # only the places of these texts
            part = np.bincount((place - low) * len(self.langs) + self.lang[found], self.value[found])
            total[low * len(self.langs):low * len(self.langs) + len(part)] += part

        held, first = [], 0
        for i, words in enumerate(texts):
            held += words
            last = i == len(texts) - 1
            if len(held) >= CHUNK or last and held:
                text = np.repeat(np.arange(first, i + 1), sizes[first:i + 1])[-len(held):]
                end = len(held) if last else len(held) - len(held) % CHUNK
                for at in range(0, end, CHUNK):
                    add(held[at:at + CHUNK], text[at:at + CHUNK])
                held, first = held[end:], i
        return total.reshape(len(texts), len(self.langs)) / np.maximum(sizes, 1)[:, None]

    def best(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        if not self.langs or not texts:
            return [("und", 0.0)] * len(texts)
        score = self.scores(texts)
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        at = share.argmax(axis=1)
        return [(self.langs[j], float(share[i, j])) if texts[i] else ("und", 0.0) for i, j in enumerate(at)]


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) and ``lang_pred``, ``score``.

    ``lang_pred`` is the language of the highest mean word score, ``score`` its share after exponentiation (0 to 1).
    A known word scores its value per language (:func:`train`), any other the mean value of its longest n-grams that
    the model knows; what it costs to be absent is the same for all languages and drops out. No letter, NULL or empty text, or a model without languages:
    ``und`` and 0. Ties: the language first by name. Own ``lang_pred``/``score`` columns of ``docs`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's limits
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    others = [c for c in kept if c != text_col]  # the text is sent once, as the first column
    order = [0 if c == text_col else 1 + others.index(c) for c in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        scorer = Scorer(shared.value)
        for batch in batches:
            said, texts, held = [], [], 0
            for text in batch.column(0):
                texts.append(words_of(text.as_py()))
                held += len(texts[-1])
                if held >= CHUNK:
                    said += scorer.best(texts)
                    texts, held = [], 0
            said += scorer.best(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in order), pa.array([s[0] for s in said], pa.string()),
                 pa.array([s[1] for s in said], pa.float64())], names=[*kept, "lang_pred", "score"])

    shape = docs.select(*kept).schema
    shape = type(shape)(list(shape)).add("lang_pred", "string").add("score", "double")
    return docs.select(text_col, *others).mapInArrow(predict, shape)


def held_out(id_col: str = "doc_id"):
    """Documents that training must not see; a NULL id counts as an empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train_on_documents(docs: DataFrame) -> dict:
    return train(docs.where(~held_out()).select("lang", "text"))


@query("op6_langid")
def op6_langid(spark, sf_dir):
    docs = given(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train_on_documents(docs), keep=["doc_id", "held_out"])
