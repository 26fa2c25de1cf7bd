"""Language identification by word-first backoff.

A known word adds its log frequency in each language.  An unseen word backs off to its character
n-grams, padded with word marks: the longest length of which any n-gram is known decides, and the
mean log frequency of the known n-grams is added.  The language of the largest sum wins; the score
is its share after normalising the sums over the languages.

Counts come from a sample of about `docs_per_lang` labelled documents a language, chosen by a hash
of the id, at most WINDOW_CHARS characters of each; of each language the `words_per_lang` most
frequent words are kept, if they were seen twice.  These bounds hold whatever the corpus's size;
every text is scored whole.

Edge cases: null text, empty text and text without a letter get `und` and score 0, as does every
text if nothing was learned; ties go to the language that sorts first; a document whose id is null
is not held out and not learned from.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, WordIds, append_columns, discard, fold, held_out, materialise, sample_by_class, slices, utf8, window

DOCS_PER_LANG = 1500
WORDS_PER_LANG = 20_000
MAX_GRAM = 5
#: A run of more letters counts as pieces of that length.
MAX_WORD_CHARS = 100
SMOOTHING = 0.5

#: Like common.WORD_TABLE, but digits are no part of a word either.
LETTER_TABLE = bytes(32 if 48 <= c <= 57 else WORD_TABLE[c] for c in range(256))

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def words_of(text: bytes) -> list[bytes]:
    """Words of a text's UTF-8 bytes: runs of letters after lower-casing; other scripts' signs stay in."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8")
    words = low.translate(LETTER_TABLE).split()
    if max(map(len, words), default=0) <= MAX_WORD_CHARS:
        return words
    long = (w.decode("utf-8", "replace") for w in words)
    return [w[i : i + MAX_WORD_CHARS].encode("utf-8") for w in long for i in range(0, len(w), MAX_WORD_CHARS)]


def has_letter(words: list[bytes]) -> bool:
    return any(unicodedata.category(c)[0] == "L" for w in words for c in w.decode("utf-8", "replace"))


def grams(word: bytes, n: int) -> list[str]:
    marked = f"^{word.decode('utf-8', 'replace')}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(marked[1:-1])


class _Table:
    """Counts by key and language, and then the log frequencies of the kept keys: a number a key, a row a number."""

    def __init__(self, width: int):
        self.width, self.number, self.at, self.lang, self.n = width, {}, [], [], []

    def add(self, key, lang: int, n: int) -> None:
        self.at.append(self.number.setdefault(key, len(self.number)))
        self.lang.append(lang)
        self.n.append(n)

    def close(self, least: int = 1) -> None:
        """Keep keys that were counted at least that often, as log frequencies with SMOOTHING added to each count."""
        counts = np.zeros((len(self.number), self.width))
        np.add.at(counts, (self.at, self.lang), self.n)
        total = counts.sum(axis=0)
        kept = counts.sum(axis=1) >= least
        place = np.cumsum(kept) - 1
        self.number = {k: int(place[i]) for k, i in self.number.items() if kept[i]}
        spread = np.log(total + SMOOTHING * max(1, kept.sum()))
        self.logs = (np.log(counts[kept] + SMOOTHING) - spread).astype(np.float32)
        self.at = self.lang = self.n = None

    def get(self, key) -> np.ndarray | None:
        i = self.number.get(key)
        return None if i is None else self.logs[i]


class LanguageModel:
    """Log frequencies of words and n-grams for each language, from (word, language, count) rows."""

    def __init__(self, rows: list[tuple[bytes, str, int]], max_gram: int = MAX_GRAM):
        self.langs = sorted({lang for _, lang, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.words = _Table(len(self.langs))
        self.grams = [_Table(len(self.langs)) for _ in range(max_gram + 1)]
        for word, lang, n in rows:
            self.words.add(word, at[lang], n)
            for size in range(1, max_gram + 1):
                for g in grams(word, size):
                    self.grams[size].add(g, at[lang], n)
        self.words.close(least=2)
        for t in self.grams:
            t.close()

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to each language's sum, less the best language's part; nothing if none of its n-grams is known."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = []
        for i, word in enumerate(words):
            if (at := self.words.number.get(word)) is None:
                left.append((i, word))
            else:
                out[i] = self.words.logs[at]
        for size in range(len(self.grams) - 1, 0, -1):
            get = self.grams[size].number.get
            rows, flat, counts, unknown = [], [], [], []
            for i, word in left:
                if found := [k for k in map(get, grams(word, size)) if k is not None]:
                    rows.append(i)
                    flat += found
                    counts.append(len(found))
                else:
                    unknown.append((i, word))
            if rows:
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                out[rows] = np.add.reduceat(self.grams[size].logs[flat], starts, axis=0) / np.array(counts, np.float32)[:, None]
            left = unknown
        return out - out.max(axis=1, keepdims=True) if self.langs else out


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG,
) -> LanguageModel:
    """A model from the labelled rows of docs; the counts are summed on the executors."""
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(
        (F.coalesce(F.length("t"), F.lit(0)) > 0) & F.col("l").isNotNull()
    )
    chosen = sample_by_class(labelled, "i", "l", docs_per_lang).withColumn("t", window("t", "i"))

    def count(batches):
        for b in batches:
            sums: dict[tuple[str, bytes], int] = {}
            for text, lang in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for w in words_of(text):
                    sums[lang, w] = sums.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for _, w in sums], pa.binary()),
                    pa.array([lang for lang, _ in sums], pa.string()),
                    pa.array(list(sums.values()), pa.int64()),
                ],
                names=["word", "lang", "n"],
            )

    counted = chosen.select("t", "l").mapInArrow(count, "word binary, lang string, n long")
    # Written first, so that the words are chosen on the executors and only the kept ones come here.
    paths: list[str] = []
    counted = materialise(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")), "language-words", paths)
    twice = counted.groupBy("word").agg(F.sum("n").alias("total")).filter("total > 1").select("word")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counted.join(twice, "word").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= words_per_lang)
    rows = counted.join(best.select("word").distinct(), "word").select("word", "lang", "n").collect()
    discard(docs.sparkSession, paths)
    return LanguageModel([(bytes(r.word), r.lang, r.n) for r in sorted(rows)])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        model = shared.value
        width = max(1, len(model.langs))
        ids = WordIds(width, model.vectors)

        def score(column: pa.Array) -> list[pa.Array]:
            texts = [t or b"" for t in utf8(column)]
            langs, shares = [], []
            for lo, hi in slices(texts):
                ids.trim()
                split = [words_of(t) for t in texts[lo:hi]]
                sums = np.zeros((hi - lo, width))
                if model.langs:
                    full = [k for k, words in enumerate(split) if words]
                    if full:
                        each = [ids.ids(split[k]) for k in full]
                        ends = np.cumsum([len(e) for e in each])
                        picked = ids.rows[np.concatenate(each)].astype(np.float64)
                        sums[full] = np.add.reduceat(picked, np.concatenate([[0], ends[:-1]]), axis=0)
                for words, row in zip(split, sums):
                    if not model.langs or not words or not has_letter(words):
                        langs.append("und")
                        shares.append(0.0)
                    else:
                        best = int(row.argmax())
                        langs.append(model.langs[best])
                        shares.append(1.0 / sum(math.exp(min(0.0, x - row[best])) for x in row))
            return [pa.array(langs, pa.string()), pa.array(shares, pa.float64())]

        return score

    return append_columns(docs, text_col, FIELDS, scorer)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of each document, learned from the folds that are not held out."""
    model = fit(docs.filter(fold(id_col) != 0), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, model, "__text").select(id_col, "held_out", "lang_pred", "score")
