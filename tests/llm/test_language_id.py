from __future__ import annotations

import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import language_id, queries
from helixframe.llm.common import table


def test_held_out_accuracy(spark, medium):
    got = queries.op1_language_id(spark, medium)
    truth = table(spark, medium, "documents").select("doc_id", "lang")
    assert got.count() == truth.count()
    share = got.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97


def test_backoff_goes_from_long_to_short():
    rows = [(b"hello", "en", 9), (b"world", "en", 3), (b"hallo", "de", 9), (b"welt", "de", 5), (b"hello", "de", 1)]
    model = language_id.LanguageModel(rows)
    assert model.langs == ["de", "en"]
    en = model.langs.index("en")
    assert model.vectors([b"hello"])[0].argmax() == en  # a known word
    seen = {n: [g for g in language_id.grams(b"worl", n) if model.grams[n].get(g) is not None] for n in range(1, 6)}
    assert seen[5] == ["^worl"]  # the longest n-grams decide
    want = model.grams[5].get("^worl")
    assert np.allclose(model.vectors([b"worl"])[0], want - want.max())
    assert np.allclose(model.vectors(["中".encode()])[0], 0)  # nothing known at any length


def plain_vector(rows, langs, word):
    """A word's log frequencies from plain dictionaries of counts."""

    def logs(counts, key, least):
        kept = {k: c for k, c in counts.items() if sum(c.values()) >= least}
        if key not in kept:
            return None
        total = {x: sum(c.get(x, 0) for c in counts.values()) for x in langs}
        return np.array([math.log((kept[key].get(x, 0) + 0.5) / (total[x] + 0.5 * len(kept))) for x in langs])

    def pieces(w, n):
        w = w.decode()
        return list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]

    words, grams = {}, {n: {} for n in range(1, 6)}
    for w, lang, n in rows:
        words.setdefault(w, {})[lang] = words.setdefault(w, {}).get(lang, 0) + n
        for size in grams:
            for g in pieces(w, size):
                grams[size].setdefault(g, {})[lang] = grams[size].setdefault(g, {}).get(lang, 0) + n
    v = logs(words, word, 2)
    if v is None:
        for size in (5, 4, 3, 2, 1):
            if found := [x for g in pieces(word, size) if (x := logs(grams[size], g, 1)) is not None]:
                v = np.mean(found, axis=0)
                break
        else:
            return np.zeros(len(langs))
    return v - v.max()


def test_scores_against_plain_counts(spark):
    """The whole operator against dictionaries: counts, log frequencies, back-off, sums and score."""
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 3 + [("only once", "en")]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(train, 1)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = collections.Counter((w.encode(), lang) for t, lang in train for w in t.split())
    totals = collections.Counter()
    for (w, _), n in counts.items():
        totals[w] += n
    rows = [(w, lang, n) for (w, lang), n in counts.items() if totals[w] > 1]
    langs = ["de", "en", "fr"]
    texts = ["the hound and cat", "die hunde", "xyz the", "chats noirs", "zq", "?!", "", None, "12 34", "中文", "Only ONCE"]
    got = language_id.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for t, r in zip(texts, got):
        words = [w for w in re.split(r"[^a-z\u0080-\uffff]+", (t or "").lower()) if w]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = sum(plain_vector(rows, langs, w.encode()) for w in words)
        assert r.lang_pred == langs[int(np.argmax(np.round(sums, 5)))], t
        assert math.isclose(r.score, 1 / np.exp(sums - sums.max()).sum(), rel_tol=1e-4)


def test_words_of_each_language_are_kept(spark):
    """A language with few documents has its words, whatever others have."""
    docs = [(i, " ".join(f"w{k}x" for k in range(i % 7, 400)).replace("0", "o").replace("1", "i"), "a") for i in range(40)]
    docs += [(100, "lonely speech", "b"), (101, "lonely speech", "b")]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), words_per_lang=3)
    assert {b"lonely", b"speech"} <= set(model.words.number) and len(model.words.number) == 5


def test_many_languages(spark):
    docs = [(i, f"sprache{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 2, f"l{i}") for i in range(1001)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert len(model.langs) == 1001
    got = language_id.predict(frame.limit(20), model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_long_runs_are_cut_at_characters():
    words = language_id.words_of(("中" * 150).encode())
    assert [w.decode() for w in words] == ["中" * 100, "中" * 50]


def test_edges(spark, edges, no_docs):
    rows = language_id.identify(edges).collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" for i in (1, 2, 3))
    assert by_id[None].held_out is False and 0 <= by_id[4].score <= 1
    assert language_id.identify(no_docs).count() == 0
    unlabelled = language_id.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_lang_is_no_input(spark, medium):
    docs = table(spark, medium, "documents").select("doc_id", "text", "lang").limit(200)
    model = language_id.fit(docs)
    a = language_id.predict(docs, model).select("doc_id", "lang_pred", "score").collect()
    b = language_id.predict(docs.withColumn("lang", F.lit("en")), model).select("doc_id", "lang_pred", "score").collect()
    assert a == b
