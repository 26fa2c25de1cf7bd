"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

A chain is a sentence, cut every CHAIN_WORDS words.  Its labels are toxic and other; a word's
features are its hashed form, prefixes and last letters, and the forms of the words beside it.
Forward-backward gives each word's marginal; a document's score is a logistic function of its
expected number of toxic words and of its largest marginal, and words whose marginal reaches one
half are its offending spans.

Labelled tokens come from labelled documents: a word of a toxic document is labelled toxic if its
form or a prefix of it is a seed, found in many toxic and hardly any other labelled documents; near
copies of a toxic document count once.  How many are enough follows from how many features there are
to choose from, and if none is enough the best ones are taken.  Seeds are counted on the executors
over the whole texts of all labelled documents outside the held-out fold, so that a language with few of them has its words
too.  The weights are fitted by one executor's task on about FIT_DOCS of these, chosen by a hash of the id,
and at most WINDOW_CHARS characters of each; these bounds hold whatever the corpus's size.

Edge cases: null and empty texts score like a text without toxic words; with no toxic or no other
label, or no word that tells them apart, every document scores 0; null labels are ignored, and of
several labels for one id the largest counts; of several texts for one id the least in byte order is
fitted; a null id is not held out and not learned from; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, WordIds, append_columns, discard, fitted, fold, held_out, kept_rows, materialise, sample_by_class, slices, texts_of, utf8

#: Labelled documents by label on which weights are fitted, about so many.
FIT_DOCS = {1: 1000, 0: 2000}
#: Labels up to which their table is sent to all tasks that read texts (some 100 MB); more are joined by a shuffle.
MAX_BROADCAST_LABELS = 2_000_000
CHAIN_WORDS = 128
BUCKETS, NEAR = 1 << 15, 1 << 13
#: A seed's toxic documents, times the log odds of that class, exceed the log of the number of features by this: that
#: any feature does so by chance has a probability of about exp(-SEED_MARGIN).
SEED_MARGIN = 4.0
SEED_RATIO = 20.0
#: Words whose features a task remembers, and features of other documents that it counts before it passes them on.
REMEMBERED_WORDS, COUNTED_FEATURES = 50_000, 300_000

FIELDS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)

#: Words are kept, sentence ends become line ends, all else becomes a space.
_TABLE = bytes(10 if c in b".!?\n" else WORD_TABLE[c] for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CLIP = 30.0


def tokens(text: bytes) -> list[bytes]:
    """Words and line ends (sentence breaks) of a text; empty strings stand between some and mean nothing."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8")
    return low.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _cuts(word: bytes) -> tuple[list[bytes], bytes]:
    """The word's prefixes of 3 to 6 characters, and its last 3."""
    if word.isascii():
        return [word[:k] for k in (3, 4, 5, 6) if len(word) > k], word[-3:]
    text = word.decode("utf-8", "replace")
    return [text[:k].encode() for k in (3, 4, 5, 6) if len(text) > k], text[-3:].encode()


def word_features(word: bytes) -> list[bytes]:
    return [b"w" + word, *(b"p" + c for c in _cuts(word)[0])]


def feature_key(feature: bytes) -> int:
    """A feature's 64-bit key, under which it is counted and kept as a seed."""
    return xxhash.xxh3_64_intdigest(feature) - (1 << 63)


def word_buckets(word: bytes, seeds: set[int]) -> list[int]:
    """The word's own features; the bucket after the last hashed one is that of seeds."""
    cuts, last = _cuts(word)
    named = [b"w" + word, *(b"p" + c for c in cuts)]
    found = [zlib.crc32(f) % BUCKETS for f in (*named, b"s" + last, b"b")]
    return found if seeds.isdisjoint(map(feature_key, named)) else [*found, BUCKETS]


def near_bucket(word: bytes) -> int:
    return zlib.crc32(word) % NEAR


class Chains:
    """The chains of a run of texts: for each word its row and document, and the chains by length."""

    def __init__(self, ids: np.ndarray, doc_of: np.ndarray):
        """ids: 0 nothing, 1 a break, others words; doc_of: each token's document."""
        at = np.flatnonzero(ids > 1)
        self.words, self.docs = ids[at], doc_of[at]
        n = len(at)
        key = np.cumsum(ids == 1)[at]
        fresh = np.ones(n, bool)
        fresh[1:] = (key[1:] != key[:-1]) | (self.docs[1:] != self.docs[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, int)
        first = (np.arange(n) - begin) % CHAIN_WORDS == 0
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        self.first, self.starts, self.lengths = first, starts[order], lengths[order]
        longest = int(lengths.max()) if n else 0
        #: how many chains have a word at each position; the words by position, and where each position begins there
        self.active = np.searchsorted(-self.lengths, -np.arange(1, longest + 1), side="right")
        self.by_position = np.concatenate([self.starts[:k] + t for t, k in enumerate(self.active)]) if n else np.zeros(0, int)
        self.begins = np.concatenate([[0], np.cumsum(self.active)])

    def marginals(self, emission: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's toxic marginal, and the forward and backward shares that give it.

        emission: log weight of toxic against other for each word; start, move: log weights.
        """
        weight = np.exp(np.clip(emission, -_CLIP, _CLIP))[self.by_position]
        m, s = np.exp(move), np.exp(start)
        f, b = np.empty(len(emission)), np.full(len(emission), 0.5)
        for t, (at, n) in enumerate(zip(self.begins, self.active)):
            w = weight[at : at + n]
            if t:
                a = f[self.begins[t - 1] :][:n]
                u0, u1 = (1 - a) * m[0, 0] + a * m[1, 0], ((1 - a) * m[0, 1] + a * m[1, 1]) * w
            else:
                u0, u1 = s[0], s[1] * w
            f[at : at + n] = u1 / (u0 + u1)
        for t in range(len(self.active) - 1, 0, -1):
            at, n = self.begins[t], self.active[t]
            after, w = b[at : at + n], weight[at : at + n]
            v0, v1 = m[0, 0] * (1 - after) + m[0, 1] * w * after, m[1, 0] * (1 - after) + m[1, 1] * w * after
            b[self.begins[t - 1] :][:n] = v1 / (v0 + v1)
        fwd, bwd = np.empty_like(f), np.empty_like(b)
        fwd[self.by_position], bwd[self.by_position] = f, b
        up = fwd * bwd
        return up / (up + (1 - fwd) * (1 - bwd)), fwd, bwd

    def emission(self, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each word's log weight: its own, and what the word before (left) and after it (right) adds."""
        total, inner = own.astype(np.float64), np.flatnonzero(~self.first)
        total[inner] += left[inner - 1]
        total[inner - 1] += right[inner]
        return total

    def moves(self, emission: np.ndarray, move: np.ndarray, fwd: np.ndarray, bwd: np.ndarray) -> np.ndarray:
        """Expected number of each pair of adjacent labels."""
        i = np.flatnonzero(~self.first)
        w, m = np.exp(np.clip(emission[i], -_CLIP, _CLIP)), np.exp(move)
        a, b = np.stack([1 - fwd[i - 1], fwd[i - 1]]), np.stack([1 - bwd[i], bwd[i] * w])
        joint = a[:, None, :] * m[:, :, None] * b[None, :, :]
        return (joint / joint.sum(axis=(0, 1))).sum(axis=2)


class ToxicModel:
    """Weights of the field and of the document score."""

    def __init__(self) -> None:
        self.theta = np.zeros(BUCKETS + 1)  # the last one is that of seed words
        self.near = np.zeros((2, NEAR))  # what a word adds to the one after it, and to the one before it
        self.seeds: set[int] = set()
        self.start, self.move = np.zeros(2), np.zeros((2, 2))
        self.head: np.ndarray | None = None  # weights of log expected count, logit of the largest marginal, and 1

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """For each word its own log weight and those that it adds to its neighbours."""
        each = [word_buckets(w, self.seeds) for w in words]
        starts = np.concatenate([[0], np.cumsum([len(e) for e in each])[:-1]])
        own = np.add.reduceat(self.theta[[k for e in each for k in e]], starts)
        return np.column_stack([own, *self.near[:, [near_bucket(w) for w in words]]])

    @staticmethod
    def summary(marginal: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
        """A row a document of what its score is a function of."""
        total = np.bincount(docs, marginal, n_docs)
        top = np.zeros(n_docs)
        np.maximum.at(top, docs, marginal)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.log(total + 1e-3), np.log(top / (1 - top)), np.ones(n_docs)], axis=1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.head, -_CLIP, _CLIP)))


def _flat(texts: list[bytes], ids: Callable[[list[bytes]], np.ndarray]) -> Chains:
    each = [ids(tokens(t) + [b"\n"]) for t in texts]
    doc_of = np.repeat(np.arange(len(texts)), [len(e) for e in each])
    return Chains(np.concatenate(each) if each else np.zeros(0, np.int32), doc_of)


def _copy_key(words: list[bytes]) -> int:
    """Near copies mostly share the least hash of their word triples."""
    return min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def enough(features: int) -> float:
    """The evidence that a seed must have, where there are so many features to choose from."""
    return math.log(max(1, features)) + SEED_MARGIN


def count_seeds(labelled: DataFrame) -> set[int]:
    """Keys of the seed features of all rows of a table of __t, a text, and __y, its label.

    A task gives the features of each toxic document with the document's copy key, and adds up those
    of its other documents, at most COUNTED_FEATURES at a time.  Only seeds reach the driver.
    """

    def run(batches):
        features: dict[bytes, list[int]] = {}
        misses: Counter = Counter()
        schema = pa.schema([("feature", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

        def rows(names, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

        for b in batches:
            texts, labels = utf8(b.column(0)), b.column(1).to_pylist()
            others = 0
            for text, label in zip(texts, labels):
                words = [w for w in tokens(text) if w and w != b"\n"]
                if len(features) > REMEMBERED_WORDS:
                    features.clear()
                found = set()
                for w in set(words):
                    if (named := features.get(w)) is None:
                        features[w] = named = [feature_key(f) for f in word_features(w)]
                    found.update(named)
                if label == 1:
                    key = _copy_key(words)
                    yield rows([*found, None], [key] * (len(found) + 1), [0] * (len(found) + 1))
                else:
                    others += 1
                    misses.update(found)
                    if len(misses) > COUNTED_FEATURES:
                        yield rows(list(misses), [None] * len(misses), list(misses.values()))
                        misses.clear()
            if others:
                yield rows([None], [None], [others])
        if misses:
            yield rows(list(misses), [None] * len(misses), list(misses.values()))

    counted = labelled.select("__t", "__y").mapInArrow(run, "feature long, key long, n long").groupBy("feature").agg(
        F.countDistinct("key").alias("hits"), F.sum("n").alias("misses")
    )
    paths: list[str] = []
    counted = materialise(counted, "tox-counts", paths)
    is_total = F.col("feature").isNull()
    toxic, other, features = counted.agg(  # documents of each label, and features of toxic ones
        F.sum(F.when(is_total, F.col("hits"))), F.sum(F.when(is_total, F.col("misses"))), F.count(F.when(~is_total & (F.col("hits") > 0), 1))
    ).first()
    seeds: set[int] = set()
    if toxic and other:
        rare = F.col("hits") / toxic >= SEED_RATIO * (F.col("misses") + 0.5) / other
        good = counted.filter(~is_total & rare)
        best = good.agg(F.max("hits")).first()[0] or 0
        least = min(enough(features) / math.log((toxic + other) / toxic), best)
        if best > 1:
            seeds = {r[0] for r in good.filter(F.col("hits") >= least).select("feature").collect()}
    discard(labelled.sparkSession, paths)
    return seeds


def fit(rows: list[tuple[bytes, int]], seeds: set[int], epochs: int = 60, rate: float = 0.3, decay: float = 1e-3) -> ToxicModel:
    """The model of (text, label) rows with the seeds given; it stays without a head if a class or every seed is missing."""
    model = ToxicModel()
    if not seeds or len({y for _, y in rows}) < 2:
        return model
    model.seeds = seeds
    vocabulary: dict[bytes, int] = {b"": 0, b"\n": 1}
    known = lambda ws: np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int32, len(ws))
    chains = _flat([t for t, _ in rows], known)
    forms = list(vocabulary)
    buckets = [word_buckets(w, seeds) for w in forms]
    label = np.array([y for _, y in rows])[chains.docs]
    gold = np.array([b[-1] == BUCKETS for b in buckets])[chains.words] & (label == 1)
    flat = np.fromiter((k for b in buckets for k in b), np.int32)
    owner = np.repeat(np.arange(len(forms), dtype=np.int32), [len(b) for b in buckets])
    beside = np.fromiter(map(near_bucket, forms), np.int32, len(forms))[chains.words]
    del buckets
    inner = np.flatnonzero(~chains.first)
    had = np.zeros((2, 2))
    np.add.at(had, (gold[inner - 1].astype(int), gold[inner].astype(int)), 1)
    begun = np.bincount(gold[chains.first].astype(int), minlength=2)
    params = [model.theta, model.near, model.start, model.move]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = 1 / max(1, gold.sum())

    def emission() -> np.ndarray:
        own = np.bincount(owner, model.theta[flat], len(forms))
        return chains.emission(own[chains.words], model.near[0][beside], model.near[1][beside])

    for step in range(1, epochs + 1):
        weights = emission()
        marginal, fwd, bwd = chains.marginals(weights, model.start, model.move)
        error = marginal - gold
        by_word = np.bincount(chains.words, error, len(forms))
        p1 = marginal[chains.first].sum()
        grads = [
            np.bincount(flat, by_word[owner], BUCKETS + 1),
            np.stack([np.bincount(beside[inner - 1], error[inner], NEAR), np.bincount(beside[inner], error[inner - 1], NEAR)]),
            np.array([chains.first.sum() - p1, p1]) - begun,
            chains.moves(weights, model.move, fwd, bwd) - had,
        ]
        for p, g, m, v in zip(params, grads, mean, square):
            g = g * scale + decay * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    marginal, _, _ = chains.marginals(emission(), model.start, model.move)
    x = model.summary(marginal, chains.docs, len(rows))
    model.head = _logistic(x, np.array([float(y) for _, y in rows]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_CLIP, _CLIP)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model from the labelled documents outside the held-out fold: seeds of all, weights of a bounded sample."""
    marked = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .filter(F.col("__y").isin(0, 1) & (fold("__id") != 0)).groupBy("__id").agg(F.max("__y").alias("__y"))
    )
    whole = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).filter(F.col("__t").isNotNull())
    few = marked.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    seeds = count_seeds(whole.join(F.broadcast(marked) if few else marked, "__id"))
    if not seeds:
        return ToxicModel()
    parts = [sample_by_class(marked.filter(F.col("__y") == y), "__id", "__y", n) for y, n in FIT_DOCS.items()]
    sample = texts_of(docs, parts[0].unionByName(parts[1]), id_col, text_col, "__y")
    return fitted(sample, lambda rows: fit([(t, y) for _, t, y in rows], seeds), ["__id", "__t", "__y"])


def score_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with score, predicted and spans (code-point ranges of toxic words), in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        model = shared.value
        cache = WordIds(3, model.vectors)

        def ids(ws: list[bytes]) -> np.ndarray:
            return cache.ids(ws)

        def score(column: pa.Array) -> list[pa.Array]:
            texts = [t or b"" for t in utf8(column)]
            if model.head is None:
                n = len(texts)
                return [pa.array([0.0] * n), pa.array([0] * n, pa.int32()), pa.array([[]] * n, pa.list_(pa.list_(pa.int32())))]
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            for lo, hi in slices(texts):
                cache.trim()
                if not cache:
                    for mark in (b"", b"\n"):
                        cache[mark]  # rows 0 and 1, as Chains expects
                chains = _flat(texts[lo:hi], ids)
                emission = chains.emission(*cache.rows[chains.words].T)
                marginal, _, _ = chains.marginals(emission, model.start, model.move)
                scores[lo:hi] = model.score(model.summary(marginal, chains.docs, hi - lo))
                ordinal = np.arange(len(marginal)) - np.searchsorted(chains.docs, chains.docs)
                for k in np.flatnonzero(marginal >= 0.5):
                    spans[lo + chains.docs[k]].append(int(ordinal[k]))
            for i, words in enumerate(spans):
                if words:
                    at = [m.span() for m in _WORD.finditer(texts[i].decode("utf-8", "replace"))]
                    spans[i] = [list(at[k]) for k in words]
            return [
                pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            ]

        return score

    return append_columns(docs, text_col, FIELDS, scorer)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted and spans of each document."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return score_documents(rows, model, "__text").select(id_col, "held_out", "score", "predicted", "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with exactly their columns, that are not predicted to be toxic."""
    model = train(docs, labels, id_col, text_col)
    return kept_rows(docs, text_col, lambda d, t: score_documents(d, model, t), F.col("predicted") == 0)
