"""Mixing sources to target weights with soft membership.

A softmax classifier, trained on a labelled table, gives each document's posterior over domains.
A nonnegative rate a document is then fitted, such that the expected tokens of each domain, the sum
over documents of rate x tokens x posterior, match the targets.  The fit is projected-gradient
least squares from rates of one: an iteration sums K totals and a K x K matrix over all documents and
steps each document's rate by the inner product of its posterior with K weighted residuals, cut at zero.  Only
these sums meet on the driver; a document's rate is a function of its posterior and of the steps so far.

Learning uses a sample of about DOCS_PER_DOMAIN documents a domain, chosen by a hash of the id, and
at most WINDOW_CHARS characters of each; one executor's task fits it.  The sums and rates cover
every document.  The fit ends when the targets are met.  If a step shows that no rates can meet them (a
direction in which every posterior lies on one side and the targets on the other), it ends when it
no longer gains; a warning then names the shares reached and the error that remains at least.

Edge cases: null and empty texts have no tokens, a posterior like any other text, and a rate, but
weigh nothing; unlabelled documents are mixed like labelled ones; null labels or domains are ignored
and of several for one id the largest counts; a domain without labelled documents cannot be
predicted, its target is dropped and the other targets are rescaled; a domain without a target
keeps its share; if nothing is labelled every rate is one; repeated rows get equal rates; of several
texts for one id the least in byte order is learned from.
"""

from __future__ import annotations

import logging
import zlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, WordIds, append_columns, discard, fitted, fold, materialise, sample_by_class, slices, texts_of, utf8

DOCS_PER_DOMAIN = 400
LEXICAL, SHAPES = 512, 24
DENSE = 5
#: Iterations of the fit at most, those whose rates are recomputed in one expression, those in which the error must
#: fall by a tenth when targets are out of reach, those that may be worse than one before them, and the error to stop at.
MAX_STEPS, CHAIN_STEPS, STALL, REMEMBERED, TOLERANCE = 500, 10, 10, 6, 1e-4

_LOG = logging.getLogger(__name__)

# ----------------------------------------------------------------------------------------------
# Classifier


def _shape(token: bytes) -> int:
    """Coarse form of a token: letters' case, digits, and what is around them."""
    core = token.strip(b".,;:!?")
    marks = len(token) - len(token.rstrip(b"!?*$%&#"))
    text = core if core.isascii() else core.decode("utf-8", "replace")
    letters = text.lower() != text.upper() if core.isascii() else any(c.isalpha() for c in text)
    case = 0 if not letters else 1 if text.islower() else 2 if text.isupper() and len(text) > 1 else 3
    digits = core.translate(None, b"0123456789") != core if core.isascii() else any(c.isdigit() for c in text)
    return (case * 3 + min(marks, 2)) * 2 + digits


def _token_buckets(tokens: list[bytes]) -> np.ndarray:
    """For each token the bucket of its lower-cased word, and that of its shape."""
    low = [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode("utf-8") for t in tokens]
    return np.array([(zlib.crc32(w.translate(WORD_TABLE).strip()) % LEXICAL, LEXICAL + _shape(t)) for w, t in zip(low, tokens)])


class Features:
    """Texts to rows of numbers: hashed words, token shapes, and measures of repetition and length."""

    width = LEXICAL + SHAPES + DENSE

    def __init__(self) -> None:
        self.ids = WordIds(2, _token_buckets, dtype=np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the number of tokens of each text."""
        self.ids.trim()
        each = [self.ids.ids(t.split()) for t in texts]
        n = np.array([len(e) for e in each])
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(texts)), n)
        pairs = self.ids.rows[flat]
        hist = np.bincount((owner[:, None] * self.width + pairs).ravel(), minlength=len(texts) * self.width)
        x = np.sqrt(hist.reshape(len(texts), -1) / np.maximum(1, n)[:, None])
        same = np.bincount(owner[1:][(flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
        kinds = np.array([len(np.unique(e)) for e in each])
        chars = np.array([len(t) for t in texts])
        lines = np.array([t.count(b"\n") for t in texts])
        safe = np.maximum(1, n)
        x[:, -DENSE:] = np.stack([same / safe, kinds / safe, np.log1p(n) / 8, chars / safe / 10, lines / safe], axis=1)
        return x.astype(np.float32), n


@dataclass
class DomainModel:
    """Softmax weights over standardised features."""

    domains: list[str]
    centre: np.ndarray = field(default_factory=lambda: np.zeros(Features.width, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(Features.width, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((Features.width, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) / self.scale) @ self.weights + self.bias
        e = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
        return e / e.sum(axis=1, keepdims=True)


def fit_domains(rows: list[tuple[bytes, str]], steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> DomainModel:
    """Softmax regression on (text, domain) rows by Adam."""
    model = DomainModel(sorted({d for _, d in rows}))
    if not rows:
        return model
    make = Features()
    texts = [t for t, _ in rows]
    x = np.concatenate([make(texts[lo:hi])[0] for lo, hi in slices(texts)])
    y = np.zeros((len(rows), len(model.domains)), np.float32)
    y[np.arange(len(rows)), [model.domains.index(d) for _, d in rows]] = 1
    weight = (1 / np.maximum(1, y.sum(axis=0)))[y.argmax(axis=1)][:, None] / len(model.domains)
    prior = y.sum(axis=0) / len(rows)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - model.centre) / model.scale
    model.weights, model.bias = np.zeros((z.shape[1], y.shape[1]), np.float32), np.log(prior).astype(np.float32)
    moments = [np.zeros_like(p) for p in (model.weights, model.weights, model.bias, model.bias)]
    for t in range(1, steps + 1):
        p = model.posterior(x).astype(np.float32)
        err = (p - y) * weight
        grads = (z.T @ err + decay * model.weights, err.sum(axis=0))
        for k, (param, g) in enumerate(zip((model.weights, model.bias), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return model


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DomainModel:
    """A model from the labelled documents outside the held-out fold, by way of a bounded sample."""
    marked = (
        labelled.select(F.col(id_col).alias("__id"), F.col(domain_col).cast("string").alias("__d"))
        .filter(F.col("__d").isNotNull() & (fold("__id") != 0)).groupBy("__id").agg(F.max("__d").alias("__d"))
    )
    sample = texts_of(docs, sample_by_class(marked, "__id", "__d", DOCS_PER_DOMAIN), id_col, text_col, "__d")
    return fitted(sample, lambda rows: fit_domains([(t, d.decode("utf-8", "replace")) for _, t, d in rows]), ["__id", "__t", "__d"])


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and posterior, one probability a domain, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def scorer():
        model, make = shared.value, Features()

        def score(column: pa.Array) -> list[pa.Array]:
            texts = [t or b"" for t in utf8(column)]
            counts, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(model.domains)))]
            for lo, hi in slices(texts):
                x, n = make(texts[lo:hi])
                counts.append(n)
                shares.append(model.posterior(x) if model.domains else np.zeros((hi - lo, 0)))
            flat = np.concatenate(shares)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * flat.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel(), pa.float64()))
            return [pa.array(np.concatenate(counts), pa.int64()), lists]

        return score

    return append_columns(docs, text_col, fields, scorer)


# ----------------------------------------------------------------------------------------------
# Fit of the rates


def _stepped(rate: Column, moves: list[np.ndarray], k: int) -> Column:
    """The rate after a step along each of the moves, one number a domain."""
    for c in moves:
        move = reduce(lambda a, b: a + b, [F.lit(float(c[j])) * F.col(f"p{j}") for j in range(k)])
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def _sums(base: DataFrame, moves: list[np.ndarray], k: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """In one pass: all tokens; the tokens of each domain at the stepped rates; the Gram matrix of the posteriors of the
    documents whose rate is not zero; and the least inner product of a document's posterior with the last move.

    A task adds up a matrix of K rows, the rows of all tasks are added on the executors, and K rows come to the driver.
    """

    def run(batches):
        total, had, gram, low = 0.0, np.zeros(k), np.zeros((k, k)), np.inf
        for b in batches:
            if not b.num_rows:
                continue
            t, rate, *columns = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)
            p = np.stack(columns, axis=1)
            for c in moves:
                rate = np.maximum(0, rate - p @ c)
            total += t.sum()
            had += (t * rate) @ p
            used = rate > 0
            gram += (p[used] * t[used, None]).T @ p[used]
            if moves and (t > 0).any():
                low = min(low, float((p[t > 0] @ moves[-1]).min()))
        rows = np.column_stack([np.full(k, total), had, gram])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([low] * k)], names=["j", "v", "low"])

    def add(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, float) for x in t["v"].to_pylist())
        return pa.table({"j": t["j"][:1], "v": pa.array([v.tobytes()], pa.binary()), "low": pa.array([min(t["low"].to_pylist())])})

    schema = "j long, v binary, low double"
    parts = base.select("n_tokens", "rate", *[f"p{j}" for j in range(k)]).mapInArrow(run, schema)
    found = sorted(parts.groupBy("j").applyInArrow(add, schema).collect(), key=lambda r: r.j)
    if not found:
        return 0.0, np.zeros(k), np.zeros((k, k)), np.inf
    v = np.array([np.frombuffer(r.v, float) for r in found])
    return float(v[0, 0]), v[:, 1], v[:, 2:], found[0].low


def _inverse(gram: np.ndarray) -> np.ndarray:
    """The inverse over the directions in which the posteriors differ."""
    values, vectors = np.linalg.eigh(gram)
    there = values > 1e-12 * max(values[-1], 1e-300)
    return (vectors[:, there] / values[there]) @ vectors[:, there].T


def out_of_reach(move: np.ndarray, low: float, targets: np.ndarray) -> float:
    """What the largest error is at least, whatever the rates are, by a move and its least product with a posterior.

    Posteriors sum to one, so the move less `low` has no negative product with any of them, and none with
    what nonnegative rates can give; a negative product with the targets is then an error that remains.
    """
    raised = move - low
    size = np.abs(raised).sum()
    return float(-(targets @ raised) / size) if size and np.isfinite(low) else 0.0


def fit_rates(rows: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """rows with `rate`, and the fit's report.

    rows: n_tokens and p0..pK-1, one row a document; targets: K shares of all tokens, of which those that
    are NaN stand for the share that the domain has, and the others are scaled to what these leave.

    The least squares weigh residuals by the inverse of the posteriors' Gram matrix, so that a step of length one
    meets the targets at once as long as no rate is cut at zero, however alike the posteriors are.  Where rates are cut, the
    matrix of the documents that are not is taken, unless the squares have not fallen below the largest of the last few steps.
    The fit ends when the targets are met.  If they are shown to be out of reach, plain steps from rates of one
    lead down to where STALL of them no longer gain a tenth.

    Every CHAIN_STEPS steps the rates are written out, so that no expression grows with the steps.
    """
    k, spark = len(targets), rows.sparkSession
    one = rows.withColumn("rate", F.lit(1.0))
    report = {"steps": 0, "error": None, "tokens": 0.0, "met": True, "least_error": 0.0}
    total, had, full, _ = _sums(one, [], k) if k else (0.0, None, None, 0.0)
    report["tokens"] = total
    if not total:
        return one, report
    gram = full = full / total
    share, kept = gram.sum(axis=1), np.isnan(targets)
    rest, wanted = 1 - share[kept].sum(), np.where(kept, 0, targets)
    targets = np.where(kept, share, wanted / wanted.sum() * rest if wanted.sum() else 0)
    whole = _inverse(full)
    base, moves, written = one, [], []
    squares: list[float] = []
    best, stalled, least, plain = np.inf, 0, 0.0, False
    while True:
        residual = had / total - targets
        error = float(np.abs(residual).max())
        best, stalled = (error, 0) if error < 0.9 * best else (best, stalled + 1)
        if error < tolerance or report["steps"] >= max_steps or (plain and stalled >= STALL):
            report |= {"error": error, "shares": (residual + targets).tolist(), "targets": targets.tolist(), "met": error < tolerance, "least_error": least}
            return base.withColumn("rate", _stepped(F.col("rate"), moves, k)), report
        squares.append(float(residual @ whole @ residual))
        steep = not plain and gram.any() and squares[-1] <= max(squares[-1 - REMEMBERED : -1], default=np.inf)
        move = (_inverse(gram) if steep else whole) @ residual
        if len(moves) == CHAIN_STEPS:
            before, written = written, []
            base, moves = materialise(base.withColumn("rate", _stepped(F.col("rate"), moves, k)), "mix-rates", written), []
            discard(spark, before)
        moves.append(move)
        report["steps"] += 1
        _, had, gram, low = _sums(base, moves, k)
        gram = gram / total
        least = max(least, out_of_reach(move, low, targets))
        if least > tolerance and not plain:
            plain, base, moves, best, stalled = True, one, [], np.inf, 0
            had, gram = share * total, full


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_tokens, domain (the likeliest), posterior, rate and expected tokens of each document.

    labelled: id and domain; targets: domain -> share of the mixed tokens.
    """
    model = train(docs, labelled, id_col, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    k = len(model.domains)
    columns = [F.col("posterior")[j].alias(f"p{j}") for j in range(k)]
    scored = materialise(posteriors(rows, model, "__text").select(id_col, "n_tokens", *columns), "mix-posteriors")
    rated, report = fit_rates(scored, np.array([float(targets.get(d, np.nan)) for d in model.domains]))
    if not report["met"]:
        reached = ", ".join(f"{d} {a:.4f} of {b:.4f}" for d, a, b in zip(model.domains, report["shares"], report["targets"]))
        _LOG.warning("targets are not met after %d steps, with an error of %.4g where %.4g is the least: %s", report["steps"], report["error"], report["least_error"], reached)
    best = F.lit(None).cast("string")
    if k:
        top = F.greatest(*[F.col(f"p{j}") for j in range(k)]) if k > 1 else F.col("p0")
        best = F.coalesce(*[F.when(F.col(f"p{j}") == top, d) for j, d in enumerate(model.domains)])
    posterior = F.array(*[F.round(f"p{j}", 9) for j in range(k)]).cast("array<double>")
    rate = F.round("rate", 9)
    return rated.select(
        id_col, "n_tokens", best.alias("domain"), posterior.alias("posterior"), rate.alias("rate"),
        F.round(F.col("rate") * F.col("n_tokens"), 6).alias("expected_tokens"),
    )


def copies(mixed: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """mixed with `copies`: the rate rounded up or down at random, by a hash of the id, so that its mean is the rate."""
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return mixed.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))


def language_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled table of the query: a document's domain is its language with its quality mark."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("__q"))
    return docs.filter(F.col("lang").isNotNull()).join(marks, id_col).select(
        id_col, F.concat_ws(":", "lang", F.when(F.col("__q") == 1, "good").otherwise("poor")).alias("domain")
    )
