"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training texts.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.  A window is `n`
consecutive words of an item; an item of fewer words, but not none, is one window.  A document
word inside any occurrence of a window is hit.  Every candidate position is verified against the
window's words themselves, so a hash collision cannot make a hit.

Edge cases: null and empty documents have no words and no hits; items with a null id or without
words have no windows; repeated item ids share their windows under one id; an empty benchmark
hits nothing; repeated document rows are scored each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, append_columns, ascii_words, discard, kept_rows, materialise, run_hashes, utf8, word_hashes

#: Bytes of benchmark text whose windows go out in one broadcast, of about four times that size, and broadcasts that
#: a worker holds.  A larger benchmark is dealt into parts by hash, and the documents are scanned in several passes.
PART_BYTES, PARTS_A_PASS = 16 << 20, 4

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Windows:
    """The windows of (item_id, text) pairs: by length, sorted hashes and where each window is in the normalised texts.

    That is about four bytes a byte of text; a window's own words are read from the texts when a hash is met.
    """

    def __init__(self, items: list[tuple], n: int):
        self.names: list[str] = []
        texts, begins, found, vocabulary = [], [], {}, []
        base = 0
        for item_id, text in items:
            words = ascii_words((text or "").encode("utf-8", "replace"))
            if item_id is None or not words:
                continue
            size = min(n, len(words))
            hashes = word_hashes(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1 + base
            first = np.concatenate([[base], ends[:-1] + 1])
            found.setdefault(size, []).append((run_hashes(hashes, size), first[: len(words) - size + 1], ends[size - 1 :]))
            vocabulary.append(np.unique(hashes))
            self.names.append(str(item_id))
            begins.append(base)
            texts.append(b" ".join(words))
            base = int(ends[-1]) + 1
        self.text, self.begins = b" ".join(texts), np.array(begins, np.int64)
        self.vocabulary = np.unique(np.concatenate(vocabulary)) if vocabulary else np.zeros(0, np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        place = np.int64 if base >= 1 << 32 else np.uint32
        for size, parts in found.items():
            hashes, first, ends = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], first[order].astype(place), ends[order].astype(place)

    def scan(self, words: list[bytes], hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """A flag for each word, and the ids of items with occurring windows; known: whether a word is in the vocabulary."""
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(known != 0)])
        for size, (keys, first, ends) in self.by_length.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(upto[size:] - upto[:-size] == size)
            if not len(starts):
                continue
            of_run = run_hashes(hashes, size, starts)
            low, high = np.searchsorted(keys, of_run, "left"), np.searchsorted(keys, of_run, "right")
            met: set[bytes] = set()
            for i, a, b in zip(*(x[high > low].tolist() for x in (starts, low, high))):
                window = b" ".join(words[i : i + size])
                if window not in met:
                    same = [k for k in range(a, b) if self.text[first[k] : ends[k]] == window]
                    if not same:
                        continue
                    met.add(window)
                    items.update(self.names[j] for j in np.searchsorted(self.begins, first[same], "right") - 1)
                hit[i : i + size] = True
        return hit, items


class Scanner:
    """Several parts of a benchmark over texts, whose words are hashed and looked up once."""

    def __init__(self, parts: list[Windows]):
        self.parts = parts
        self.ids = WordIds(1 + len(parts), self._vectors, dtype=np.uint64)

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        hashes = word_hashes(words)
        known = []
        for p in self.parts:
            at = np.searchsorted(p.vocabulary, hashes)
            known.append(p.vocabulary[np.minimum(at, len(p.vocabulary) - 1)] == hashes if len(p.vocabulary) else np.zeros(len(words), bool))
        return np.column_stack([hashes, *known])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        self.ids.trim()
        rows = self.ids.ids(words)
        rows = self.ids.rows[rows]
        hit, items = np.zeros(len(words), bool), set()
        for k, p in enumerate(self.parts):
            h, i = p.scan(words, rows[:, 0], rows[:, 1 + k])
            hit |= h
            items |= i
        return hit, items


def benchmark_parts(benchmark: DataFrame, n: int, id_col: str, text_col: str, part_bytes: int) -> Iterator[Windows]:
    """The benchmark's windows in parts of about part_bytes of text, one at a time; their number comes from its measured size."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    chosen = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    for k in range(parts):
        yield Windows([(r.i, r.t) for r in items.filter(chosen == k).collect()], n)


def _runs(hit: np.ndarray) -> np.ndarray:
    """[first, end) word ranges of consecutive hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans, ranges of code points.

    The parts of a benchmark are built and sent out one by one; a pass scans with PARTS_A_PASS of them.  With
    several passes each writes the documents with its flags, packed to bits, for the next one.
    """
    carried = T.StructType([T.StructField("__hits", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))])
    sc = docs.sparkSession.sparkContext
    sent, out, before = [], docs, None
    for part in benchmark_parts(benchmark, n, item_id, item_text, part_bytes):
        if len(sent) == PARTS_A_PASS:
            paths: list[str] = []
            out = materialise(_merge_pass(out, text_col, carried, sent, first=before is None), "decon-pass", paths)
            for b in sent:
                b.destroy()
            discard(docs.sparkSession, before or [])
            sent, before = [], paths
        sent.append(sc.broadcast(part))
    if before is None:
        return append_columns(out, text_col, FIELDS, _digester(sent))
    return _digest_carried(_merge_pass(out, text_col, carried, sent, first=False), text_col)


def _digest(text: bytes, hit: np.ndarray, items: set[str]) -> tuple:
    spans = None
    if hit.any():
        at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
        spans = [[at[a][0], at[b - 1][1]] for a, b in _runs(hit)]
    joined = ",".join(sorted(items))
    return len(hit), int(hit.sum()), len(items), hashlib.sha256(joined.encode()).hexdigest(), bool(hit.any()), spans or []


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def _digester(parts: list) -> Callable:
    def make():
        scan_words = Scanner([p.value for p in parts])

        def score(column: pa.Array) -> list[pa.Array]:
            texts = [t or b"" for t in utf8(column)]
            return _columns([_digest(t, *scan_words(ascii_words(t))) for t in texts])

        return score

    return make


def _merge_pass(docs: DataFrame, text_col: str, carried: T.StructType, parts: list, first: bool) -> DataFrame:
    names = [c for c in docs.columns if c not in carried.names]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if first else carried.names))
    schema = T.StructType([docs.schema[c] for c in names] + carried.fields)
    at = names.index(text_col)

    def run(batches):
        scan_words = Scanner([p.value for p in parts])
        for b in batches:
            hits, ids = [], []
            before = [None] * b.num_rows if first else b.column(len(names)).to_pylist()
            had = [[]] * b.num_rows if first else b.column(len(names) + 1).to_pylist()
            for text, old, old_items in zip(utf8(b.column(at)), before, had):
                hit, items = scan_words(ascii_words(text or b""))
                packed = np.packbits(hit)
                if old is not None:
                    packed |= np.frombuffer(old, np.uint8)
                hits.append(packed.tobytes())
                ids.append(sorted(items | set(old_items)))
            arrays = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(hits, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=schema.names
            )

    return source.mapInArrow(run, schema)


def _digest_carried(docs: DataFrame, text_col: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("__hits", "__items") and (c not in FIELDS.names or c == text_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in names], "__hits", "__items")
    schema = T.StructType([docs.schema[c] for c in names] + FIELDS.fields)
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            rows = []
            for text, packed, items in zip(
                utf8(b.column(at)), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            ):
                text = text or b""
                n = len(ascii_words(text))
                hit = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
                rows.append(_digest(text, hit, set(items)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + _columns(rows), names=schema.names)

    return source.mapInArrow(run, schema)


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the given code-point ranges; the caller may prefer this to dropping a document."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (mode='spans') without the hit spans of their texts."""
    if mode == "documents":
        return kept_rows(docs, text_col, lambda d, t: scan(d, benchmark, n, t), ~F.col("contaminated"))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    private = [f"__c{k}" for k in range(len(docs.columns))]
    at = private[docs.columns.index(text_col)]
    scanned = scan(docs.toDF(*private), benchmark, n, at)
    cut = F.udf(lambda t, s: None if t is None else remove_spans(t, s or []), "string", useArrow=True)
    clean = F.when(F.col("contaminated"), cut(F.col(at), F.col("hit_spans"))).otherwise(F.col(at))
    return scanned.withColumn(at, clean).select(private).toDF(*docs.columns)
