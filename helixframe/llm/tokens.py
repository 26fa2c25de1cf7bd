"""Token counts of whole texts by a published tokenizer, without making token ids.

A tokenizer of the kind read here cuts a text into pre-tokens and each of these, by itself, into
pieces; so a text's count is the sum of its pre-tokens' counts.  The pieces are counted once per
distinct pre-token of the corpus: a first pass over the texts counts how often each pre-token
occurs (added up in each partition before the shuffle), and the pieces of the distinct ones are counted
into a table.  A second pass joins that table to each text's pre-token frequencies and sums: the
HOT pre-tokens, a table of bounded size, are sent to all tasks and summed in place, and
only what is left of a text, its rare pre-tokens with their frequencies, takes a shuffle join.  The
join's keys are rare by construction, so none is skewed.  The
HOT ones are those that occur most.  Pre-tokens over KEY_BYTES are known by their SHA-256, so a key is
short however long a pre-token is.

The cutting is the library's own: its normaliser, its pre-tokenizer and its model.  Where a tokenizer
drops white space, a text may be cut at ASCII white space first, and each distinct word of a task's
texts is cut once, many of them in one call.  Other tokenizers get whole texts.  Strings of added tokens inside a text are one token
each, as by the library's default; beginnings, ends, truncation and padding are left out.

Edge cases: null text counts as empty, zero bytes and zero tokens; rows that share an id or are equal
throughout are each counted; columns named like a result are replaced; other columns stay.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, append_columns, materialise, slices, utf8

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens of the table that every task gets, those that occur most; with keys of at most 65 bytes some 30 MB in a worker.
HOT = 200_000
#: Longer pre-tokens are known by their SHA-256.
KEY_BYTES = 64
#: Entries of a task's tables of words, which then start anew, and words that are cut in one call.
KEPT, TOGETHER = 400_000, 1_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits(spec: dict) -> str | None:
    """The pattern of a tokenizer in which white space ends pre-tokens and is in none, else None.

    It splits by a pattern of suffixes after an apostrophe and of classes of letters, numbers and the rest, keeps
    matches only, and normalises nothing but composition, case and runs of white space.
    """
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    plain = kept and re.fullmatch(r"(?:'\w+\|)*(?:\[(?:\^\\s)?(?:\\p\{[LN]\})+\]\+?\|?)+", pattern)
    bytewise = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
    normal = spec.get("normalizer") or {"normalizers": []}
    known = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " ")
        for n in normal.get("normalizers", [normal])
    )
    return pattern if plain and bytewise and known else None


class PreTokens:
    """The pre-tokens of texts and the numbers of their pieces, as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:  # the vocabulary is installed on every machine
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on what is around them are not read")
        pattern = _splits(spec)
        self.by_word = pattern is not None
        # The same pattern for printable ASCII, of which each byte stands for itself; words are lines.
        self._ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9") + "|\n", re.ASCII) if pattern else None
        self._runs = bool(pattern) and self._ascii.findall("azAZ") == ["azAZ"]
        self._lower = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        own = Tokenizer.from_file(path)
        self._normal, self._cut, self._model = own.normalizer, own.pre_tokenizer, own.model
        # The longest of the added tokens that start at a place is taken, from the left.
        strings = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
        self._added = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def of_text(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token is marked by a zero character before it."""
        parts = self._added.split(text) if self._added else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)
            elif part:
                part = self._normal.normalize_str(part) if self._normal else part
                out.extend(p for p, _ in self._cut.pre_tokenize_str(part)) if self._cut else out.append(part)
        return out

    def words(self, text: bytes) -> list[bytes]:
        """The parts that a text may be cut into beforehand."""
        return text.split() if self.by_word else [text] if text else []

    def of_words(self, words: list[bytes]) -> list[list[str]]:
        """The pre-tokens of each word: a word of ASCII letters is one; other printable ASCII is cut by the tokenizer's own
        pattern, and all else by the library, TOGETHER words at a time."""
        if not self.by_word:
            return [self.of_text(w.decode("utf-8", "replace")) for w in words]
        out: list[list[str]] = [[] for _ in words]
        plain, others, lower = [], [], self._lower
        for i, w in enumerate(words):
            if self._runs and w.isalpha():
                out[i].append((w.lower() if lower else w).decode("ascii"))
            elif w.isascii() and (t := w.decode("ascii")).isprintable():
                plain.append((i, t))
            else:
                others.append((i, w.decode("utf-8", "replace")))
        for some, cut in ((plain, self._by_pattern), (others, self._by_library)):
            for lo in range(0, len(some), TOGETHER):
                part = some[lo : lo + TOGETHER]
                into = [out[i] for i, _ in part]
                texts = [t for _, t in part]
                if (self._added and self._added.search(" ".join(texts))) or not cut(texts, into):
                    for own, t in zip(into, texts):
                        own[:] = self.of_text(t)
        return out

    def _by_pattern(self, texts: list[str], into: list[list[str]]) -> bool:
        text = "\n".join(texts)
        k, own = 0, into[0]
        for p in self._ascii.findall(text.lower() if self._lower else text):
            if p == "\n":
                k += 1
                own = into[k]
            else:
                own.append(p)
        return True

    def _by_library(self, texts: list[str], into: list[list[str]]) -> bool:
        """False where white space inside a word leaves open which word a pre-token is of."""
        text = " ".join(texts)
        text = self._normal.normalize_str(text) if self._normal else text
        parts = text.split(" ")
        if len(parts) != len(texts):
            return False
        k, end = 0, len(parts[0])
        for p, (start, _) in self._cut.pre_tokenize_str(text):
            while start > end:
                k += 1
                end += 1 + len(parts[k])
            into[k].append(p)
        return True

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token[:1] == "\0" else len(self._model.tokenize(pre_token))


@functools.lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One a process, since reading a vocabulary takes longer than many a batch."""
    return PreTokens(path)


def key_of(pre_token: str) -> str:
    if len(pre_token) * 4 > KEY_BYTES and len(raw := pre_token.encode()) > KEY_BYTES:
        return "\1" + hashlib.sha256(raw).hexdigest()
    return pre_token


def piece_counts(docs: DataFrame, path: str, text_col: str, tables: list[str]) -> DataFrame:
    """key, n, pieces of each distinct pre-token and how often it occurs, written; long pre-tokens travel once a partition."""

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(path)
        words: Counter[bytes] = Counter()

        def batch() -> pa.RecordBatch:
            counts: Counter[str] = Counter()
            for parts, n in zip(cut.of_words(list(words)), words.values()):
                for p in parts:
                    counts[p] += n
            words.clear()
            keys = [key_of(p) for p in counts]
            long = [p if k[:1] == "\1" else None for p, k in zip(counts, keys)]
            out = [pa.array(keys, pa.string()), pa.array(long, pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=["key", "long", "n"])

        for b in batches:
            for text in utf8(b.column(0)):
                words.update(cut.words(text or b""))
                if len(words) >= KEPT:
                    yield batch()
        if words:
            yield batch()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(path)
        for b in batches:
            whole = [k if p is None else p for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(map(cut.pieces, whole), pa.int64())], names=["key", "n", "pieces"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    distinct = texts.mapInArrow(occurring, "key string, long string, n long").groupBy("key", "long").agg(F.sum("n").alias("n"))
    return materialise(distinct.mapInArrow(count, "key string, n long, pieces long"), "token-pieces", tables)


_LEFT = T.StructType([
    T.StructField("__hot", T.LongType()),
    T.StructField("__rest", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())]))),
])


#: What most words leave: no pre-token that is not hot.
_NONE: list[str] = []


class _Words(WordIds):
    """The words of a task's texts: the pieces of their hot pre-tokens, how many others they have, and the keys of these."""

    def __init__(self, cut: PreTokens, pieces: dict[str, int]):
        super().__init__(2, self._count, KEPT, np.int64)
        self.cut, self.pieces = cut, pieces
        self.rest: list[list[str]] = []

    def _count(self, words: list[bytes]) -> np.ndarray:
        sums, left, rest, get = [], [], self.rest, self.pieces.get
        for parts in self.cut.of_words(words):
            total, others = 0, _NONE
            for p in parts:
                if (n := get(key := p if len(p) < KEY_BYTES // 4 else key_of(p))) is not None:
                    total += n
                elif others:
                    others.append(key)
                else:
                    others = [key]
            sums.append(total)
            left.append(len(others))
            rest.append(others)
        return np.array([sums, left], np.int64).T

    def trim(self) -> None:
        if self.n >= self.limit:
            self.rest = []
        super().trim()


def _summed(path: str, hot) -> Callable[[pa.Array], list[pa.Array]]:
    """For a batch of texts: the pieces of their hot pre-tokens, and the frequencies of the others."""
    cut = pre_tokens(path)
    words = _Words(cut, hot.value)

    def score(column: pa.Array) -> list[pa.Array]:
        sums, rests = [], []
        texts = [t or b"" for t in utf8(column)]
        for lo, hi in slices(texts):
            words.trim()
            ids = [words.ids(cut.words(t)) for t in texts[lo:hi]]
            table = words.rows
            for own in ids:
                found = table[own]
                sums.append(int(found[:, 0].sum()))
                rest = Counter(k for i in own[found[:, 1] > 0].tolist() for k in words.rest[i])
                rests.append([{"key": k, "n": n} for k, n in rest.items()])
        return [pa.array(sums, pa.int64()), pa.array(rests, pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())])))]

    return score


def _hot(counted: DataFrame, most: int) -> DataFrame:
    """key, pieces of at most `most` pre-tokens, those that occur oftener than any others, by classes of a 16th of an octave."""
    octave = F.floor(F.log2("n") * 16).cast("int")
    classes = counted.groupBy(octave.alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect()  # under a thousand
    least, total = None, 0
    for r in classes:
        total += r.k
        if total > most:
            break
        least = r.c
    return counted.filter(F.lit(False) if least is None else octave >= least).select("key", "pieces")


def count(docs: DataFrame, path: str | None = None, text_col: str = "text", limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """docs without their text, with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    kept: list[str] = []
    counted = piece_counts(docs, path, text_col, kept)
    sent = spark.sparkContext.broadcast({r.key: r.pieces for r in _hot(counted, hot).collect()})

    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    private = [f"__c{k}" for k in range(len(names))]
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, private)], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"), text.alias("__t"))
    summed = append_columns(source, "__t", _LEFT, lambda: _summed(path, sent)).drop("__t").withColumn("__row", F.monotonically_increasing_id())
    summed = materialise(summed, "token-rows", kept)
    rest = summed.filter(F.size("__rest") > 0).select("__row", F.inline("__rest"))
    # A key without a count cannot be; a count that was lost on the way must not pass for none.
    pieces = F.coalesce(F.col("pieces"), F.raise_error(F.lit("a pre-token was not counted")).cast("long"))
    more = rest.join(counted.select("key", "pieces"), "key", "left").groupBy("__row").agg(F.sum(F.col("n") * pieces).alias("__more"))
    tokens = (F.col("__hot") + F.coalesce("__more", F.lit(0))).cast("long")
    out = summed.join(more, "__row", "left").select(*private, F.col("__bytes").alias("n_bytes"), tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
    return out.toDF(*names, "n_bytes", "n_tokens", "over_limit")
