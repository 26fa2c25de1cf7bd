"""Shared pieces of the text operators: table access, sampling, Arrow plumbing, joins on skewed keys.

Every operator here follows the same conventions.  Inputs are DataFrames that may carry any
extra columns; only the named ones are read.  A result column replaces an input column of the
same name.  Null text counts as empty text unless an operator says otherwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.tables import discard, fresh_path, materialise  # noqa: F401  for the operators

#: Classes that a sample may be drawn from; the table of them is sent to every task.
MAX_CLASSES = 100_000
#: Characters of a training text at most; of a longer text a window at a hashed place is taken.
WINDOW_CHARS = 20_000
#: Rows of an Arrow batch that are scored together, so that arrays stay within a few tens of MB.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------------------------------------
# Folds and bounded training samples


def fold(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out, a null id has a null fold."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def sample_by_class(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """About per_class rows of each class, chosen by a hash of the id.

    One aggregation counts the classes; a row then stays if its hash falls under per_class / count.
    The expected size is per_class times the number of classes whatever the input's size, and the
    rows are filtered where they are read, without a shuffle.  More than MAX_CLASSES classes are an
    error: such a column holds no labels, and none is dropped.
    """
    kind = rows.schema[class_col]
    counts = rows.groupBy(class_col).agg(F.count("*").alias("__n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{class_col} holds more than {MAX_CLASSES} classes")
    share = sorted((r[0], float(per_class) / r[1]) for r in counts)
    small = rows.sparkSession.createDataFrame(share, T.StructType([kind, T.StructField("__share", T.DoubleType())]))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(20177)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(small), class_col).filter(unit < F.col("__share")).drop("__share")


def window(text: str, key: str, chars: int = WINDOW_CHARS) -> Column:
    """The text, or of a longer one `chars` characters from a place that a hash of the key gives."""
    spare = F.greatest(F.length(text) - F.lit(chars - 1), F.lit(1))
    return F.substr(F.col(text), F.pmod(F.xxhash64(key, F.lit(977)), spare.cast("long")).cast("int") + 1, F.lit(chars))


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, class_col: str) -> DataFrame:
    """__id, __t and the class of the chosen ids (a bounded table): one text an id, at most WINDOW_CHARS of it."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).filter(F.col("__t").isNotNull())
    found = texts.join(F.broadcast(chosen.select("__id", class_col)), "__id").withColumn("__t", window("__t", "__id"))
    return found.groupBy("__id", class_col).agg(F.min("__t").alias("__t"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object], columns: list[str]) -> object:
    """What fit returns for a bounded sample's rows, in order of the columns; the rows meet in one executor's task.

    Only the fitted object, pickled, reaches the driver.
    """

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(utf8(c) if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    made = sample.select(columns).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])


# ----------------------------------------------------------------------------------------------
# Arrow plumbing


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most SLICE_ROWS texts and, but for a single longer text, SLICE_BYTES bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= SLICE_ROWS or size + len(t) > SLICE_BYTES):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


def append_columns(
    df: DataFrame, text_col: str, fields: T.StructType, scorer: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """df with columns computed from its text column, in one pass without a shuffle.

    scorer() is called once a task and gives a function from a string array to the new arrays.
    Input columns named like a new one are replaced.
    """
    new = set(fields.names)
    kept = [c for c in df.columns if c not in new or c == text_col]
    source = df.select([F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    keep_at = [i for i, c in enumerate(kept) if c not in new]
    schema = T.StructType([source.schema.fields[i] for i in keep_at] + fields.fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + score(batch.column(at)), names=names)

    return source.mapInArrow(run, schema)


def kept_rows(df: DataFrame, text_col: str, score: Callable[[DataFrame, str], DataFrame], keep: Column) -> DataFrame:
    """The rows of df, with exactly its columns, for which the scored frame's condition holds.

    score(frame, text column) appends its columns; it sees df under other names, so that columns of
    df that are named like them come through untouched.
    """
    private = [f"__c{k}" for k in range(len(df.columns))]
    scored = score(df.toDF(*private), private[df.columns.index(text_col)])
    return scored.filter(keep).select(private).toDF(*df.columns)


class WordIds(dict):
    """Word -> row of a growing table of vectors; unseen words are numbered at once and computed together.

    compute gives the vectors of a list of words.  The table is bounded: at `limit` words it starts
    anew, and words over KEPT_BYTES are computed each time, so a worker's memory follows neither the
    number nor the length of a corpus's words.
    """

    KEPT_BYTES = 64

    def __init__(self, width: int, compute: Callable[[list[bytes]], np.ndarray], limit: int = 250_000, dtype=np.float32):
        super().__init__()
        self.width, self.compute, self.limit = width, compute, limit
        self.table = np.zeros((1024, width), dtype)
        self.n = 0
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if len(word) <= self.KEPT_BYTES:
            self[word] = self.n
        self.fresh.append(word)
        self.n += 1
        return self.n - 1

    @property
    def rows(self) -> np.ndarray:
        if self.fresh:
            if self.n > len(self.table):
                grown = np.zeros((max(self.n, 2 * len(self.table)), self.width), self.table.dtype)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[self.n - len(self.fresh) : self.n] = np.asarray(self.compute(self.fresh)).reshape(-1, self.width)
            self.fresh = []
        return self.table

    def trim(self) -> None:
        """Call between texts: ids handed out before are void afterwards if the table was full."""
        if self.n >= self.limit:
            self.clear()
            self.n, self.fresh, self.table = 0, [], self.table[: min(len(self.table), 2 * self.limit)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


#: ASCII upper case to lower case, every other ASCII byte but letters and digits to a space;
#: bytes over 0x7F stay, so a word is a run of [0-9a-z] and non-ASCII characters.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of `size` words, or of those that begin at `starts`, from the hashes of the words."""
    n = len(hashes) - size + 1
    h = np.full(n if starts is None else len(starts), size, np.uint64)
    for k in range(size):
        h = h * _MIX + (hashes[k : n + k] if starts is None else hashes[starts + k])
        h ^= h >> np.uint64(29)
    return h


def ascii_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


# ----------------------------------------------------------------------------------------------
# Joins on keys of which a few may hold a large part of the rows


#: Keys of no more rows than this are left to the shuffle.
COOL_ROWS = 10_000
#: Rows a task of small tables whose size is known before they are written.
ROWS_A_TASK = 16_384


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """df, which has so many rows at most, in as few partitions as these need; None: not known."""
    return df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def join_by_key(
    rows: DataFrame, per_key: DataFrame, key: str, weight: str, how: str = "left", weights: tuple[int | None, int | None] | None = None
) -> DataFrame:
    """rows joined with per_key, a table of one row for each key whose column `weight` counts the key's rows.

    Keys that hold over a thousandth of all rows number under a thousand by arithmetic, whatever
    the input's size; they are broadcast, so their rows never meet in one task.  The other keys
    take a shuffle join.  `how` is left or inner; weights: the sum and the largest weight, if known.
    """
    spark = rows.sparkSession
    total, most = weights or per_key.agg(F.sum(weight), F.max(weight)).first()
    floor = max(COOL_ROWS, (total or 0) // 1000)
    if (most or 0) <= floor:
        return rows.join(per_key, key, how)
    hot = [r[0] for r in per_key.filter(F.col(weight) > floor).select(key).limit(1001).collect()]
    hot_keys = spark.createDataFrame([(k,) for k in hot], T.StructType([per_key.schema[key]]))
    marked = rows.join(F.broadcast(hot_keys.withColumn("__hot", F.lit(True))), key, "left")
    cool = marked.filter(F.col("__hot").isNull()).drop("__hot").join(
        per_key.join(F.broadcast(hot_keys), key, "left_anti"), key, how
    )
    warm = marked.filter(F.col("__hot")).drop("__hot").join(
        F.broadcast(per_key.join(F.broadcast(hot_keys), key, "left_semi")), key, "inner"
    )
    return cool.unionByName(warm)
