"""Inner-product search over randomly rotated one-bit codes.

Each vector is normalised, padded to `bits` dimensions, rotated by one random orthogonal matrix and
kept as the signs of its coordinates, together with its norm and the inner product of the rotated
unit vector with its own code.  From these an inner product with a query is estimated without
bias, and its error is bounded with high probability.  Within a block of candidates the estimates'
best give a threshold by exact products; every candidate whose estimate plus bound reaches it is
scored exactly, and only exact scores are compared.

Queries and candidates meet in blocks of bounded size, so no task holds more than one block of
each; a block hands on at most k rows a query.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows with a null id; every other row is a candidate, repeated ones and those that share an id too,
but for the rows of the query's own id; of several vectors under one query's id that of the most
components, and then the greatest in byte order, is searched for; vectors of different lengths are
not compared; ties go to the smaller id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEED = 20240917
#: Standard errors of the estimate that the bound spans.
EPSILON = 4.0
MIN_BITS = 256
#: Components of a block of candidates and of queries (at 64 a vector, 32,768 and 16,384 vectors).  What is
#: sent to the pairs of blocks falls with their size; a task holds one block of each.
CANDIDATE_CELLS, QUERY_CELLS = 1 << 21, 1 << 20
#: Small inputs are dealt into up to SPREAD blocks of LEAST_BLOCK candidates, to be shared by several tasks.
LEAST_BLOCK, SPREAD = 4096, 16
#: Estimates that a task holds at once.
ESTIMATES = 1 << 22

INDEX_SCHEMA = "vec_id long, dim int, vec binary, code binary, norm double, own double"


def code_bits(dim: int) -> int:
    """Short vectors are padded, since the estimate's error falls with the root of the code's length."""
    return max(MIN_BITS, -(-dim // 64) * 64)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of code_bits(dim) columns."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and each unit vector's inner product with its own code."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rot
    own = np.abs(turned).sum(axis=1) / math.sqrt(rot.shape[1])
    return np.packbits(turned > 0, axis=1), norm, own


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """One row a usable vector, in one pass without a shuffle: its components as doubles, code, norm and correction scalar."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))

    def run(batches):
        rotations: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(1)
            ends = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(ends)])
            for dim in np.unique(ends):
                which = np.flatnonzero(ends == dim)
                x = flat[at[which][:, None] + np.arange(dim)]
                rot = rotations.setdefault(int(dim), rotation(int(dim), seed))
                code, norm, own = encode(x, rot)
                good = np.isfinite(norm) & (norm > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[which][good]), pa.array(np.full(good.sum(), dim, np.int32)),
                        pa.array([v.tobytes() for v in x[good]], pa.binary()), pa.array([c.tobytes() for c in code[good]], pa.binary()),
                        pa.array(norm[good]), pa.array(own[good]),
                    ],
                    names=["vec_id", "dim", "vec", "code", "norm", "own"],
                )

    return rows.mapInArrow(run, INDEX_SCHEMA)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _stack(column: pa.ChunkedArray, kind, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def search_block(queries: pa.Table, candidates: pa.Table, k: int, seed: int = SEED, epsilon: float = EPSILON) -> tuple:
    """query ids, candidate ids and exact scores of each query's k best in this block of candidates."""
    out: tuple[list, list, list] = ([], [], [])
    dims = set(queries["dim"].to_pylist()) & set(candidates["dim"].to_pylist())
    for dim in sorted(dims):
        qs, cs = (t.filter(pa.compute.equal(t["dim"], dim)) for t in (queries, candidates))
        rot = rotation(dim, seed)
        bits = rot.shape[1]
        q_ids, c_ids = qs["vec_id"].to_numpy(), cs["vec_id"].to_numpy()
        q, x = _stack(qs["vec"], np.float64, len(qs)), _stack(cs["vec"], np.float64, len(cs))
        signs = np.unpackbits(_stack(cs["code"], np.uint8, len(cs)), axis=1).astype(np.float32) * 2 - 1
        norm, own = cs["norm"].to_numpy(), cs["own"].to_numpy()
        scale = norm / (own * math.sqrt(bits))
        spread = norm * np.sqrt(np.maximum(0, 1 - own**2)) / own * epsilon / math.sqrt(bits - 1)
        step = max(1, ESTIMATES // len(x))
        for lo in range(0, len(q), step):
            turned = (q[lo : lo + step] @ rot).astype(np.float32)
            guess = (turned @ signs.T).astype(np.float64) * scale
            for j, estimate in enumerate(guess, lo):
                other = c_ids != q_ids[j]
                estimate[~other] = -np.inf
                first = np.argpartition(-estimate, min(2 * k, len(x) - 1))[: 2 * k]
                scores = np.sort(exact(q[j], x[first[other[first]]]))
                least = scores[-k] if len(scores) >= k else -np.inf
                near = np.flatnonzero(other & (estimate + spread * np.linalg.norm(q[j]) >= least))
                near = np.union1d(near, first[other[first]])
                found = exact(q[j], x[near])
                best = np.lexsort((c_ids[near], -found))[:k]
                out[0].extend([q_ids[j]] * len(best))
                out[1].extend(c_ids[near[best]])
                out[2].extend(found[best])
    return out


def block_of(salt: int, blocks: int) -> Column:
    """A row's block, by its id and vector, so that the rows of one id are dealt into many."""
    return F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(blocks)).cast("int")


def search(index: DataFrame, is_query: Column, k: int = 20, seed: int = SEED, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all other rows of the index."""
    n, nq, dim = index.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    nb = max(1, -(-n * dim // CANDIDATE_CELLS), min(SPREAD, -(-n // LEAST_BLOCK)))
    nqb = max(1, -(-nq * dim // QUERY_CELLS))
    candidates = index.withColumn("cb", block_of(1, nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))))
    asked = index.filter(is_query).groupBy("vec_id").agg(F.max(F.struct("dim", "vec")).alias("asked"))
    queries = asked.select("vec_id", "asked.*").withColumn("qb", block_of(2, nqb))
    queries = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, scores = search_block(left, right, k, seed, epsilon) if len(left) and len(right) else ([], [], [])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    near = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each vector whose id is divisible by `every`, among all others."""
    index = materialise(build_index(vectors, id_col, vec_col), "ann-index")
    return search(index, F.col("vec_id") % every == 0, k)


def recall(found: pd.DataFrame, truth: pd.DataFrame) -> float:
    """The share of true (query_id, vec_id) pairs that were found."""
    want = set(zip(truth.query_id, truth.vec_id))
    return len(want & set(zip(found.query_id, found.vec_id))) / max(1, len(want))
