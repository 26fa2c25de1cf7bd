"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  Documents of one set are folded first.  Each set
is embedded as COORDINATES tokens, its min-hashes; two sets share a token with a chance equal to
their Jaccard similarity.  A run puts the sets into buckets by their token at one coordinate; a
bucket of at most LEAF sets is compared by brute force on the embeddings, a larger one is split
again by one or by two coordinates, half of the buckets each, that its key chooses.  So a pair at
the threshold has 1.2 chances on average to stay together at each split, and its chance to be in
one leaf does not vanish with the depth.  Runs are repeated until a pair at the threshold is found
with the target recall: first as many as USUAL_LEVEL levels need, then, for sets in buckets that are
split further, as many as the deepest level reached needs.  A large bucket is not split if all but
LEAF of its sets are near its first one: these are one group, and the others are compared with all.
One that is still large at the last level shares that many sampled tokens; its sets are linked
without comparison, since all links are verified.

What the runs find are candidate groups, not results: the shingle sets of each connected candidate
group are brought together once, in blocks of bounded size, and every pair of the group is
compared exactly.  Links between sets are counted there, weighted by the number of documents of
each set; pairs are never written out.

Result: a row a document with class_id, the least doc_id of its connected class, and n_links, the
number of other documents whose similarity is at least the threshold.

Edge cases: ids are integers; a text of fewer than five words is one shingle; null and empty texts
have none, and are a class of their own without links; equal sets are similar; the threshold itself
counts; repeated ids are documents of their own, and null ids take no part (null class, no links).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, WordIds, discard, few, join_by_key, materialise, run_hashes, slices, utf8, word_hashes
from .components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, LEVELS, LEAF = 64, 10, 2048
#: Levels at which most buckets are small enough; the first runs are counted for it.
USUAL_LEVEL = 2
#: Estimates within so many standard errors under the threshold are candidates.
SLACK = 3.5
#: The most sets and shingles of a block of a candidate group; a group of some size is dealt into up to SPREAD
#: blocks of at least LEAST_SETS even below these, so that its comparison is shared by several tasks.
BLOCK_SETS, BLOCK_SHINGLES, LEAST_SETS, SPREAD = 2048, 1_500_000, 256, 16
COLUMNS = 2048
#: Pairs of embeddings of small buckets that a task compares at once, and the size from which it compares set by set.
PAIRS, BY_SET = 1 << 17, 64
SEED = 7919

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def chance(similarity: float, levels: int) -> float:
    """Of a pair that agrees on such a share of the coordinates, the chance to be in one bucket of a run after its last level."""
    below = 1.0
    for _ in range(levels - 1):
        below = 0.5 * similarity * below + 0.5 * (1 - (1 - similarity * below) ** 2)
    return similarity * below


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, levels: int = USUAL_LEVEL) -> int:
    """Runs after which a pair at the threshold was once in one bucket of that many levels with that chance.

    All runs draw on the same coordinates, so they are independent only given how many of those the pair shares.
    """
    share = [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    missed = [1 - chance(k / COORDINATES, levels) for k in range(COORDINATES + 1)]
    runs = 1
    while sum(p * m**runs for p, m in zip(share, missed)) > 1 - recall:
        runs += 1
    return runs


# ----------------------------------------------------------------------------------------------
# Sets


def set_words(text: bytes) -> list[bytes]:
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8")
    return low.translate(WORD_TABLE).split()


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.ids = WordIds(1, word_hashes, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        self.ids.trim()
        out = []
        for text in texts:
            words = set_words(text)
            if not words:
                out.append(np.zeros(0, np.uint64))
                continue
            at = self.ids.ids(words)
            w = self.ids.rows[at, 0]
            out.append(np.unique(run_hashes(w, min(self.n, len(w))) * _MIX2))
        return out


class Embedding:
    """Min-hash tokens of sets."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of 32-bit tokens a set; the sets are not empty."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            out[:, i] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts)
        return out


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, print (of the set, 16 bytes) and tokens of each document with an id."""

    def run(batches):
        make, tokens = Shingler(), Embedding()
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(1))]
            for lo, hi in slices(texts):
                sets = make(texts[lo:hi])
                full = [k for k, s in enumerate(sets) if len(s)]
                codes: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, tokens([sets[k] for k in full])):
                        codes[k] = row.tobytes()
                prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(prints, pa.binary()), pa.array(codes, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "print", "tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("doc_id is not null").mapInArrow(run, "doc_id long, n_shingles int, print binary, tokens binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their group starts, from batches sorted by their first `keys` columns of longs."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        fresh = np.ones(len(t), bool)
        if len(t):
            same = np.ones(len(t) - 1, bool)
            for k in range(keys):
                x = t.column(k).to_numpy()
                same &= x[1:] == x[:-1]
            fresh[1:] = ~same
        return np.flatnonzero(fresh)

    for b in batches:
        now = pa.Table.from_batches([b])
        rest = now if rest is None else pa.concat_tables([rest, now])
        at = starts(rest)
        if len(at) > 1:
            yield rest.slice(0, at[-1]), at[:-1]
            rest = rest.slice(at[-1]).combine_chunks()
    if rest is not None and len(rest):
        yield rest, starts(rest)


# ----------------------------------------------------------------------------------------------
# Candidate groups by chosen paths


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def root_keys(tokens: np.ndarray, runs: range) -> np.ndarray:
    """The key of each set's first bucket in each run, a row a set; tokens: a row of 64-bit numbers a set."""
    order = np.random.default_rng(SEED + 1).permutation(COORDINATES)
    return np.stack([_mixed(_mixed(tokens[:, order[r % COORDINATES]] + np.uint64(r + 1)) ^ np.uint64(r + 1)) for r in runs], axis=1)


def split_keys(keys: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the buckets into which each row's bucket is split, by one coordinate or by two."""
    drawn = _mixed(keys)
    rows = np.arange(len(keys))
    first = (drawn % np.uint64(COORDINATES)).astype(int)
    second = (first + 1 + (drawn >> np.uint64(8)).astype(int) % (COORDINATES - 1)) % COORDINATES
    both = (drawn >> np.uint64(60)) % np.uint64(2) == 1
    one = _mixed(drawn ^ _mixed(tokens[rows, first] + np.uint64(1)))
    two = _mixed((drawn + np.uint64(1)) ^ _mixed(tokens[rows, second] + np.uint64(1)))
    return np.concatenate([rows, rows[both]]), np.concatenate([one, two[both]])


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1).astype(np.uint64)


def _roots(sets: DataFrame, runs: range) -> DataFrame:
    """node and key of each set's first bucket in each run."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = root_keys(_unpacked(b.column(1)), runs)
                nodes = np.repeat(b.column(0).to_numpy(), len(runs))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.view(np.int64).ravel())], names=["node", "key"])

    return sets.select("node", "tokens").mapInArrow(run, "node long, key long")


def _against_pivots(rows: DataFrame, least: float) -> DataFrame:
    """key, node, m, n, near (whether the node's embedding is near that of the bucket's pivot m) and the keys of its next buckets.

    rows: key, node, m, n, tokens and pivot, the tokens of m.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            tokens, pivots = _unpacked(b.column(4)), _unpacked(b.column(5))
            at, keys = split_keys(b.column(0).to_numpy().view(np.uint64), tokens)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(b.num_rows + 1)).astype(np.int32)
            near = (tokens == pivots).sum(axis=1) >= least * tokens.shape[1]
            next_keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near), next_keys], names=["key", "node", "m", "n", "near", "next"])

    kind = "key long, node long, m long, n long, near boolean, next array<long>"
    return rows.select("key", "node", "m", "n", "tokens", "pivot").mapInArrow(run, kind)


def near_pairs(tokens: np.ndarray, size: int, starts: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the buckets of that size whose tokens agree on at least that share."""
    enough = math.ceil(least * tokens.shape[1])
    if size <= BY_SET:
        ia, ib = np.triu_indices(size, 1)
        some = max(1, PAIRS // len(ia))
        for lo in range(0, len(starts), some):
            a, b = (np.add.outer(starts[lo : lo + some], i).ravel() for i in (ia, ib))
            near = (tokens[a] == tokens[b]).sum(axis=1, dtype=np.int16) >= enough
            yield a[near], b[near]
        return
    for first in starts:
        column = np.ascontiguousarray(tokens[first : first + size].T)
        low = column.astype(np.uint8)  # if these agree less often, so do the tokens
        for i in range(size - 1):
            near = i + 1 + np.flatnonzero((low[:, i + 1 :] == low[:, i : i + 1]).sum(axis=0, dtype=np.uint8) >= enough)
            near = near[(column[:, near] == column[:, i : i + 1]).sum(axis=0) >= enough]
            if len(near):
                yield np.full(len(near), first + i), first + near


def _compare_leaves(leaves: DataFrame, least: float) -> DataFrame:
    """Edges that join, within each bucket, the sets whose embeddings agree on at least that share of tokens."""

    def run(batches):
        for t, starts in whole_groups(batches, 1):
            sizes = np.diff(np.append(starts, len(t)))
            nodes = t.column(1).to_numpy()
            tokens = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint32).reshape(len(t), -1)
            us, vs = [], []
            for size in np.unique(sizes[sizes > 1]):
                grown: dict[int, int] = {}
                for a, b in near_pairs(tokens, size, starts[sizes == size], least):
                    for u, v in _forest(a, b, grown):
                        us.append(nodes[u])
                        vs.append(nodes[v])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    grouped = leaves.select("key", "node", "tokens").repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(run, "u long, v long")


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Of the edges (a, b), those that join two trees grown so far; parent: the trees, which grow."""

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            out.append((u, v))
    return out


def _with_far_sets(told: DataFrame, per_key: DataFrame, weights: tuple) -> DataFrame:
    """key and node of leaves, in which all sets of the buckets of per_key meet those that are not near the pivot.

    A bucket's near sets are dealt into leaves of about LEAF, each of which has all its other sets, at most LEAF, too.
    """
    blocks = F.ceil(F.col("n") / LEAF).cast("long")
    rows = join_by_key(told.select("key", "node", "near"), per_key.withColumn("blocks", blocks), "key", "n", "inner", weights)
    leaf = lambda block: F.xxhash64("key", block).alias("key")
    own = rows.filter("near").select(leaf(F.pmod(F.xxhash64("node"), F.col("blocks"))), "node")
    far = rows.filter("not near").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.unionByName(far.select(leaf(F.col("block")), "node"))


def _sizes(per_key: DataFrame, *parts) -> list[tuple[int, int]]:
    """The sum and the largest of n over the keys of each part."""
    n = [F.when(part, F.col("n")) for part in parts]
    found = per_key.agg(*[f(x) for x in n for f in (F.sum, F.max)]).first()
    return [(found[k] or 0, found[k + 1] or 0) for k in range(0, len(found), 2)]


def _split(sets: DataFrame, runs: range, paths: list[str], least: float) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Edges found in the runs, the nodes of buckets that are split past USUAL_LEVEL, and the most levels of a path.

    In a bucket of more than LEAF sets those near its first one are in one candidate group with it.  If at most LEAF
    are left, these are compared with all sets of the bucket, and it is done; else it is split.
    """
    found: list[DataFrame] = []
    leaves: list[DataFrame] = []
    deep = at_most = None
    embedded = sets.select("node", "tokens")
    keyed = _roots(sets, runs)
    for level in range(1, LEVELS + 1):
        keep = lambda df, tag, rows: materialise(few(df, rows), tag, paths)
        sized = keyed.groupBy("key").agg(
            F.count("*").alias("n"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("members")
        )
        # Runs often meet the same bucket again; of small ones with the same members one is compared.
        same = F.when(F.col("n") > LEAF, F.col("key")).otherwise(F.col("members"))
        split = sized.filter("n > 1").groupBy("n", same.alias("same")).agg(F.min("key").alias("key"), F.min("m").alias("m")).drop("same")
        split = keep(split, "cp-split", at_most)
        large, small = F.col("n") > LEAF, F.col("n") <= LEAF
        every, big = _sizes(split, F.lit(True), large)
        joined = keep(join_by_key(keyed, split, "key", "n", "inner", every), "cp-level", every[0])
        leaves.append(joined.filter(small).select("key", "node"))
        if not big[0]:
            break
        pivots = keep(split.filter(large).join(embedded.toDF("m", "pivot"), "m").select("key", "n", "pivot"), "cp-pivots", big[0] // LEAF)
        rows = join_by_key(joined.filter(large).drop("n"), pivots, "key", "n", "inner", big)
        told = keep(_against_pivots(rows.join(embedded, "node"), least), "cp-told", big[0])
        found.append(told.filter("near and node <> m").select(F.col("node").alias("u"), F.col("m").alias("v")))
        per_key = told.groupBy("key").agg(F.max("n").alias("n"), F.count(F.when(~F.col("near"), 1)).alias("far"))
        per_key = keep(per_key.filter("far > 0"), "cp-far", big[0] // LEAF)
        some, many = F.col("far") <= LEAF, F.col("far") > LEAF
        done, still = _sizes(per_key, some, many)
        if done[0]:
            leaves.append(_with_far_sets(told, per_key.filter(some), done))
        if not still[0]:
            break
        rows = join_by_key(told.select("key", "node", "m", "next"), per_key.filter(many).select("key", "n"), "key", "n", "inner", still)
        if level == USUAL_LEVEL:
            deep = rows.select("node").distinct()
        if level == LEVELS:
            found.append(rows.filter("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v")))
        else:
            at_most = 2 * still[0]
            keyed = keep(rows.select("node", F.explode("next").alias("key")), "cp-branches", at_most)
    found.append(_compare_leaves(_union(leaves).join(embedded, "node"), least))
    return found, deep, level


def candidate_edges(sets: DataFrame, paths: list[str], threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges u, v between sets that may be similar; sets: node and tokens.

    The tables that the edges are read from are added to `paths`.
    """
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    runs = runs_for(recall, threshold)
    found, deep, reached = _split(sets, range(runs), paths, least)
    if deep is not None:  # a pair in a bucket that is split further has both its sets among these
        crowd = materialise(sets.select("node", "tokens").join(deep, "node"), "cp-deep", paths)
        while runs < (need := runs_for(recall, threshold, reached)):
            need = runs_for(recall, threshold, min(LEVELS, reached + 2))  # the added runs may go deeper
            added, _, now = _split(crowd, range(runs, need), paths, least)
            found += added
            reached, runs = max(reached, now), need
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ----------------------------------------------------------------------------------------------
# Exact comparison within candidate groups


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each left and right set, whether their Jaccard similarity reaches the threshold."""
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(left) * len(right) <= 16:
        both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], float)
    else:
        flat = np.concatenate(left + right)
        owner = np.repeat(np.arange(len(nl) + len(nr)), np.concatenate([nl, nr]))
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        column, owner = column[shared], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        dense = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        both = np.zeros((len(nl), len(nr)), np.float32)
        for lo in range(0, int(dense[-1]) + 1 if len(dense) else 0, COLUMNS):
            a, b = np.searchsorted(dense, [lo, lo + COLUMNS])
            m = np.zeros((len(nl) + len(nr), COLUMNS), np.float32)
            m[owner[a:b], dense[a:b] - lo] = 1
            both += m[: len(nl)] @ m[len(nl) :].T
    union = nl[:, None] + nr[None, :] - both
    return both >= threshold * union - 1e-6


def _local_roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] >= 0:
            continue
        seen = links[i].copy()
        seen[i] = True
        edge = seen.copy()
        while edge.any():
            grown = links[edge].any(axis=0) & ~seen
            seen |= grown
            edge = grown
        root[seen] = i
    return root


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """node, parent (a linked node, or itself) and links of each set in each pair of blocks."""

    def run(batches):
        for t, starts in whole_groups(batches, 3):
            ends = np.append(starts[1:], len(t))
            low, high = t.column(1).to_numpy(), t.column(2).to_numpy()
            nodes, block, copies = (t.column(k).to_numpy() for k in (3, 4, 5))
            packed = t.column(6).to_pylist()
            out_node, out_parent, out_links = [], [], []
            for a, b in zip(starts, ends):
                _, keep = np.unique(nodes[a:b], return_index=True)  # a repeated document row adds no set
                at = a + keep
                sets = [np.frombuffer(packed[i], np.uint64) for i in at]
                weight = copies[at].astype(float)
                if low[a] == high[a]:
                    links = similar(sets, sets, threshold)
                    np.fill_diagonal(links, False)
                else:
                    side = block[at] == low[a]
                    links = np.zeros((len(at), len(at)), bool)
                    if side.any() and not side.all():
                        i, j = np.flatnonzero(side), np.flatnonzero(~side)
                        cross = similar([sets[k] for k in i], [sets[k] for k in j], threshold)
                        links[np.ix_(i, j)] = cross
                        links[np.ix_(j, i)] = cross.T
                root = _local_roots(links)
                out_node.append(nodes[at])
                out_parent.append(nodes[at][root])
                out_links.append((links @ weight).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (out_node, out_parent, out_links)], names=["node", "parent", "links"]
            )

    order = ["comp", "low", "high"]
    grouped = rows.select(*order, "node", "block", "copies", "shingles").repartition(*order).sortWithinPartitions(*order)
    return grouped.mapInArrow(run, "node long, parent long, links long")


def _member_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """members with `shingles`, read again from the text of each set's first document.

    An id may repeat with other texts; only a row whose set has the member's print counts.  Of the rows that
    repeat it a task gives the first, so what meets in a group follows the sets and not the rows.
    """
    names = ["comp", "node", "block", "blocks", "copies"]

    def run(batches):
        make, given = Shingler(), set()
        for b in batches:
            new = [k for k, n in enumerate(b.column(3).to_pylist()) if n not in given]
            b = b.take(pa.array(new, pa.int64()))
            texts = [t or b"" for t in utf8(b.column(0))]
            prints, nodes = b.column(1).to_pylist(), b.column(3).to_pylist()
            for lo, hi in slices(texts):
                sets = make(texts[lo:hi])
                good = []
                for k, s in enumerate(sets):
                    if nodes[lo + k] not in given and xxhash.xxh3_128_digest(s.tobytes()) == prints[lo + k]:
                        given.add(nodes[lo + k])
                        good.append(k)
                part = b.slice(lo, hi - lo).take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2 + k) for k in range(len(names))] + [pa.array([sets[k].tobytes() for k in good], pa.binary())],
                    names=[*names, "shingles"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("rep_id"), F.col(text_col).cast("string").alias("__text"))
    joined = texts.filter("rep_id is not null").join(members, "rep_id").select("__text", "print", *names)
    return joined.mapInArrow(run, "comp long, node long, block long, blocks long, copies long, shingles binary")


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and print of each document with an id; and print, copies, links, label and class_id of each set."""
    embedded = materialise(embed(docs, id_col, text_col), "jac-embedded")
    folded = embedded.filter("n_shingles > 0").groupBy("print").agg(
        F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("tokens").alias("tokens"),
    )
    paths: list[str] = []
    sets = materialise(folded.withColumn("node", F.monotonically_increasing_id()), "jac-sets", paths)
    edge_paths: list[str] = []
    groups = materialise(components(candidate_edges(sets, edge_paths, threshold, recall), edge_paths), "jac-groups", paths)
    discard(docs.sparkSession, edge_paths)

    # Blocks: a group is dealt into as many as keep each under both bounds.
    member = groups.join(sets.drop("tokens"), "node").withColumnRenamed("label", "comp")
    member = materialise(member, "jac-members", paths)
    size = member.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    shared = F.least(F.lit(SPREAD), F.ceil(F.col("n") / LEAST_SETS))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES), shared).cast("long")
    size = materialise(size.select("comp", "n", blocks.alias("blocks")), "jac-sizes", paths)
    placed = join_by_key(member, size, "comp", "n", "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    with_sets = _member_sets(docs, placed.select("rep_id", "print", "comp", "node", "block", "blocks", "copies"), id_col, text_col)
    paired = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "copies", "shingles"
    )
    checked = materialise(_verify(paired, threshold), "jac-checked", paths)

    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(checked.filter("node <> parent").select(F.col("node").alias("u"), F.col("parent").alias("v")), paths)
    told = (
        sets.drop("tokens").join(links, "node", "left").join(label, "node", "left")
        .select("print", "rep_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    )
    told = materialise(told, "jac-told", paths)
    first = told.groupBy("label").agg(F.min("rep_id").alias("class_id"), F.count("*").alias("sets"))
    classed = join_by_key(told, materialise(first, "jac-classes", paths), "label", "sets", "inner").drop("sets")
    classed = materialise(classed, "jac-prints")
    discard(docs.sparkSession, paths)
    return embedded.select("doc_id", "n_shingles", "print"), classed


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of each document."""
    rows, classed = _classes(docs, threshold, recall, id_col, text_col)
    by_print = classed.select("print", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    full = join_by_key(rows.filter("n_shingles > 0").select("doc_id", "print"), by_print, "print", "copies", "inner")
    empty = rows.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    nulls = docs.filter(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    out = full.select("doc_id", "class_id", "n_links").unionByName(empty).unionByName(nulls)
    return out.withColumnRenamed("doc_id", id_col)


def _with_prints(rows: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """rows with __id and __print, the print of each text's set (null if it is empty)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__id", T.LongType()), T.StructField("__print", T.BinaryType())])

    def run(batches):
        make = Shingler()
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(text_at))]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for lo, hi in slices(texts) for s in make(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([*b.columns, b.column(id_at).cast(pa.int64()), pa.array(prints, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with exactly their columns, that have the least id of their class; one row of each class stays.

    Rows that repeat an id are documents of their own: those of other classes stay beside one another.  Of several
    rows that could stay for a class, that of the least print, and then of the least text, does.  Null ids all stay.
    """
    rows, classed = _classes(docs, threshold, RECALL, id_col, text_col)
    full = classed.groupBy("label").agg(F.min(F.struct(F.col("rep_id").alias("doc_id"), "print")).alias("first")).select("first.*")
    empty = rows.filter("n_shingles = 0").select("doc_id", "print").distinct()
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = materialise(full.unionByName(empty).join(counts, "doc_id"), "jac-kept")

    private = [f"__c{k}" for k in range(len(docs.columns))]
    source = docs.toDF(*private)
    at = {name: private[docs.columns.index(name)] for name in (id_col, text_col)}
    key = F.col(at[id_col]).cast("long")
    once = source.join(kept.filter("rows = 1").select("doc_id"), key == F.col("doc_id"), "left_semi")
    again = kept.filter("rows > 1").select("doc_id", F.col("print").alias("kept_print"))
    repeated = source.join(again.select("doc_id").distinct(), key == F.col("doc_id"), "left_semi")
    marked = _with_prints(repeated, private.index(at[id_col]), private.index(at[text_col]))
    order = F.struct(F.coalesce(F.col(at[text_col]), F.lit("")), F.xxhash64(*private))
    one = marked.groupBy("__id", "__print").agg(F.min_by(F.struct(*private), order).alias("row"))
    chosen = one.join(again, (F.col("__id") == F.col("doc_id")) & F.col("__print").eqNullSafe(F.col("kept_print")), "left_semi")
    nulls = source.filter(F.col(at[id_col]).isNull())
    return once.unionByName(chosen.select("row.*")).unionByName(nulls).toDF(*docs.columns)
