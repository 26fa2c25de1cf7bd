"""A Merkle manifest of a dataset: a root for each group of rows, one over the groups, a proof for every row.

A row's leaf is the SHA-256 of its fields.  The leaves of a group, in the order of their ids, are the
nodes of level 0 of a tree; as long as a level has several nodes, every `arity` consecutive ones (at
its end perhaps fewer, even one) become one of the next level, the SHA-256 of their digests.  What
remains is the group's subroot, a lone leaf itself.  The subroots, in the order of their groups, are
the leaves of the tree that gives the root.  Digests are lower-case hexadecimal text.

Trees are built by a monoid.  A Fragment holds nodes whose siblings it has not met, keyed by tree,
level and index; since the size of each tree is known, so is the arity of every run of siblings, and
adding two fragments replaces each run that is now complete by its parent.  Addition is associative
and commutative, so it does not matter which rows a task holds.  Each partition folds its leaves to
a fragment, and rounds of groups add the fragments up: a round's groups are the aligned spans of
SPAN nodes at most, so that what reaches the next round is one node a span, a thousandth of the
level below.  No task and no driver ever holds more than a span and the fragment of its own rows.

Proofs go the other way.  The spans of a round, each with the path of the node above it, give the
paths of their nodes, from the root down to the leaves; a path is never longer than the tree is high.

Rows are numbered by a range partitioning on (group, id, leaf), their counts a partition and group
being a table of so many rows.  Ranges may cut a group anywhere, so large groups are no special case.

Edge cases: a null group comes before all others, a null id before all ids; rows that share an id
follow each other by their leaves, and rows that are equal throughout are leaves of their own; null
fields count as `-`, which differs from an empty text; columns that are not named are not read; an
empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise

ARITY = 2
#: Nodes of a span at most: what a task holds at once of one tree.
SPAN = 1024
#: Rows up to which the table of counts a partition and group is broadcast (some tens of MB).
MAX_BROADCAST_ROWS = 200_000
DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and its text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# ----------------------------------------------------------------------------------------------
# The monoid


class Fragment:
    """Nodes of trees of known sizes whose runs of siblings are not complete; the empty one is the identity."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.sizes: dict[str, int] = {}
        self.levels: dict[str, list[dict[int, str]]] = {}

    def add(self, tree: str, size: int, level: int, index: int, value: str) -> None:
        self.sizes[tree] = size
        levels = self.levels.setdefault(tree, [])
        while len(levels) <= level:
            levels.append({})
        if levels[level].setdefault(index, value) != value:
            raise ValueError(f"two nodes {index} of level {level}")

    def settle(self, top: int) -> Fragment:
        """Replace complete runs below level `top` by their parents."""
        for tree, levels in self.levels.items():
            width, level = self.sizes[tree], 0
            while level < min(top, len(levels)) and width > 1:
                nodes = levels[level]
                for first in {i - i % self.arity for i in nodes}:
                    run = range(first, min(first + self.arity, width))
                    if all(i in nodes for i in run):
                        self.add(tree, self.sizes[tree], level + 1, first // self.arity, digest("".join(nodes.pop(i) for i in run)))
                width, level = -(-width // self.arity), level + 1
        return self

    def merge(self, other: Fragment, top: int) -> Fragment:
        """The sum of two fragments; this one is changed."""
        for node in other.nodes():
            self.add(*node)
        return self.settle(top)

    def nodes(self) -> Iterator[tuple[str, int, int, int, str]]:
        for tree, levels in self.levels.items():
            for level, nodes in enumerate(levels):
                for index, value in nodes.items():
                    yield tree, self.sizes[tree], level, index, value


_PARTS = "key string, size long, level int, span long, index long, digest string"
_NODES = "key string, size long, pos long, digest string"


def _levels(arity: int) -> int:
    """Levels of a round: as many as a span of SPAN nodes has."""
    n = 1
    while arity ** (n + 1) <= SPAN:
        n += 1
    return n


def _climb(nodes: DataFrame, arity: int) -> DataFrame:
    """The nodes a round of levels further up: fragments of the partitions, added up by aligned spans."""
    top = _levels(arity)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fragment(arity)
        for b in batches:
            for key, size, pos, value in zip(*(c.to_pylist() for c in b.columns)):
                own.add(key, size, 0, pos, value)
            own.settle(top)
        rows = [(k, n, lv, i // arity ** (top - lv), i, v) for k, n, lv, i, v in own.nodes()]
        for lo in range(0, len(rows), 10_000):
            cols = list(zip(*rows[lo : lo + 10_000]))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "size", "level", "span", "index", "digest"])

    def add_up(t: pa.Table) -> pa.Table:
        own = Fragment(arity)
        for key, size, level, index, value in zip(*(t[c].to_pylist() for c in ("key", "size", "level", "index", "digest"))):
            own.add(key, size, level, index, value)
        found = list(own.settle(top).nodes())
        if len(found) != 1:
            raise ValueError(f"{len(found)} nodes remain of a span: its leaves are not numbered without gaps")
        key, size, _, _, value = found[0]
        columns = {"key": [key], "size": [max(1, -(-size // arity**top))], "pos": [t["span"][0].as_py()], "digest": [value]}
        return pa.table(columns, schema=pa.schema([("key", pa.string()), ("size", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())]))

    parts = nodes.select("key", "size", "pos", "digest").mapInArrow(fold, _PARTS)
    return parts.groupBy("key", "span").applyInArrow(add_up, _NODES)


# ----------------------------------------------------------------------------------------------
# Paths.  One of a path's levels is `before,after`: the digests of the siblings on either side.


def span_levels(values: list[str], first: int, size: int, arity: int, levels: int) -> list[tuple[int, list[str]]]:
    """The index of the first node and the digests of each level of a span, from its nodes up, below the tree's root."""
    out = []
    while size > 1 and len(out) < levels:
        out.append((first, values))
        values = [digest("".join(values[i : i + arity])) for i in range(0, len(values), arity)]
        first, size = first // arity, -(-size // arity)
    return out


def siblings(levels: list[tuple[int, list[str]]], pos: int, arity: int) -> list[str]:
    path = []
    for first, values in levels:
        i = pos - first
        lo = i - i % arity
        path.append("".join(values[lo:i]) + "," + "".join(values[i + 1 : lo + arity]))
        pos //= arity
    return path


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and a path lead to."""
    for step in path:
        before, _, after = step.partition(",")
        leaf = digest(before + leaf + after)
    return leaf


def proof_digest(path: list[str]) -> str:
    return digest("".join(path).replace(",", ""))


_ABOVE = "key string, pos long, path array<string>, subroot string, root string"


def _with_span(nodes: DataFrame, arity: int) -> DataFrame:
    return nodes.withColumn("span", F.floor(F.col("pos") / F.lit(arity ** _levels(arity))).cast("long"))


def _descend(nodes: DataFrame, above: DataFrame, arity: int, schema: str, emit) -> DataFrame:
    """emit(span's nodes sorted, their paths, the row of the node above) for each span, as a table of the schema."""
    top = _levels(arity)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or right.num_rows != 1:
            raise ValueError("a span without its node above, or the other way round")
        left = left.sort_by("pos")
        pos, size = left["pos"].to_pylist(), left["size"][0].as_py()
        levels = span_levels(left["digest"].to_pylist(), pos[0], size, arity, top)
        over = right["path"][0].as_py()
        return emit(left, [siblings(levels, p, arity) + over for p in pos], right)

    spans = _with_span(nodes, arity).groupBy("key", "span")
    return spans.cogroup(above.withColumnRenamed("pos", "span").groupBy("key", "span")).applyInArrow(run, schema)


def _inner(left: pa.Table, paths: list[list[str]], above: pa.Table) -> pa.Table:
    n = left.num_rows
    return pa.table({
        "key": left["key"], "pos": left["pos"], "path": pa.array(paths, pa.list_(pa.string())),
        "subroot": pa.array([above["subroot"][0].as_py()] * n, pa.string()), "root": pa.array([above["root"][0].as_py()] * n, pa.string()),
    })


# ----------------------------------------------------------------------------------------------
# Numbering


def _numbered(rows: DataFrame, order: list[str], tables: list[str]) -> tuple[DataFrame, int]:
    """rows with their position `pos` in the order of the columns within each `key`, the key's size, and the largest size.

    Rows that are equal in all of these are dealt apart by where they stand, which does not change the result.
    """
    dealt = rows.withColumn("__s", F.xxhash64(F.monotonically_increasing_id()))
    sort = ["key", *order, "__s"]
    placed = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__s")
    written = materialise(placed.withColumn("__m", F.monotonically_increasing_id()), "merkle-ordered", tables)
    part = F.shiftright("__m", 33)  # the number of the partition that wrote the row
    counts = written.groupBy("key", part.alias("__p")).agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    by_key = Window.partitionBy("key")
    before = F.sum("__n").over(by_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("key", "__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(by_key).alias("size"))
    starts = materialise(starts, "merkle-starts", tables)
    n, largest = starts.agg(F.count("*"), F.max("size")).first()
    joined = written.withColumn("__p", part).join(F.broadcast(starts) if n <= MAX_BROADCAST_ROWS else starts, ["key", "__p"])
    return joined.withColumn("pos", F.col("__m") - F.col("__first") + F.col("__before")).drop("__m", "__p", "__first", "__before"), largest or 0


# ----------------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """root: None of an empty table.  subroots: key, size, digest.  tables: what rows() reads, for discard()."""

    root: str | None
    subroots: DataFrame
    leaves: DataFrame
    above: DataFrame
    arity: int = ARITY
    tables: list[str] = field(default_factory=list)

    def rows(self, id_name: str = "doc_id") -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

        proof_sha256 is the digest of the row's proof; folded_root is what the claimed leaf, or the row's own where
        nothing is claimed, leads to with the proof's siblings.
        """
        kind = self.leaves.schema["id"].dataType

        def emit(left: pa.Table, paths: list[list[str]], above: pa.Table) -> pa.Table:
            subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
            ends = [folded(c or d, p) for c, d, p in zip(left["claimed"].to_pylist(), left["digest"].to_pylist(), paths)]
            n = left.num_rows
            return pa.table({
                id_name: left["id"], "leaf": left["digest"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array([proof_digest(p) for p in paths], pa.string()), "folded_root": pa.array(ends, pa.string()),
                "verified": pa.array([e == root for e in ends], pa.bool_()),
            })

        schema = f"`{id_name}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return _descend(self.leaves, self.above, self.arity, schema, emit)

    def proofs(self, id_name: str = "doc_id") -> DataFrame:
        """id, leaf, path of each row: for each level up to the root the digests before and after, with a comma between."""
        kind = self.leaves.schema["id"].dataType

        def emit(left: pa.Table, paths: list[list[str]], above: pa.Table) -> pa.Table:
            return pa.table({id_name: left["id"], "leaf": left["digest"], "path": pa.array(paths, pa.list_(pa.string()))})

        return _descend(self.leaves, self.above, self.arity, f"`{id_name}` {kind.simpleString()}, leaf string, path array<string>", emit)


def _group_key(value: Column) -> Column:
    """A text that sorts null first and other groups by their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _forest(leaves: DataFrame, largest: int, arity: int, tables: list[str]) -> list[DataFrame]:
    """The nodes after each round of levels, the leaves first and the roots of all trees last."""
    nodes = [leaves]
    while len(nodes) == 1 or largest > 1:
        nodes.append(materialise(_climb(nodes[-1], arity), f"merkle-nodes-{len(nodes)}", tables))
        largest = -(-largest // arity ** _levels(arity))
    return nodes


def build(
    rows: DataFrame, fields: Sequence[str] = DOCUMENT_FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    claimed: Column | None = None, arity: int = ARITY,
) -> Manifest:
    """The manifest of a table.  claimed: a column of leaves to be verified in place of the rows' own, null where none is claimed."""
    if arity < 2:
        raise ValueError("a run has two siblings at least")
    spark: SparkSession = rows.sparkSession
    leaf = leaf_of([F.col(f"`{c}`") for c in fields])
    claim = F.lit(None).cast("string") if claimed is None else claimed
    first: list[str] = []
    kept: list[str] = []
    small: list[str] = []
    hashed = materialise(
        rows.select(_group_key(F.col(f"`{group_col}`")).alias("key"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), claim.alias("claimed")), "merkle-leaves", first
    )
    leaves, largest = _numbered(hashed, ["id", "digest"], kept)
    discard(spark, first)
    nodes = _forest(leaves, largest, arity, small)
    subroots = nodes[-1].select("key", "digest")
    trees, n_trees = _numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("id"), "digest"), ["id", "digest"], small)
    grove = _forest(trees, n_trees, arity, small)
    end = grove[-1].first()
    root = end.digest if end else None

    above = spark.createDataFrame([("", 0, [], None, root)] if end else [], _ABOVE)
    for k in range(len(grove) - 2, 0, -1):
        above = materialise(_descend(grove[k], above, arity, _ABOVE, _inner), "merkle-above", small)
    of_trees = _descend(trees, above, arity, _ABOVE, _tree_paths)
    above = materialise(of_trees, "merkle-above", small if len(nodes) > 2 else kept)
    for k in range(len(nodes) - 2, 0, -1):
        above = materialise(_descend(nodes[k], above, arity, _ABOVE, _inner), "merkle-above", small if k > 1 else kept)
    told = materialise(nodes[-1].select("key", "digest").join(leaves.select("key", "size").groupBy("key").agg(F.max("size").alias("size")), "key"), "merkle-subroots", kept)
    discard(spark, small)
    return Manifest(root, told.select("key", "size", "digest"), leaves, above, arity, kept)


def _tree_paths(left: pa.Table, paths: list[list[str]], above: pa.Table) -> pa.Table:
    """The paths of the groups' subroots, under the groups' keys."""
    n = left.num_rows
    return pa.table({
        "key": left["id"], "pos": pa.array([0] * n, pa.int64()), "path": pa.array(paths, pa.list_(pa.string())), "subroot": left["digest"],
        "root": pa.array([above["root"][0].as_py()] * n, pa.string()),
    })


def documents_manifest(docs: DataFrame) -> Manifest:
    """The manifest of documents, where those whose crc32 of the id is a multiple of 7 claim one character more than they have."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in DOCUMENT_FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return build(docs, claimed=F.when(tampered, leaf_of(changed)))
