"""Residue networks over a thresholded correlation matrix: components, communities, centrality, paths."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.tables import discard, materialise

#: Edges that the driver holds as adjacency lists and hands to the executors (about 100 MB).
MAX_EDGES = 5_000_000


def edges(correlation: DataFrame, threshold: float) -> DataFrame:
    """A16. src, dst, weight in both directions of the pairs with |value| at least the threshold."""
    strong = correlation.filter((F.col("i") != F.col("j")) & (F.abs("value") >= threshold))
    return strong.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("value").alias("weight"))


def components(graph: DataFrame, nodes: DataFrame, node: str = "node", rounds: int = 64) -> DataFrame:
    """N10. node, component: the least node that each node is connected with.

    Labels take the least of the neighbours' and are then followed to their own labels, so rounds
    grow with the logarithm of the longest path.  Each round is a written table.
    """
    labels = materialise(nodes.select(F.col(node).cast("long").alias("node"), F.col(node).cast("long").alias("component")), "labels")
    pairs = materialise(graph.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("other")).distinct(), "edges")
    for _ in range(rounds):
        best = pairs.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        grown = labels.join(best, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        jump = grown.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = materialise(grown.join(jump, "component").select("node", F.col("up").alias("component"), "old"), "labels")
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def adjacency(graph: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """The graph as sorted adjacency lists, if it has at most MAX_EDGES edges."""
    rows = graph.select("src", "dst", "weight").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges; raise the threshold")
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in rows:
        out.setdefault(a, []).append((b, w))
    for near in out.values():
        near.sort()
    return out


def _dependencies(near: dict[int, list], source: int) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """What shortest paths from the source give to each node and to each edge, in the manner of Brandes."""
    depth, paths, order = {source: 0}, {source: 1.0}, []
    before: dict[int, list[int]] = {source: []}
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w, _ in near.get(v, ()):
            if w not in depth:
                depth[w], paths[w], before[w] = depth[v] + 1, 0.0, []
                queue.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    node = dict.fromkeys(order, 0.0)
    edge: dict[tuple[int, int], float] = {}
    for w in reversed(order):
        for v in before[w]:
            share = paths[v] / paths[w] * (1.0 + node[w])
            key = (v, w) if v < w else (w, v)
            edge[key] = edge.get(key, 0.0) + share
            node[v] += share
    node.pop(source)
    return node, edge


def betweenness(graph: DataFrame, n: int) -> DataFrame:
    """N11. node, betweenness of the unweighted graph on nodes 0..n-1, over (n-1)(n-2) ordered pairs.

    Sources are dealt over the executors; each adds up the dependencies of its share.
    """
    spark = graph.sparkSession
    shared = spark.sparkContext.broadcast(adjacency(graph))
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0

    def run(batches):
        import pyarrow as pa

        sums = np.zeros(n)
        for b in batches:
            for s in b.column(0).to_pylist():
                for v, x in _dependencies(shared.value, s)[0].items():
                    sums[v] += x
        yield pa.RecordBatch.from_pydict({"node": np.arange(n, dtype=np.int64), "b": sums})

    parts = spark.range(n).mapInArrow(run, "node long, b double")
    return parts.groupBy("node").agg((F.sum("b") / F.lit(scale)).alias("betweenness"))


def _component(near: dict[int, list], v: int) -> list[int]:
    seen, queue = {v}, [v]
    while queue:
        for w, _ in near.get(queue.pop(), ()):
            if w not in seen:
                seen.add(w)
                queue.append(w)
    return sorted(seen)


def _edge_sums(spark: SparkSession, near: dict[int, list], members: list[int], local_work: int) -> dict[tuple[int, int], float]:
    """What all shortest paths of one component give to each of its edges.

    Sources are dealt over the executors, each task adding up its own; a component whose nodes times edges are
    at most local_work is less work than a job is.
    """
    own = {v: near[v] for v in members if near.get(v)}

    def of(sources) -> dict[tuple[int, int], float]:
        total: dict[tuple[int, int], float] = {}
        for s in sources:
            for e, x in _dependencies(own, s)[1].items():
                total[e] = total.get(e, 0.0) + x
        return total

    if len(members) * sum(map(len, own.values())) <= local_work:
        return of(members)
    shared = spark.sparkContext.broadcast(own)

    def run(batches):
        import pyarrow as pa

        total: dict[tuple[int, int], float] = {}
        for b in batches:
            for s in b.column(0).to_pylist():
                for e, x in _dependencies(shared.value, s)[1].items():
                    total[e] = total.get(e, 0.0) + x
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([e[0] for e in total], [e[1] for e in total], total.values()), kinds)], names=["a", "b", "x"])

    sources = spark.createDataFrame([(v,) for v in members], "v long").repartition(max(1, min(len(members), spark.sparkContext.defaultParallelism)))
    summed = sources.mapInArrow(run, "a long, b long, x double").groupBy("a", "b").agg(F.sum("x").alias("x"))
    return {(r.a, r.b): r.x for r in summed.collect()}  # an entry an edge


#: Nodes times edges of a component up to which its edges' sums are made on the driver.
LOCAL_WORK = 4_000_000


def girvan_newman(spark: SparkSession, near: dict[int, list], n: int, max_communities: int = 10, local_work: int | None = None) -> list[list[int]]:
    """N10. Communities by taking away the edge of most shortest paths, ties to the least (i, j).

    A removal changes the paths of the component that it was in only, so only that component's sums are made anew.
    """
    near, work = {v: list(e) for v, e in near.items()}, LOCAL_WORK if local_work is None else local_work
    parts: dict[int, list[int]] = {}
    seen: set[int] = set()
    for v in range(n):
        if v not in seen:
            parts[v] = _component(near, v)
            seen.update(parts[v])
    sums = {lead: _edge_sums(spark, near, members, work) for lead, members in parts.items() if len(members) > 1}
    while len(parts) < max_communities and any(sums.values()):
        top = max(x for total in sums.values() for x in total.values())
        a, b = min(e for total in sums.values() for e, x in total.items() if x >= top - 1e-9)
        lead = next(k for k, total in sums.items() if (a, b) in total)
        near[a] = [x for x in near[a] if x[0] != b]
        near[b] = [x for x in near[b] if x[0] != a]
        del parts[lead], sums[lead]
        for v in (a, b):
            members = _component(near, v)
            if members[0] not in parts:
                parts[members[0]] = members
                sums[members[0]] = _edge_sums(spark, near, members, work)
    return [parts[k] for k in sorted(parts)]


def communities(graph: DataFrame, n: int, max_communities: int = 10) -> DataFrame:
    """node, community, size; communities numbered by their least node.

    The removal of edges is sequential by definition; the paths that each removal needs are counted on the executors.
    """
    found = girvan_newman(graph.sparkSession, adjacency(graph), n, max_communities)
    rows = [(v, k, len(g)) for k, g in enumerate(found) for v in g]
    return graph.sparkSession.createDataFrame(rows, "node int, community int, size int")


_REACHED = "node long, cost double, back_cost double, back long, open boolean"


def _relaxed(reached: DataFrame, links: DataFrame, limit: float, goal: float | None) -> DataFrame:
    """The nodes reached after those that are open and cost at most the limit have passed on their costs.

    A node keeps the least cost, and of equal ones the predecessor of least cost and then number; it is open
    again if its cost has fallen.  Costs beyond the goal's lead nowhere.
    """
    front = reached.filter(F.col("open") & (F.col("cost") <= limit)).select(F.col("node").alias("src"), "cost")
    new = front.join(links, "src").select(F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.col("cost").alias("back_cost"), F.col("src").alias("back"))
    if goal is not None:
        new = new.filter(F.col("cost") <= goal)
    had = reached.withColumn("open", F.col("open") & (F.col("cost") > limit)).withColumn("old", F.col("cost"))
    both = had.unionByName(new.withColumns({"open": F.lit(False), "old": F.lit(None).cast("double")}))
    # The start has no predecessor; nothing may take its place at equal cost.
    order = F.struct("cost", F.coalesce("back_cost", F.lit(-1.0)).alias("k"), "back_cost", "back")
    best = both.groupBy("node").agg(F.min(order).alias("m"), F.max("old").alias("old"), F.max("open").alias("open"))
    fallen = F.col("old").isNull() | (F.col("m.cost") < F.col("old"))
    return best.select("node", "m.cost", "m.back_cost", "m.back", (F.col("open") | fallen).alias("open"))


def optimal_path(graph: DataFrame, n: int, source: int, sink: int, delta: float | None = None) -> DataFrame:
    """N12. hop (from 1), src, dst, cumulative cost of the path of least -ln(weight); empty if source and sink are one node.

    Delta-stepping over the table of edges: a round passes on the costs of the open nodes within `delta` (the
    mean cost of an edge) of the cheapest, as a join, and writes what is reached.  It ends when no open node is cheaper than the sink, so
    the driver sees two numbers a round and in the end the path.  Of paths of equal cost the one
    whose nodes have predecessors of least cost, and then of least number, is given.
    """
    if not (0 <= source < n and 0 <= sink < n):
        raise ValueError(f"nodes are 0 to {n - 1}")
    spark = graph.sparkSession
    told = "hop int, src int, dst int, cost double"
    if source == sink:
        return spark.createDataFrame([], told)
    kept: list[str] = []
    links = materialise(graph.select(F.col("src").cast("long"), F.col("dst").cast("long"), (-F.ln("weight")).alias("c")), "links", kept)
    width = links.agg(F.avg("c")).first()[0] if delta is None else delta
    reached, before = spark.createDataFrame([(source, 0.0, None, None, True)], _REACHED), []
    while True:
        goal = F.max(F.when(F.col("node") == sink, F.col("cost")))
        lowest, there = reached.agg(F.min(F.when(F.col("open"), F.col("cost"))), goal).first()
        if lowest is None or (there is not None and lowest >= there):
            break
        paths: list[str] = []
        reached = materialise(_relaxed(reached, links, lowest + (width or 0.0), there), "reached", paths)
        discard(spark, before)
        before = paths
    if there is None:
        raise ValueError(f"no path leads from {source} to {sink} at this threshold")
    path, at = [], sink
    while at != source:
        row = reached.filter(F.col("node") == at).first()
        path.append((row.back, at, row.cost))
        at = row.back
    discard(spark, before + kept)
    return spark.createDataFrame([(k + 1, a, b, float(c)) for k, (a, b, c) in enumerate(reversed(path))], told)


def nodes_of(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"))
