from __future__ import annotations

import itertools

import numpy as np
import pytest

from helixframe.operators import correlation, network
from tests.builders import make, noise, square


def test_dccm(spark):
    t = noise(spark)
    c = square(correlation.dccm(t), 6)
    assert np.diag(c) == pytest.approx(1) and c == pytest.approx(c.T) and np.abs(c).max() <= 1 + 1e-9
    still = make(spark, np.ones((3, 2, 3)))
    assert not square(correlation.dccm(still), 2).any()
    moving = np.zeros((4, 2, 3))
    moving[:, 0, 0], moving[:, 1, 0] = [1, -1, 1, -1], [-2, 2, -2, 2]
    assert square(correlation.dccm(make(spark, moving)), 2) == pytest.approx(np.array([[1, -1], [-1, 1]]))


def test_contacts(spark):
    x = [[[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0], [9, 0, 0]], [[0, 0, 0], [1, 0, 0], [2, 0, 0], [30, 0, 0], [90, 0, 0]]]
    c = square(correlation.contact_map(make(spark, x), 8.0), 5, "freq")
    want = np.zeros((5, 5))
    want[0, 3] = want[3, 0] = 0.5  # residues 1 and 4
    want[1, 4] = want[4, 1] = 0.5  # exactly at the cutoff
    assert c == pytest.approx(want)


def test_hydrogen_bonds(spark):
    atoms = [("N", "ALA", "A", 1, "N"), ("O", "ALA", "A", 2, "O"), ("C", "ALA", "A", 3, "C"), ("O", "ALA", "A", 4, "O")]
    x = np.zeros((10, 4, 3))
    x[:, 1, 0], x[:, 3, 0] = 3.0, 20.0
    x[5:, 1, 0] = 9.0
    x[0, 3, 0] = 2.0
    rows = correlation.hydrogen_bonds(make(spark, x, atoms), 3.5, 0.2).collect()
    assert [(r.donor, r.acceptor, r.occupancy, r.mean_dist) for r in rows] == [(0, 1, 0.5, 3.0)]
    rows = correlation.hydrogen_bonds(make(spark, x, atoms), 3.5, 0.05).collect()
    assert [(r.donor, r.acceptor) for r in rows] == [(0, 1), (0, 3), (1, 3)]
    assert len(correlation.polar_atoms(noise(spark))) == 6  # none is polar, so all count


def test_mutual_information(spark):
    t = noise(spark, frames=60)
    m = square(correlation.mutual_information(t), 6)
    assert np.diag(m) == pytest.approx(1) and m == pytest.approx(m.T) and 0 <= m.min() and m.max() <= 1


def test_mutual_information_in_blocks(spark, monkeypatch):
    """Blocks of atoms that do not come out even, several chunks a task and several groups of frames."""
    t = noise(spark, frames=60, atoms=7)
    whole = square(correlation.mutual_information(t), 7)
    for name, size in (("NMI_BLOCK", 3), ("NMI_CHUNK", 4), ("NMI_FRAMES", 17)):
        monkeypatch.setattr(correlation, name, size)
    assert square(correlation.mutual_information(t), 7) == pytest.approx(whole)


def test_perturbation_response(spark):
    rows = correlation.prs_profiles(noise(spark)).collect()
    assert max(r.effectiveness for r in rows) == pytest.approx(1)
    assert [r.effectiveness for r in rows] == pytest.approx([r.sensitivity for r in rows])


# -- networks


def graph(spark, pairs):
    rows = [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]
    return spark.createDataFrame(rows, "src int, dst int, weight double")


PATH = [(k, k + 1, 0.5) for k in range(4)]


def test_edges_and_components(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, -0.7), (1, 0, -0.7), (1, 2, 0.2)], "i int, j int, value double")
    assert {(r.src, r.dst, r.weight) for r in network.edges(cells, 0.7).collect()} == {(0, 1, 0.7), (1, 0, 0.7)}
    g = graph(spark, PATH + [(6, 7, 1.0)])
    label = {r.node: r.component for r in network.components(g, network.nodes_of(spark, 8)).collect()}
    assert label == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6}


def test_betweenness_of_a_path(spark):
    b = {r.node: r.betweenness for r in network.betweenness(graph(spark, PATH), 5).collect()}
    assert [b[k] for k in range(5)] == pytest.approx([0, 6 / 12, 8 / 12, 6 / 12, 0])


def test_betweenness_against_enumeration(spark):
    rng = np.random.default_rng(6)
    pairs = [(a, b, 1.0) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.35]
    near = {v: {b for a, b, _ in pairs if a == v} | {a for a, b, _ in pairs if b == v} for v in range(8)}

    def shortest(s, t):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            paths = [[*p, w] for p in paths for w in near[p[-1]] if w not in p]
        return [p for p in paths if p[-1] == t]

    want = np.zeros(8)
    for s, t in itertools.permutations(range(8), 2):
        found = shortest(s, t)
        for v in range(8):
            if found and v not in (s, t):
                want[v] += sum(v in p for p in found) / len(found)
    b = {r.node: r.betweenness for r in network.betweenness(graph(spark, pairs), 8).collect()}
    assert [b[k] for k in range(8)] == pytest.approx(want / 42)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(0, 4, 1.0)]
    rows = network.communities(graph(spark, pairs), 8, 2).collect()
    assert {r.node: r.community for r in rows} == {k: k // 4 for k in range(8)} and {r.size for r in rows} == {4}


def plain_communities(near, n, most):
    """All shortest paths of the whole graph anew for every edge taken away."""
    near = {v: list(e) for v, e in near.items()}

    def parts():
        left, out = set(range(n)), []
        while left:
            group, queue = set(), [min(left)]
            while queue:
                v = queue.pop()
                if v not in group:
                    group.add(v)
                    queue += [w for w, _ in near.get(v, ())]
            out.append(sorted(group))
            left -= group
        return out

    while len(parts()) < most and any(near.values()):
        total = {}
        for s in range(n):
            for e, x in network._dependencies(near, s)[1].items():
                total[e] = total.get(e, 0.0) + x
        a, b = min(e for e, x in total.items() if x >= max(total.values()) - 1e-9)
        near[a] = [x for x in near[a] if x[0] != b]
        near[b] = [x for x in near[b] if x[0] != a]
    return parts()


@pytest.mark.parametrize("local_work", [10**9, 0])
def test_communities_against_counting_all_anew(spark, local_work):
    """Ties throughout (a ring, equal cliques), several components, and random graphs."""
    rng = np.random.default_rng(8)
    ring = [(k, (k + 1) % 6, 1.0) for k in range(6)] + [(7, 8, 1.0), (8, 9, 1.0)]
    cliques = [(a, b, 1.0) for g in (range(4), range(4, 8), range(8, 11)) for a, b in itertools.combinations(g, 2)] + [(0, 4, 1.0), (4, 8, 1.0)]
    loose = [(a, b, 0.5) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.2]
    for pairs, n, most in ((ring, 11, 6), (cliques, 11, 3), (loose, 12, 5))[: 3 if local_work else 2]:
        near = network.adjacency(graph(spark, pairs))
        assert network.girvan_newman(spark, near, n, most, local_work) == plain_communities(near, n, most)


def plain_path(pairs, source, sink):
    """The least cost over all simple paths, by trying them all; of equal ones by predecessors from the sink."""
    near, best = {}, {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, -np.log(w)))
        near.setdefault(b, []).append((a, -np.log(w)))
    stack = [(source, 0.0, (source,))]
    while stack:
        v, cost, path = stack.pop()
        best[v] = min(best.get(v, np.inf), cost)
        stack += [(w, cost + c, (*path, w)) for w, c in near.get(v, ()) if w not in path]
    if sink not in best:
        return None
    path = [sink]
    while path[-1] != source:
        path.append(min((best[v], v) for v, c in near[path[-1]] if best[v] + c == best[path[-1]])[1])
    return path[::-1], best[sink]


@pytest.mark.parametrize("delta", [None, 0.2, 100.0])
def test_optimal_path_against_trying_all(spark, delta):
    """Equal costs by powers of a half, a detour that is cheaper than an edge, and random weights."""
    rng = np.random.default_rng(3)
    ties = [(0, 1, 0.5), (0, 2, 0.5), (1, 3, 0.25), (2, 3, 0.25), (3, 4, 0.5), (0, 4, 0.0625), (1, 4, 0.125)]
    loose = [(a, b, round(rng.uniform(0.05, 0.95), 3)) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.4] + [(0, 7, 0.01)]
    for pairs, sink in ((ties, 4), (loose, 7))[: 2 if delta is None else 1]:
        want, cost = plain_path(pairs, 0, sink)
        rows = network.optimal_path(graph(spark, pairs), 9, 0, sink, delta).orderBy("hop").collect()
        assert [0, *[r.dst for r in rows]] == want and [r.src for r in rows] == want[:-1] and rows[-1].cost == pytest.approx(cost)


def test_optimal_path(spark):
    g = graph(spark, [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.5), (3, 4, 0.9)])
    rows = network.optimal_path(g, 5, 0, 2).orderBy("hop").collect()
    assert [(r.src, r.dst) for r in rows] == [(0, 1), (1, 2)] and rows[-1].cost == pytest.approx(-2 * np.log(0.9))
    assert network.optimal_path(g, 5, 1, 1).count() == 0
    with pytest.raises(ValueError, match="no path"):
        network.optimal_path(g, 5, 0, 4)
    with pytest.raises(ValueError, match="nodes are"):
        network.optimal_path(g, 5, 0, 9)
