"""The engine's queries on the synthetic tables, each with the same answer stated in SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.ligand import frames as ligand_frames
from helixframe.operators import correlation, dihedrals, geometry, linalg, mbar, network, sasa, structural, thermo
from helixframe.operators.membrane import Membrane
from helixframe.selection import compile_selection, resolve_mask
from helixframe.sinks import structures as sinks
from helixframe.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

#: Correlations of the synthetic frames are weak, so their networks take a low threshold.
THRESHOLD = 0.03
FORCE = 300.0
CENTERS = [(-2.0, -2.0), (0.0, 0.0), (2.0, 2.0), (-2.0, 2.0)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places, and no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function's name, with doubles rounded, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            SQL[f.__name__] = complete(sql, digits)
        return f

    return add


#: The bindings of the synthetic tables, as common table expressions.
VIEWS = {
    "traj": """traj AS (
  SELECT vec_id AS frame, k::INT AS atom_idx, 20 * embedding[3*k+1]::DOUBLE AS x, 20 * embedding[3*k+2]::DOUBLE AS y, 20 * embedding[3*k+3]::DOUBLE AS z
  FROM embeddings, range(21) t(k))""",
    "atoms": """atoms AS (
  SELECT k::INT AS atom_idx, ['N','CA','C'][k%3+1] AS atom_name, ['ALA','GLY','SER','LEU','LYS','ASP','VAL'][k//3+1] AS res_name,
    'A' AS chain_id, (k//3+1)::BIGINT AS res_seq, ['N','C','C'][k%3+1] AS element FROM range(21) t(k))""",
    "patoms": """patoms AS (
  SELECT p_partkey::INT AS atom_idx, ['N','CA','C'][p_partkey%3+1] AS atom_name, ['ALA','GLY','SER','LEU','LYS','ASP','VAL'][(p_partkey//3)%7+1] AS res_name,
    CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS chain_id, (p_partkey//3+1)::BIGINT AS res_seq, ['N','C','C'][p_partkey%3+1] AS element FROM part)""",
    "cells": "cells AS (SELECT vec_id AS frame, 60.0::DOUBLE + vec_id % 7 AS a, 60.0::DOUBLE + vec_id % 5 AS b, 80.0::DOUBLE AS c FROM embeddings)",
    "windows": "windows AS (SELECT k::INT AS window_idx, -0.8::DOUBLE + (2.1::DOUBLE - -0.8::DOUBLE) * k / 29 AS val0 FROM range(30) t(k))",
    "cv": """cv AS (
  SELECT window_idx, event_id AS sample_idx, val0 + (value - 50) / 250 AS x FROM events JOIN windows ON window_idx = event_id % 30)""",
    "states": """states AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, dense_rank() OVER (ORDER BY event_type) - 1 AS state FROM events)""",
    "total": "total AS (SELECT count(*)::DOUBLE AS n FROM embeddings)",
    "mean": "mean AS (SELECT atom_idx, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM traj GROUP BY atom_idx)",
    "delta": "delta AS (SELECT frame, atom_idx, x - mx AS dx, y - my AS dy, z - mz AS dz FROM traj JOIN mean USING (atom_idx))",
    "gram": """gram AS (
  SELECT a.atom_idx AS i, b.atom_idx AS j, sum(a.dx*b.dx + a.dy*b.dy + a.dz*b.dz) AS g FROM delta a JOIN delta b USING (frame) GROUP BY ALL)""",
    "dccm": """dccm AS (
  SELECT g.i, g.j, CASE WHEN sqrt(p.g) * sqrt(q.g) > 1e-9 THEN g.g / (sqrt(p.g) * sqrt(q.g)) ELSE 0 END AS value
  FROM gram g JOIN gram p ON p.i = g.i AND p.j = g.i JOIN gram q ON q.i = g.j AND q.j = g.j)""",
    "edges": f"edges AS (SELECT i AS src, j AS dst, abs(value) AS weight FROM dccm WHERE i <> j AND abs(value) >= {THRESHOLD})",
    "pairs": """pairs AS (
  SELECT a.frame, a.atom_idx AS i, b.atom_idx AS j, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d
  FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx < b.atom_idx)""",
}
_ORDER = ["traj", "atoms", "patoms", "cells", "windows", "cv", "states", "total", "mean", "delta", "gram", "dccm", "edges", "pairs"]
_NEEDS = {"cv": ["windows"], "mean": ["traj"], "delta": ["traj", "mean"], "gram": ["delta"], "dccm": ["gram"], "edges": ["dccm"], "pairs": ["traj"]}


def complete(sql: str, digits: int = 6) -> str:
    """The query with the views it names put in front; `{{expr}}` marks a double to be rounded."""
    import re

    wanted: set[str] = set()

    def need(v: str) -> None:
        if v not in wanted:
            wanted.add(v)
            for w in _NEEDS.get(v, []):
                need(w)

    for v in _ORDER:
        if re.search(rf"\b{v}\b", sql):
            need(v)
    body = re.sub(r"\{\{(.*?)\}\}", rf"(round(\1, {digits}) + 0.0)", sql, flags=re.S).strip()
    views = [VIEWS[v] for v in _ORDER if v in wanted]
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if m := re.match(r"WITH(\s+RECURSIVE)?\s+", body, flags=re.I):
        return f"WITH {recursive}" + ",\n".join([*views, body[m.end() :]])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body


def traj(spark, sf_dir):
    return fixtures.trajectory(spark, sf_dir)


# ---------------------------------------------------------------------------------------------- structure


@query("""SELECT t.frame, {{sqrt(sum((t.x-r.x)**2 + (t.y-r.y)**2 + (t.z-r.z)**2) / count(*))}} AS rmsd
FROM traj t JOIN traj r USING (atom_idx) WHERE r.frame = (SELECT min(frame) FROM traj) GROUP BY t.frame""")
def rmsd(spark, sf_dir):
    return structural.rmsd(traj(spark, sf_dir))


@query("SELECT atom_idx, {{sqrt(avg(dx*dx) + avg(dy*dy) + avg(dz*dz))}} AS rmsf FROM delta GROUP BY atom_idx")
def rmsf(spark, sf_dir):
    return structural.rmsf(traj(spark, sf_dir))


@query("SELECT frame, {{sqrt(var_pop(x) + var_pop(y) + var_pop(z))}} AS rg FROM traj GROUP BY frame")
def radius_of_gyration(spark, sf_dir):
    return structural.radius_of_gyration(traj(spark, sf_dir))


@query("SELECT atom_idx, {{mx}} AS x, {{my}} AS y, {{mz}} AS z FROM mean")
def mean_structure(spark, sf_dir):
    return structural.mean_structure(traj(spark, sf_dir))


@query("SELECT atom_idx, {{x}} AS x, {{y}} AS y, {{z}} AS z FROM traj WHERE frame = 5")
def frame_snapshot(spark, sf_dir):
    return structural.frame_coordinates(traj(spark, sf_dir), 5)


@query("""WITH kept AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS f FROM (SELECT DISTINCT frame FROM traj) WHERE frame % 3 = 0)
SELECT f AS frame, atom_idx, {{x}} AS x, {{y}} AS y, {{z}} AS z FROM traj JOIN kept USING (frame)""")
def stride_subsample(spark, sf_dir):
    return structural.stride(traj(spark, sf_dir), 3).long


def _selected(spark, sf_dir, text):
    return fixtures.part_atoms(spark, sf_dir).filter(compile_selection(text)).select("atom_idx", "atom_name", "res_name", "res_seq")


@query("SELECT atom_idx, atom_name, res_name, res_seq FROM patoms WHERE atom_name IN ('N', 'CA', 'C')")
def select_backbone(spark, sf_dir):
    return _selected(spark, sf_dir, "name N CA C")


@query("SELECT atom_idx, atom_name, res_name, res_seq FROM patoms WHERE res_seq >= 2 AND res_seq <= 5 AND atom_name LIKE 'C%'")
def select_resid_range(spark, sf_dir):
    return _selected(spark, sf_dir, "resid >= 2 and resid <= 5 and name C*")


@query("SELECT atom_idx, atom_name, res_name, res_seq FROM patoms WHERE NOT (res_name IN ('GLY', 'SER') OR atom_idx BETWEEN 0 AND 2)")
def select_not(spark, sf_dir):
    return _selected(spark, sf_dir, "not (resname GLY SER or index 0:2)")


@query("""SELECT atom_idx + 1 AS serial FROM patoms
WHERE res_seq IN (2, 3) OR upper(res_name) = 'LYS' OR atom_idx + 1 IN (1, 20)""")
def mask_resolve(spark, sf_dir):
    return resolve_mask(fixtures.part_atoms(spark, sf_dir), ":2,3 @1,20,0 :lys")


@query("SELECT atom_idx, res_seq, res_name, chain_id FROM patoms")
def selection_residues(spark, sf_dir):
    return fixtures.part_atoms(spark, sf_dir).select("atom_idx", "res_seq", "res_name", "chain_id")


@query("""WITH f AS (SELECT atom_idx, sqrt(avg(dx*dx) + avg(dy*dy) + avg(dz*dz)) AS v FROM delta GROUP BY atom_idx)
SELECT atom_idx, {{(v - (SELECT min(v) FROM f)) / ((SELECT max(v) FROM f) - (SELECT min(v) FROM f)) * 100}} AS bfactor FROM f""")
def bfactor_scale(spark, sf_dir):
    return structural.bfactors(structural.rmsf(traj(spark, sf_dir)), "rmsf")


# ---------------------------------------------------------------------------------------------- correlation


@query("""WITH d AS (
  SELECT frame, 3*atom_idx AS k, x AS v FROM traj UNION ALL SELECT frame, 3*atom_idx + 1, y FROM traj UNION ALL SELECT frame, 3*atom_idx + 2, z FROM traj
) SELECT a.k AS i, b.k AS j, {{covar_pop(a.v, b.v)}} AS value FROM d a JOIN d b USING (frame) GROUP BY ALL""")
def covariance_3n(spark, sf_dir):
    from helixframe.plans.primitives import covariance, entries

    return entries(spark, covariance(traj(spark, sf_dir)))


@query("SELECT i, j, {{value}} AS value FROM dccm")
def dccm(spark, sf_dir):
    return correlation.dccm(traj(spark, sf_dir))


@query("""WITH c AS (
  SELECT i, j, count(*) / (SELECT n FROM total) AS freq FROM pairs JOIN atoms a ON a.atom_idx = i JOIN atoms b ON b.atom_idx = j
  WHERE d <= 8.0 AND abs(a.res_seq - b.res_seq) > 2 GROUP BY i, j
), s AS (SELECT i, j, freq FROM c UNION ALL SELECT j, i, freq FROM c)
SELECT a.atom_idx AS i, b.atom_idx AS j, {{coalesce(freq, 0)}} AS freq
FROM atoms a CROSS JOIN atoms b LEFT JOIN s ON s.i = a.atom_idx AND s.j = b.atom_idx""")
def contact_map(spark, sf_dir):
    return correlation.contact_map(traj(spark, sf_dir))


@query("""SELECT i AS donor, j AS acceptor, {{count(*) / (SELECT n FROM total)}} AS occupancy, {{avg(d)}} AS mean_dist
FROM pairs WHERE d <= 3.5 AND i % 3 = 0 AND j % 3 = 0 GROUP BY i, j HAVING count(*) / (SELECT n FROM total) >= 0.05""")
def hbond_occupancy(spark, sf_dir):
    return correlation.hydrogen_bonds(traj(spark, sf_dir))


_PRS = """c AS (SELECT i, j, g / (SELECT n FROM total) AS c FROM gram), v AS (SELECT i, greatest(c, 1e-12) AS v FROM c WHERE i = j)"""


@query(f"WITH {_PRS} SELECT c.i, c.j, {{{{abs(c) / sqrt(p.v * q.v)}}}} AS value FROM c JOIN v p ON p.i = c.i JOIN v q ON q.i = c.j")
def prs_matrix(spark, sf_dir):
    return correlation.prs_matrix(traj(spark, sf_dir))


@query(f"""WITH {_PRS}, e AS (SELECT c.i, sum(abs(c)) / any_value(v.v) AS e FROM c JOIN v ON v.i = c.i WHERE c.i <> c.j GROUP BY c.i)
SELECT i AS atom_idx, {{{{e / (SELECT max(e) FROM e)}}}} AS effectiveness FROM e""")
def prs_effectiveness(spark, sf_dir):
    return correlation.prs_profiles(traj(spark, sf_dir)).select("atom_idx", "effectiveness")


@query(f"""WITH {_PRS}, e AS (SELECT c.j, sum(abs(c)) / any_value(v.v) AS e FROM c JOIN v ON v.i = c.j WHERE c.i <> c.j GROUP BY c.j)
SELECT j AS atom_idx, {{{{e / (SELECT max(e) FROM e)}}}} AS sensitivity FROM e""")
def prs_sensitivity(spark, sf_dir):
    return correlation.prs_profiles(traj(spark, sf_dir)).select("atom_idx", "sensitivity")


@query("""WITH l AS (SELECT frame, atom_idx, sqrt(dx*dx + dy*dy + dz*dz) AS d FROM delta),
k AS (SELECT least(50, greatest(5, floor(sqrt(n)))) AS k FROM total),
r AS (SELECT atom_idx, min(d) - ((max(d) - min(d)) * 0.01 + 1e-12) AS lo, (max(d) - min(d)) + 2 * ((max(d) - min(d)) * 0.01 + 1e-12) AS w FROM l GROUP BY atom_idx),
b AS (SELECT frame, atom_idx, greatest(0, least(k - 1, floor((d - lo) / w * k))) AS b FROM l JOIN r USING (atom_idx), k),
h AS (SELECT i, j, sum(-p * ln(p)) AS h FROM (
  SELECT x.atom_idx AS i, y.atom_idx AS j, count(*) / (SELECT n FROM total) AS p FROM b x JOIN b y USING (frame) GROUP BY x.atom_idx, y.atom_idx, x.b, y.b) GROUP BY i, j)
SELECT h.i, h.j, {{CASE WHEN h.i = h.j THEN 1 WHEN sqrt(p.h * q.h) < 1e-12 THEN 0
  ELSE greatest(0, least(1, (p.h + q.h - h.h) / sqrt(p.h * q.h))) END}} AS value
FROM h JOIN h p ON p.i = h.i AND p.j = h.i JOIN h q ON q.i = h.j AND q.j = h.j""")
def mutual_information(spark, sf_dir):
    return correlation.mutual_information(traj(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- modes


_SPRINGS = """s AS (
  SELECT a.atom_idx AS i, b.atom_idx AS j, [b.mx-a.mx, b.my-a.my, b.mz-a.mz] AS r, (b.mx-a.mx)**2 + (b.my-a.my)**2 + (b.mz-a.mz)**2 AS r2
  FROM mean a JOIN mean b ON a.atom_idx <> b.atom_idx
), n AS (SELECT * FROM s WHERE r2 <= 7.5**2)"""


@query(f"""WITH {_SPRINGS} SELECT a.atom_idx AS i, b.atom_idx AS j,
  CASE WHEN a.atom_idx = b.atom_idx THEN (SELECT count(*) FROM n WHERE n.i = a.atom_idx)::DOUBLE
    ELSE -(SELECT count(*) FROM n WHERE n.i = a.atom_idx AND n.j = b.atom_idx)::DOUBLE + 0.0 END AS value FROM atoms a CROSS JOIN atoms b""")
def gnm_kirchhoff(spark, sf_dir):
    return linalg.kirchhoff(traj(spark, sf_dir))


@query(f"""WITH {_SPRINGS}, ab AS (SELECT a, b FROM range(3) t(a), range(3) u(b)),
o AS (SELECT 3*i + a AS i, 3*j + b AS j, -r[a+1] * r[b+1] / r2 AS value FROM n, ab),
d AS (SELECT 3*i + a AS i, 3*i + b AS j, sum(r[a+1] * r[b+1] / r2) AS value FROM n, ab GROUP BY ALL)
SELECT p.k::INT AS i, q.k::INT AS j, {{{{coalesce(o.value, d.value, 0)}}}} AS value
FROM range(63) p(k) CROSS JOIN range(63) q(k) LEFT JOIN o ON o.i = p.k AND o.j = q.k LEFT JOIN d ON d.i = p.k AND d.j = q.k""")
def anm_hessian(spark, sf_dir):
    return linalg.hessian(traj(spark, sf_dir))


@query()
def enm_bfactors(spark, sf_dir):
    return linalg.ElasticNetwork(traj(spark, sf_dir)).bfactors()


@query()
def enm_modes(spark, sf_dir):
    return linalg.ElasticNetwork(traj(spark, sf_dir)).modes()


@query()
def nma_overlap(spark, sf_dir):
    return linalg.ElasticNetwork(traj(spark, sf_dir)).overlap()


@query()
def pca_variance(spark, sf_dir):
    return linalg.Pca(traj(spark, sf_dir)).variance()


@query()
def pca_projection(spark, sf_dir):
    return linalg.Pca(traj(spark, sf_dir)).projection()


@query()
def conformational_entropy(spark, sf_dir):
    return linalg.entropy(traj(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- networks


def _edges(spark, sf_dir):
    return network.edges(correlation.dccm(traj(spark, sf_dir)), THRESHOLD)


@query("SELECT src, dst, {{weight}} AS weight FROM edges")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM edges),
reach(node, other) AS (SELECT atom_idx, atom_idx FROM atoms UNION SELECT node, dst FROM reach JOIN e ON src = other)
SELECT node::BIGINT AS node, min(other)::BIGINT AS component FROM reach GROUP BY node""")
def graph_components(spark, sf_dir):
    return network.components(_edges(spark, sf_dir), network.nodes_of(spark, fixtures.N_ATOMS))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM edges),
walk(s, v, d, seen) AS (
  SELECT atom_idx, atom_idx, 0, [atom_idx] FROM atoms
  UNION ALL SELECT s, dst, d + 1, list_append(seen, dst) FROM walk JOIN e ON src = v WHERE NOT list_contains(seen, dst) AND d < 4
), p AS MATERIALIZED (SELECT s, v, d, count(*)::DOUBLE AS n FROM walk GROUP BY s, v, d QUALIFY d = min(d) OVER (PARTITION BY s, v))
SELECT x.atom_idx::BIGINT AS node, {{coalesce(sum(a.n * b.n / st.n), 0) / (20 * 19)}} AS betweenness
FROM atoms x LEFT JOIN (p st JOIN p a ON a.s = st.s JOIN p b ON b.v = st.v AND b.s = a.v AND a.d + b.d = st.d AND a.v <> st.s AND a.v <> st.v)
  ON a.v = x.atom_idx GROUP BY x.atom_idx""")
def betweenness(spark, sf_dir):
    return network.betweenness(_edges(spark, sf_dir), fixtures.N_ATOMS)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT i AS src, j AS dst, -ln(abs(value)) AS c FROM dccm WHERE i <> j AND abs(value) >= 0.001),
walk(v, cost, path, costs) AS (
  SELECT 0, 0.0::DOUBLE, [0], [0.0::DOUBLE]
  UNION ALL SELECT dst, cost + c, list_append(path, dst), list_append(costs, cost + c) FROM walk JOIN e ON src = v
  WHERE NOT list_contains(path, dst) AND len(path) < 4 AND v <> 20
), best AS (SELECT path, costs FROM walk WHERE v = 20 ORDER BY cost LIMIT 1)
SELECT k::INT AS hop, path[k]::INT AS src, path[k + 1]::INT AS dst, {{costs[k + 1]}} AS cost FROM best, range(1, 4) t(k) WHERE k < len(path)""")
def optimal_path(spark, sf_dir):
    graph = network.edges(correlation.dccm(traj(spark, sf_dir)), 0.001)
    return network.optimal_path(graph, fixtures.N_ATOMS, 0, 20)


@query()
def communities_gn(spark, sf_dir):
    return network.communities(_edges(spark, sf_dir), fixtures.N_ATOMS)


# ---------------------------------------------------------------------------------------------- free energy, clusters


@query("""WITH p AS (SELECT x, y FROM traj WHERE atom_idx = 0),
r AS (SELECT min(x) AS x0, (max(x) - min(x)) * 1.05 AS xw, min(y) AS y0, (max(y) - min(y)) * 1.05 AS yw, count(*) AS n FROM p),
c AS (SELECT greatest(0, least(49, floor((y - y0) / yw * 50)))::INT AS y_bin, greatest(0, least(49, floor((x - x0) / xw * 50)))::INT AS x_bin, count(*) AS k FROM p, r GROUP BY ALL),
f AS (SELECT a.k::INT AS y_bin, b.k::INT AS x_bin, -ln(coalesce(c.k, 1) / r.n) AS e
  FROM range(50) a(k) CROSS JOIN range(50) b(k) CROSS JOIN r LEFT JOIN c ON c.y_bin = a.k AND c.x_bin = b.k)
SELECT y_bin, x_bin, {{e - (SELECT min(e) FROM f)}} AS energy FROM f""")
def fes_2d(spark, sf_dir):
    first = traj(spark, sf_dir).frames.select("frame", F.get("xyz", F.lit(0)).alias("x"), F.get("xyz", F.lit(1)).alias("y"))
    return thermo.free_energy_surface(first, "x", "y")


@query()
def fes_pca(spark, sf_dir):
    return thermo.free_energy_surface(linalg.Pca(traj(spark, sf_dir)).projection(), "pc1", "pc2")


def _points(spark, sf_dir):
    """x and y of the first atom as points in the plane."""
    rows = traj(spark, sf_dir).frames
    return rows.select(F.col("frame").alias("t"), F.get("xyz", F.lit(0)).alias("pc1"), F.get("xyz", F.lit(1)).alias("pc2"))


_POINTS = "p AS (SELECT frame AS t, x, y FROM traj WHERE atom_idx = 0)"
_C0 = "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(CENTERS)) + ") v(k, cx, cy))"


def _step(k: int) -> str:
    return f"""a{k} AS (SELECT t, x, y, k FROM p, c{k} QUALIFY row_number() OVER (PARTITION BY t ORDER BY (x-cx)**2 + (y-cy)**2, k) = 1),
c{k + 1} AS (SELECT c{k}.k, coalesce(avg(x), any_value(cx)) AS cx, coalesce(avg(y), any_value(cy)) AS cy FROM c{k} LEFT JOIN a{k} USING (k) GROUP BY c{k}.k)"""


@query(f"WITH {_POINTS}, {_C0}, {_step(0)} SELECT t, k AS cluster FROM a0")
def kmeans_assign_step(spark, sf_dir):
    return thermo.assign(_points(spark, sf_dir), CENTERS)


@query(f"WITH {_POINTS}, {_C0}, {_step(0)}, {_step(1)}, {_step(2)} SELECT k AS cluster, {{{{cx}}}} AS x, {{{{cy}}}} AS y FROM c3")
def kmeans_lloyd_3steps(spark, sf_dir):
    centers, points = CENTERS, _points(spark, sf_dir)
    for _ in range(3):
        centers = thermo.lloyd_step(points, centers)
    return spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(centers)], "cluster int, x double, y double")


@query(f"""WITH {_POINTS}, {_C0}, {_step(0)}
SELECT k AS cluster, {{{{count(t) / (SELECT count(*) FROM p)}}}} AS population FROM c0 LEFT JOIN a0 USING (k) GROUP BY k""")
def cluster_populations(spark, sf_dir):
    return thermo.populations(thermo.assign(_points(spark, sf_dir), CENTERS), len(CENTERS))


@query()
def kmeans_converged(spark, sf_dir):
    points = thermo.points_of(linalg.Pca(traj(spark, sf_dir)).projection())
    return thermo.assign(points, thermo.kmeans(points, 5))


@query()
def msm_timescales(spark, sf_dir):
    points = thermo.points_of(linalg.Pca(traj(spark, sf_dir)).projection())
    return thermo.MarkovModel(thermo.assign(points, thermo.kmeans(points, 5)), 5, lag=10).its()


@query("SELECT a.state::INT AS i, b.state::INT AS j, count(*) AS n FROM states a JOIN states b ON b.t = a.t + 10 GROUP BY ALL")
def msm_counts_lag10(spark, sf_dir):
    return thermo.lag_counts(fixtures.states(spark, sf_dir), 10)


@query("""WITH c AS (SELECT a.state AS i, b.state AS j, count(*) / 2 AS n FROM states a JOIN states b ON b.t = a.t + 10 GROUP BY ALL),
s AS (SELECT i, j, sum(n) AS n FROM (SELECT i, j, n FROM c UNION ALL SELECT j, i, n FROM c) GROUP BY ALL),
g AS (SELECT a.k AS i, b.k AS j, coalesce(n, 0) AS n FROM range(5) a(k) CROSS JOIN range(5) b(k) LEFT JOIN s ON s.i = a.k AND s.j = b.k)
SELECT i::INT AS i, j::INT AS j, {{CASE WHEN sum(n) OVER (PARTITION BY i) > 0 THEN n / sum(n) OVER (PARTITION BY i) WHEN i = j THEN 1 ELSE 0 END}} AS p FROM g""")
def msm_transition_matrix(spark, sf_dir):
    return thermo.transition_matrix(thermo.lag_counts(fixtures.states(spark, sf_dir), 10), 5)


# ---------------------------------------------------------------------------------------------- umbrella sampling


@query("SELECT window_idx, {{any_value(val0)}} AS val0, count(sample_idx) AS n FROM windows LEFT JOIN cv USING (window_idx) GROUP BY window_idx")
def umbrella_windows(spark, sf_dir):
    n = mbar.window_stats(fixtures.cv_samples(spark, sf_dir)).select("window_idx", "n")
    return fixtures.windows(spark).join(n, "window_idx", "left").select("window_idx", "val0", F.coalesce("n", F.lit(0)).alias("n"))


_BETA = repr(mbar.beta())


@query(f"""SELECT cv.window_idx, sample_idx, w.window_idx AS k, {{{{{_BETA} * 0.5 * {FORCE} * (x - w.val0)**2}}}} AS u
FROM cv CROSS JOIN windows w""")
def umbrella_bias_matrix(spark, sf_dir):
    return mbar.bias_matrix(fixtures.cv_samples(spark, sf_dir), fixtures.windows(spark), FORCE)


_SWEEP = f"""n AS (SELECT window_idx AS k, count(*)::DOUBLE AS n FROM cv GROUP BY window_idx),
u AS (SELECT cv.sample_idx, cv.x, w.window_idx AS k, {_BETA} * 0.5 * {FORCE} * (cv.x - w.val0)**2 AS u FROM cv CROSS JOIN windows w),
m AS (SELECT sample_idx, any_value(x) AS x, max(ln(n) - u) AS m FROM u JOIN n USING (k) GROUP BY sample_idx),
d AS (SELECT u.sample_idx, any_value(m.x) AS x, any_value(m.m) + ln(sum(exp(ln(n) - u - m.m))) AS d FROM u JOIN n USING (k) JOIN m USING (sample_idx) GROUP BY u.sample_idx)"""


@query(f"""WITH {_SWEEP}, f AS (SELECT k, -ln(sum(exp(-u - d))) AS f FROM u JOIN d USING (sample_idx) GROUP BY k)
SELECT k, {{{{f - (SELECT f FROM f WHERE k = 0)}}}} AS f FROM f""")
def mbar_one_sweep(spark, sf_dir):
    return mbar.one_sweep(fixtures.cv_samples(spark, sf_dir), fixtures.windows(spark), FORCE)


@query(f"""WITH {_SWEEP} SELECT greatest(0, least(28, floor((x - lo) / (hi - lo) * 29)))::INT AS bin, count(*) AS n, {{{{-ln(sum(exp(-d)))}}}} AS pmf_kt
FROM d, (SELECT min(val0) AS lo, max(val0) AS hi FROM windows) WHERE x BETWEEN lo AND hi GROUP BY ALL""")
def mbar_pmf_fixed_f(spark, sf_dir):
    return mbar.pmf_at(fixtures.cv_samples(spark, sf_dir), fixtures.windows(spark), FORCE, [0.0] * fixtures.N_WINDOWS, 29)


@query()
def mbar_pmf(spark, sf_dir):
    return mbar.Mbar(fixtures.cv_samples(spark, sf_dir), fixtures.windows(spark), FORCE, n_boot=50).profile()


@query("""WITH s AS (SELECT window_idx, count(*) AS n, greatest(stddev_pop(x), 1e-12) * pow(count(*)::DOUBLE, -0.2) AS bw FROM cv GROUP BY window_idx),
g AS (SELECT k::INT AS point, (-0.8::DOUBLE - 2.9 * 0.05) + (2.9::DOUBLE + 2 * 2.9 * 0.05) * k / 59 AS x FROM range(60) t(k))
SELECT cv.window_idx, point, {{any_value(g.x)}} AS x, {{sum(exp(-0.5 * ((g.x - cv.x) / bw)**2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))}} AS density
FROM cv JOIN s USING (window_idx) CROSS JOIN g GROUP BY cv.window_idx, point""")
def window_kde(spark, sf_dir):
    return mbar.window_density(fixtures.cv_samples(spark, sf_dir), -0.8, 2.1)


@query("SELECT window_idx, count(*) AS n, {{avg(x)}} AS mean, {{stddev_pop(x)}} AS std FROM cv GROUP BY window_idx")
def window_stats(spark, sf_dir):
    return mbar.window_stats(fixtures.cv_samples(spark, sf_dir))


@query("""SELECT sample_idx, w.window_idx FROM cv CROSS JOIN windows w
QUALIFY row_number() OVER (PARTITION BY sample_idx ORDER BY abs(x - w.val0), w.window_idx) = 1""")
def nearest_window(spark, sf_dir):
    samples = fixtures.cv_samples(spark, sf_dir).select("sample_idx", "x")
    return mbar.nearest_window(samples, fixtures.windows(spark), "x").select("sample_idx", "window_idx")


# ---------------------------------------------------------------------------------------------- membrane


_LEAF = """h AS (SELECT frame, atom_idx, z FROM traj WHERE atom_idx % 3 = 0),
md AS (SELECT frame, list_sort(list(z))[count(*) // 2 + 1] AS m FROM h GROUP BY frame),
l AS (SELECT frame, atom_idx, z, z >= m AS up FROM h JOIN md USING (frame))"""


@query(f"""WITH {_LEAF} SELECT frame, {{{{abs(coalesce(avg(z) FILTER (WHERE up), 0) - coalesce(avg(z) FILTER (WHERE NOT up), 0))}}}} AS thickness FROM l GROUP BY frame""")
def membrane_thickness(spark, sf_dir):
    return Membrane(traj(spark, sf_dir), "N").per_frame().select("frame", "thickness")


@query(f"""WITH {_LEAF}, u AS (SELECT frame, count(DISTINCT atom_idx // 3) FILTER (WHERE up) AS n FROM l GROUP BY frame)
SELECT frame, {{{{CASE WHEN n > 0 THEN a * b / n ELSE 0 END}}}} AS apl FROM u JOIN cells USING (frame)""")
def membrane_apl(spark, sf_dir):
    return Membrane(traj(spark, sf_dir), "N").per_frame().select("frame", "apl")


@query(f"""WITH {_LEAF}, r AS (SELECT up, min(z) AS lo, greatest(1, max(z) - min(z)) AS w FROM l GROUP BY up),
b AS (SELECT up, greatest(0, least(49, floor((z - lo) / w * 50)))::INT AS bin, count(*) AS n FROM l JOIN r USING (up) GROUP BY ALL)
SELECT CASE WHEN g.up THEN 'upper' ELSE 'lower' END AS leaflet, k::INT AS bin, {{{{coalesce(n / (SELECT max(n) FROM b x WHERE x.up = g.up), 0)}}}} AS density
FROM (VALUES (true), (false)) g(up) CROSS JOIN range(50) t(k) LEFT JOIN b ON b.up = g.up AND b.bin = k""")
def membrane_z_density(spark, sf_dir):
    return Membrane(traj(spark, sf_dir), "N").density()


@query("""WITH c AS (SELECT atom_idx, lead(atom_idx) OVER (ORDER BY atom_idx) AS nxt, row_number() OVER (ORDER BY atom_idx) - 1 AS pair, atom_name || res_seq AS label FROM atoms WHERE element = 'C')
SELECT pair::INT AS pair, label, {{abs(avg(0.5 * (3 * ((b.z - a.z) / greatest(sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2), 1e-10))**2 - 1)))}} AS abs_scd
FROM c JOIN traj a ON a.atom_idx = c.atom_idx JOIN traj b ON b.atom_idx = nxt AND b.frame = a.frame GROUP BY pair, label""")
def lipid_order(spark, sf_dir):
    return Membrane(traj(spark, sf_dir), "N").order()


@query(f"""WITH {_LEAF}, u AS (SELECT frame, count(DISTINCT atom_idx // 3) FILTER (WHERE up) AS nu, count(DISTINCT atom_idx // 3) FILTER (WHERE NOT up) AS nl,
  abs(coalesce(avg(z) FILTER (WHERE up), 0) - coalesce(avg(z) FILTER (WHERE NOT up), 0)) AS t FROM l GROUP BY frame),
v AS (SELECT u.*, CASE WHEN nu > 0 THEN a * b / nu ELSE 0 END AS apl FROM u JOIN cells USING (frame))
SELECT {{{{avg(t)}}}} AS mean_thickness, {{{{avg(apl)}}}} AS mean_apl, arg_min(nu, frame)::INT AS n_upper, arg_min(nl, frame)::INT AS n_lower FROM v""")
def membrane_summary(spark, sf_dir):
    return Membrane(traj(spark, sf_dir), "N").summary()


# ---------------------------------------------------------------------------------------------- surface


#: Every point of every atom is tried against every other atom of its frame.
_SURFACE = """sp AS (SELECT k, 1 - 2 * k / 91.0::DOUBLE AS y, pi() * (3 - sqrt(5)) * k AS phi FROM range(92) t(k)),
sa AS (SELECT frame, atom_idx, res_name || ' ' || res_seq AS residue, x, y, z, CASE element WHEN 'C' THEN 1.70 ELSE 1.55 END::DOUBLE + 1.4 AS r FROM traj JOIN atoms USING (atom_idx)),
sq AS (SELECT sa.frame, sa.atom_idx, k, sa.x + r * sqrt(greatest(0, 1 - sp.y*sp.y)) * cos(phi) AS px, sa.y + r * sp.y AS py, sa.z + r * sqrt(greatest(0, 1 - sp.y*sp.y)) * sin(phi) AS pz FROM sa CROSS JOIN sp),
sc AS (SELECT sq.frame, sq.atom_idx, count(DISTINCT k) AS n FROM sq JOIN sa o ON o.frame = sq.frame
  WHERE o.atom_idx <> sq.atom_idx AND (o.x-px)**2 + (o.y-py)**2 + (o.z-pz)**2 < o.r**2 GROUP BY sq.frame, sq.atom_idx),
ser AS (SELECT sa.frame, (sa.atom_idx // 3)::INT AS res_idx, residue, sum(4 * pi() * r**2 * (92 - coalesce(n, 0)) / 92) AS sasa
  FROM sa LEFT JOIN sc ON sc.frame = sa.frame AND sc.atom_idx = sa.atom_idx GROUP BY sa.frame, sa.atom_idx // 3, residue)"""


@query(f"WITH {_SURFACE} SELECT frame, res_idx, residue, {{{{sasa}}}} AS sasa FROM ser")
def sasa_residue_series(spark, sf_dir):
    return sasa.residue_series(traj(spark, sf_dir))


@query(f"WITH {_SURFACE} SELECT res_idx, residue, {{{{avg(sasa)}}}} AS mean_sasa, {{{{stddev_pop(sasa)}}}} AS std_sasa FROM ser GROUP BY res_idx, residue")
def sasa_per_residue(spark, sf_dir):
    return sasa.per_residue(sasa.residue_series(traj(spark, sf_dir)))


@query(f"WITH {_SURFACE} SELECT frame, {{{{sum(sasa)}}}} AS total_sasa FROM ser GROUP BY frame")
def sasa_total(spark, sf_dir):
    return sasa.total(sasa.residue_series(traj(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- dihedrals, geometry


_ANGLES = """pts AS (SELECT frame, list([x, y, z] ORDER BY atom_idx) AS p FROM traj GROUP BY frame),
quad AS (
  SELECT r AS res_idx, frame, 'phi' AS kind, p[3*(r-1)+3] AS a, p[3*r+1] AS b, p[3*r+2] AS c, p[3*r+3] AS d FROM pts, range(1, 7) t(r)
  UNION ALL SELECT r, frame, 'psi', p[3*r+1], p[3*r+2], p[3*r+3], p[3*(r+1)+1] FROM pts, range(0, 6) t(r)),
vec AS (SELECT res_idx, frame, kind, [b[1]-a[1], b[2]-a[2], b[3]-a[3]] AS u, [c[1]-b[1], c[2]-b[2], c[3]-b[3]] AS v, [d[1]-c[1], d[2]-c[2], d[3]-c[3]] AS w FROM quad),
nrm AS (SELECT res_idx, frame, kind, v, [u[2]*v[3]-u[3]*v[2], u[3]*v[1]-u[1]*v[3], u[1]*v[2]-u[2]*v[1]] AS n, [v[2]*w[3]-v[3]*w[2], v[3]*w[1]-v[1]*w[3], v[1]*w[2]-v[2]*w[1]] AS m FROM vec),
ang AS (SELECT res_idx, frame, kind, -degrees(atan2(
    ((n[2]*v[3]-n[3]*v[2])*m[1] + (n[3]*v[1]-n[1]*v[3])*m[2] + (n[1]*v[2]-n[2]*v[1])*m[3]) / sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]),
    n[1]*m[1]+n[2]*m[2]+n[3]*m[3])) AS angle FROM nrm),
ser AS (SELECT r::INT AS res_idx, (r + 1)::BIGINT AS res_seq, res_name, (3*r + 1)::INT AS atom_idx, f.frame,
    max(angle) FILTER (WHERE kind = 'phi') AS phi, max(angle) FILTER (WHERE kind = 'psi') AS psi
  FROM range(7) t(r) CROSS JOIN (SELECT vec_id AS frame FROM embeddings) f JOIN atoms ON atoms.atom_idx = 3*r + 1
  LEFT JOIN ang ON ang.res_idx = r AND ang.frame = f.frame GROUP BY r, res_name, f.frame)"""


@query(f"WITH {_ANGLES} SELECT res_idx, res_seq, res_name, atom_idx, frame, {{{{phi}}}} AS phi, {{{{psi}}}} AS psi FROM ser")
def dihedral_series(spark, sf_dir):
    return dihedrals.series(traj(spark, sf_dir))


@query(f"""WITH {_ANGLES} SELECT res_idx, res_seq, res_name, atom_idx, {{{{avg(phi)}}}} AS phi_mean, {{{{stddev_pop(phi)}}}} AS phi_std,
  {{{{avg(psi)}}}} AS psi_mean, {{{{stddev_pop(psi)}}}} AS psi_std, least(count(phi), count(psi)) AS n_valid FROM ser GROUP BY res_idx, res_seq, res_name, atom_idx""")
def dihedral_summary(spark, sf_dir):
    return dihedrals.summary(dihedrals.series(traj(spark, sf_dir)))


@query(f"""WITH {_ANGLES}, c AS (SELECT greatest(0, least(59, floor((psi + 180) / 360 * 60)))::INT AS psi_bin, greatest(0, least(59, floor((phi + 180) / 360 * 60)))::INT AS phi_bin, count(*) AS n
  FROM ser WHERE phi IS NOT NULL AND psi IS NOT NULL GROUP BY ALL) SELECT psi_bin, phi_bin, {{{{n / (SELECT max(n) FROM c)}}}} AS density FROM c""")
def rama_density(spark, sf_dir):
    return dihedrals.density(dihedrals.series(traj(spark, sf_dir)))


@query(f"""WITH {_ANGLES}, c AS (SELECT CASE WHEN phi BETWEEN -145 AND -30 AND psi BETWEEN -60 AND 20 THEN 'alpha' WHEN phi BETWEEN -170 AND -55 AND psi >= 90 THEN 'beta' ELSE 'other' END AS region
  FROM ser WHERE phi IS NOT NULL AND psi IS NOT NULL) SELECT region, count(*) AS n, {{{{count(*) / (SELECT count(*) FROM c)}}}} AS share FROM c GROUP BY region""")
def rama_regions(spark, sf_dir):
    return dihedrals.regions(dihedrals.series(traj(spark, sf_dir)))


@query(f"""WITH {_ANGLES} SELECT request, res_idx, res_seq, res_name, ser.atom_idx, frame, {{{{phi}}}} AS phi, {{{{psi}}}} AS psi
FROM ser JOIN (VALUES (0, 13), (1, 4), (2, 99)) v(request, a) ON ser.atom_idx = a""")
def dihedral_lookup(spark, sf_dir):
    return dihedrals.lookup(dihedrals.series(traj(spark, sf_dir)), [13, 4, 99])


@query("""SELECT p.k AS series_idx, 'd(' || i || ',' || j || ')' AS label, a.frame AS t, {{sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)}} AS value
FROM (VALUES (0, 0, 10), (1, 3, 20)) p(k, i, j) JOIN traj a ON a.atom_idx = i JOIN traj b ON b.atom_idx = j AND b.frame = a.frame""")
def geometry_distance(spark, sf_dir):
    return geometry.series(traj(spark, sf_dir), pairs=[(0, 10), (3, 20)]).select("series_idx", "label", "t", "value")


@query("""SELECT a.frame AS t, {{degrees(acos(greatest(-1, least(1, ((a.x-b.x)*(c.x-b.x) + (a.y-b.y)*(c.y-b.y) + (a.z-b.z)*(c.z-b.z))
  / (sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) * sqrt((c.x-b.x)**2 + (c.y-b.y)**2 + (c.z-b.z)**2))))))}} AS value
FROM traj a JOIN traj b ON b.frame = a.frame AND b.atom_idx = 4 JOIN traj c ON c.frame = a.frame AND c.atom_idx = 7 WHERE a.atom_idx = 1""")
def geometry_angle(spark, sf_dir):
    return geometry.series(traj(spark, sf_dir), triplets=[(1, 4, 7)]).select("t", "value")


@query("""WITH d AS (SELECT a.frame, k, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS v
  FROM (VALUES (0, 0, 10), (1, 3, 20)) p(k, i, j) JOIN traj a ON a.atom_idx = i JOIN traj b ON b.atom_idx = j AND b.frame = a.frame)
SELECT p.frame AS t, {{p.v - q.v}} AS value FROM d p JOIN d q USING (frame) WHERE p.k = 0 AND q.k = 1""")
def geometry_composite(spark, sf_dir):
    made = geometry.series(traj(spark, sf_dir), pairs=[(0, 10), (3, 20)], composites=[(0, 1)])
    return made.filter("kind = 'composite'").select("t", "value")


# ---------------------------------------------------------------------------------------------- sinks


@query("""WITH r AS (SELECT t.frame AS f, sqrt(sum((t.x-r.x)**2 + (t.y-r.y)**2 + (t.z-r.z)**2) / count(*)) AS v FROM traj t JOIN traj r USING (atom_idx)
  WHERE r.frame = (SELECT min(frame) FROM traj) GROUP BY t.frame),
s AS (SELECT atom_idx::BIGINT AS f, sqrt(avg(dx*dx) + avg(dy*dy) + avg(dz*dz)) AS v FROM delta GROUP BY atom_idx),
g AS (SELECT frame AS f, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS v FROM traj GROUP BY frame)
SELECT coalesce(r.f, s.f, g.f) AS frame, coalesce(printf('%.6f', r.v), 'NaN') AS rmsd_angstrom, coalesce(printf('%.6f', s.v), 'NaN') AS rmsf_angstrom,
  coalesce(printf('%.6f', g.v), 'NaN') AS rg_angstrom FROM r FULL JOIN s USING (f) FULL JOIN g ON g.f = coalesce(r.f, s.f)""")
def export_wide(spark, sf_dir):
    t = traj(spark, sf_dir)
    return sinks.export_wide(structural.rmsd(t), structural.rmsf(t), structural.radius_of_gyration(t))


@query("SELECT i, " + ", ".join(f"printf('%.4f', round(max(value) FILTER (WHERE j = {j}), 9) + 0.0) AS c{j}" for j in range(21)) + " FROM dccm GROUP BY i")
def dccm_pivot(spark, sf_dir):
    cells = correlation.dccm(traj(spark, sf_dir)).withColumn("value", F.round("value", 9) + 0.0)
    return sinks.pivot_matrix(cells, fixtures.N_ATOMS)


@query("""WITH f AS (SELECT atom_idx, sqrt(avg(dx*dx) + avg(dy*dy) + avg(dz*dz)) AS v FROM delta GROUP BY atom_idx),
b AS (SELECT atom_idx, (v - (SELECT min(v) FROM f)) / ((SELECT max(v) FROM f) - (SELECT min(v) FROM f)) * 100 AS b FROM f)
SELECT atom_idx::BIGINT AS line, printf('ATOM  %5d  %s %s %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %s', atom_idx + 1, rpad(atom_name, 3, ' '), res_name, chain_id, res_seq,
  x, y, z, b, lpad(element, 2, ' ')) AS text FROM traj JOIN atoms USING (atom_idx) JOIN b USING (atom_idx) WHERE frame = 0
UNION ALL SELECT * FROM (VALUES (220::BIGINT, 'TER'), (221::BIGINT, 'END'))""")
def pdb_lines(spark, sf_dir):
    t = traj(spark, sf_dir)
    return sinks.pdb_lines(t, 0, structural.bfactors(structural.rmsf(t), "rmsf"))


@query("""WITH n AS (SELECT b.atom_idx FROM traj a JOIN traj b ON b.frame = a.frame
  WHERE a.frame = 0 AND a.atom_idx = 0 AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 5.0)
SELECT ':' || string_agg(DISTINCT res_seq::VARCHAR, ',' ORDER BY res_seq::VARCHAR) AS mask, count(*)::INT AS n_atoms FROM n JOIN atoms USING (atom_idx)""")
def qm_region_mask(spark, sf_dir):
    """The residues with an atom within 5 Å of the first, in the first frame."""
    t = traj(spark, sf_dir)
    one = structural.frame_coordinates(t, 0)
    x, y, z = one.filter("atom_idx = 0").select("x", "y", "z").first()
    near = one.filter((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 + (F.col("z") - z) ** 2 <= 25.0)
    return sinks.region_mask(sinks.region_atoms(t, 0, [r.atom_idx + 1 for r in near.collect()]))  # atoms of one region


@query("""SELECT atom_idx + 1 AS serial, atom_name, res_name, res_seq, chain_id, element, {{x}} AS x, {{y}} AS y, {{z}} AS z
FROM traj JOIN atoms USING (atom_idx) WHERE frame = 0 AND atom_idx IN (0, 7)
UNION ALL SELECT 9, 'C1', 'LIG', 9999, 'L', 'C', 1.0, 2.0, 3.0 UNION ALL SELECT 10, 'O2', 'LIG', 9999, 'L', 'O', 4.0, 5.0, 6.0""")
def qm_region_append(spark, sf_dir):
    region = sinks.region_atoms(traj(spark, sf_dir), 0, [1, 8])
    ligand = spark.createDataFrame([(0, "C", 1.0, 2.0, 3.0), (1, "O", 4.0, 5.0, 6.0)], "idx int, element string, x double, y double, z double")
    return sinks.append_to_region(region, ligand)


# ---------------------------------------------------------------------------------------------- small molecules


@query()
def ligand_properties(spark, sf_dir):
    rows = fixtures.molecules(spark, sf_dir)
    told = ligand_frames.properties(rows.select("smiles").distinct())
    return rows.join(told, "smiles").select("mol_id", "smiles", "properties.*")


@query()
def ligand_coordinates(spark, sf_dir):
    rows = fixtures.molecules(spark, sf_dir)
    return rows.join(ligand_frames.minimised(rows.select("smiles").distinct().repartition(8), steps=50), "smiles")
