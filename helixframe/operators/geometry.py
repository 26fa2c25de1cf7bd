"""N20. Distance, angle and composite series of chosen atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.expr import angle_degrees, atom, distance
from helixframe.model import Trajectory

SCHEMA = "series_idx int, label string, kind string, unit string, t long, value double"


def _checked(traj: Trajectory, indices: list[int], strict: bool) -> None:
    if strict and (bad := [i for i in indices if not 0 <= i < traj.n_atoms]):
        raise ValueError(f"atom {bad[0]} is out of range")


def series(
    traj: Trajectory, pairs: list[tuple[int, int]] = (), triplets: list[tuple[int, int, int]] = (), labels: list[str] = (),
    composites: list[tuple[int, int]] = (), weights: list[float] = (), composite_labels: list[str] = (), strict: bool = True,
    key: str = "frame",
) -> DataFrame:
    """series_idx, label, kind, unit, t, value: distances, angles at the middle atom, then a + weight x b.

    strict: an unknown atom is an error, else its series is null (umbrella windows).  A composite's
    weight is -1 if none is given; null members make it null.  Everything is computed in a frame's row.
    """
    _checked(traj, [i for p in (*pairs, *triplets) for i in p], strict)
    made: list[tuple[str, str, str, Column]] = []
    for i, j in pairs:
        made.append((f"d({i},{j})", "distance", "Å", distance(atom("xyz", i), atom("xyz", j))))
    for i, j, k in triplets:
        made.append((f"a({i},{j},{k})", "angle", "°", angle_degrees(*[atom("xyz", a) for a in (i, j, k)])))
    for n, label in enumerate(labels[: len(made)]):
        if label.strip():
            made[n] = (label, *made[n][1:])
    simple = len(made)
    for n, (a, b) in enumerate(composites):
        if a >= simple or b >= simple:
            raise ValueError(f"composite {n} names a series that there is not")
        w = weights[n] if n < len(weights) else -1.0
        label = composite_labels[n] if n < len(composite_labels) and composite_labels[n].strip() else f"RC({a}{'−' if w < 0 else '+'}{b})"
        made.append((label, "composite", "Å", made[a][3] + F.lit(float(w)) * made[b][3]))
    if not made:
        raise ValueError("no pair or triplet was given")
    structs = [
        F.struct(F.lit(n).alias("series_idx"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(unit).alias("unit"), value.alias("value"))
        for n, (label, kind, unit, value) in enumerate(made)
    ]
    rows = traj.whole_frames.select(F.col(key).alias("t"), F.inline(F.array(*structs)))
    return rows.select("series_idx", "label", "kind", "unit", "t", "value")


def from_restraint(block: dict) -> dict:
    """The pairs and composite that a two-distance restraint block asks for, with 0-based atoms."""
    iat = [i - 1 for i in block["iat"]]
    if len(iat) == 4:
        w = block["rstwt"]
        return {"pairs": [(iat[0], iat[1]), (iat[2], iat[3])], "composites": [(0, 1)], "weights": [w[1] if len(w) > 1 else -1.0]}
    if len(iat) == 3:
        return {"triplets": [tuple(iat)]}
    return {"pairs": [(iat[0], iat[1])]}
