"""Column expressions: three-dimensional vectors, angles, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def atom(xyz: Column | str, i: int | Column) -> Vec:
    """The coordinates of atom i in a frame's array; null where there is no such atom."""
    at = F.lit(i) if isinstance(i, int) else i
    return tuple(F.get(F.col(xyz) if isinstance(xyz, str) else xyz, at * 3 + c) for c in range(3))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def angle_degrees(a: Vec, b: Vec, c: Vec) -> Column:
    """The angle at b; null where an arm is shorter than 1e-10."""
    u, v = sub(a, b), sub(c, b)
    nu, nv = norm(u), norm(v)
    cosine = F.try_divide(dot(u, v), nu * nv)
    return F.when((nu >= 1e-10) & (nv >= 1e-10), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def dihedral_degrees(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """The signed torsion about b-c; null where b and c are closer than 1e-10."""
    axis = sub(c, b)
    n1, n2 = cross(sub(b, a), axis), cross(axis, sub(d, c))
    length = norm(axis)
    sine = F.try_divide(dot(cross(n1, axis), n2), length)
    return F.when(length >= 1e-10, -F.degrees(F.atan2(sine, dot(n1, n2))))


def bin_index(value: Column, low: Column | float, width: Column | float, bins: int) -> Column:
    """floor((value - low) / width x bins) cut to 0..bins-1; bin 0 where the width is zero."""
    low, width = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, width))
    at = F.floor(F.try_divide(value - low, width) * bins)
    return F.when(value.isNotNull(), F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)), F.lit(0))).cast("int")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
