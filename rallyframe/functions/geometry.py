"""Column functions on points, given as (x, y) pairs of columns; a point with a null x is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def point(name: str) -> Point:
    return F.col(f"{name}_x"), F.col(f"{name}_y")


def present(*points: Point) -> Column:
    out = points[0][0].isNotNull()
    for p in points[1:]:
        out &= p[0].isNotNull()
    return out


def distance(a: Point, b: Point) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def midpoint(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def vector_angle(u: Point, v: Point, zero: Column | None = None) -> Column:
    """Degrees between two vectors, the cosine clipped to [-1, 1]; ``zero`` (0.0) for a zero vector."""
    dot = (u[0] * v[0] + u[1] * v[1]).cast("double")
    norm = F.sqrt((u[0] * u[0] + u[1] * u[1]).cast("double")) * F.sqrt((v[0] * v[0] + v[1] * v[1]).cast("double"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(norm != 0, norm)))
    return F.when(norm == 0, F.lit(0.0) if zero is None else zero).otherwise(F.degrees(F.acos(cosine)))


def angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees at b between the arms to a and c; 0.0 for an arm of no length, null for a missing point."""
    arm = lambda p: (p[0] - b[0], p[1] - b[1])
    return F.when(present(a, b, c), vector_angle(arm(a), arm(c)))


def seconds(ts: Column) -> Column:
    """``HH:MM:SS``, ``MM:SS`` or ``SS`` as seconds, without range checks; empty is 0, anything else null."""
    group = lambda pattern, k: F.regexp_extract(ts, pattern, k).cast("long")
    three, two, one = r"^(\d+):(\d+):(\d+)$", r"^(\d+):(\d+)$", r"^(\d+)$"
    return (
        F.when(ts == "", F.lit(0).cast("long"))
        .when(ts.rlike(three), group(three, 1) * 3600 + group(three, 2) * 60 + group(three, 3))
        .when(ts.rlike(two), group(two, 1) * 60 + group(two, 2))
        .when(ts.rlike(one), group(one, 1))
    )
