"""Geometry as Column expressions: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def length3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def segment_code(dx: Column, dy: Column, dz: Column, tolerance: float = 5.0, inclusive: bool = False, zero: str | None = None) -> Column:
    """R (riser), H (horizontal) or D (diagonal) by the angle above the horizontal.

    `inclusive` counts the tolerance itself as R or H and measures by atan2; `zero` is the code of a segment
    without length.
    """
    length = length3(dx, dy, dz)
    if inclusive:
        flat = F.sqrt(dx * dx + dy * dy)
        angle = F.when(flat <= 1e-6, 90.0).otherwise(F.degrees(F.atan2(F.abs(dz), flat)))
        code = F.when(angle >= 90 - tolerance, "R").when(angle <= tolerance, "H").otherwise("D")
    else:
        angle = F.degrees(F.asin(F.least(F.abs(dz) / length, F.lit(1.0))))
        code = F.when(angle > 90 - tolerance, "R").when(angle < tolerance, "H").otherwise("D")
    return F.when(length < 1e-9, F.lit(zero)).otherwise(code)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def unit3(x: Column, y: Column, z: Column, least: float = 1e-9) -> Column:
    """Struct of the unit vector; zero where the length is below `least`."""
    n = length3(x, y, z)
    part = lambda c: F.when(n < least, 0.0).otherwise(c / n)
    return F.struct(part(x).alias("x"), part(y).alias("y"), part(z).alias("z"))


def cross3(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return a["dy"] * b["dz"] - a["dz"] * b["dy"], a["dz"] * b["dx"] - a["dx"] * b["dz"], a["dx"] * b["dy"] - a["dy"] * b["dx"]


def box_distance(p: tuple[Column, Column, Column], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """Distance of a point to an axis-aligned box; 0 inside."""
    out = [F.greatest(lo - x, F.lit(0.0), x - hi) for x, lo, hi in zip(p, low, high)]
    return length3(*out)


def box_hit(p: tuple[Column, ...], q: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...], margin: float = 0.0) -> Column:
    """Whether the segment p-q meets the box widened by `margin` (slab test; axes of no extent are tested apart)."""
    first, last = [F.lit(0.0)], [F.lit(1.0)]
    for x, y, lo, hi in zip(p, q, low, high):
        d, lo, hi = y - x, lo - margin, hi + margin
        still = F.abs(d) < 1e-9
        inside = (x >= lo) & (x <= hi)
        safe = F.when(still, 1.0).otherwise(d)
        a, b = (lo - x) / safe, (hi - x) / safe
        first.append(F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)))
        last.append(F.when(still, 1.0).otherwise(F.greatest(a, b)))
    return F.greatest(*first) <= F.least(*last)


def rotate_xy(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def snap_orthogonal(x: Column, y: Column) -> tuple[Column, Column]:
    """Keeps the larger component; x wins ties."""
    wide = F.abs(x) >= F.abs(y)
    return F.when(wide, x).otherwise(0.0), F.when(wide, 0.0).otherwise(y)


def face(offsets: dict[str, Column]) -> Column:
    """Name of the largest offset; the first name wins ties."""
    ranked = F.array(*(F.struct(v.alias("v"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(offsets.items())))
    return F.array_max(ranked)["n"]


def displacement(p: Column, q: Column) -> Column:
    """(dx, dy, dz) from p to q with two decimals."""
    return F.struct(*(F.round(q[c] - p[c], 2).alias(f"d{c}") for c in "xyz"))


def y_up(p: Column) -> Column:
    """A point in the axes of viewers, where y points up."""
    return F.struct(p["x"].alias("x"), p["z"].alias("y"), (-p["y"]).alias("z"))
