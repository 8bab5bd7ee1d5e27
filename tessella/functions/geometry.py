"""Scalar functions and predicates on rectangles (columns xmin, ymin, xmax, ymax)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def sides(df: DataFrame) -> list[Column]:
    return [df[s] for s in SIDES]


def normalised(x1: str, y1: str, x2: str, y2: str) -> list[Column]:
    """The four sides of the rectangle between two corners, in any order."""
    return [F.least(x1, x2).alias("xmin"), F.least(y1, y2).alias("ymin"), F.greatest(x1, x2).alias("xmax"), F.greatest(y1, y2).alias("ymax")]


def scaled(col: Column | str, factor: float) -> Column:
    """A double as a fixed-precision integer, rounded half away from zero. Values beyond 32 bits raise (ANSI)."""
    return F.round((F.col(col) if isinstance(col, str) else col) * F.lit(float(factor))).cast("int")


def centre(low: Column | str, high: Column | str) -> Column:
    """Middle of two sides in 64 bits, truncated toward zero."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    both = low.cast("long") + high.cast("long")
    return F.when(both >= 0, F.shiftright(both, 1)).otherwise(-F.shiftright(-both, 1))


def centre_point() -> list[Column]:
    """The degenerate rectangle at the centre."""
    cx, cy = centre("xmin", "xmax"), centre("ymin", "ymax")
    return [cx.alias("xmin"), cy.alias("ymin"), cx.alias("xmax"), cy.alias("ymax")]


def _spread(v: Column) -> Column:
    """The low 16 bits of v with a zero between any two."""
    v = v.cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(x: Column, y: Column) -> Column:
    """Interleaved low 16 bits, y above x, as a signed 32-bit integer."""
    z = F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))
    return F.when(z >= 1 << 31, z - (1 << 32)).otherwise(z).cast("int")


def overlaps(a: str, b: str) -> Column:
    """Closed overlap of two aliased relations: touching edges and corners count."""
    p, q = (lambda s: F.col(f"{a}.{s}")), (lambda s: F.col(f"{b}.{s}"))
    return (p("xmin") <= q("xmax")) & (p("xmax") >= q("xmin")) & (p("ymin") <= q("ymax")) & (p("ymax") >= q("ymin"))


def ceil_div(a: Column | int, b: Column | int) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.floor((a.cast("long") + b.cast("long") - 1) / b).cast("long")


def clamped(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def bounding(prefix: str = "") -> list[Column]:
    """Aggregates of the least rectangle around a group."""
    return [F.min(f"{prefix}xmin").alias("xmin"), F.min(f"{prefix}ymin").alias("ymin"), F.max(f"{prefix}xmax").alias("xmax"), F.max(f"{prefix}ymax").alias("ymax")]
