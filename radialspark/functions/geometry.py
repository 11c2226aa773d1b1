"""Column functions over points and axis-aligned boxes, in float32 as the counting rule asks for.

A point is three float columns; a box is two such triples (low, upp). Literals are cast to float, since Spark widens a
float combined with a Python number to double.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX_LOW, BOX_HIGH = 0.0, 1000.0
Point = Sequence[Column]


def f32(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def point(*names: str) -> list[Column]:
    return [f32(F.col(n)) for n in names]


def squared_distance(a: Point, b: Point) -> Column:
    """(dx^2 + dy^2) + dz^2, associated to the left."""
    d = [f32(x - y) for x, y in zip(a, b, strict=True)]
    return f32(f32(f32(d[0] * d[0]) + f32(d[1] * d[1])) + f32(d[2] * d[2]))


def within_distance(a: Point, b: Point, radius: float) -> Column:
    return squared_distance(a, b) < f32(float32(float32(radius) ** 2))


def margin(low: Point, upp: Point) -> Column:
    """Sum of the edges."""
    e = [f32(u - lo) for lo, u in zip(low, upp, strict=True)]
    return f32(f32(e[0] + e[1]) + e[2])


def volume(low: Point, upp: Point) -> Column:
    e = [f32(u - lo) for lo, u in zip(low, upp, strict=True)]
    return f32(f32(e[0] * e[1]) * e[2])


def overlaps(low1: Point, upp1: Point, low2: Point, upp2: Point) -> Column:
    """Whether two closed boxes meet."""
    out = F.lit(True)
    for a, b, c, d in zip(low1, upp1, low2, upp2, strict=True):
        out = out & (a <= d) & (c <= b)
    return out


def overlap_volume(low1: Point, upp1: Point, low2: Point, upp2: Point) -> Column:
    """Volume of the intersection, 0 if there is none."""
    e = [F.greatest(f32(0.0), f32(F.least(b, d) - F.greatest(a, c))) for a, b, c, d in zip(low1, upp1, low2, upp2, strict=True)]
    return f32(f32(e[0] * e[1]) * e[2])


def center_distance(low1: Point, upp1: Point, low2: Point, upp2: Point) -> Column:
    """Squared distance of the centres."""
    mid = lambda low, upp: [f32(f32(a + b) / f32(2.0)) for a, b in zip(low, upp, strict=True)]
    return squared_distance(mid(low1, upp1), mid(low2, upp2))


def enlarge(low1: Point, upp1: Point, low2: Point, upp2: Point) -> tuple[list[Column], list[Column]]:
    """The least box around two boxes."""
    return [F.least(a, b) for a, b in zip(low1, low2, strict=True)], [F.greatest(a, b) for a, b in zip(upp1, upp2, strict=True)]


def query_box(center: Point, half: float) -> tuple[list[Column], list[Column]]:
    return [f32(c - f32(half)) for c in center], [f32(c + f32(half)) for c in center]


def below(low: Point, box_low: float = BOX_LOW) -> list[Column]:
    return [x < f32(box_low) for x in low]


def above(upp: Point, box_high: float = BOX_HIGH) -> list[Column]:
    return [x > f32(box_high) for x in upp]


def float32(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def half_width(radius: float) -> float:
    """The float half-width of the query box: the root of the squared float radius."""
    r = float32(radius)
    return float32(math.sqrt(float32(r * r)))


def log_radii(low: float, high: float, n: int) -> list[float]:
    """n log-spaced float radii from low to high, both included; n = 1 gives high alone. Ends may be swapped."""
    if n < 1 or low <= 0 or high <= 0 or low == high:
        raise ValueError("radii need n >= 1 and two different positive ends")
    low, high = min(low, high), max(low, high)
    a, b = math.log10(low), math.log10(high)
    out = [float32(10.0 ** (a + i * (b - a) / (n - 1))) for i in range(n - 1)] if n > 1 else []
    return [*out, float32(10.0**b)]


def check_radii(radii: Sequence[float]) -> list[float]:
    """The radii as floats; they must not be negative and must ascend."""
    out = [float32(r) for r in radii]
    if not out or out[0] < 0 or any(a >= b for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("radii must be non-negative and ascending")
    return out
