"""Column builders for boxes, zones and lines: no UDFs, so they stay inside generated code.

A box is (x, y, w, h) with the top-left corner first and y growing downward. A zone is a ring of (x, y)
points, a polygon as a list of rings (the first the outside, the others holes), or a list of such polygons.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of the width and height at which each anchor lies.
ANCHORS = {
    "tl": (0.0, 0.0), "tc": (0.5, 0.0), "tr": (1.0, 0.0),
    "cl": (0.0, 0.5), "cc": (0.5, 0.5), "cr": (1.0, 0.5),
    "bl": (0.0, 1.0), "bc": (0.5, 1.0), "br": (1.0, 1.0),
}


def lit(x: float) -> Column:
    return F.lit(float(x))


def ref_point(anchor: str = "bc", offset: Sequence[float] | None = None, x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> tuple[Column, Column]:
    """Anchor point of a box, moved by offset; unknown anchors mean bottom centre."""
    ax, ay = ANCHORS.get(anchor, ANCHORS["bc"])
    dx, dy = offset or (0, 0)
    px = F.col(x) + F.col(w) * lit(ax) + lit(dx)
    py = F.col(y) + F.col(h) * lit(ay) + lit(dy)
    return px, py


def polygons(zone) -> list[list[list[tuple[float, float]]]]:
    """Any accepted form of a zone as a list of polygons of rings."""
    if not zone:
        return []
    first = zone[0]
    if not isinstance(first[0], (list, tuple)):
        return [[[(float(a), float(b)) for a, b in zone]]]
    if not isinstance(first[0][0], (list, tuple)):
        return [[[(float(a), float(b)) for a, b in ring] for ring in zone]]
    return [[[(float(a), float(b)) for a, b in ring] for ring in polygon] for polygon in zone]


def _edges(rings: list[list[tuple[float, float]]]):
    for ring in rings:
        if len(set(ring)) < 3:
            raise ValueError("a ring needs at least three points")
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if a != b:
                yield a, b


def within_polygon(px: Column, py: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Strictly inside: an odd number of edges to the right, and on no edge."""
    xs, ys = zip(*(p for ring in rings for p in ring))
    inside, on = [], []
    for (x1, y1), (x2, y2) in _edges(rings):
        side = lit(x2 - x1) * (py - lit(y1)) - lit(y2 - y1) * (px - lit(x1))
        on.append((side == lit(0)) & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            inside.append(((py < lit(y1)) != (py < lit(y2))) & (px < lit(x1) + (py - lit(y1)) * lit((x2 - x1) / (y2 - y1))))
    near = (px > lit(min(xs))) & (px < lit(max(xs))) & (py > lit(min(ys))) & (py < lit(max(ys)))
    odd = reduce(lambda a, b: a != b, inside)
    return near & odd & ~reduce(or_, on)


def within_zone(px: Column, py: Column, zone) -> Column:
    """Strictly inside one of the zone's polygons; nulls are not inside."""
    parts = [within_polygon(px, py, rings) for rings in polygons(zone)]
    return F.coalesce(reduce(or_, parts), F.lit(False)) if parts else F.lit(False)


def within_any(px: Column, py: Column, zones: Sequence) -> Column:
    return reduce(or_, [within_zone(px, py, z) for z in zones]) if zones else F.lit(False)


def _segment_meets(x0: Column, y0: Column, x1: Column, y1: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Closed segment against closed box: their ranges meet, and the box's corners are not all on one side."""
    (ax, ay), (bx, by) = a, b
    meet = (x0 <= lit(max(ax, bx))) & (x1 >= lit(min(ax, bx))) & (y0 <= lit(max(ay, by))) & (y1 >= lit(min(ay, by)))
    sides = [lit(bx - ax) * (py - lit(ay)) - lit(by - ay) * (px - lit(ax)) for px in (x0, x1) for py in (y0, y1)]
    return meet & (F.least(*sides) <= lit(0)) & (F.greatest(*sides) >= lit(0))


def box_meets_line(line: Sequence[tuple[float, float]], size: float = 0, x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """Whether the closed box touches the polyline. size > 0 replaces the box by the square of that half width
    and height that stands on its bottom centre."""
    if len(line) < 2:
        raise ValueError("a line needs at least two points")
    x0, y0, x1, y1 = F.col(x), F.col(y), F.col(x) + F.col(w), F.col(y) + F.col(h)
    if size:
        centre = F.col(x) + F.col(w) / lit(2)
        x0, x1, y0 = centre - lit(size), centre + lit(size), y1 - lit(size)
    parts = [_segment_meets(x0, y0, x1, y1, tuple(a), tuple(b)) for a, b in zip(line, line[1:])]
    return F.coalesce(reduce(or_, parts), F.lit(False))


def area(w: str = "w", h: str = "h") -> Column:
    return F.col(w) * F.col(h)


def overlap(a: Sequence[Column], b: Sequence[Column], inclusive: bool = False) -> Column:
    """Area shared by two boxes (x, y, w, h); inclusive counts pixels, as if sides were one longer."""
    one = lit(1 if inclusive else 0)
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    across = F.least(ax + aw, bx + bw) - F.greatest(ax, bx) + one
    down = F.least(ay + ah, by + bh) - F.greatest(ay, by) + one
    return F.greatest(across, lit(0)) * F.greatest(down, lit(0))


def iou(a: Sequence[Column], b: Sequence[Column], inclusive: bool = False, least_union: float = 1e-6) -> Column:
    """Intersection over union, the union at least least_union."""
    one = lit(1 if inclusive else 0)
    both = overlap(a, b, inclusive)
    union = (a[2] + one) * (a[3] + one) + (b[2] + one) * (b[3] + one) - both
    return both / F.greatest(union, lit(least_union))


def iob(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """Intersection over either box's own area, 0 where that is 0; negative sizes raise an error."""
    wrong = reduce(or_, [c < lit(0) for c in (a[2], a[3], b[2], b[3])])
    both = F.when(wrong, F.raise_error(F.lit("box sizes must not be negative")).cast("double")).otherwise(overlap(a, b))
    share = lambda size: F.when(size > lit(0), both / F.greatest(size, lit(1e-300))).otherwise(both * lit(0))
    return share(a[2] * a[3]), share(b[2] * b[3])


__all__ = ["ANCHORS", "area", "box_meets_line", "iob", "iou", "overlap", "polygons", "ref_point", "within_any", "within_polygon", "within_zone"]
