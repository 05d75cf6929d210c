"""Planar predicates as Column expressions; points are structs with fields x and y (or i and j).

Integers are widened to long before products, so values are exact up to about 2**31 in each
coordinate difference; doubles are computed as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _xy(p: Column, fields: tuple[str, str]) -> tuple[Column, Column]:
    return p[fields[0]], p[fields[1]]


def orient(a: Column, b: Column, c: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """Twice the signed area of a, b, c: positive if they turn counterclockwise."""
    (ax, ay), (bx, by), (cx, cy) = (_xy(p, fields) for p in (a, b, c))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def incircle(a: Column, b: Column, c: Column, p: Column, oriented: bool = False, fields: tuple[str, str] = ("x", "y")) -> Column:
    """In-circle determinant, in double: positive if p is inside the circle of counterclockwise a, b, c.

    ``oriented`` makes the sign independent of the triangle's orientation and null for a collinear one.
    """
    px, py = (v.cast("double") for v in _xy(p, fields))
    rows = []
    for q in (a, b, c):
        x, y = (v.cast("double") for v in _xy(q, fields))
        dx, dy = x - px, y - py
        rows.append((dx, dy, dx * dx + dy * dy))
    (ax, ay, aa), (bx, by, bb), (cx, cy, cc) = rows
    det = aa * (bx * cy - cx * by) + bb * (cx * ay - ax * cy) + cc * (ax * by - bx * ay)
    if not oriented:
        return det
    side = orient(a, b, c, fields)
    return F.when(side > 0, det).when(side < 0, -det)


def on_segment(a: Column, b: Column, p: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """p lies on the closed segment a b."""
    (ax, ay), (bx, by), (px, py) = (_xy(q, fields) for q in (a, b, p))
    return (orient(a, b, p, fields) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def bboxes_overlap(a: Column, b: Column, c: Column, d: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """The closed bounding boxes of a b and c d meet."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (_xy(p, fields) for p in (a, b, c, d))
    return (
        (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx))
        & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    )


def same_point(a: Column, b: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    (ax, ay), (bx, by) = _xy(a, fields), _xy(b, fields)
    return (ax == bx) & (ay == by)


def xcross(a: Column, b: Column, c: Column, d: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """The open segments cross in one inner point of both."""
    s = lambda x: F.signum(x.cast("double"))
    o = lambda p, q, r: s(orient(p, q, r, fields))
    return (o(a, b, c) * o(a, b, d) < 0) & (o(c, d, a) * o(c, d, b) < 0)


def lines_intersect(a: Column, b: Column, c: Column, d: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """-1 apart, 0 share an end, 1 cross, 2 overlap, 3 identical, 4 an end within the other, 5 degenerate."""
    same = lambda p, q: same_point(p, q, fields)
    ends = same(a, c) | same(a, d) | same(b, c) | same(b, d)
    inside = lambda p, q, r: on_segment(p, q, r, fields) & ~same(r, p) & ~same(r, q)
    within = inside(a, b, c) | inside(a, b, d) | inside(c, d, a) | inside(c, d, b)
    collinear = (orient(a, b, c, fields) == 0) & (orient(a, b, d, fields) == 0)
    return (
        F.when(same(a, b) | same(c, d), 5)
        .when(~bboxes_overlap(a, b, c, d, fields), -1)
        .when((same(a, c) & same(b, d)) | (same(a, d) & same(b, c)), 3)
        .when(xcross(a, b, c, d, fields), 1)
        .when(collinear, F.when(within, 2).when(ends, 0).otherwise(-1))
        .when(ends, 0)
        .when(within, 4)
        .otherwise(-1)
    )


def dist_l1(a: Column, b: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    (ax, ay), (bx, by) = _xy(a, fields), _xy(b, fields)
    return F.abs(ax - bx) + F.abs(ay - by)


def dist2(a: Column, b: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    (ax, ay), (bx, by) = _xy(a, fields), _xy(b, fields)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def point_segment_dist2(p: Column, a: Column, b: Column, fields: tuple[str, str] = ("x", "y")) -> Column:
    """Squared distance of p to the closed segment a b; to a where the segment is a point."""
    (px, py), (ax, ay), (bx, by) = ((v.cast("double") for v in _xy(q, fields)) for q in (p, a, b))
    vx, vy = bx - ax, by - ay
    n = vx * vx + vy * vy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * vx + (py - ay) * vy) / n)))
    return (px - ax - t * vx) ** 2 + (py - ay - t * vy) ** 2
