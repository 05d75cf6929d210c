"""Exact predicates on Python integers, for kernels and for coordinates beyond 64-bit products."""

from __future__ import annotations


def orient(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def incircle(a, b, c, p, oriented: bool = False):
    rows = []
    for q in (a, b, c):
        dx, dy = q[0] - p[0], q[1] - p[1]
        rows.append((dx, dy, dx * dx + dy * dy))
    (ax, ay, aa), (bx, by, bb), (cx, cy, cc) = rows
    det = aa * (bx * cy - cx * by) + bb * (cx * ay - ax * cy) + cc * (ax * by - bx * ay)
    if not oriented:
        return det
    side = orient(a, b, c)
    if side == 0:
        raise ValueError("the triangle is collinear")
    return det if side > 0 else -det


def crosses(a, b, c, d) -> bool:
    """The open segments cross in one inner point of both."""
    s = lambda x: (x > 0) - (x < 0)
    return s(orient(a, b, c)) * s(orient(a, b, d)) < 0 and s(orient(c, d, a)) * s(orient(c, d, b)) < 0
