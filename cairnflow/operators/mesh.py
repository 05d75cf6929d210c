"""Meshing: Delaunay triangulation, neighbours, constraint graphs and constrained recovery.

verts: mesh_id, vid, x, y; faces: mesh_id, fid, a, b, c (counterclockwise, smallest vertex
first, rows sorted); nabrs: n0, n1, n2, the face across the side opposite each vertex or -1.
The triangulation kernels take a mesh per task; everything else is relational.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exact
from ..functions import geometry as geo
from ..plans.iterate import durable, ranked
from .errors import ConstraintError

RIDGE, VALLEY, BOUNDARY = 2, 1, 4
KINDS = {"OTHER": 0, "VALLEY": VALLEY, "RIDGE": RIDGE, "BOUNDARY": BOUNDARY}
GHOST = -1


class Mesh:
    """Triangles as a map from directed sides to the vertex on their left, and for each vertex the end of a side from it."""

    def __init__(self, points: list[tuple], faces: Iterable[tuple[int, int, int]] = ()):
        self.p, self.apex, self.out = points, {}, {}
        for f in faces:
            self.add(*f)

    def add(self, a: int, b: int, c: int) -> None:
        for u, v, w in ((a, b, c), (b, c, a), (c, a, b)):
            if (u, v) in self.apex:
                raise ConstraintError(f"side ({u}, {v}) belongs to two faces of one orientation")
            self.apex[u, v] = w
            self.out[u] = v

    def remove(self, a: int, b: int, c: int) -> None:
        for side in ((a, b), (b, c), (c, a)):
            del self.apex[side]

    def faces(self) -> list[tuple[int, int, int]]:
        """Canonical rows, without ghost faces."""
        return sorted((u, v, w) for (u, v), w in self.apex.items() if GHOST not in (u, v, w) and u < v and u < w)

    def has(self, u: int, v: int) -> bool:
        return (u, v) in self.apex or (v, u) in self.apex

    def flip(self, u: int, v: int) -> tuple[int, int]:
        """Replace the diagonal u v of its quadrilateral; returns the new one."""
        c, d = self.apex[u, v], self.apex[v, u]
        self.remove(u, v, c)
        self.remove(v, u, d)
        self.add(u, d, c)
        self.add(d, v, c)
        return (min(c, d), max(c, d))

    def convex(self, u: int, v: int) -> bool:
        c, d = self.apex.get((u, v)), self.apex.get((v, u))
        return c is not None and d is not None and exact.crosses(self.p[u], self.p[v], self.p[c], self.p[d])

    def around(self, u: int) -> Iterator[tuple[int, int]]:
        """The sides opposite u of the faces at u: counterclockwise to the boundary, then clockwise."""
        first = w = self.out.get(u)
        while w is not None and (x := self.apex.get((u, w))) is not None:
            yield w, x
            w = x
            if w == first:
                return
        w = first
        while w is not None and (x := self.apex.get((w, u))) is not None:
            yield x, w
            w = x

    def crossing(self, u: int, v: int) -> list[tuple[int, int]]:
        """Interior sides that the segment u v properly crosses, found by walking the faces from u to v.

        Where the segment meets a vertex or the boundary on its way, every side is looked at.
        """
        pu, pv = self.p[u], self.p[v]
        found = []
        start = next(((a, b) for a, b in self.around(u) if exact.orient(pu, pv, self.p[a]) < 0 < exact.orient(pu, pv, self.p[b]) and exact.orient(self.p[a], self.p[b], pv) <= 0), None)
        while start is not None:
            a, b = start
            found.append((min(a, b), max(a, b)))
            c = self.apex.get((b, a))
            if c == v:
                return sorted(found)
            side = 0 if c is None else exact.orient(pu, pv, self.p[c])
            if not side or len(found) > len(self.apex):
                break
            start = (c, b) if side < 0 else (a, c)
        return sorted((a, b) for (a, b) in self.apex if a < b and (b, a) in self.apex and not {a, b} & {u, v} and exact.crosses(pu, pv, self.p[a], self.p[b]))


def delaunay(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Canonical faces of a Delaunay triangulation by incremental insertion with ghost triangles.

    Each insertion walks from the last face to the point, then grows the cavity of faces
    whose circle holds it, over shared sides. Raises for fewer than 3 points, repeated points
    and points on one line.
    """
    n = len(points)
    if n < 3 or len(set(points)) < n:
        raise ValueError("at least three distinct points are needed")
    order = sorted(range(n), key=lambda k: _curve(points[k]))
    i, j = order[0], order[1]
    k = next((m for m in order[2:] if exact.orient(points[i], points[j], points[m]) != 0), None)
    if k is None:
        raise ValueError("all points lie on one line")
    if exact.orient(points[i], points[j], points[k]) < 0:
        i, j = j, i
    mesh = Mesh(points, [(i, j, k), (j, i, GHOST), (k, j, GHOST), (i, k, GHOST)])

    def holds(a: int, b: int, c: int, m: int) -> bool:
        if GHOST in (a, b, c):
            while c != GHOST:
                a, b, c = b, c, a
            side = exact.orient(points[a], points[b], points[m])
            if side:
                return side > 0
            lo, hi = sorted((points[a], points[b]))
            return lo < points[m] < hi
        return exact.incircle(points[a], points[b], points[c], points[m]) > 0

    last = (i, j, k)
    for m in order:
        if m in (i, j, k):
            continue
        a, b, c = last
        for _ in range(4 * n + 16):  # walk towards m; a face of the cavity ends it
            if holds(a, b, c, m):
                break
            for u, v in ((a, b), (b, c), (c, a)):
                if GHOST in (u, v):
                    continue
                if exact.orient(points[u], points[v], points[m]) < 0:
                    a, b, c = v, u, mesh.apex[v, u]
                    break
            else:
                if GHOST in (a, b, c):
                    while c != GHOST:
                        a, b, c = b, c, a
                    a, b, c = GHOST, b, mesh.apex[GHOST, b]  # along the hull
                else:
                    break
        if not holds(a, b, c, m):  # a walk can stall on ties: look at every face
            a, b, c = next((u, v, w) for (u, v), w in mesh.apex.items() if holds(u, v, w, m))
        cavity, stack = {_turned(a, b, c)}, [(a, b, c)]
        while stack:
            a, b, c = stack.pop()
            for u, v in ((a, b), (b, c), (c, a)):
                f = (v, u, mesh.apex[v, u])
                if _turned(*f) not in cavity and holds(*f, m):
                    cavity.add(_turned(*f))
                    stack.append(f)
        rim = [(u, v) for a, b, c in cavity for u, v in ((a, b), (b, c), (c, a)) if _turned(v, u, mesh.apex[v, u]) not in cavity]
        for f in cavity:
            mesh.remove(*f)
        for u, v in rim:
            mesh.add(u, v, m)
        last = next(((u, v, m) for u, v in rim if GHOST not in (u, v)), (*rim[0], m))
    return mesh.faces()


def _turned(a: int, b: int, c: int) -> tuple[int, int, int]:
    return min((a, b, c), (b, c, a), (c, a, b))


def _curve(p: tuple[int, int]) -> tuple:
    """An insertion order that keeps successive points near each other: rows of a coarse grid, back and forth."""
    row = int(p[1]) // 64
    return (row, p[0] if row % 2 == 0 else -p[0], p[1])


def recover_edge(mesh: Mesh, u: int, v: int, locked: set[tuple[int, int]]) -> None:
    """Make u v a side of the mesh by flips, then restore the Delaunay property around it."""
    edge = (min(u, v), max(u, v))
    if mesh.has(u, v):
        return
    todo = mesh.crossing(u, v)
    if not todo:
        raise ConstraintError(f"edge ({u}, {v}) isn't in the mesh and crosses no side")
    if bad := [e for e in todo if e in locked]:
        raise ConstraintError(f"edge ({u}, {v}) crosses the locked side {bad[0]}")
    fresh, stalled = [], 0
    while todo:
        a, b = todo.pop(0)
        if not mesh.convex(a, b):
            todo.append((a, b))
            stalled += 1
            if stalled > len(todo):
                raise ConstraintError(f"edge ({u}, {v}) can't be recovered")
            continue
        stalled = 0
        c, d = mesh.flip(a, b)
        if not {c, d} & {u, v} and exact.crosses(mesh.p[u], mesh.p[v], mesh.p[c], mesh.p[d]):
            todo.append((c, d))
        else:
            fresh.append((c, d))
    if not mesh.has(u, v):
        raise ConstraintError(f"edge ({u}, {v}) passes through a vertex")
    changed = True
    while changed:
        changed = False
        for n, (a, b) in enumerate(fresh):
            if (a, b) == edge or (a, b) in locked or not mesh.convex(a, b):
                continue
            c, d = mesh.apex[a, b], mesh.apex[b, a]
            if exact.incircle(mesh.p[a], mesh.p[b], mesh.p[c], mesh.p[d]) > 0:
                fresh[n] = mesh.flip(a, b)
                changed = True


def recover_edges(points: list[tuple], faces: list[tuple[int, int, int]], edges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Canonical faces of the mesh with every edge recovered, in order; rows present from the start are locked at once."""
    mesh = Mesh(points, faces)
    canon = [(min(e), max(e)) for e in edges]
    locked = {e for e in canon if mesh.has(*e)}
    for n, e in enumerate(canon):
        try:
            recover_edge(mesh, *e, locked)
        except ConstraintError as err:
            raise ConstraintError(f"constraint edge {n} {e}: {err}") from err
        locked.add(e)
    if missing := [n for n, e in enumerate(canon) if not mesh.has(*e)]:
        raise ConstraintError(f"constraint edge {missing[0]} {canon[missing[0]]} was lost")
    return mesh.faces()


FACES = "mesh_id string, fid int, a int, b int, c int"


def _face_rows(mesh_id: str, faces: list[tuple[int, int, int]]) -> pd.DataFrame:
    f = np.array(faces, np.int32).reshape(-1, 3)
    return pd.DataFrame({"mesh_id": mesh_id, "fid": np.arange(len(f), dtype=np.int32), "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]})


def triangulate_points(verts: DataFrame) -> DataFrame:
    """Canonical Delaunay faces of each mesh_id's integer points; vertices are meant by vid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        vid = pdf.vid.to_numpy()
        faces = [tuple(int(vid[k]) for k in f) for f in delaunay(list(zip(pdf.x.tolist(), pdf.y.tolist())))]
        return _face_rows(pdf.mesh_id.iloc[0], sorted(_turned(*f) for f in faces))

    return verts.select("mesh_id", "vid", "x", "y").groupBy("mesh_id").applyInPandas(run, FACES)


def canonical_faces(faces: DataFrame) -> DataFrame:
    """Smallest vertex first, rows numbered in order."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    turn = lambda x, y, z: F.when((a < b) & (a < c), x).when(b < c, y).otherwise(z)
    rows = faces.select("mesh_id", turn(a, b, c).alias("a"), turn(b, c, a).alias("b"), turn(c, a, b).alias("c"))
    number = F.row_number().over(W.partitionBy("mesh_id").orderBy("a", "b", "c")) - 1
    return rows.select("mesh_id", number.alias("fid"), "a", "b", "c")


def sides(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, side (opposite which vertex), u, v: each face's three directed sides."""
    each = F.array(*(F.struct(F.lit(k).alias("side"), F.col(u).alias("u"), F.col(v).alias("v")) for k, (u, v) in enumerate((("b", "c"), ("c", "a"), ("a", "b")))))
    return faces.select("mesh_id", "fid", F.explode(each).alias("s")).select("mesh_id", "fid", "s.side", "s.u", "s.v")


def facet_neighbours(faces: DataFrame, check: bool = False) -> DataFrame:
    """mesh_id, fid, n0, n1, n2: the face across each side, by an equi-join of opposite sides."""
    s = sides(faces)
    if check:
        bad = s.groupBy("mesh_id", "u", "v").count().where("count > 1").limit(5).collect()
        if bad:
            raise ConstraintError(f"sides of two faces with one orientation: {[(r.u, r.v) for r in bad]}")
    other = s.select("mesh_id", F.col("fid").alias("nabr"), F.col("v").alias("u"), F.col("u").alias("v"))
    met = s.join(other, ["mesh_id", "u", "v"], "left")
    at = lambda k: F.max(F.when(F.col("side") == k, F.coalesce("nabr", F.lit(-1)))).alias(f"n{k}")
    return met.groupBy("mesh_id", "fid").agg(at(0), at(1), at(2))


def crossing_edges(verts: DataFrame, faces: DataFrame, segments: DataFrame) -> DataFrame:
    """mesh_id, cid, fid, side, u, v: interior sides that each segment (mesh_id, cid, p, q as vids) properly crosses.

    A side is named by its first face (the smaller id), as sides of two faces.
    """
    # segments of one place are judged once, and only in meshes that have any
    lines = segments.select("mesh_id", "p", "q").distinct()
    s = sides(faces.join(lines.select("mesh_id").distinct(), "mesh_id", "left_semi"))
    inner = s.join(s.select("mesh_id", F.col("fid").alias("f2"), F.col("v").alias("u"), F.col("u").alias("v")), ["mesh_id", "u", "v"]).where("fid < f2")
    point = lambda name: verts.select("mesh_id", F.col("vid").alias(name), F.struct("x", "y").alias(f"p_{name}"))
    e = inner.join(point("u"), ["mesh_id", "u"]).join(point("v"), ["mesh_id", "v"])
    q = lines.join(point("p"), ["mesh_id", "p"]).join(point("q"), ["mesh_id", "q"])
    met = e.join(q, "mesh_id").where(geo.bboxes_overlap(F.col("p_u"), F.col("p_v"), F.col("p_p"), F.col("p_q")) & geo.xcross(F.col("p_u"), F.col("p_v"), F.col("p_p"), F.col("p_q")))
    met = met.select("mesh_id", "p", "q", "fid", "side", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return segments.select("mesh_id", "cid", "p", "q").join(met, ["mesh_id", "p", "q"]).select("mesh_id", "cid", "fid", "side", "u", "v")


def existing_constraints(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (mesh_id, cid, u, v) with ``present``: whether they are sides of the mesh."""
    held = sides(faces).select("mesh_id", F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"), F.lit(True).alias("present")).distinct()
    keyed = edges.withColumn("_a", F.least("u", "v")).withColumn("_b", F.greatest("u", "v"))
    return keyed.join(held, ["mesh_id", "_a", "_b"], "left").withColumn("present", F.coalesce("present", F.lit(False))).drop("_a", "_b")


def recover_constraints(verts: DataFrame, faces: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical faces with all constraint edges (mesh_id, cid, u, v) recovered in order of cid, a mesh per task."""
    rows = (
        verts.select("mesh_id", F.lit(0).alias("kind"), F.col("vid").cast("long").alias("k"), F.col("x").cast("long").alias("a"), F.col("y").cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
        .union(faces.select("mesh_id", F.lit(1), F.col("fid").cast("long"), F.col("a").cast("long"), F.col("b").cast("long"), F.col("c").cast("long")))
        .union(edges.select("mesh_id", F.lit(2), F.col("cid").cast("long"), F.col("u").cast("long"), F.col("v").cast("long"), F.lit(0).cast("long")))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "k"])
        part = [pdf[pdf.kind == n] for n in range(3)]
        at = {int(v): n for n, v in enumerate(part[0].k)}
        back = list(at)
        points = list(zip(part[0].a.tolist(), part[0].b.tolist()))
        faces = [(at[a], at[b], at[c]) for a, b, c in zip(part[1].a, part[1].b, part[1].c)]
        done = recover_edges(points, faces, [(at[a], at[b]) for a, b in zip(part[2].a, part[2].b)])
        return _face_rows(pdf.mesh_id.iloc[0], sorted(_turned(*(back[k] for k in f)) for f in done))

    return rows.groupBy("mesh_id").applyInPandas(run, FACES)


def flip_edge(points: list[tuple], faces: list[tuple[int, int, int]], iface: int, iside: int) -> list[tuple[int, int, int]]:
    """Faces after the diagonal opposite vertex ``iside`` of face ``iface`` is flipped, the two faces in their places."""
    face = faces[iface]
    u, v = face[(iside + 1) % 3], face[(iside + 2) % 3]
    mesh = Mesh(points, faces)
    if not mesh.convex(u, v):
        raise ConstraintError("the side is on the boundary or its quadrilateral isn't convex")
    c, d = mesh.apex[u, v], mesh.apex[v, u]
    across = next(n for n, f in enumerate(faces) if n != iface and {u, v, d} == set(f))
    out = list(faces)
    out[iface], out[across] = _turned(u, d, c), _turned(d, v, c)
    return out


def constraint_graph(arcs: DataFrame, kinds: DataFrame, shape: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices: vid, i, j; edges: u, v, kinds) of arcs with a kind per graph (graph_id, kind), and the raster's boundary.

    With ``shape`` the closed loop of the four corners joins as BOUNDARY. An edge that lies on
    the perimeter is replaced by the chain through every vertex on it; kinds of an edge that
    comes from several graphs are or-ed.
    """
    seg = arcs.select("graph_id", F.col("path").alias("p")).where(F.size("p") > 1)
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    edges = seg.select("graph_id", F.explode(pairs).alias("s")).join(F.broadcast(kinds), "graph_id").select(*(F.col(f"s.{e}.{c}").cast("long").alias(f"{e}{c}") for e in "ab" for c in "ij"), F.col("kind").cast("int").alias("kind"))
    if shape is not None:
        top, right = shape[0] - 1, shape[1] - 1
        ring = [(0, 0), (top, 0), (top, right), (0, right)]
        loop = [(*ring[k], *ring[(k + 1) % 4], BOUNDARY) for k in range(4)]
        edges = edges.unionByName(arcs.sparkSession.createDataFrame(loop, "ai long, aj long, bi long, bj long, kind int"))
    points = edges.select(F.col("ai").alias("i"), F.col("aj").alias("j")).union(edges.select("bi", "bj")).distinct()
    if shape is not None:
        on = ((F.col("ai") == F.col("bi")) & F.col("ai").isin(0, top)) | ((F.col("aj") == F.col("bj")) & F.col("aj").isin(0, right))
        rim = edges.where(on).withColumn("e", F.struct("ai", "aj", "bi", "bj", "kind"))
        # edges and vertices of a side meet in stretches of 1024 cells
        i, j, stretch = F.col("i"), F.col("j"), lambda c: F.shiftright(c, 10)
        along = F.when((F.col("ai") == F.col("bi")) & F.col("ai").isin(0, top), 0).otherwise(1)
        rim = rim.withColumn("axis", along).withColumn("line", F.when(F.col("axis") == 0, F.col("ai")).otherwise(F.col("aj")))
        span = [F.when(F.col("axis") == 0, f("aj", "bj")).otherwise(f("ai", "bi")) for f in (F.least, F.greatest)]
        rim = rim.withColumn("stretch", F.explode(F.sequence(*(stretch(c) for c in span))))
        place = lambda axis, line, at, lines: F.when(line.isin(*lines), F.struct(F.lit(axis).alias("axis"), line.alias("line"), stretch(at).alias("stretch")))
        edge_points = points.select("i", "j", F.inline(F.array_compact(F.array(place(0, i, j, (0, top)), place(1, j, i, (0, right))))))
        inside = i.between(F.least("ai", "bi"), F.greatest("ai", "bi")) & j.between(F.least("aj", "bj"), F.greatest("aj", "bj"))
        between = rim.join(edge_points, ["axis", "line", "stretch"]).where(inside)
        w = W.partitionBy("e").orderBy("i", "j")
        chain = between.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.lead("i").over(w).alias("bi"), F.lead("j").over(w).alias("bj"), "kind").where("bi is not null")
        edges = edges.where(~on).unionByName(chain)
    verts = ranked(points, [], ["i", "j"], "n").select((F.col("n") - 1).alias("vid"), "i", "j")
    start, end = (verts.select(F.col("vid").alias(n), F.col("i").alias(f"{e}i"), F.col("j").alias(f"{e}j")) for n, e in (("s", "a"), ("t", "b")))
    named = edges.join(start, ["ai", "aj"]).join(end, ["bi", "bj"]).where("s <> t")
    merged = named.groupBy(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).agg(F.bit_or("kind").alias("kinds"))
    return verts, merged


def validate_constraints(verts: DataFrame, edges: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Rows (problem, u, v) of everything wrong: bad references, order, repeats, crossings, boundary cover."""
    known = verts.select("vid")
    refs = edges.select("u", "v", F.explode(F.array("u", "v")).alias("vid")).join(known, "vid", "left_anti").select(F.lit("unknown vertex").alias("problem"), "u", "v")
    order = edges.where("u >= v").select(F.lit("not in canonical order").alias("problem"), "u", "v")
    twice = edges.groupBy("u", "v").count().where("count > 1").select(F.lit("repeated").alias("problem"), "u", "v")
    twin = verts.groupBy("i", "j").agg(F.count("*").alias("n"), F.min("vid").alias("u"), F.max("vid").alias("v")).where("n > 1").select(F.lit("repeated vertex").alias("problem"), "u", "v")
    out = refs.union(order).union(twice).union(twin)
    from .network import topology_violations

    point = lambda n: verts.select(F.col("vid").alias(n), F.struct(F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j")).alias(f"p{n}"))
    lines = durable(ranked(edges.join(point("u"), "u").join(point("v"), "v"), [], ["u", "v"], "arc_id"))
    bad = topology_violations(lines.select(F.lit("g").alias("graph_id"), "arc_id", F.lit(0).alias("ord"), F.array("pu", "pv").alias("path")))
    crossed = bad.join(lines.select(F.col("arc_id").alias("iarc"), "u", "v"), "iarc").select(F.lit("meets another edge").alias("problem"), "u", "v")
    out = out.union(crossed)
    if shape is not None:
        top, right = shape[0] - 1, shape[1] - 1
        rim = verts.where(f"i in (0, {top}) or j in (0, {right})")
        i, j = F.col("i"), F.col("j")
        turn = F.when(j == 0, i).when(i == top, top + j).when(j == right, top + right + top - i).otherwise(2 * top + right + right - j)
        w = W.orderBy("turn")
        chain = rim.withColumn("turn", turn).withColumn("next", F.coalesce(F.lead("vid").over(w), F.first("vid").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
        want = chain.select(F.least("vid", "next").alias("u"), F.greatest("vid", "next").alias("v"))
        have = edges.where(F.col("kinds").bitwiseAND(BOUNDARY) > 0).select("u", "v")
        out = out.union(want.exceptAll(have).select(F.lit("boundary edge missing"), "u", "v")).union(have.exceptAll(want).select(F.lit("boundary edge not on the perimeter"), "u", "v"))
    return out
