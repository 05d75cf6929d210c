"""Network operators: golden cases and brute force."""

import random

import numpy as np
import pytest

from cairnflow.functions import exact
from cairnflow.functions import geometry as geo
from cairnflow.operators import flow, grid, mesh, metrics, network
from cairnflow.operators.directions import identity_scheme
from cairnflow.operators.errors import ArcRangeError, ConstraintError, FlowCycleError
from pyspark.sql import functions as F


def coded(spark, codes, valid=None):
    c = grid.cells_from_array(spark, [[float(x) for x in r] for r in codes], valid)
    return flow.durable(flow.flow_from_codes(c.withColumn("code", F.col("z").cast("smallint")), identity_scheme()))


def paths(arcs):
    return sorted((r.ord, [(int(p.i), int(p.j)) for p in r.path]) for r in arcs.collect())


def test_flowgraph_golden(spark):
    f = coded(spark, [[3, 3, 3], [3, 3, 3], [1, 1, 0]], [[True, False, True], [True] * 3, [True] * 3])
    arcs = network.construct_flowgraph(f, metrics.strahler(f), min_order=1)
    assert paths(arcs) == [(1, [(0, 0), (1, 0), (2, 0), (2, 1)]), (1, [(0, 2), (1, 2), (2, 2)]), (1, [(1, 1), (2, 1)]), (2, [(2, 1), (2, 2)])]
    joined = {r.ord: r.path for r in network.concat_flowgraph(arcs).collect()}
    assert len(joined[1]) == 11 and len(joined[2]) == 2 and sum(np.isnan(p.i) for p in joined[1]) == 2
    v, e = network.flat_model(arcs)
    assert v.count() == 11 and [(r.first, r.last) for r in e.orderBy("arc_id").collect()] == [(0, 1), (2, 4), (5, 8), (9, 10)]
    assert network.flowline_segments(f).count() == 3 * 7


def test_cycle_is_reported(spark):
    f = coded(spark, [[1, 5]])
    orders = f.select("grid_id", "i", "j", "cid", F.lit(1).alias("ord"))
    with pytest.raises(FlowCycleError) as e:
        network.construct_flowgraph(f, orders, 1)
    assert sorted(e.value.cells) == [(0, 0), (0, 1)]


def test_insert_endpt(spark):
    a = network.arcs_from_arrays(spark, [1, 2], [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)], [(0, 2), (3, 4)])
    assert paths(network.insert_endpt(a, 2, 3)) == [(1, [(0, 1), (2, 3)]), (1, [(2, 3), (4, 5)]), (2, [(6, 7), (8, 9)])]
    assert paths(network.insert_endpt(a, 0, 1)) == paths(a) == paths(network.insert_endpt(a, 50, 50))
    with pytest.raises(ArcRangeError):
        network.arcs_from_arrays(spark, [1], [(0, 0)], [(0, 3)])


def test_overlaps(spark):
    g1 = network.arcs_from_arrays(spark, [1, 1], [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 9), (9, 8)], [(0, 4), (5, 6)], "a")
    g2 = network.arcs_from_arrays(spark, [1, 1], [(5, 0), (3, 0), (2, 0), (1, 0), (6, 0), (8, 8), (8, 7)], [(0, 4), (5, 6)], "b")
    kinds = {(r.i, r.j): r.kind for r in network.graph_overlaps(g1, g2).collect()}
    assert kinds == {(1, 0): "ii", (2, 0): "ii", (3, 0): "ii"}
    for allowed, n in ((True, 4), (False, 5)):
        x, y = network.solve_graph_overlaps(g1, g2, allowed)
        assert x.count() == n and y.count() == n
        x2, y2 = network.solve_graph_overlaps(x, y, allowed)
        assert paths(x2) == paths(x) and paths(y2) == paths(y)


def test_rdp(spark):
    a = network.arcs_from_arrays(spark, [1], [(0, 0), (1, 1), (2, 2)], [(0, 2)])
    assert network.rdp_simplify(a, 1).first().keep == [True, False, True]
    b = network.arcs_from_arrays(spark, [1, 1], [(0, 0.8), (1, 2), (2, 0.2), (0.5, 0.5), (1.5, 0.5)], [(0, 2), (3, 4)])
    free = {r.arc_id: r.keep for r in network.simplify_flowgraph(b, 1.5, check_topology=False).collect()}
    safe = {r.arc_id: r.keep for r in network.simplify_flowgraph(b, 1.5).collect()}
    assert free[0] == [True, False, True] and safe[0] == [True, True, True]
    loop = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert network.rdp_keep(loop, 0.5).tolist() == [True, True, True, True, True] or network.rdp_keep(loop, 0.5).sum() >= 4


def brute_rdp(p, tol):
    keep = {0, len(p) - 1}

    def d2(q, a, b):
        v = b - a
        t = min(1, max(0, (q - a) @ v / (v @ v))) if v @ v else 0
        return ((q - a - t * v) ** 2).sum()

    def go(a, b):
        if b - a < 2:
            return
        e = [d2(p[k], p[a], p[b]) for k in range(a + 1, b)]
        k = a + 1 + int(np.argmax(e))
        if max(e) > tol * tol:
            keep.add(k)
            go(a, k)
            go(k, b)

    go(0, len(p) - 1)
    return [k in keep for k in range(len(p))]


def test_rdp_random():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = rng.integers(0, 20, (rng.integers(2, 40), 2)).astype(float)
        tol = float(rng.integers(0, 6))
        assert network.rdp_keep(p, tol).tolist() == brute_rdp(p, tol)


def flag(a, b, c, d):
    on = lambda p, q, r: exact.orient(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    if a == b or c == d:
        return 5
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return -1
    if {a, b} == {c, d}:
        return 3
    if exact.crosses(a, b, c, d):
        return 1
    shared = bool({a, b} & {c, d})
    inner = any(on(p, q, r) and r not in (p, q) for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
    if exact.orient(a, b, c) == 0 and exact.orient(a, b, d) == 0:
        return 2 if inner else 0 if shared else -1
    return 0 if shared else 4 if inner else -1


def test_segment_classes(spark):
    rng = random.Random(4)
    rows = [tuple((rng.randint(0, 3), rng.randint(0, 3)) for _ in range(4)) for _ in range(1500)]
    d = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{c} struct<x:long,y:long>" for c in "abcd"))
    got = {r.n: r.f for r in d.select("n", geo.lines_intersect(*(F.col(c) for c in "abcd")).alias("f")).collect()}
    assert all(got[n] == flag(*r) for n, r in enumerate(rows))
    assert set(got.values()) == {-1, 0, 1, 2, 3, 4, 5}


def test_violations(spark):
    x = network.arcs_from_arrays(spark, [1, 1], [(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 1), (2, 3)])
    r = network.topology_violations(x).first()
    assert (r.iarc, r.jarc, r.iseg, r.jseg, r.flag) == (0, 1, 0, 0, 1)
    rng = random.Random(7)
    vtx = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(60)]
    ends = [(k, k + 5) for k in range(0, 60, 6)]
    arcs = network.arcs_from_arrays(spark, [1] * 10, vtx, ends)
    want = set()
    seg = [(n, s, vtx[a + s], vtx[a + s + 1]) for n, (a, b) in enumerate(ends) for s in range(b - a)]
    for p in range(len(seg)):
        for q in range(p + 1, len(seg)):
            f = flag(seg[p][2], seg[p][3], seg[q][2], seg[q][3])
            if f > 0:
                want.add((seg[p][0], seg[q][0], seg[p][1], seg[q][1], f))
    for bucket in (None, 3.0, 100.0):
        got = [(r.iarc, r.jarc, r.iseg, r.jseg, r.flag) for r in network.topology_violations(arcs, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_shared_lines_are_no_violation(spark):
    a = network.arcs_from_arrays(spark, [1], [(0, 0), (2, 2), (4, 0)], [(0, 2)], "a")
    b = network.arcs_from_arrays(spark, [1], [(4, 0), (2, 2), (0, 0)], [(0, 2)], "b")
    both = a.unionByName(b)
    v = network.topology_violations(both)
    assert v.count() == 2 and network.without_shared_arcs(v, both).count() == 0
    assert network.simplify_flowgraph(both, 5.0).where("size(path) <> 2").count() == 0


def check_delaunay(points, faces):
    hull = 0
    for f in faces:
        a, b, c = (points[k] for k in f)
        area = exact.orient(a, b, c)
        assert area > 0
        hull += area
        assert not any(exact.incircle(a, b, c, p) > 0 for p in points)
    return hull


def hull_area(points):
    p = sorted(points)
    half = lambda q: [r for r in _chain(q)]
    ring = half(p)[:-1] + half(p[::-1])[:-1]
    return sum(ring[k - 1][0] * ring[k][1] - ring[k - 1][1] * ring[k][0] for k in range(len(ring)))


def _chain(p):
    out = []
    for q in p:
        while len(out) > 1 and exact.orient(out[-2], out[-1], q) <= 0:
            out.pop()
        out.append(q)
    return out


def test_delaunay_is_valid():
    rng = random.Random(1)
    sets = [[(x, y) for x in range(5) for y in range(4)], [(0, 0), (4, 0), (0, 4)], [(0, 0), (1, 0), (2, 0), (3, 0), (1, 5)]]
    sets += [list({(rng.randint(0, s), rng.randint(0, s)) for _ in range(n)}) for n, s in ((40, 8), (200, 1000), (60, 10**6))]
    for points in sets:
        faces = mesh.delaunay(points)
        assert faces == sorted(faces) and check_delaunay(points, faces) == hull_area(points)
    assert len(mesh.delaunay(sets[0])) == 2 * 4 * 3
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 1), (0, 0), (3, 4)]):
        with pytest.raises(ValueError):
            mesh.delaunay(bad)


def test_flip_and_neighbours(spark):
    square = [(0, 0), (1, 0), (0, 1), (1, 1)]
    assert sorted(mesh.flip_edge(square, [(0, 1, 2), (1, 3, 2)], 0, 0)) == [(0, 1, 3), (0, 3, 2)]
    faces = spark.createDataFrame([("m", n, *f) for n, f in enumerate([(0, 1, 4), (0, 4, 3), (1, 2, 5), (1, 5, 4)])], "mesh_id string, fid int, a int, b int, c int")
    got = {r.fid: [r.n0, r.n1, r.n2] for r in mesh.facet_neighbours(faces, check=True).collect()}
    assert [got[k] for k in range(4)] == [[3, 1, -1], [-1, -1, 0], [-1, 3, -1], [-1, 0, 2]]
    odd = spark.createDataFrame([("m", 0, 3, 2, 1), ("m", 1, 2, 0, 1)], faces.schema)
    assert [(r.a, r.b, r.c) for r in mesh.canonical_faces(odd).orderBy("fid").collect()] == [(0, 1, 2), (1, 3, 2)]


def test_constraint_recovery(spark):
    strip = [(x, y) for y in range(2) for x in range(4)]
    faces = [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6)]
    done = mesh.recover_edges(strip, faces, [(1, 4), (2, 5), (3, 6)])
    sides = {tuple(sorted((f[k], f[(k + 1) % 3]))) for f in done for k in range(3)}
    assert {(1, 4), (2, 5), (3, 6)} <= sides
    square = [(0, 0), (1, 0), (0, 1), (1, 1)]
    with pytest.raises(ConstraintError, match=r"constraint edge 1 \(0, 3\)"):
        mesh.recover_edges(square, [(0, 1, 2), (1, 3, 2)], [(1, 2), (0, 3)])
    rng = random.Random(3)
    points = list({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(80)})
    chain = sorted(range(len(points)), key=lambda k: points[k])[::9]
    faces = mesh.delaunay(points)
    edges = [(a, b) for a, b in zip(chain, chain[1:]) if not any(exact.orient(points[a], points[b], p) == 0 for p in points if p not in (points[a], points[b]))]
    done = mesh.recover_edges(points, faces, edges)
    sides = {tuple(sorted((f[k], f[(k + 1) % 3]))) for f in done for k in range(3)}
    assert {tuple(sorted(e)) for e in edges} <= sides
    assert sum(exact.orient(*(points[k] for k in f)) for f in done) == hull_area(points)


def test_mesh_frames(spark):
    pts = [(x, y) for x in range(4) for y in range(4)]
    verts = spark.createDataFrame([(m, 10 * k, x, y) for m in ("a", "b") for k, (x, y) in enumerate(pts)], "mesh_id string, vid int, x long, y long")
    faces = mesh.triangulate_points(verts)
    assert faces.groupBy("mesh_id").count().where("count = 18").count() == 2
    edges = spark.createDataFrame([("a", 0, 0, 60), ("b", 0, 10, 70)], "mesh_id string, cid int, u int, v int")
    done = mesh.recover_constraints(verts, faces, edges)
    assert mesh.existing_constraints(done, edges).where("not present").count() == 0
    crossed = mesh.crossing_edges(verts, faces, edges.select("mesh_id", "cid", F.col("u").alias("p"), F.col("v").alias("q")))
    assert crossed.count() > 0


def test_constraint_graph(spark):
    none = network.arcs_from_arrays(spark, [], [], [])
    kinds = spark.createDataFrame([("v", mesh.VALLEY), ("r", mesh.RIDGE)], "graph_id string, kind int")
    v, e = mesh.constraint_graph(none, kinds, (5, 7))
    assert v.count() == 4 and [r.kinds for r in e.collect()] == [mesh.BOUNDARY] * 4
    assert mesh.validate_constraints(v, e, (5, 7)).count() == 0
    valley = network.arcs_from_arrays(spark, [1], [(4, 1), (4, 3)], [(0, 1)], "v")
    ridge = network.arcs_from_arrays(spark, [1], [(4, 2), (2, 2)], [(0, 1)], "r")
    v, e = mesh.constraint_graph(valley.unionByName(ridge), kinds, (5, 7))
    at = {r.vid: (r.i, r.j) for r in v.collect()}
    named = {frozenset((at[r.u], at[r.v])): r.kinds for r in e.collect()}
    assert named[frozenset(((4, 1), (4, 2)))] == 5 and named[frozenset(((4, 2), (4, 3)))] == 5
    assert named[frozenset(((4, 2), (2, 2)))] == mesh.RIDGE and named[frozenset(((4, 0), (4, 1)))] == mesh.BOUNDARY
    assert mesh.validate_constraints(v, e, (5, 7)).count() == 0
    broken = e.where("kinds <> 5").unionByName(spark.createDataFrame([(3, 1, 1), (0, 99, 1)], "u long, v long, kinds int"))
    problems = {r.problem for r in mesh.validate_constraints(v, broken, (5, 7)).collect()}
    assert {"unknown vertex", "not in canonical order", "boundary edge missing"} <= problems


def test_crossing_sides_are_found_by_walking(monkeypatch):
    rng = np.random.default_rng(11)
    pts = list({(int(x), int(y)) for x, y in rng.integers(0, 4000, (400, 2))})
    m = mesh.Mesh(pts, mesh.delaunay(pts))
    calls, crosses = [], exact.crosses
    monkeypatch.setattr(mesh.exact, "crosses", lambda *a: calls.append(a) or crosses(*a))
    for u, v in rng.integers(0, len(pts), (60, 2)):
        if u != v:
            want = sorted((a, b) for (a, b) in m.apex if a < b and (b, a) in m.apex and not {a, b} & {int(u), int(v)} and crosses(pts[u], pts[v], pts[a], pts[b]))
            assert m.crossing(int(u), int(v)) == want
    assert len(calls) < 10 * len(m.apex)  # looking at every side took about 60 times as many
    grid_ = [(x, y) for x in range(4) for y in range(4)]
    lattice = mesh.Mesh(grid_, [f for x in range(3) for y in range(3) for f in ((4 * x + y, 4 * x + y + 4, 4 * x + y + 5), (4 * x + y, 4 * x + y + 5, 4 * x + y + 1))])
    assert lattice.crossing(1, 4) == [(0, 5)] and lattice.crossing(0, 15) == []  # through vertices
