"""Raster operators: golden cases and brute force."""

import math

import numpy as np
import pytest

from cairnflow.functions import colour, exact
from cairnflow.operators import components, flow, grid, metrics, ridges, stencil, terrain
from cairnflow.operators.directions import D8, D8Directions, identity_scheme
from pyspark.sql import functions as F


def arr(df, column, shape, fill=np.nan):
    a = np.full(shape, fill)
    for r in df.select("i", "j", F.col(column).cast("double").alias("v")).collect():
        a[r.i, r.j] = fill if r.v is None else r.v
    return a


def coded(spark, codes, valid=None):
    """A flow table from identity codes."""
    c = grid.cells_from_array(spark, [[float(x) for x in r] for r in codes], valid)
    table = c.withColumn("code", F.col("z").cast("smallint"))
    return flow.flow_from_codes(table, identity_scheme())


def down(spark, codes):
    ni, nj = len(codes), len(codes[0])
    by = {d.code: (d.di, d.dj) for d in identity_scheme().all()}
    out = {}
    for i in range(ni):
        for j in range(nj):
            di, dj = by[codes[i][j]]
            t = (i + di, j + dj)
            out[i, j] = t if t != (i, j) and 0 <= t[0] < ni and 0 <= t[1] < nj else None
    return out


def test_scheme():
    assert [d.name for d in D8.neighbours()] == ["N", "W", "E", "S", "NW", "NE", "SW", "SE"]
    assert {d.name: d.code for d in D8.neighbours()} == {"E": 1, "SE": 2, "S": 4, "SW": 8, "W": 16, "NW": 32, "N": 64, "NE": 128}
    assert D8.opposite_codes()[1] == 16 and D8.offset(3) == (0, 0) and D8.no_flow_code == 0
    for bad in ({"window": 4}, {"slices": 1}, {"shape": "oval"}, {"transform_codes": lambda k: 300}):
        with pytest.raises(ValueError):
            D8Directions(**bad)


def test_indegree_and_strahler(spark):
    a = [[3, 3, 3], [3, 3, 3], [1, 1, 0]]
    f = coded(spark, a)
    assert arr(flow.indegree(f), "indegree", (3, 3)).tolist() == [[0, 0, 0], [1, 1, 1], [1, 2, 2]]
    assert arr(metrics.strahler(f), "ord", (3, 3)).tolist() == [[1, 1, 1], [1, 1, 1], [1, 2, 2]]
    b = [[1, 2, 2, 2], [8, 1, 1, 1], [8, 8, 8, 8], [1, 2, 1, 2]]
    assert arr(metrics.strahler(coded(spark, b)), "ord", (4, 4)).tolist() == [[1, 2, 1, 1], [1, 1, 2, 2], [1, 1, 1, 1], [1, 1, 1, 1]]
    c = [[5, 1, 1], [5, 1, 1], [5, 1, 1]]
    assert arr(flow.indegree(coded(spark, c)), "indegree", (3, 3)).tolist() == [[0, 0, 1]] * 3


def test_downstream_and_off_grid(spark):
    c = grid.cells_from_array(spark, [[5.0, 1, 1], [5, 1, 1], [5, 1, 1]]).withColumn("code", F.col("z").cast("smallint"))
    d = stencil.downstream(c, identity_scheme())
    assert arr(d, "dsj", (3, 3)).tolist() == [[-1, 2, 3]] * 3
    assert arr(d, "inbounds", (3, 3)).tolist() == [[0, 1, 0]] * 3
    with pytest.raises(ValueError):
        stencil.check_inbounds(c, identity_scheme())


def test_cycles(spark):
    f = coded(spark, [[1, 1, 5, 0]], [[True, True, True, False]])
    r = flow.acyclic(f)
    assert arr(r, "acyclic", (1, 4)).tolist() == [[1, 0, 0, 0]] and arr(r, "cyclic", (1, 4)).tolist() == [[0, 1, 1, 0]]


def test_flats(spark):
    a = [[9.0] * 7, [9, 5, 5, 5, 5, 5, 9], [9, 5, 5, 5, 5, 5, 9], [9, 5, 5, 5, 5, 5, 3], [9] * 7]
    r = flow.complete_d8(grid.cells_from_array(spark, a)).persist()
    assert (arr(r, "label", (5, 7))[1:4, 1:6] == 1).all()
    ends = metrics.watersheds(r)
    assert set(arr(ends, "label", (5, 7)).ravel()) == {1.0}


def test_single_flat_gradients(spark):
    n = 5
    base = grid.cells_from_array(spark, [[1.0] * n for _ in range(n)])
    rim = (F.col("i").isin(0, n - 1)) | (F.col("j").isin(0, n - 1))
    centre = (F.col("i") == 2) & (F.col("j") == 2)
    t = base.withColumn("label", F.lit(1)).withColumn("high_edge", rim).withColumn("low_edge", centre)
    g = flow.flat_gradients(t)
    pull = [[3] * 5, [3, 2, 2, 2, 3], [3, 2, 1, 2, 3], [3, 2, 2, 2, 3], [3] * 5]
    assert arr(g, "pull", (5, 5)).tolist() == pull
    one = flow.flat_gradients(t.withColumn("high_edge", centre))
    assert arr(one, "push", (5, 5)).tolist() == [[4 - x for x in r] for r in pull]
    assert arr(flow.flat_gradients(t, kernel_cells=3), "pull", (5, 5)).tolist() == pull


@pytest.mark.parametrize("dem, want", [
    ([[5, 5, 5], [5, 1, 5], [5, 5, 5]], [[5] * 3] * 3),
    ([[0, 0, 0, 0], [4, -3, -2, 0], [4, -4, -1, 0], [4, 4, 4, 4]], [[0, 0, 0, 0], [4, 0, 0, 0], [4, 0, 0, 0], [4, 4, 4, 4]]),
    ([[5, 5, 5, 5], [5, 2, 2, 1], [5, 2, 0, 5], [5, 5, 5, 5]], [[5, 5, 5, 5], [5, 2, 2, 1], [5, 2, 1, 5], [5, 5, 5, 5]]),
])
def test_fill(spark, dem, want):
    got = flow.fill_depressions(grid.cells_from_array(spark, [[float(x) for x in r] for r in dem]), tile=2)
    assert arr(got, "z", (len(dem), len(dem[0]))).tolist() == [[float(x) for x in r] for r in want]


def brute_fill(z, ok):
    ni, nj = z.shape
    near = lambda i, j: [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= i + a < ni and 0 <= j + b < nj]
    sink = np.array([[ok[i, j] and (i in (0, ni - 1) or j in (0, nj - 1) or any(not ok[n] for n in near(i, j))) for j in range(nj)] for i in range(ni)])
    w = np.where(ok & ~sink, np.inf, z)
    changed = True
    while changed:
        changed = False
        for i in range(ni):
            for j in range(nj):
                if ok[i, j] and not sink[i, j]:
                    v = max(z[i, j], min((w[n] for n in near(i, j) if ok[n]), default=np.inf))
                    if v < w[i, j]:
                        w[i, j], changed = v, True
    return w


def test_fill_random_with_mask(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 25, (19, 14)).astype(float)
    ok = rng.random((19, 14)) > 0.05
    got = arr(flow.fill_depressions(grid.cells_from_array(spark, z.tolist(), ok.tolist()), tile=6), "z", z.shape)
    assert (got == brute_fill(z, ok)).all()


def test_fill_max_size(spark):
    a = np.full((7, 13), 5.0)
    a[1:6, 1:6], a[1:6, 7:12] = 2, 2
    a[1, 1] = a[1, 11] = 1
    a[2:5, 6] = 5
    got = arr(flow.fill_small_depressions(grid.cells_from_array(spark, a.tolist()), 24), "z", a.shape)
    assert got[1, 1] == 1 and got[1, 11] == 1 and got[3, 3] == 2
    assert (arr(flow.fill_small_depressions(grid.cells_from_array(spark, a.tolist()), 25), "z", a.shape) == 5).all()


def test_oceans(spark):
    a = np.full((7, 9), 5.0)
    a[0:2, 0:3] = a[5:7, 7:9] = a[3, 3:6] = 0
    c = grid.cells_from_array(spark, a.tolist())
    label = arr(components.ocean_basins(c), "label", a.shape)
    assert label[0, 0] == 1 and label[6, 8] == 2 and label[3, 4] == 0
    assert arr(components.invalidate_ocean_basins(c, min_size=6), "valid", a.shape).sum() == 63 - 6
    assert components.mask_areas(c, F.col("z") == 0).agg(F.max("label")).first()[0] == 3
    b = grid.cells_from_array(spark, [[0.0, -1, -1, 5], [0, -1, -1, 5]])
    assert arr(components.ocean_basins(b, 0, flood_below=False), "label", (2, 4)).tolist() == [[1, 0, 0, 0]] * 2


def test_isolation_golden_and_brute(spark):
    a = np.zeros((6, 6))
    a[2, 2], a[2, 3], a[4, 2] = 5, 6, 7
    r = terrain.isolation(grid.cells_from_array(spark, a.tolist()), dx=10, dy=1).where("i = 2 and j = 2").first()
    assert (r.iso, r.ilp_i, r.ilp_j, r.censored) == (2.0, 4, 2, False)
    rng = np.random.default_rng(5)
    z = rng.integers(0, 40, (23, 17)).astype(float)
    ok = rng.random(z.shape) > 0.1
    for dx, dy in ((1.0, 1.0), (3.0, 0.5)):
        got = arr(terrain.isolation(grid.cells_from_array(spark, z.tolist(), ok.tolist()), dx, dy), "iso", z.shape)
        for i in range(23):
            for j in range(17):
                d = [math.hypot((a - i) * dy, (b - j) * dx) for a in range(23) for b in range(17) if ok[a, b] and ok[i, j] and z[a, b] > z[i, j]]
                assert got[i, j] == pytest.approx(min(d, default=0.0))


def test_prominence(spark):
    for dem, want in (([[3, 1, 2]], [-1, 0, 1]), ([[2, 1, 2]], [-1, 0, -1]), ([[4, 2, 4, 2, 5]], [2, 0, 2, 0, -1])):
        c = grid.cells_from_array(spark, [[float(x) for x in r] for r in dem])
        assert arr(terrain.prominence(c), "prom", (1, len(dem[0]))).tolist() == [want]
    f = {r.fid: r for r in terrain.prominence_features(grid.cells_from_array(spark, [[10.0, 6, 8, 4, 12]])).collect()}
    at = {r.j: k for k, r in f.items()}
    assert [f[at[j]].kind for j in (0, 2, 4, 1, 3)] == [1, 1, 1, 2, 2]
    assert f[at[0]].parent == at[1] and f[at[2]].parent == at[1] and f[at[1]].parent == at[3] and f[at[4]].parent == at[3]
    assert f[at[2]].key_saddle == at[1] and f[at[0]].key_saddle == at[3] and f[at[4]].key_saddle == -1


def test_prominence_against_thresholds(spark):
    rng = np.random.default_rng(8)
    z = rng.permutation(64).reshape(8, 8).astype(float)
    got = arr(terrain.prominence(grid.cells_from_array(spark, z.tolist())), "prom", z.shape)
    near = lambda i, j: [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= i + a < 8 and 0 <= j + b < 8]
    for i in range(8):
        for j in range(8):
            if any(z[n] > z[i, j] for n in near(i, j)):
                assert got[i, j] == 0
                continue
            saddle = None
            for level in sorted(z.ravel(), reverse=True):
                seen, stack = {(i, j)}, [(i, j)]
                while stack:
                    for n in near(*stack.pop()):
                        if z[n] >= level and n not in seen:
                            seen.add(n)
                            stack.append(n)
                if level < z[i, j] and any(z[n] > z[i, j] for n in seen):
                    saddle = level
                    break
            assert got[i, j] == (-1 if saddle is None else z[i, j] - saddle)


def forest(rng, ni, nj):
    """Random acyclic codes: each cell flows to a neighbour of lower random rank."""
    rank = rng.permutation(ni * nj).reshape(ni, nj)
    codes = np.zeros((ni, nj), int)
    for i in range(ni):
        for j in range(nj):
            lower = [d.code for d in identity_scheme().neighbours() if 0 <= i + d.di < ni and 0 <= j + d.dj < nj and rank[i + d.di, j + d.dj] < rank[i, j]]
            if lower and rng.random() < 0.95:
                codes[i, j] = lower[rng.integers(len(lower))]
    return codes.tolist()


def test_tree_metrics_against_walks(spark):
    rng = np.random.default_rng(6)
    codes = forest(rng, 9, 11)
    f = coded(spark, codes).persist()
    to = down(spark, codes)
    path = {c: [c] for c in to}
    for c in to:
        while to[path[c][-1]]:
            path[c].append(to[path[c][-1]])
    length = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:]))
    shape = (9, 11)
    acc, dist, src, wet = (arr(x, c, shape) for x, c in ((metrics.accumulation(f), "accum"), (metrics.dist2sink(f), "dist"), (metrics.dist2source(f), "dist"), (metrics.flood_upstream(f, F.col("i") == 4), "wet")))
    fed = {t for t in to.values() if t}
    for c in to:
        assert acc[c] == sum(c in path[o] for o in to)
        assert dist[c] == pytest.approx(length(path[c]))
        assert wet[c] == any(n[0] == 4 for n in path[c])
        best = max(((path[o].index(c), o[1], o[0], length(path[o][: path[o].index(c) + 1])) for o in to if o not in fed and c in path[o]))
        assert src[c] == pytest.approx(best[3])
    order = arr(metrics.strahler(f), "ord", shape)

    def strahler(c):
        up = sorted((strahler(o) for o in to if to[o] == c), reverse=True)
        return 1 if not up else up[0] + (len(up) > 1 and up[0] == up[1])

    assert all(order[c] == strahler(c) for c in to)
    label = arr(metrics.watersheds(f), "label", shape)
    sinks = sorted((c for c in to if to[c] is None), key=lambda c: (c[1], c[0]))
    assert all(label[c] == sinks.index(path[c][-1]) + 1 for c in to)
    far = arr(ridges.dist2conf_max(f), "dist", shape)
    for c in to:
        want = 0.0
        for n in ((c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            if n in to:
                common = [k for k, x in enumerate(path[c]) if x in path[n]]
                want = max(want, length(path[c][: common[0] + 1] if common else path[c]))
        assert far[c] == pytest.approx(want)


def test_ridge_composition(spark):
    f = flow.simple_d8(grid.cells_from_array(spark, np.random.default_rng(1).random((8, 8)).tolist()))
    d = ridges.ridgedir(flow.durable(f))
    assert d.where("valid and code is null").count() == 0
    assert ridges.ridge_strahler(d, dir_is_ridge=True).agg(F.min("ord")).first()[0] >= 1
    assert ridges.dist2ridge(d, dir_is_ridge=True).where("dist < 0").count() == 0


def test_branch_distance_golden(spark):
    c = coded(spark, [[2, 3], [1, 0]])
    r = arr(ridges.dist2conf_max(c), "dist", (2, 2))
    assert r == pytest.approx(np.array([[math.sqrt(2), 1], [1, 0]]))


def test_grid_frame(spark):
    a = np.arange(30.0).reshape(5, 6)
    c = grid.cells_from_array(spark, a.tolist())
    assert arr(grid.stride(c, 2), "z", (3, 3)).tolist() == a[::2, ::2].tolist()
    x = grid.crop(grid.transform2xy(c), (1, 4), (1, 3))
    assert arr(x, "z", (2, 3)).tolist() == a[1:3, 1:4].tolist()
    s = arr(grid.gaussian_filter(c, 0.7), "z", a.shape)
    w = np.array(grid.gaussian_weights(0.7))
    r = len(w) // 2
    pad = np.pad(a, r, mode="symmetric")
    rows = sum(w[k] * pad[k : k + 5, :] for k in range(len(w)))
    assert s == pytest.approx(sum(w[k] * rows[:, k : k + 6] for k in range(len(w))))
    g = np.gradient(a)
    assert arr(terrain.slope(c), "slope", a.shape) == pytest.approx(np.hypot(*g))
    n = stencil.neighbour_values(c, pad=-1.0, include_self=True)
    assert n.count() == 30 * 9 and n.where("i = 0 and j = 0 and value = -1").count() == 5


def test_pits_and_colour(spark):
    c = grid.cells_from_array(spark, [[5.0, 5, 5], [5, 1, 4], [5, 5, 5]])
    p = terrain.fill_pits(c)
    assert arr(p, "z", (3, 3))[1, 1] == 4 and arr(p, "is_pit", (3, 3)).sum() == 1
    r = c.select("i", "j", *(v.alias(k) for k, v in colour.colour(F.col("z"), 1, 5, "dune", alpha=True).items())).where("i = 1 and j = 1").first()
    assert (r.r, r.g, r.b, r.a) == pytest.approx((0x01 / 255, 0x2E / 255, 0x40 / 255, 1.0))
    assert len(colour.truncate(colour.PALETTES["mist"], 0.2, 0.8, 16)) == 16


def test_exact_predicates():
    assert exact.orient((0, 0), (4, 0), (0, 3)) == 12
    assert exact.incircle((0, 0), (2, 0), (0, 2), (1, 1)) == 8
    k = 2**40
    assert exact.incircle(*((x + k, y - k) for x, y in ((0, 0), (2, 0), (0, 2), (1, 1)))) == 8
    with pytest.raises(ValueError):
        exact.incircle((0, 0), (1, 1), (2, 2), (3, 4), oriented=True)


def test_simple_d8_of_other_schemes(spark):
    z = np.random.default_rng(3).integers(0, 9, (9, 8)).astype(float)
    cells = grid.cells_from_array(spark, z.tolist())
    for scheme in (D8, D8Directions(sort_by_distance=False), D8Directions(window=5, transform_codes=int)):
        got = {(r.i, r.j): r.code for r in flow.simple_d8(cells, scheme).collect()}
        for (i, j), code in got.items():
            near = [(z[i + d.di, j + d.dj], d.ord, d.code) for d in scheme.neighbours() if 0 <= i + d.di < 9 and 0 <= j + d.dj < 8]
            low = min(near)
            assert code == (low[2] if low[0] < z[i, j] else 0)
