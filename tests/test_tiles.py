"""Plans that solve tiles first: the same results for any size of tile, in few jobs."""

import uuid

import numpy as np
import pytest

from cairnflow.operators import flow, grid, mesh, metrics, prominence, ridges, stencil, terrain
from cairnflow.operators.directions import D8, D8Directions
from cairnflow.plans import iterate
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .test_raster import arr, coded, down


def jobs(spark, run):
    """How many Spark jobs a call takes."""
    sc, group = spark.sparkContext, f"count-{uuid.uuid4()}"
    sc.setJobGroup(group, "")
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def field(spark, seed, acyclic=False, shape=(11, 9)):
    """Random codes; without cycles if none points up or left."""
    codes = np.random.default_rng(seed).choice([0, 1, 2, 3] if acyclic else range(9), shape, p=[0.05, 0.35, 0.3, 0.3] if acyclic else None).tolist()
    return coded(spark, codes), down(spark, codes)


@pytest.fixture(params=[(9, 10**6, 10**5), (1, 10**6, 10**5), (1, 0, 0)], ids=["one-tile", "tiles", "rounds"])
def tiled(request, monkeypatch):
    for name, value in zip(("TILE_BITS", "ALONE", "SMALL"), request.param):
        monkeypatch.setattr(iterate, name, value)


def test_cycles_across_tiles(spark, tiled):
    table, to = field(spark, 3)
    on = set()
    for c in to:
        seen, at = [], c
        while at is not None and at not in seen:
            seen.append(at)
            at = to[at]
        if at is not None:
            on |= set(seen[seen.index(at) :])
    got = arr(flow.acyclic(table), "cyclic", (11, 9))
    assert on and {(int(i), int(j)) for i, j in zip(*np.nonzero(got))} == on


def test_trees_across_tiles(spark, tiled):
    table, to = field(spark, 5, acyclic=True)
    accum, steps, order = np.ones((11, 9)), {c: 0 for c in to}, np.ones((11, 9), int)
    for c in sorted(to):  # every target comes after its sources
        if to[c] is not None:
            accum[to[c]] += accum[c]
            steps[to[c]] = max(steps[to[c]], steps[c] + 1)
            fed = sorted(order[s] for s in to if to[s] == to[c])
            order[to[c]] = fed[-1] + (len(fed) > 1 and fed[-2] == fed[-1])
    assert (arr(metrics.accumulation(table), "accum", (11, 9)) == accum).all()
    assert (arr(metrics.strahler(table), "ord", (11, 9)) == order).all()
    ends = {c: (lambda f: f(f, c))(lambda f, c: c if to[c] is None else f(f, to[c])) for c in to}
    sinks = sorted({e for e in ends.values() if to[e] is None}, key=lambda c: (c[1], c[0]))
    got = iterate.descend(table.where("valid"), ["grid_id"], F.lit(1.0))
    assert {r.cid: r.root for r in got.collect()} == {c[1] * 2**31 + c[0]: ends[c][1] * 2**31 + ends[c][0] for c in to} and sinks
    far = metrics.dist2source(table.withColumn("is_sink", F.lit(False)), l1=False)
    assert ((arr(far, "dist", (11, 9)) > 0) == (np.array([[steps[i, j] for j in range(9)] for i in range(11)]) > 0)).all()


def test_cycle_is_an_error_in_any_tile(spark, tiled):
    with pytest.raises(Exception, match="cycle"):
        metrics.accumulation(coded(spark, [[1, 1, 1, 5]])).collect()


def test_acyclic_takes_few_jobs(spark):
    n = 60
    ring = np.zeros((n, n), int)
    ring[0, :], ring[:, -1], ring[-1, :], ring[:, 0] = 1, 3, 5, 7
    ring[0, 0], ring[0, -1], ring[-1, -1], ring[-1, 0] = 1, 3, 5, 7
    table = iterate.durable(coded(spark, ring.tolist()))
    got, n_jobs = jobs(spark, lambda: flow.acyclic(table).where("cyclic").count())
    assert got == 4 * n - 4 and n_jobs <= 25  # pointer doubling took one job and more a round


def test_gradients_of_a_single_row(spark):
    assert metrics.accumulation(flow.simple_d8(grid.cells_from_array(spark, [[3.0, 2, 1]]))).agg(F.max("accum")).first()[0] == 3


@pytest.mark.parametrize("seed", [2, 7])
def test_branch_distance_across_tiles(spark, tiled, seed):
    z = np.random.default_rng(seed).integers(0, 60, (13, 12)).astype(float)
    table = iterate.durable(flow.complete_d8(grid.cells_from_array(spark, z.tolist())))
    to = {r.cid: r.ds for r in table.select("cid", "ds").collect()}
    at = {(c & (2**31 - 1), c >> 31): c for c in to}

    def way(c):
        out = [(c, 0.0)]
        while to[c] is not None:
            a, b = (c & (2**31 - 1), c >> 31), (to[c] & (2**31 - 1), to[c] >> 31)
            c = to[c]
            out.append((c, out[-1][1] + float(np.hypot(a[0] - b[0], a[1] - b[1]))))
        return out

    ways, want = {c: way(c) for c in to}, np.zeros(z.shape)
    for (i, j), c in at.items():
        for d in D8.neighbours():
            if (n := at.get((i + d.di, j + d.dj))) is not None:
                other = {x for x, _ in ways[n]}
                want[i, j] = max(want[i, j], next((s for x, s in ways[c] if x in other), ways[c][-1][1]))
    got = arr(ridges.dist2conf_max(table), "dist", z.shape)
    assert np.allclose(got, want)


def test_neighbourhood_across_blocks(spark, monkeypatch):
    z = np.random.default_rng(4).integers(0, 9, (9, 7))
    cells = grid.cells_from_array(spark, z.astype(float).tolist())
    monkeypatch.setattr(stencil, "BLOCK_BITS", 1)
    near = stencil.neighbourhood(cells, ["z"])
    shuffles = near._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    assert shuffles == 1  # by block; a partition held a whole line before
    got = {(r.i, r.j): [r[f"nb_{d.di + 1}{d.dj + 1}"] for d in D8.neighbours()] for r in near.collect()}
    assert len(got) == z.size
    for (i, j), found in got.items():
        for d, n in zip(D8.neighbours(), found):
            inside = 0 <= i + d.di < 9 and 0 <= j + d.dj < 7
            assert (n is not None) == inside and (not inside or n.z == z[i + d.di, j + d.dj])


def test_dist2ridge_takes_few_jobs(spark):
    z = np.random.default_rng(9).integers(0, 50, (8, 8)).astype(float)
    table = iterate.durable(flow.simple_d8(grid.cells_from_array(spark, z.tolist())))
    before = jobs(spark, lambda: ridges.ridgedir(table).count())[1]
    got, after = jobs(spark, lambda: ridges.dist2ridge(table).count())
    assert got == 64 and after <= before + 40  # the ridge directions are made once


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_many_partitions(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).cast("string").alias("grid_id"), ((F.col("id") * 7919) % 1009).alias("v"))
    w = W.partitionBy("grid_id").orderBy("v")
    got = {(r.grid_id, r.v): r.n for r in iterate.ranked(df, ["grid_id"], ["v"], "n").collect()}
    assert got == {(r.grid_id, r.v): r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert sorted(r.n for r in iterate.ranked(df, [], ["grid_id", "v"], "n").collect()) == list(range(1, 501))


def test_perimeter_edges_meet_vertices_by_stretches(spark):
    n = 3000
    path = [(0.0, 0.0), (float(n - 1), 0.0)]
    rows = [("g", 0, 1, path)] + [("g", k, 1, [(float(i), 0.0), (float(i), 1.0)]) for k, i in enumerate((5, 1023, 1024, 2100), 1)]
    arcs = spark.createDataFrame(rows, "graph_id string, arc_id int, ord int, path array<struct<i:double,j:double>>")
    verts, edges = mesh.constraint_graph(arcs, spark.createDataFrame([("g", mesh.VALLEY)], "graph_id string, kind int"), (n, 4))
    assert "NestedLoop" not in plan_of(edges)  # every perimeter edge met every perimeter vertex before
    at = {r.vid: (r.i, r.j) for r in verts.collect()}
    got = {(at[r.u], at[r.v]): r.kinds for r in edges.collect()}
    side = [(i, 0) for i in (0, 5, 1023, 1024, 2100, n - 1)]
    assert {e for e in got if e[0][1] == e[1][1] == 0} == set(zip(side, side[1:])) and got[side[0], side[1]] == mesh.VALLEY | mesh.BOUNDARY
    assert mesh.validate_constraints(verts, edges, (n, 4)).where("problem like '%boundary%'").isEmpty()


def test_repeated_segments_cross_alike(spark):
    verts = spark.createDataFrame([("m", 0, 0, 0), ("m", 1, 4, 0), ("m", 2, 4, 4), ("m", 3, 0, 4), ("x", 0, 0, 0), ("x", 1, 4, 0), ("x", 2, 4, 4)], "mesh_id string, vid int, x long, y long")
    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 2, 3), ("x", 0, 0, 1, 2)], "mesh_id string, fid int, a int, b int, c int")
    segments = spark.createDataFrame([("m", k, 1, 3) for k in range(6)] + [("m", 9, 0, 1)], "mesh_id string, cid long, p int, q int")
    got = mesh.crossing_edges(verts, faces, segments)
    assert sorted(tuple(r) for r in got.collect()) == [("m", k, 0, 1, 0, 2) for k in range(6)]
    assert plan_of(got).count("LeftSemi") >= 1  # meshes without segments are left out


def test_isolation_looks_at_higher_cells_alone(spark, monkeypatch):
    z = np.random.default_rng(1).permutation(40 * 40).reshape(40, 40).astype(float)
    kept, keep = [], terrain.durable
    monkeypatch.setattr(terrain, "durable", lambda df: kept.append((df.columns, n.count())) or n if (n := keep(df)) is not None else n)
    got = arr(terrain.isolation(grid.cells_from_array(spark, z.tolist())), "iso", z.shape)
    i, j = np.mgrid[:40, :40]
    for a, b in ((3, 5), (20, 20), (39, 39), *zip(*np.nonzero(z > 1560))):
        d2 = ((i - a) ** 2 + (j - b) ** 2)[z > z[a, b]]
        assert got[a, b] == pytest.approx(np.sqrt(d2.min()) if len(d2) else 0.0)
    cells = [n for columns, n in kept if columns == ["grid_id", "i", "j", "cid", "z", "valid"]]
    assert len(cells) > 2 and cells[0] == 1600 and cells[-1] < 200


def divide_tree(z, ok):
    """(prominence, features) of a small raster: domains as sets, joined flat by flat from the highest."""
    ni, nj = z.shape
    near = lambda c: [(c[0] + d.di, c[1] + d.dj) for d in D8.neighbours() if 0 <= c[0] + d.di < ni and 0 <= c[1] + d.dj < nj and ok[c[0] + d.di, c[1] + d.dj]]
    flats, seen = [], set()
    for c in sorted(((i, j) for i in range(ni) for j in range(nj) if ok[i, j]), key=lambda c: (c[1], c[0])):
        if c not in seen:
            flat, stack = {c}, [c]
            while stack:
                more = [n for n in near(stack.pop()) if z[n] == z[c] and n not in flat]
                flat |= set(more)
                stack += more
            seen |= flat
            flats.append((-z[c], c[1], c[0], flat))
    prom, features, domains = np.where(ok, 0.0, -1.0), [], []
    for down, _, _, flat in sorted(flats, key=lambda x: x[:3]):
        met = [d for d in domains if any(n in d["cells"] for c in flat for n in near(c))]
        domains = [d for d in domains if not any(d is m for m in met)]
        new = {"cells": set(flat).union(*(d["cells"] for d in met)), "z": max((d["z"] for d in met), default=-down)}
        if len(met) != 1:
            middle = np.mean(list(flat), axis=0)
            features.append([1 if not met else 2, *min(flat, key=lambda c: (((np.array(c) - middle) ** 2).sum(), c[1], c[0])), -1, -1])
            for d in met:
                features[d["last"]][4] = len(features) - 1
                for k, top in d["tops"] if d["z"] < new["z"] else ():
                    features[k][3] = len(features) - 1
                    for c in top:
                        prom[c] = d["z"] + down
        k = len(features) - 1
        new["last"] = k if len(met) != 1 else met[0]["last"]
        new["tops"] = [t for d in met if d["z"] == new["z"] for t in d["tops"]] or [(k, flat)]
        domains.append(new)
    for d in domains:
        for _, top in d["tops"]:
            for c in top:
                prom[c] = -1
    return prom, features


@pytest.mark.parametrize("levels", [3, 50])
def test_prominence_across_tiles(spark, tiled, levels):
    rng = np.random.default_rng(levels)
    z, ok = rng.integers(0, levels, (13, 11)).astype(float), rng.random((13, 11)) > 0.1
    cells = grid.cells_from_array(spark, z.tolist(), ok.tolist())
    prom, features = divide_tree(z, ok)
    assert (arr(terrain.prominence(cells), "prom", z.shape) == prom).all()
    got = terrain.prominence_features(cells).orderBy("fid").collect()
    assert [[r.kind, r.i, r.j, r.key_saddle, r.parent] for r in got] == features


def test_prominence_leaves_a_small_graph_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(iterate, "TILE_BITS", 4)
    z = np.random.default_rng(2).permutation(64 * 48).reshape(64, 48).astype(float)
    cells = grid.cells_from_array(spark, z.tolist())
    rows, _ = prominence.swept(cells, D8, False)
    shared = sum(1 for i in range(64) for j in range(48) if (i and i % 16 == 0) or (j and j % 16 == 0))
    kinds = {r.t: r["count"] for r in rows.groupBy("t").count().collect()}
    assert kinds[prominence.CELL] == 64 * 48 and kinds[prominence.MEETING] + kinds[prominence.TOP] < 3 * shared


def test_orders_and_source_ways_take_two_passes(spark, monkeypatch):
    monkeypatch.setattr(iterate, "TILE_BITS", 2)
    table, _ = field(spark, 11, acyclic=True)
    table = table.localCheckpoint()
    assert metrics.strahler(table).agg(F.max("ord")).first()[0] > 1
    for run in (metrics.strahler, metrics.dist2source):
        _, n = jobs(spark, lambda: run(table).collect())
        assert n <= 16  # a gathering per order adds jobs with each order


def test_order_grows_along_a_way_across_tiles(spark, monkeypatch):
    # tributaries of orders 1, 2 and 1 join a way that crosses tiles: 2 at the first, 3 at the second, still 3 at the third
    monkeypatch.setattr(iterate, "TILE_BITS", 1)
    codes = [[0] * 9 for _ in range(4)]
    codes[3] = [1] * 8 + [0]
    codes[2][1] = codes[2][4] = codes[2][7] = 3
    codes[1][4], codes[1][3] = 3, 2
    table = coded(spark, codes)
    assert arr(metrics.strahler(table), "ord", (4, 9))[3].tolist() == [1, 2, 2, 2, 3, 3, 3, 3, 3]


def test_flood_looks_up_directions_once(monkeypatch):
    calls, all_ = [], D8Directions.all
    monkeypatch.setattr(D8Directions, "all", lambda self: calls.append(1) or all_(self))
    z = np.array([[3.0, 3, 3, 3], [3, 1, 2, 3], [3, 3, 3, 3]])
    rim = [(i, j) for i in range(3) for j in range(4) if (i, j) not in ((1, 1), (1, 2))]
    filled, label, spill = flow._flood(z, np.ones(z.shape, bool), rim)
    assert (filled == 3).all() and (label >= 0).all() and set(spill.values()) == {3.0} and len(calls) == 1


def odd_cells(spark, seed, shape=(13, 11)):
    """Two grids of few levels with a mask, both zeros, and valid cells of NaN and null elevation."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("a", "b"):
        for i, j in np.ndindex(shape):
            z = [0.0, -0.0, 1.0, 2.0, 1 + 1e-12, float("nan"), None][rng.choice(7, p=[0.2, 0.2, 0.25, 0.15, 0.1, 0.06, 0.04])]
            rows.append((g, i, j, z, bool(rng.random() < 0.9)))
    return grid.with_ids(spark.createDataFrame(rows, "grid_id string, i int, j int, z double, valid boolean")).withColumn("note", F.concat("grid_id", F.col("i").cast("string")))


@pytest.mark.parametrize("bits, alone, kernel_cells", [(8, 10**6, 10**6), (2, 10**6, 10**6), (1, 0, 10**6), (1, 10**6, 4)], ids=["one-tile", "tiles", "rounds", "large-flats"])
def test_flats_across_tiles(spark, monkeypatch, bits, alone, kernel_cells):
    monkeypatch.setattr(flow.tiled, "TILE_BITS", bits)
    monkeypatch.setattr(iterate, "ALONE", alone)
    made = ["code", "ds", "is_flat", "low_edge", "high_edge", "push", "pull"]
    cells = iterate.durable(odd_cells(spark, bits))
    steps = flow.flat_gradients(iterate.durable(flow.flat_labels(iterate.durable(flow.flat_edges(iterate.durable(flow.simple_d8(cells)))))))
    want = steps.select("note", "grid_id", "cid", *made, "label").collect()
    got = flow.numbered(flow.tiled_flats(cells, ["note", "grid_id", "cid", *made, "first"], kernel_cells=kernel_cells)).select(want[0].__fields__).collect()
    assert max(r.pull for r in want) > 2 and max(r.push for r in want) > 2 and max(r.label for r in want) > 2
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_flats_look_past_missing_cells(spark):
    line = spark.createDataFrame([("g", k, k, z, True) for k, z in enumerate((1.0, 1.0, 0.0))], "grid_id string, i int, j int, z double, valid boolean")
    got = flow.tiled_flats(grid.with_ids(line), ["i", "code", "pull"])
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2), (1, 2, 1), (2, 0, 0)]


def test_large_flats_grow_as_small_ones(spark, monkeypatch):
    z = np.random.default_rng(6).choice([1.0, 2.0], (12, 12), p=[0.6, 0.4])
    near = iterate.durable(flow.flat_labels(iterate.durable(flow.flat_edges(iterate.durable(flow.simple_d8(grid.cells_from_array(spark, z.tolist())))))))
    low = near.withColumn("low_edge", F.col("cid") % 9 == 0)
    got = [arr(flow.flat_gradients(low, kernel_cells=n), c, (12, 12)).tolist() for c in ("push", "pull") for n in (10**6, 0)]
    assert max(map(max, got[2])) > 2 and got[0] == got[1] and got[2] == got[3]


def test_push_is_nothing_without_high_edges(spark):
    level = flow.tiled_flats(grid.cells_from_array(spark, [[1.0] * 4] * 3), ["i", "j", "push", "pull"])
    assert {(r.push, r.pull) for r in level.collect()} == {(0, 0)}


def test_complete_directions_take_few_jobs(spark):
    z = np.random.default_rng(4).integers(0, 3, (40, 40)).astype(float).tolist()
    cells = iterate.durable(grid.cells_from_array(spark, z))
    _, n_jobs = jobs(spark, lambda: flow.complete_d8(cells).agg(F.sum("z_syn")).first())
    assert n_jobs <= 25  # one stencil, edge or component step after another took more


def test_small_flats_share_kernel_calls(spark):
    """Their number goes with the cells, not with the labels: 64 labels apart shared a call."""
    n = 3000
    t = grid.cells_from_array(spark, [[1.0] for _ in range(n)]).withColumn("label", (F.col("i") * 64 + 1).cast("int")).withColumn("n", F.lit(1)).withColumn("high_edge", F.lit(True)).withColumn("low_edge", F.lit(False))
    got = flow._layers_by_flat(t, n).cache()
    assert got.where("push_d = 1 and pull_d = 0").count() == n
    keys = [x for x in plan_of(flow._layers_by_flat(t, n)).splitlines() if "xxhash64" in x]
    assert keys and "pmod" in keys[0]
