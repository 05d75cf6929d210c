"""Registered queries of the terrain, network and mesh operators, with their SQL forms.

The raster is the table ``embeddings``: row i = vec_id, column j = position, elevation
floor(1000 * value), an integer that 32-bit floats hold exactly; coarse ones
take floor(40 * value) or floor(10 * value) and have many flats. Arcs are the customers of a nation in order of key at
(c_custkey, floor(c_acctbal / 1000)).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import colour as colours
from ..functions import geometry as geo
from ..operators import components, flow, grid, mesh, metrics, network, ridges, stencil, terrain
from ..operators.directions import D8, D8Directions
from ..session import ship
from .iterate import durable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AFFINE = grid.Affine(2.0, 0.5, 10.0, -0.25, -3.0, 100.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL form if there is one."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raster(spark: SparkSession, sf_dir: str, scale: int = 1000) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return grid.cells_from_vectors(e, "vec_id", "embedding", F.floor(F.col("e").cast("double") * scale).cast("double"))


def flow_table(spark: SparkSession, sf_dir: str, scale: int = 1000) -> DataFrame:
    return durable(flow.simple_d8(raster(spark, sf_dir, scale)))


def customer_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    point = F.struct("c_custkey", F.col("c_custkey").cast("double").alias("i"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("j"))
    grouped = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(point)).alias("v"))
    path = F.transform("v", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j")))
    return grouped.select(F.concat(F.lit("g"), (F.col("c_nationkey") % 2).cast("string")).alias("graph_id"), F.col("c_nationkey").cast("int").alias("arc_id"), (F.col("c_nationkey") % 3).cast("int").alias("ord"), path.alias("path"))


def grid_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the raster's lattice, each band of 20 rows a mesh: two triangles per square."""
    c = raster(spark, sf_dir).select((F.col("i") / 20).cast("int").cast("string").alias("mesh_id"), ((F.col("i") % 20) * 64 + F.col("j")).alias("vid"), (F.col("i") % 20).cast("long").alias("x"), F.col("j").cast("long").alias("y"), "i", "j")
    top = c.groupBy("mesh_id").agg(F.max("x").alias("last"))
    square = c.join(top, "mesh_id").where((F.col("x") < F.col("last")) & (F.col("y") < 63))
    v = F.col("vid")
    two = F.array(F.struct(v.alias("a"), (v + 64).alias("b"), (v + 65).alias("c")), F.struct(v.alias("a"), (v + 65).alias("b"), (v + 1).alias("c")))
    faces = square.select("mesh_id", F.explode(two).alias("f")).select("mesh_id", F.col("f.a").cast("int").alias("a"), F.col("f.b").cast("int").alias("b"), F.col("f.c").cast("int").alias("c"))
    return c.select("mesh_id", "vid", "x", "y"), mesh.canonical_faces(faces)


def _cells_sql(scale: int = 1000) -> str:
    return f"""c AS (SELECT CAST(vec_id AS INTEGER) AS i, CAST(ord - 1 AS INTEGER) AS j, CAST(FLOOR(CAST(e AS DOUBLE) * {scale}) AS DOUBLE) AS z
        FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS ord FROM embeddings))"""


CELLS = _cells_sql()
COARSE = _cells_sql(10)
DIRS = "d(ord, di, dj, code) AS (VALUES " + ", ".join(f"({d.ord}, {d.di}, {d.dj}, {d.code})" for d in D8.neighbours()) + ")"
NEAR = "n AS (SELECT c.i, c.j, c.z, d.ord, d.code, b.i AS bi, b.j AS bj, b.z AS bz FROM c CROSS JOIN d JOIN c AS b ON b.i = c.i + d.di AND b.j = c.j + d.dj)"
#: Lowest strictly lower neighbour, ties by ord; f: i, j, z, code, ti, tj (target or null)
#: (bz, ord) as one exact double: elevations are integers, orders below 16
FLOW = """f AS MATERIALIZED (SELECT c.i, c.j, c.z, COALESCE(m.code, 0) AS code, m.bi AS ti, m.bj AS tj FROM c LEFT JOIN
    (SELECT i, j, ARG_MIN(code, bz * 16 + ord) FILTER (WHERE bz < z) AS code, ARG_MIN(bi, bz * 16 + ord) FILTER (WHERE bz < z) AS bi, ARG_MIN(bj, bz * 16 + ord) FILTER (WHERE bz < z) AS bj FROM n GROUP BY i, j) AS m ON c.i = m.i AND c.j = m.j)"""
BASE = f"{CELLS}, {DIRS}, {NEAR}, {FLOW}"
#: Every cell with each cell on its way down: r: i, j, ai, aj, hops, dist
REACH = """r AS (SELECT i, j, i AS ai, j AS aj, 0 AS hops, CAST(0 AS DOUBLE) AS dist FROM f
    UNION ALL SELECT r.i, r.j, f.ti, f.tj, r.hops + 1, r.dist + sqrt((f.ti - f.i) * (f.ti - f.i) + (f.tj - f.j) * (f.tj - f.j))
    FROM r JOIN f ON f.i = r.ai AND f.j = r.aj WHERE f.ti IS NOT NULL)"""
TREE = f"WITH RECURSIVE {BASE}, {REACH}"


@query(f"WITH {CELLS} SELECT i, j, CAST(z AS BIGINT) AS z, CAST(j AS BIGINT) * (SELECT MAX(i) + 1 FROM c) + i AS flat FROM c")
def raster_cells(spark, sf_dir):
    return grid.flat_id(raster(spark, sf_dir)).select("i", "j", F.col("z").cast("long").alias("z"), "flat")


@query(f"WITH {CELLS} SELECT i, j, 10.0 + 2.0 * (j + 0.5) + 0.5 * (i + 0.5) AS x, 100.0 + (-0.25) * (j + 0.5) + (-3.0) * (i + 0.5) AS y FROM c")
def raster_xy(spark, sf_dir):
    return grid.transform2xy(raster(spark, sf_dir), AFFINE).select("i", "j", "x", "y")


@query(f"WITH {CELLS} SELECT i // 3 AS i, j // 3 AS j, CAST(z AS BIGINT) AS z FROM c WHERE i % 3 = 0 AND j % 3 = 0")
def raster_stride(spark, sf_dir):
    return grid.stride(raster(spark, sf_dir), 3).select("i", "j", F.col("z").cast("long").alias("z"))


@query(f"""WITH {CELLS}, k AS (SELECT * FROM c WHERE j + 0.5 BETWEEN 10 AND 40 AND i + 0.5 BETWEEN 20 AND 300)
    SELECT i - (SELECT MIN(i) FROM k) AS i, j - (SELECT MIN(j) FROM k) AS j, CAST(z AS BIGINT) AS z FROM k""")
def raster_crop(spark, sf_dir):
    return grid.crop(grid.transform2xy(raster(spark, sf_dir)), (10, 40), (20, 300)).select("i", "j", F.col("z").cast("long").alias("z"))


@query(f"WITH {CELLS} SELECT i, j, (CAST(z AS BIGINT) % 7) <> 0 AS valid FROM c")
def raster_valid(spark, sf_dir):
    return grid.validity(raster(spark, sf_dir), (F.col("z").cast("long") % 7) != 0).select("i", "j", "valid")


_W = grid.gaussian_weights(1.0)
_WEIGHTS = "w(k, w) AS (VALUES " + ", ".join(f"({k - len(_W) // 2}, CAST({x!r} AS DOUBLE))" for k, x in enumerate(_W)) + ")"
_REFLECT = "CASE WHEN ((({0} + k) % (2 * {1})) + 2 * {1}) % (2 * {1}) < {1} THEN ((({0} + k) % (2 * {1})) + 2 * {1}) % (2 * {1}) ELSE 2 * {1} - 1 - ((({0} + k) % (2 * {1})) + 2 * {1}) % (2 * {1}) END"


@query(f"""WITH {CELLS}, {_WEIGHTS}, s AS (SELECT MAX(i) + 1 AS ni, MAX(j) + 1 AS nj FROM c),
    a AS (SELECT c.i, c.j, SUM(w.w * b.z) AS z FROM c, s, w JOIN c AS b ON b.j = c.j AND b.i = {_REFLECT.format("c.i", "s.ni")} GROUP BY c.i, c.j)
    SELECT a.i, a.j, ROUND(SUM(w.w * b.z), 3) AS z FROM a, s, w JOIN a AS b ON b.i = a.i AND b.j = {_REFLECT.format("a.j", "s.nj")} GROUP BY a.i, a.j""")
def gaussian_smooth(spark, sf_dir):
    return grid.gaussian_filter(raster(spark, sf_dir), 1.0).select("i", "j", F.round("z", 3).alias("z"))


def _scheme(name: str, scheme: D8Directions) -> None:
    """Register the simple directions of a scheme: of strictly lower neighbours the lowest, ties in the scheme's order."""

    def run(spark, sf_dir):
        out = flow.simple_d8(raster(spark, sf_dir, 40), scheme)
        return out.select("i", "j", F.col("code").cast("int").alias("code"), F.col("ds").isNull().alias("is_flat"))

    dirs = "d(ord, di, dj, code) AS (VALUES " + ", ".join(f"({d.ord}, {d.di}, {d.dj}, {d.code})" for d in scheme.neighbours()) + ")"
    run.__name__ = name
    query(f"""WITH {_cells_sql(40)}, {dirs}, n AS (SELECT c.i, c.j, c.z, d.ord, d.code, b.z AS bz FROM c CROSS JOIN d JOIN c AS b ON b.i = c.i + d.di AND b.j = c.j + d.dj),
    m AS (SELECT i, j, ARG_MIN(code, bz * 64 + ord) AS code FROM n WHERE bz < z GROUP BY i, j) SELECT c.i, c.j, COALESCE(m.code, 0) AS code, m.code IS NULL AS is_flat FROM c LEFT JOIN m ON m.i = c.i AND m.j = c.j""")(run)


_scheme("d8_scan_order", D8Directions(sort_by_distance=False))
_scheme("d8_window_5", D8Directions(window=5, transform_codes=int))


@query(f"WITH {CELLS}, {DIRS} SELECT c.i, c.j, d.ord, d.code, COALESCE(b.z, -99.0) AS value FROM c CROSS JOIN d LEFT JOIN c AS b ON b.i = c.i + d.di AND b.j = c.j + d.dj")
def neighbour_values(spark, sf_dir):
    return stencil.neighbour_values(raster(spark, sf_dir), pad=-99.0).select("i", "j", "ord", F.col("code").cast("int").alias("code"), "value")


@query(f"""WITH {BASE} SELECT f.i, f.j, f.i + COALESCE(d.di, 0) AS dsi, f.j + COALESCE(d.dj, 0) AS dsj, CAST(f.j + COALESCE(d.dj, 0) AS BIGINT) * (SELECT MAX(i) + 1 FROM c) + f.i + COALESCE(d.di, 0) AS flat
    FROM f LEFT JOIN d ON d.code = f.code""")
def downstream_index(spark, sf_dir):
    return stencil.downstream(flow_table(spark, sf_dir)).select("i", "j", "dsi", "dsj", "flat")


@query(f"WITH {DIRS} SELECT a.code, b.code AS opposite FROM d AS a JOIN d AS b ON a.di = -b.di AND a.dj = -b.dj UNION ALL SELECT 0, 0")
def dir_opposite(spark, sf_dir):
    d = D8.frame(spark)
    b = d.select((-F.col("di")).alias("di"), (-F.col("dj")).alias("dj"), F.col("code").alias("opposite"))
    return d.join(b, ["di", "dj"]).select(F.col("code").cast("int").alias("code"), F.col("opposite").cast("int").alias("opposite"))


_GRAD = """g AS (SELECT i, j, z,
    CASE WHEN LAG(z) OVER r IS NULL THEN LEAD(z) OVER r - z WHEN LEAD(z) OVER r IS NULL THEN z - LAG(z) OVER r ELSE (LEAD(z) OVER r - LAG(z) OVER r) / 2 END AS gx,
    CASE WHEN LAG(z) OVER k IS NULL THEN LEAD(z) OVER k - z WHEN LEAD(z) OVER k IS NULL THEN z - LAG(z) OVER k ELSE (LEAD(z) OVER k - LAG(z) OVER k) / 2 END AS gy
    FROM c WINDOW r AS (PARTITION BY i ORDER BY j), k AS (PARTITION BY j ORDER BY i))"""


@query(f"WITH {CELLS}, {_GRAD} SELECT i, j, ROUND(sqrt(gx * gx + gy * gy), 6) AS slope FROM g")
def slope(spark, sf_dir):
    return terrain.slope(raster(spark, sf_dir)).select("i", "j", F.round("slope", 6).alias("slope"))


_DOT = """t AS (SELECT i, j, (-gy * cos(radians(45)) * cos(radians(180 - 315)) - gx * cos(radians(45)) * sin(radians(180 - 315)) + sin(radians(45))) / sqrt(gx * gx + gy * gy + 1) AS dot FROM g)"""


def _shade(method: str) -> Query:
    def run(spark, sf_dir):
        return terrain.hillshade(raster(spark, sf_dir), 315, 45, method).select("i", "j", F.round("shade", 6).alias("shade"))

    run.__name__ = f"hillshade_{method}"
    return run


for _m, _e in (("hard", "LEAST(GREATEST(dot, 0.0), 1.0)"), ("half", "(dot + 1) / 2"), ("soft", "((dot + 1) / 2) * ((dot + 1) / 2)")):
    query(f"WITH {CELLS}, {_GRAD}, {_DOT} SELECT i, j, ROUND({_e}, 6) AS shade FROM t")(_shade(_m))


@query(f"WITH {BASE} SELECT i, j, code, ti IS NULL AS is_flat FROM f")
def d8_simple(spark, sf_dir):
    return flow.simple_d8(raster(spark, sf_dir)).select("i", "j", F.col("code").cast("int").alias("code"), "is_flat")


_EDGES = """e AS (SELECT f.i, f.j, f.z, f.code, f.ti IS NOT NULL AND BOOL_OR(g.z = f.z AND g.ti IS NULL) AS low_edge, f.ti IS NULL AND BOOL_OR(g.z > f.z) AS high_edge
    FROM f CROSS JOIN d JOIN f AS g ON g.i = f.i + d.di AND g.j = f.j + d.dj GROUP BY f.i, f.j, f.z, f.code, f.ti)"""
FLAT_SCALE = 40
_COARSE = f"{_cells_sql(FLAT_SCALE)}, {DIRS}, {NEAR}, {FLOW}, {_EDGES}"


@query(f"WITH {_COARSE} SELECT i, j, low_edge, high_edge FROM e")
def flat_edges(spark, sf_dir):
    return flow.flat_edges(flow_table(spark, sf_dir, FLAT_SCALE)).select("i", "j", "low_edge", "high_edge")


#: Components of equal elevation by least cell id; l: i, j, label
_LABELS = """p AS (SELECT i, j, CAST(j AS BIGINT) * 2147483648 + i AS cid, z FROM c),
    q(cid, root) AS (SELECT cid, cid FROM p UNION SELECT b.cid, q.root FROM q JOIN p AS a ON a.cid = q.cid CROSS JOIN d JOIN p AS b ON b.i = a.i + d.di AND b.j = a.j + d.dj AND b.z = a.z WHERE b.cid > q.root),
    m AS (SELECT cid, MIN(root) AS comp FROM q GROUP BY cid),
    s AS (SELECT m.comp, MIN(m.cid) AS first FROM m JOIN p USING (cid) JOIN e ON e.i = p.i AND e.j = p.j WHERE e.low_edge OR e.code = 0 GROUP BY m.comp),
    l AS (SELECT p.i, p.j, p.cid, COALESCE(k.label, 0) AS label FROM p JOIN m USING (cid) LEFT JOIN (SELECT comp, ROW_NUMBER() OVER (ORDER BY first) AS label FROM s) AS k USING (comp))"""


@query(f"WITH RECURSIVE {_COARSE}, {_LABELS} SELECT i, j, CAST(label AS INTEGER) AS label FROM l")
def flat_labels(spark, sf_dir):
    return flow.numbered(flow.tiled_flats(raster(spark, sf_dir, FLAT_SCALE), ["grid_id", "i", "j", "cid", "first"])).select("i", "j", "label")


def _layers(name: str, seeds: str) -> str:
    return f"""{name}0 AS (SELECT l.i, l.j, l.label, 1 AS depth FROM l JOIN e ON e.i = l.i AND e.j = l.j WHERE l.label > 0 AND e.{seeds}),
    {name}1(i, j, label, depth) AS (SELECT * FROM {name}0 UNION SELECT b.i, b.j, b.label, a.depth + 1 FROM {name}1 AS a CROSS JOIN d JOIN l AS b ON b.i = a.i + d.di AND b.j = a.j + d.dj AND b.label = a.label WHERE a.depth < 60),
    {name} AS (SELECT i, j, label, MIN(depth) AS depth FROM {name}1 GROUP BY i, j, label)"""


_FLATS = f"WITH RECURSIVE {_COARSE}, {_LABELS}, {_layers('lo', 'low_edge')}, {_layers('hi', 'high_edge')}"
_PULL = "COALESCE(lo.depth, 0)"
_PUSH = "CASE WHEN l.label > 0 THEN COALESCE(t.top, 0) - COALESCE(hi.depth, 0) + 1 ELSE 0 END"
_GRADS = f"""z1 AS (SELECT l.i, l.j, l.label, CAST({_PUSH} AS BIGINT) AS push, CAST({_PULL} AS BIGINT) AS pull FROM l LEFT JOIN lo ON lo.i = l.i AND lo.j = l.j LEFT JOIN hi ON hi.i = l.i AND hi.j = l.j
    LEFT JOIN (SELECT label, MAX(depth) AS top FROM hi GROUP BY label) AS t ON t.label = l.label)"""


@query(f"{_FLATS}, {_GRADS} SELECT i, j, pull FROM z1")
def flat_pull(spark, sf_dir):
    return flow.tiled_flats(raster(spark, sf_dir, FLAT_SCALE), ["i", "j", "pull"])


@query(f"{_FLATS}, {_GRADS} SELECT i, j, push FROM z1")
def flat_push(spark, sf_dir):
    return flow.tiled_flats(raster(spark, sf_dir, FLAT_SCALE), ["i", "j", "push"])


@query(f"""{_FLATS}, {_GRADS}, v AS (SELECT a.i, a.j, d.code, ROW_NUMBER() OVER (PARTITION BY a.i, a.j ORDER BY b.push + 4 * b.pull, d.ord) AS k
    FROM z1 AS a CROSS JOIN d JOIN z1 AS b ON b.i = a.i + d.di AND b.j = a.j + d.dj AND b.label = a.label WHERE a.label > 0 AND b.push + 4 * b.pull < a.push + 4 * a.pull)
    SELECT f.i, f.j, CAST(CASE WHEN f.ti IS NULL THEN COALESCE(v.code, 0) ELSE f.code END AS INTEGER) AS code, z1.push + 4 * z1.pull AS z_syn
    FROM f JOIN z1 ON z1.i = f.i AND z1.j = f.j LEFT JOIN v ON v.i = f.i AND v.j = f.j AND v.k = 1""")
def d8_complete(spark, sf_dir):
    return flow.complete_d8(raster(spark, sf_dir, FLAT_SCALE)).select("i", "j", F.col("code").cast("int").alias("code"), F.col("z_syn").cast("long").alias("z_syn"))


@query(f"WITH {COARSE}, {DIRS}, {NEAR} SELECT i, j, z = MIN(bz) AS flat FROM n GROUP BY i, j, z")
def find_flat(spark, sf_dir):
    return terrain.find_flat(raster(spark, sf_dir, 10)).select("i", "j", "flat")


@query(f"WITH {COARSE}, {DIRS}, {NEAR}, m AS (SELECT i, j, z, bz, MIN(bz) OVER (PARTITION BY i, j) AS low FROM n) SELECT i, j, SUM(CASE WHEN bz = low THEN 1 ELSE 0 END) > 1 AND MIN(bz) < z AS ambiguous FROM m GROUP BY i, j, z")
def find_ambiguous(spark, sf_dir):
    return terrain.find_ambiguous(raster(spark, sf_dir, 10)).select("i", "j", "ambiguous")


@query(f"WITH {CELLS}, {DIRS}, {NEAR}, m AS (SELECT i, j, MIN(bz) AS low FROM n GROUP BY i, j) SELECT c.i, c.j, CAST(CASE WHEN c.z < m.low THEN m.low ELSE c.z END AS BIGINT) AS z, c.z < m.low AS is_pit FROM c JOIN m ON m.i = c.i AND m.j = c.j")
def fill_pits(spark, sf_dir):
    return terrain.fill_pits(raster(spark, sf_dir)).select("i", "j", F.col("z").cast("long").alias("z"), "is_pit")


@query(f"WITH {BASE} SELECT c.i, c.j, CAST(COUNT(f.i) AS INTEGER) AS indegree FROM c LEFT JOIN f ON f.ti = c.i AND f.tj = c.j GROUP BY c.i, c.j")
def indegree(spark, sf_dir):
    return flow.indegree(flow_table(spark, sf_dir)).select("i", "j", "indegree")


@query(f"""{TREE}, u AS (SELECT ai AS i, aj AS j, COUNT(*) AS accum FROM r GROUP BY ai, aj), g AS (SELECT ti AS i, tj AS j, COUNT(*) AS n FROM f WHERE ti IS NOT NULL GROUP BY ti, tj)
    SELECT f.i, f.j, CAST(f.z AS BIGINT) AS z, CAST(f.code AS INTEGER) AS code, CAST(COALESCE(g.n, 0) AS INTEGER) AS indegree, CAST(u.accum AS DOUBLE) AS accum FROM f JOIN u ON u.i = f.i AND u.j = f.j LEFT JOIN g ON g.i = f.i AND g.j = f.j""")
def accumulation(spark, sf_dir):
    table = flow_table(spark, sf_dir)
    out = table.join(flow.indegree(table).select("cid", "indegree"), "cid").join(metrics.accumulation(table).select("cid", "accum"), "cid")
    return out.select("i", "j", F.col("z").cast("long").alias("z"), F.col("code").cast("int").alias("code"), "indegree", "accum")


_END = "x AS (SELECT r.i, r.j, r.ai, r.aj, r.hops, r.dist FROM r JOIN f ON f.i = r.ai AND f.j = r.aj WHERE f.ti IS NULL)"


@query(f"{TREE}, {_END}, k AS (SELECT i, j, ROW_NUMBER() OVER (ORDER BY j, i) AS label FROM f WHERE ti IS NULL) SELECT x.i, x.j, CAST(k.label AS INTEGER) AS label FROM x JOIN k ON k.i = x.ai AND k.j = x.aj")
def watersheds(spark, sf_dir):
    return metrics.watersheds(flow_table(spark, sf_dir)).select("i", "j", "label")


@query(f"{TREE}, {_END} SELECT i, j, ROUND(dist, 6) AS dist FROM x")
def dist2sink(spark, sf_dir):
    return metrics.dist2sink(flow_table(spark, sf_dir)).select("i", "j", F.round("dist", 6).alias("dist"))


@query(f"""{TREE}, g AS (SELECT DISTINCT ti AS i, tj AS j FROM f WHERE ti IS NOT NULL),
    o AS (SELECT r.* FROM r LEFT JOIN g ON g.i = r.i AND g.j = r.j WHERE g.i IS NULL)
    SELECT ai AS i, aj AS j, ROUND(dist, 6) AS dist FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY ai, aj ORDER BY hops DESC, j DESC, i DESC) = 1""")
def dist2source(spark, sf_dir):
    return metrics.dist2source(flow_table(spark, sf_dir)).select("i", "j", F.round("dist", 6).alias("dist"))


#: Orders 1 .. 8: s<k+1> holds the cells at or below a meeting of two tributaries of order k
_STRAHLER = "s1 AS (SELECT i, j FROM f), " + ", ".join(
    f"""s{k + 1} AS (SELECT DISTINCT r.ai AS i, r.aj AS j FROM r JOIN (SELECT f.ti, f.tj FROM f JOIN s{k} USING (i, j) WHERE f.ti IS NOT NULL GROUP BY f.ti, f.tj HAVING COUNT(*) > 1) AS m ON m.ti = r.i AND m.tj = r.j)""" for k in range(1, 8)
)
_ORDERS = f"{_STRAHLER}, w AS (SELECT i, j, MAX(ord) AS ord FROM (" + " UNION ALL ".join(f"SELECT i, j, {k} AS ord FROM s{k}" for k in range(1, 9)) + ") AS a GROUP BY i, j)"


@query(f"{TREE}, {_ORDERS} SELECT i, j, CAST(ord AS INTEGER) AS ord FROM w")
def strahler(spark, sf_dir):
    return metrics.strahler(flow_table(spark, sf_dir)).select("i", "j", "ord")


#: Cells that reach themselves, in a field whose directions follow the last three bits of the elevation
@query(f"""WITH RECURSIVE {CELLS}, {DIRS}, f AS MATERIALIZED (SELECT c.i, c.j, b.i AS ti, b.j AS tj FROM c JOIN d ON d.ord = 1 + (((CAST(c.z AS BIGINT) % 8) + 8) % 8) LEFT JOIN c AS b ON b.i = c.i + d.di AND b.j = c.j + d.dj),
    r AS (SELECT i, j, ti, tj FROM f WHERE ti IS NOT NULL UNION SELECT r.i, r.j, f.ti, f.tj FROM r JOIN f ON f.i = r.ti AND f.j = r.tj WHERE f.ti IS NOT NULL)
    SELECT f.i, f.j, r.i IS NULL AS acyclic, r.i IS NOT NULL AS cyclic FROM f LEFT JOIN r ON r.i = f.i AND r.j = f.j AND r.ti = f.i AND r.tj = f.j""")
def acyclic(spark, sf_dir):
    codes = F.array(*(F.lit(d.code).cast("smallint") for d in D8.neighbours()))
    cells = raster(spark, sf_dir).withColumn("code", F.get(codes, F.pmod(F.col("z").cast("long"), F.lit(8)).cast("int")))
    return flow.acyclic(durable(flow.flow_from_codes(cells))).select("i", "j", "acyclic", "cyclic")


@query(f"{TREE} SELECT ai AS i, aj AS j, SUM(1) > 0 AND BOOL_OR(FALSE) AS wet FROM r WHERE FALSE GROUP BY ai, aj UNION ALL SELECT r.i, r.j, BOOL_OR(CAST(b.z AS BIGINT) % 5 = 0) AS wet FROM r JOIN c AS b ON b.i = r.ai AND b.j = r.aj GROUP BY r.i, r.j")
def flood_upstream(spark, sf_dir):
    return metrics.flood_upstream(flow_table(spark, sf_dir), F.col("z").cast("long") % 5 == 0).select("i", "j", "wet")


def _components_sql(member: str, label: str, where: str = "TRUE") -> str:
    return f"""WITH RECURSIVE {COARSE}, {DIRS}, s AS (SELECT MAX(i) + 1 AS nr, MAX(j) + 1 AS nc FROM c), p AS (SELECT i, j, CAST(j AS BIGINT) * 2147483648 + i AS cid FROM c WHERE {member}),
    q(cid, root) AS (SELECT cid, cid FROM p UNION SELECT b.cid, q.root FROM q JOIN p AS a ON a.cid = q.cid CROSS JOIN d JOIN p AS b ON b.i = a.i + d.di AND b.j = a.j + d.dj WHERE b.cid > q.root),
    m AS (SELECT cid, MIN(root) AS comp FROM q GROUP BY cid),
    k AS (SELECT m.comp, MIN({label}) AS first, COUNT(*) AS size FROM m JOIN p USING (cid) CROSS JOIN s GROUP BY m.comp),
    t AS (SELECT comp, size, ROW_NUMBER() OVER (ORDER BY first) AS label FROM k WHERE first IS NOT NULL),
    l AS (SELECT c.i, c.j, CAST(COALESCE(t.label, 0) AS INTEGER) AS label, t.size FROM c LEFT JOIN p ON p.i = c.i AND p.j = c.j LEFT JOIN m ON m.cid = p.cid LEFT JOIN t ON t.comp = m.comp)"""


_PLACE = "CASE WHEN p.i = 0 THEN p.j WHEN p.i = s.nr - 1 THEN s.nc + p.j WHEN p.j = 0 THEN 2 * s.nc + p.i WHEN p.j = s.nc - 1 THEN 2 * s.nc + s.nr + p.i END"


@query(_components_sql("z <= -3", "p.cid") + " SELECT i, j, label FROM l")
def mask_areas(spark, sf_dir):
    return components.mask_areas(raster(spark, sf_dir, 10), F.col("z") <= -3).select("i", "j", "label")


@query(_components_sql("z <= -3", _PLACE) + " SELECT i, j, label FROM l")
def ocean_basins(spark, sf_dir):
    return components.ocean_basins(raster(spark, sf_dir, 10), -3).select("i", "j", "label")


@query(_components_sql("z <= -3", _PLACE) + " SELECT i, j, COALESCE(label = 0 OR size < 4, TRUE) AS valid FROM l")
def ocean_invalidate(spark, sf_dir):
    return components.invalidate_ocean_basins(raster(spark, sf_dir, 10), -3, min_size=4).select("i", "j", "valid")


def _fill_sql(name: str, seeds: str = "") -> str:
    """Table ``name``: i, j, z at the least height at which water reaches the edge, lowered until nothing changes."""
    return f"""{name}(i, j, z) USING KEY (i, j) AS (SELECT c.i, c.j, c.z FROM c CROSS JOIN s WHERE c.i = 0 OR c.j = 0 OR c.i = nr - 1 OR c.j = nc - 1 {seeds}
    UNION SELECT e.bi, e.bj, MIN(GREATEST(e.bz, w.z)) FROM {name} AS w JOIN e ON e.i = w.i AND e.j = w.j LEFT JOIN recurring.{name} AS o ON o.i = e.bi AND o.j = e.bj WHERE o.z IS NULL OR GREATEST(e.bz, w.z) < o.z GROUP BY e.bi, e.bj)"""


_EDGES = f"{CELLS}, {DIRS}, s AS (SELECT MAX(i) + 1 AS nr, MAX(j) + 1 AS nc FROM c), e AS MATERIALIZED (SELECT a.i, a.j, b.i AS bi, b.j AS bj, b.z AS bz FROM c AS a CROSS JOIN d JOIN c AS b ON b.i = a.i + d.di AND b.j = a.j + d.dj)"


@query(f"WITH RECURSIVE {_EDGES}, {_fill_sql('w')} SELECT i, j, CAST(z AS BIGINT) AS z FROM w")
def fill_depressions(spark, sf_dir):
    return flow.fill_depressions(raster(spark, sf_dir)).select("i", "j", F.col("z").cast("long").alias("z"))


#: Raised areas of more than 8 cells, each with its lowest cell as a sink of the second flood
@query(f"""WITH RECURSIVE {_EDGES}, {_fill_sql('w')}, p AS MATERIALIZED (SELECT c.i, c.j, c.z FROM c JOIN w ON w.i = c.i AND w.j = c.j WHERE w.z > c.z),
    q(i, j, root) USING KEY (i, j) AS (SELECT i, j, CAST(j AS BIGINT) * 1000000000 + i FROM p UNION SELECT e.bi, e.bj, MIN(q.root) FROM q JOIN e ON e.i = q.i AND e.j = q.j JOIN recurring.q AS o ON o.i = e.bi AND o.j = e.bj WHERE q.root < o.root GROUP BY e.bi, e.bj),
    l AS MATERIALIZED (SELECT i, j, root, z FROM (SELECT q.i, q.j, q.root, p.z, COUNT(*) OVER (PARTITION BY q.root) AS n FROM q JOIN p ON p.i = q.i AND p.j = q.j) AS x WHERE n > 8),
    k AS MATERIALIZED (SELECT i, j, z FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY root ORDER BY z, i, j) = 1), {_fill_sql('w2', 'UNION SELECT k.i, k.j, k.z FROM k')}
    SELECT w.i, w.j, CAST(CASE WHEN l.i IS NULL THEN w.z ELSE w2.z END AS BIGINT) AS z FROM w JOIN w2 ON w2.i = w.i AND w2.j = w.j LEFT JOIN l ON l.i = w.i AND l.j = w.j""")
def fill_max_size(spark, sf_dir):
    return flow.fill_small_depressions(raster(spark, sf_dir), 8).select("i", "j", F.col("z").cast("long").alias("z"))


@query(f"""WITH {BASE}, h AS (SELECT i, j, z FROM c), b AS (SELECT i, j, MIN((bi - i) * (bi - i) + (bj - j) * (bj - j)) FILTER (WHERE bz > z) AS d2 FROM n GROUP BY i, j),
    o AS (SELECT c.* FROM c JOIN b ON b.i = c.i AND b.j = c.j WHERE b.d2 IS NULL),
    a AS (SELECT o.i, o.j, MIN((h.i - o.i) * (h.i - o.i) + (h.j - o.j) * (h.j - o.j)) AS d2 FROM o JOIN h ON h.z > o.z GROUP BY o.i, o.j),
    s AS (SELECT MAX(i) AS mi, MAX(j) AS mj FROM c), x AS (SELECT c.i, c.j, COALESCE(b.d2, a.d2) AS d2 FROM c LEFT JOIN b ON b.i = c.i AND b.j = c.j LEFT JOIN a ON a.i = c.i AND a.j = c.j)
    SELECT x.i, x.j, ROUND(COALESCE(sqrt(d2), 0.0), 6) AS iso, d2 IS NULL OR LEAST(LEAST(x.i, mi - x.i), LEAST(x.j, mj - x.j)) + 0.5 < sqrt(d2) AS censored FROM x CROSS JOIN s""")
def isolation(spark, sf_dir):
    return terrain.isolation(raster(spark, sf_dir)).select("i", "j", F.round("iso", 6).alias("iso"), "censored")


@query(f"WITH {CELLS} SELECT level, i // CAST(pow(2, level) AS INTEGER) AS bi, j // CAST(pow(2, level) AS INTEGER) AS bj, CAST(MAX(z) AS BIGINT) AS zmax FROM c CROSS JOIN (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS level) AS v GROUP BY 1, 2, 3")
def elevation_pyramid(spark, sf_dir):
    return terrain.elevation_pyramid(raster(spark, sf_dir), 6).select("level", "bi", "bj", F.col("zmax").cast("long").alias("zmax"))


@query()
def prominence(spark, sf_dir):
    return terrain.prominence(raster(spark, sf_dir)).select("i", "j", "prom")


@query()
def prominence_features(spark, sf_dir):
    return terrain.prominence_features(raster(spark, sf_dir)).drop("grid_id")


#: First common cell of each pair of neighbours is the one nearest to the first of them
@query(f"""{TREE}, {_END}, y AS (SELECT n.i, n.j, n.bi, n.bj, MIN(a.dist) AS dist FROM n LEFT JOIN r AS a ON a.i = n.i AND a.j = n.j JOIN r AS b ON b.i = n.bi AND b.j = n.bj AND b.ai = a.ai AND b.aj = a.aj GROUP BY n.i, n.j, n.bi, n.bj)
    SELECT n.i, n.j, ROUND(MAX(COALESCE(y.dist, x.dist)), 6) AS dist FROM n JOIN x ON x.i = n.i AND x.j = n.j LEFT JOIN y ON y.i = n.i AND y.j = n.j AND y.bi = n.bi AND y.bj = n.bj GROUP BY n.i, n.j""")
def dist2conf_max(spark, sf_dir):
    return ridges.dist2conf_max(flow_table(spark, sf_dir)).select("i", "j", F.round("dist", 6).alias("dist"))


@query()
def ridge_dir(spark, sf_dir):
    return ridges.ridgedir(flow_table(spark, sf_dir)).select("i", "j", F.col("code").cast("int").alias("code"))


@query()
def dist2ridge(spark, sf_dir):
    return ridges.dist2ridge(flow_table(spark, sf_dir)).select("i", "j", F.round("dist", 6).alias("dist"))


@query()
def ridge_strahler(spark, sf_dir):
    return ridges.ridge_strahler(flow_table(spark, sf_dir)).select("i", "j", "ord")


#: Selected edges, heads and the ways down from them; v: hi, hj (head), hops, i, j
_ARCS = f"""{_ORDERS}, k AS (SELECT f.i, f.j, w.ord, CASE WHEN t.i IS NULL THEN NULL ELSE f.ti END AS ti, CASE WHEN t.i IS NULL THEN NULL ELSE f.tj END AS tj FROM f JOIN w ON w.i = f.i AND w.j = f.j LEFT JOIN w AS t ON t.i = f.ti AND t.j = f.tj AND t.ord >= 2 WHERE w.ord >= 2),
    b AS (SELECT k.i, k.j, COUNT(a.i) <> 1 OR MAX(a.ord) <> k.ord AS head FROM k LEFT JOIN k AS a ON a.ti = k.i AND a.tj = k.j GROUP BY k.i, k.j, k.ord),
    v AS (SELECT i AS hi, j AS hj, 0 AS hops, i, j, FALSE AS done FROM b WHERE head
    UNION ALL SELECT v.hi, v.hj, v.hops + 1, k.ti, k.tj, b.head FROM v JOIN k ON k.i = v.i AND k.j = v.j JOIN b ON b.i = k.ti AND b.j = k.tj WHERE k.ti IS NOT NULL AND NOT v.done)"""


@query(f"{TREE}, {_ARCS}, z AS (SELECT hi, hj, COUNT(*) AS n FROM v GROUP BY hi, hj HAVING COUNT(*) > 1) SELECT CAST(k.ord AS INTEGER) AS ord, v.hi, v.hj, CAST(v.hops AS INTEGER) AS seq, v.i, v.j FROM v JOIN z USING (hi, hj) JOIN k ON k.i = v.hi AND k.j = v.hj")
def flowgraph_arcs(spark, sf_dir):
    table = flow_table(spark, sf_dir)
    arcs = network.construct_flowgraph(table, durable(metrics.strahler(table)))
    first = F.element_at("path", 1)
    flat = arcs.select("ord", first["i"].alias("hi"), first["j"].alias("hj"), F.posexplode("path").alias("seq", "p"))
    return flat.select("ord", F.col("hi").cast("int").alias("hi"), F.col("hj").cast("int").alias("hj"), "seq", F.col("p.i").cast("int").alias("i"), F.col("p.j").cast("int").alias("j"))


#: A third of the arcs is left out, by the place of their heads: their edges are uncovered
@query(f"{TREE}, {_ARCS} SELECT v.i, v.j, n.i AS i2, n.j AS j2 FROM v JOIN v AS n ON n.hi = v.hi AND n.hj = v.hj AND n.hops = v.hops + 1 WHERE (v.hi + v.hj) % 3 = 0")
def flowgraph_coverage(spark, sf_dir):
    head = F.element_at("path", 1)
    table = flow_table(spark, sf_dir)
    orders = durable(metrics.strahler(table))
    arcs = network.construct_flowgraph(table, orders, check=False)
    arcs = arcs.where((head["i"] + head["j"]) % 3 != 0)
    return network.uncovered_edges(network.selected_cells(table, orders), arcs).select("i", "j", "i2", "j2")


@query(f"WITH {BASE} SELECT i, j, p AS part, CASE p WHEN 0 THEN CAST(i AS DOUBLE) WHEN 1 THEN CAST(ti AS DOUBLE) END AS gi, CASE p WHEN 0 THEN CAST(j AS DOUBLE) WHEN 1 THEN CAST(tj AS DOUBLE) END AS gj FROM f CROSS JOIN (VALUES (0), (1), (2)) AS v(p) WHERE ti IS NOT NULL")
def flowline_segments(spark, sf_dir):
    out = network.flowline_segments(flow_table(spark, sf_dir))
    back = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select(F.col("cid").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("i"), F.shiftright("cid", 31).cast("int").alias("j"), "part", back("gi").alias("gi"), back("gj").alias("gj"))


_VERTS = """v AS (SELECT 'g' || (c_nationkey % 2) AS graph_id, CAST(c_nationkey AS INTEGER) AS arc_id, CAST(c_nationkey % 3 AS INTEGER) AS ord, CAST(c_custkey AS DOUBLE) AS i, CAST(FLOOR(c_acctbal / 1000) AS DOUBLE) AS j,
    ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seq, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"""


def _flat(arcs: DataFrame) -> DataFrame:
    return arcs.select("graph_id", "arc_id", "ord", F.posexplode("path").alias("seq", "p")).select("graph_id", "arc_id", "ord", "seq", "p.i", "p.j")


@query(f"WITH {_VERTS}, a AS (SELECT graph_id, ord, SUM(n) AS vertices, COUNT(*) - 1 AS gaps FROM (SELECT DISTINCT graph_id, ord, arc_id, n FROM v) AS x GROUP BY graph_id, ord) SELECT graph_id, ord, CAST(vertices AS INTEGER) AS vertices, CAST(gaps AS INTEGER) AS gaps FROM a")
def flowgraph_concat(spark, sf_dir):
    joined = network.concat_flowgraph(customer_arcs(spark, sf_dir))
    gaps = F.size(F.filter("path", lambda p: F.isnan(p["i"])))
    return joined.select("graph_id", "ord", (F.size("path") - gaps).alias("vertices"), gaps.alias("gaps"))


@query(f"""WITH {_VERTS}, t AS (SELECT MIN(i) FILTER (WHERE seq > 0 AND seq < n - 1) AS ti, ARG_MIN(j, i) FILTER (WHERE seq > 0 AND seq < n - 1) AS tj FROM v),
    w AS (SELECT v.*, seq > 0 AND seq < n - 1 AND i = ti AND j = tj AS cut FROM v CROSS JOIN t), x AS (SELECT *, SUM(CAST(cut AS INTEGER)) OVER (PARTITION BY graph_id, arc_id ORDER BY seq) AS k FROM w),
    y AS (SELECT graph_id, arc_id, ord, k, i, j, seq FROM x UNION ALL SELECT graph_id, arc_id, ord, k - 1, i, j, seq FROM x WHERE cut)
    SELECT graph_id, ord, i, j, CAST(COUNT(*) OVER (PARTITION BY graph_id, arc_id, k) AS INTEGER) AS len FROM y""")
def insert_endpt(spark, sf_dir):
    arcs = customer_arcs(spark, sf_dir)
    inner = arcs.select(F.explode(F.slice("path", 2, F.size("path") - 2)).alias("p")).orderBy("p.i", "p.j").limit(1).first()
    cut = network.insert_endpt(arcs, inner.p.i, inner.p.j) if inner else arcs
    return cut.select("graph_id", "ord", F.size("path").alias("len"), F.explode("path").alias("p")).select("graph_id", "ord", "p.i", "p.j", "len")


def coarse_arcs(spark, sf_dir, graph: int) -> DataFrame:
    """Arcs of every other nation on a small lattice, so that graphs share vertices."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_nationkey") % 2 == graph)
    point = F.struct("c_custkey", (F.col("c_custkey") % 40).cast("double").alias("i"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("j"))
    grouped = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(point)).alias("v"))
    return grouped.select(F.lit(f"g{graph}").alias("graph_id"), F.col("c_nationkey").cast("int").alias("arc_id"), F.lit(1).alias("ord"), F.transform("v", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"))).alias("path"))


_SHARED = """v AS (SELECT c_nationkey % 2 AS g, c_nationkey AS arc, CAST(c_custkey % 40 AS DOUBLE) AS i, CAST(FLOOR(c_acctbal / 1000) AS DOUBLE) AS j, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    a AS (SELECT g, i, j, COUNT(*) AS n, BOOL_OR(k = 1 OR k = n) AS e FROM v GROUP BY g, i, j),
    o AS (SELECT x.i, x.j, (CASE WHEN x.e THEN 'e' ELSE 'i' END) || (CASE WHEN y.e THEN 'e' ELSE 'i' END) AS kind, x.n AS n1, y.n AS n2 FROM a AS x JOIN a AS y ON x.i = y.i AND x.j = y.j AND x.g = 0 AND y.g = 1)"""


@query(f"WITH {_SHARED} SELECT i, j, kind, n1, n2 FROM o")
def graph_overlaps(spark, sf_dir):
    return network.graph_overlaps(coarse_arcs(spark, sf_dir, 0), coarse_arcs(spark, sf_dir, 1))


@query(f"""WITH {_SHARED}, w AS (SELECT v.g, v.arc, v.i, v.j, v.k, v.k > 1 AND v.k < v.n AND COALESCE(o.kind = 'ii' OR (v.g = 0 AND o.kind = 'ie') OR (v.g = 1 AND o.kind = 'ei'), FALSE) AS cut FROM v LEFT JOIN o ON o.i = v.i AND o.j = v.j),
    x AS (SELECT *, SUM(CAST(cut AS INTEGER)) OVER (PARTITION BY g, arc ORDER BY k) AS piece FROM w), y AS (SELECT g, arc, piece, i, j FROM x UNION ALL SELECT g, arc, piece - 1, i, j FROM x WHERE cut)
    SELECT 'g' || g AS graph_id, i, j, CAST(COUNT(*) OVER (PARTITION BY g, arc, piece) AS INTEGER) AS len FROM y""")
def solve_overlaps(spark, sf_dir):
    a, b = network.solve_graph_overlaps(coarse_arcs(spark, sf_dir, 0), coarse_arcs(spark, sf_dir, 1), allows_arcs_overlap=False)
    both = a.unionByName(b)
    return both.select("graph_id", F.size("path").alias("len"), F.explode("path").alias("p")).select("graph_id", "p.i", "p.j", "len")


@query()
def solve_overlaps_kept(spark, sf_dir):
    a, b = network.solve_graph_overlaps(coarse_arcs(spark, sf_dir, 0), coarse_arcs(spark, sf_dir, 1))
    return _flat(a.unionByName(b))


#: Spans (lo, hi) are halved at their farthest vertex, the first of equal ones, while it is more than 2 away
@query(f"""WITH RECURSIVE {_VERTS}, w AS MATERIALIZED (SELECT * FROM v), k(arc_id, lo, hi) AS (SELECT arc_id, CAST(0 AS BIGINT), n - 1 FROM (SELECT DISTINCT arc_id, n FROM w) AS h
    UNION ALL SELECT m.arc_id, CASE WHEN half = 0 THEN m.lo ELSE m.far END, CASE WHEN half = 0 THEN m.far ELSE m.hi END FROM (SELECT arc_id, lo, hi, ARG_MAX(seq, (d2, -seq)) AS far, MAX(d2) AS d2 FROM
    (SELECT *, (pi - t * vi) * (pi - t * vi) + (pj - t * vj) * (pj - t * vj) AS d2 FROM (SELECT *, CASE WHEN vi * vi + vj * vj = 0 THEN 0 ELSE LEAST(1.0, GREATEST(0.0, (pi * vi + pj * vj) / (vi * vi + vj * vj))) END AS t FROM
    (SELECT k.arc_id, k.lo, k.hi, x.seq, x.i - a.i AS pi, x.j - a.j AS pj, b.i - a.i AS vi, b.j - a.j AS vj FROM k JOIN w AS a ON a.arc_id = k.arc_id AND a.seq = k.lo JOIN w AS b ON b.arc_id = k.arc_id AND b.seq = k.hi JOIN w AS x ON x.arc_id = k.arc_id AND x.seq > k.lo AND x.seq < k.hi) AS y) AS y) AS y
    GROUP BY arc_id, lo, hi) AS m CROSS JOIN (VALUES (0), (1)) AS two(half) WHERE m.d2 > 4.0), g AS (SELECT arc_id, lo AS seq FROM k UNION SELECT arc_id, hi FROM k)
    SELECT graph_id, w.arc_id, ord, CAST(ROW_NUMBER() OVER (PARTITION BY w.arc_id ORDER BY w.seq) - 1 AS INTEGER) AS seq, w.i, w.j FROM w JOIN g ON g.arc_id = w.arc_id AND g.seq = w.seq""")
def rdp_simplify(spark, sf_dir):
    return _flat(network.rdp_simplify(customer_arcs(spark, sf_dir), 2.0).drop("keep"))


@query()
def rdp_topology_safe(spark, sf_dir):
    table = flow_table(spark, sf_dir)
    arcs = network.construct_flowgraph(table, durable(metrics.strahler(table)))
    return _flat(network.simplify_flowgraph(arcs, 1.0).drop("keep"))


def _orient(a: str, b: str, c: str) -> str:
    return f"(({b}1 - {a}1) * ({c}2 - {a}2) - ({b}2 - {a}2) * ({c}1 - {a}1))"


def _on(a: str, b: str, p: str) -> str:
    return f"({_orient(a, b, p)} = 0 AND {p}1 BETWEEN LEAST({a}1, {b}1) AND GREATEST({a}1, {b}1) AND {p}2 BETWEEN LEAST({a}2, {b}2) AND GREATEST({a}2, {b}2))"


def _same(a: str, b: str) -> str:
    return f"({a}1 = {b}1 AND {a}2 = {b}2)"


_BOX = "(LEAST(a1, b1) <= GREATEST(c1, d1) AND LEAST(c1, d1) <= GREATEST(a1, b1) AND LEAST(a2, b2) <= GREATEST(c2, d2) AND LEAST(c2, d2) <= GREATEST(a2, b2))"
_CROSS = f"(SIGN({_orient('a', 'b', 'c')}) * SIGN({_orient('a', 'b', 'd')}) < 0 AND SIGN({_orient('c', 'd', 'a')}) * SIGN({_orient('c', 'd', 'b')}) < 0)"
_ENDS = f"({_same('a', 'c')} OR {_same('a', 'd')} OR {_same('b', 'c')} OR {_same('b', 'd')})"
_IN = lambda p, q, r: f"({_on(p, q, r)} AND NOT {_same(r, p)} AND NOT {_same(r, q)})"
_WITHIN = f"({_IN('a', 'b', 'c')} OR {_IN('a', 'b', 'd')} OR {_IN('c', 'd', 'a')} OR {_IN('c', 'd', 'b')})"
_FLAG = f"""CASE WHEN {_same('a', 'b')} OR {_same('c', 'd')} THEN 5 WHEN NOT {_BOX} THEN -1 WHEN ({_same('a', 'c')} AND {_same('b', 'd')}) OR ({_same('a', 'd')} AND {_same('b', 'c')}) THEN 3 WHEN {_CROSS} THEN 1
    WHEN {_orient('a', 'b', 'c')} = 0 AND {_orient('a', 'b', 'd')} = 0 THEN CASE WHEN {_WITHIN} THEN 2 WHEN {_ENDS} THEN 0 ELSE -1 END WHEN {_ENDS} THEN 0 WHEN {_WITHIN} THEN 4 ELSE -1 END"""


@query(f"""WITH {_VERTS}, s AS (SELECT graph_id, arc_id, seq, i AS px, j AS py, LEAD(i) OVER w AS qx, LEAD(j) OVER w AS qy FROM v WINDOW w AS (PARTITION BY arc_id ORDER BY seq)),
    t AS (SELECT * FROM s WHERE qx IS NOT NULL), m AS (SELECT a.graph_id AS graph_i, b.graph_id AS graph_j, a.arc_id AS iarc, b.arc_id AS jarc, a.seq AS iseg, b.seq AS jseg, a.px AS a1, a.py AS a2, a.qx AS b1, a.qy AS b2, b.px AS c1, b.py AS c2, b.qx AS d1, b.qy AS d2
    FROM t AS a JOIN t AS b ON (a.graph_id, a.arc_id, a.seq) < (b.graph_id, b.arc_id, b.seq) AND a.px <= b.qx AND b.px <= a.qx)
    SELECT graph_i, graph_j, iarc, jarc, CAST(iseg AS INTEGER) AS iseg, CAST(jseg AS INTEGER) AS jseg, CAST({_FLAG} AS INTEGER) AS flag FROM m WHERE {_FLAG} > 0""")
def graph_topology_violations(spark, sf_dir):
    return network.topology_violations(customer_arcs(spark, sf_dir))


_POINTS = """p AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS a1, l_suppkey % 7 AS a2, l_orderkey % 7 AS b1, CAST(l_linenumber AS BIGINT) AS b2, CAST(l_quantity AS BIGINT) % 7 AS c1, l_partkey % 5 AS c2, l_suppkey % 5 AS d1, l_orderkey % 5 AS d2 FROM lineitem)"""


def line_points(spark, sf_dir) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lambda c: F.col(c).cast("long")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return t.select("l_orderkey", "l_linenumber", point(n("l_partkey") % 7, n("l_suppkey") % 7).alias("a"), point(n("l_orderkey") % 7, n("l_linenumber")).alias("b"), point(n("l_quantity") % 7, n("l_partkey") % 5).alias("c"), point(n("l_suppkey") % 5, n("l_orderkey") % 5).alias("d"))


def _geo(name: str, sql: str, column: Callable) -> None:
    def run(spark, sf_dir):
        return line_points(spark, sf_dir).select("l_orderkey", "l_linenumber", column(*(F.col(c) for c in "abcd")).alias("value"))

    run.__name__ = name
    query(f"WITH {_POINTS} SELECT l_orderkey, l_linenumber, {sql} AS value FROM p")(run)


_R = lambda v: f"({v}1 - d1) * ({v}1 - d1) + ({v}2 - d2) * ({v}2 - d2)"
_INCIRCLE = f"({_R('a')}) * ((b1 - d1) * (c2 - d2) - (c1 - d1) * (b2 - d2)) + ({_R('b')}) * ((c1 - d1) * (a2 - d2) - (a1 - d1) * (c2 - d2)) + ({_R('c')}) * ((a1 - d1) * (b2 - d2) - (b1 - d1) * (a2 - d2))"
_geo("geo_orient", f"CAST({_orient('a', 'b', 'c')} AS BIGINT)", lambda a, b, c, d: geo.orient(a, b, c))
_geo("geo_incircle", f"CAST({_INCIRCLE} AS DOUBLE)", geo.incircle)
_geo("geo_on_segment", _on("a", "b", "c"), lambda a, b, c, d: geo.on_segment(a, b, c))
_geo("geo_bbox", _BOX, geo.bboxes_overlap)
_geo("geo_xcross", _CROSS, geo.xcross)
_geo("geo_lines_intersect", f"CAST({_FLAG} AS INTEGER)", geo.lines_intersect)
_geo("geo_distances", "CAST(ABS(a1 - b1) + ABS(a2 - b2) + (a1 - b1) * (a1 - b1) + (a2 - b2) * (a2 - b2) AS BIGINT)", lambda a, b, c, d: geo.dist_l1(a, b) + geo.dist2(a, b))


def customer_points(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_nationkey").cast("string").alias("mesh_id"), F.col("c_custkey").cast("int").alias("vid"), F.col("c_custkey").cast("long").alias("x"), F.floor("c_acctbal").cast("long").alias("y"))


_D2 = lambda v: f"CAST((t.{v}x - p.x) * (t.{v}x - p.x) + (t.{v}y - p.y) * (t.{v}y - p.y) AS HUGEINT)"
_DET = lambda v, w: f"((t.{v}x - p.x) * (t.{w}y - p.y) - (t.{w}x - p.x) * (t.{v}y - p.y))"


#: Every counter-clockwise triangle of a nation's customers whose circle holds no other
@query(f"""WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS mesh_id, CAST(c_custkey AS INTEGER) AS v, CAST(c_custkey AS BIGINT) AS x, CAST(FLOOR(c_acctbal) AS BIGINT) AS y FROM customer),
    t AS MATERIALIZED (SELECT a.mesh_id, a.v AS a, b.v AS b, c.v AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, c.x AS cx, c.y AS cy FROM p AS a JOIN p AS b ON b.mesh_id = a.mesh_id AND b.v > a.v JOIN p AS c ON c.mesh_id = a.mesh_id AND c.v > a.v AND c.v <> b.v WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0),
    g AS (SELECT mesh_id, a, b, c FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.mesh_id = t.mesh_id AND p.v NOT IN (t.a, t.b, t.c) AND {_D2('a')} * {_DET('b', 'c')} + {_D2('b')} * {_DET('c', 'a')} + {_D2('c')} * {_DET('a', 'b')} > 0))
    SELECT mesh_id, CAST(ROW_NUMBER() OVER (PARTITION BY mesh_id ORDER BY a, b, c) - 1 AS INTEGER) AS fid, a, b, c FROM g""")
def delaunay(spark, sf_dir):
    return mesh.triangulate_points(customer_points(spark, sf_dir))


_MESH = """b AS (SELECT CAST(vec_id AS INTEGER) AS i, CAST(ord - 1 AS INTEGER) AS j FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS ord FROM embeddings)),
    p AS (SELECT CAST(i // 20 AS VARCHAR) AS mesh_id, (i % 20) * 64 + j AS vid, i % 20 AS x, j AS y FROM b), t AS (SELECT mesh_id, MAX(x) AS last FROM p GROUP BY mesh_id),
    q AS (SELECT mesh_id, vid FROM p JOIN t USING (mesh_id) WHERE x < last AND y < 63),
    f AS (SELECT mesh_id, ROW_NUMBER() OVER (PARTITION BY mesh_id ORDER BY a, b, c) - 1 AS fid, a, b, c FROM (SELECT mesh_id, vid AS a, vid + 64 AS b, vid + 65 AS c FROM q UNION ALL SELECT mesh_id, vid, vid + 65, vid + 1 FROM q) AS x),
    s AS MATERIALIZED (SELECT mesh_id, fid, 0 AS side, b AS u, c AS v FROM f UNION ALL SELECT mesh_id, fid, 1, c, a FROM f UNION ALL SELECT mesh_id, fid, 2, a, b FROM f)"""


@query(f"""WITH {_MESH} SELECT s.mesh_id, CAST(s.fid AS INTEGER) AS fid, CAST(MAX(CASE WHEN s.side = 0 THEN COALESCE(o.fid, -1) END) AS INTEGER) AS n0, CAST(MAX(CASE WHEN s.side = 1 THEN COALESCE(o.fid, -1) END) AS INTEGER) AS n1, CAST(MAX(CASE WHEN s.side = 2 THEN COALESCE(o.fid, -1) END) AS INTEGER) AS n2
    FROM s LEFT JOIN s AS o ON o.mesh_id = s.mesh_id AND o.u = s.v AND o.v = s.u GROUP BY s.mesh_id, s.fid""")
def facet_neighbours(spark, sf_dir):
    return mesh.facet_neighbours(grid_mesh(spark, sf_dir)[1])


def mesh_segments(spark, sf_dir) -> DataFrame:
    """A segment per customer between two lattice vertices of a band."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    k = F.col("k")
    return c.select((k % 25).cast("string").alias("mesh_id"), k.alias("cid"), ((k % 15) * 64 + k % 50).cast("int").alias("p"), ((k % 15 + 1 + k % 4) * 64 + k % 50 + k % 13 - 6 + 6).cast("int").alias("q"))


_SEGS = "g AS (SELECT CAST(c_custkey % 25 AS VARCHAR) AS mesh_id, c_custkey AS cid, (c_custkey % 15) * 64 + c_custkey % 50 AS p, (c_custkey % 15 + 1 + c_custkey % 4) * 64 + c_custkey % 50 + c_custkey % 13 - 6 + 6 AS q FROM customer)"


@query(f"""WITH {_MESH}, {_SEGS}, e AS MATERIALIZED (SELECT s.mesh_id, s.fid, s.side, s.u, s.v FROM s JOIN s AS o ON o.mesh_id = s.mesh_id AND o.u = s.v AND o.v = s.u WHERE s.fid < o.fid),
    m AS (SELECT e.mesh_id, g.cid, e.fid, e.side, e.u, e.v, e.u // 64 AS a1, e.u % 64 AS a2, e.v // 64 AS b1, e.v % 64 AS b2, g.p // 64 AS c1, g.p % 64 AS c2, g.q // 64 AS d1, g.q % 64 AS d2 FROM e JOIN g ON g.mesh_id = e.mesh_id AND LEAST(e.u // 64, e.v // 64) <= GREATEST(g.p // 64, g.q // 64) AND GREATEST(e.u // 64, e.v // 64) >= LEAST(g.p // 64, g.q // 64))
    SELECT mesh_id, cid, CAST(fid AS INTEGER) AS fid, CAST(side AS INTEGER) AS side, CAST(LEAST(u, v) AS INTEGER) AS u, CAST(GREATEST(u, v) AS INTEGER) AS v FROM m WHERE {_CROSS}""")
def crossing_edges(spark, sf_dir):
    verts, faces = grid_mesh(spark, sf_dir)
    return mesh.crossing_edges(verts, durable(faces), mesh_segments(spark, sf_dir))


@query(f"""WITH {_MESH}, {_SEGS}, h AS (SELECT DISTINCT mesh_id, LEAST(u, v) AS u, GREATEST(u, v) AS v FROM s)
    SELECT g.mesh_id, g.cid, CAST(g.p AS INTEGER) AS u, CAST(g.q AS INTEGER) AS v, h.u IS NOT NULL AS present FROM g LEFT JOIN h ON h.mesh_id = g.mesh_id AND h.u = LEAST(g.p, g.q) AND h.v = GREATEST(g.p, g.q)""")
def existing_constraints(spark, sf_dir):
    _, faces = grid_mesh(spark, sf_dir)
    edges = mesh_segments(spark, sf_dir).select("mesh_id", "cid", F.col("p").alias("u"), F.col("q").alias("v"))
    return mesh.existing_constraints(faces, edges).select("mesh_id", "cid", "u", "v", "present")


@query()
def cdt_recover(spark, sf_dir):
    """The chain of a nation's customers, recovered in its triangulation: it runs forward in x, so it doesn't cross itself."""
    points = customer_points(spark, sf_dir)
    w = W.partitionBy("mesh_id").orderBy("vid")
    chain = points.select("mesh_id", F.col("vid").alias("u"), F.lead("vid").over(w).alias("v")).where("v is not null")
    edges = chain.select("mesh_id", F.row_number().over(W.partitionBy("mesh_id").orderBy("u")).alias("cid"), "u", "v")
    return mesh.recover_constraints(points, durable(mesh.triangulate_points(points)), edges)


def constraint_inputs(spark, sf_dir):
    table = flow_table(spark, sf_dir)
    arcs = network.construct_flowgraph(table, durable(metrics.strahler(table)))
    kinds = spark.createDataFrame([("g", mesh.VALLEY)], "graph_id string, kind int")
    shape = grid.shapes(table).first()
    return durable(arcs), kinds, (shape.nrows, shape.ncols)


@query()
def constraint_edges(spark, sf_dir):
    arcs, kinds, shape = constraint_inputs(spark, sf_dir)
    verts, edges = mesh.constraint_graph(arcs, kinds, shape)
    a = verts.select(F.col("vid").alias("u"), F.col("i").alias("ui"), F.col("j").alias("uj"))
    b = verts.select(F.col("vid").alias("v"), F.col("i").alias("vi"), F.col("j").alias("vj"))
    return edges.join(a, "u").join(b, "v").select("ui", "uj", "vi", "vj", "kinds")


@query()
def constraint_validate(spark, sf_dir):
    arcs, kinds, shape = constraint_inputs(spark, sf_dir)
    verts, edges = mesh.constraint_graph(arcs, kinds, shape)
    return mesh.validate_constraints(durable(verts), durable(edges), shape)


def _ramp_sql(name: str, low: float, high: float) -> str:
    stops = colours.PALETTES[name]
    table = lambda n: "[" + ", ".join(repr(float(s[n])) for s in stops) + "]"
    rows = ", ".join(f"ROUND({table(n)}[k + 1] + ({table(n)}[k + 2] - {table(n)}[k + 1]) * (x - k), 6) AS {c}" for n, c in enumerate("rgb"))
    return f"""WITH {CELLS}, a AS (SELECT i, j, LEAST(FLOOR(GREATEST(0.0, LEAST(1.0, (z - {low}) / ({high} - ({low})))) * 256), 255) / 255 * 5 AS x FROM c), b AS (SELECT i, j, x, CAST(LEAST(FLOOR(x), 4) AS INTEGER) AS k FROM a) SELECT i, j, {rows} FROM b"""


@query(_ramp_sql("light_terrain", -3000.0, 3000.0))
def colormap_apply(spark, sf_dir):
    rgb = colours.colour(F.col("z"), -3000.0, 3000.0)
    return raster(spark, sf_dir).select("i", "j", *(F.round(c, 6).alias(n) for n, c in rgb.items()))
