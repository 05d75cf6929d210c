"""Flow-graph networks: arcs from flow directions, edits, overlaps, simplification, topology checks.

arcs: graph_id string, arc_id int, ord int, path array<struct<i:double,j:double>>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as geo
from ..plans.iterate import descend, durable, ranked
from .errors import ArcRangeError, FlowCycleError, IncompleteFlowGraphError

IJ = ("i", "j")


def selected_cells(flow: DataFrame, orders: DataFrame, min_order: int = 2) -> DataFrame:
    """Valid cells of at least ``min_order`` with ds (null unless selected too) and ord."""
    o = orders.select("grid_id", "cid", "ord")
    chosen = flow.where("valid").join(o, ["grid_id", "cid"]).where(F.col("ord") >= min_order).select("grid_id", "i", "j", "cid", "ds", "ord")
    target = chosen.select("grid_id", F.col("cid").alias("ds"), F.lit(True).alias("_t"))
    return chosen.join(target, ["grid_id", "ds"], "left").withColumn("ds", F.when(F.col("_t"), F.col("ds"))).drop("_t")


def construct_flowgraph(flow: DataFrame, orders: DataFrame, min_order: int = 2, preserve_junctions: bool = True, check: bool = True) -> DataFrame:
    """Arcs along the selected cells, broken where the order changes and, if asked, at junctions.

    A cell carries on the arc of its only feeder (the one of its own order); any other cell
    heads an arc. Following these links back to the heads by pointer doubling numbers every
    cell of an arc at once; the cell an arc ends in is added by the last edge.
    """
    cells = durable(selected_cells(flow, orders, min_order))
    edges = cells.where("ds is not null").select("grid_id", F.col("ds").alias("cid"), F.col("cid").alias("src"), F.col("ord").alias("src_ord"))
    fed = edges.groupBy("grid_id", "cid").agg(F.count("*").alias("n"), F.collect_list(F.struct("src_ord", "src")).alias("feeders"))  # at most 8 feeders
    own = F.filter("feeders", lambda x: x["src_ord"] == F.col("ord"))
    goes_on = (F.col("n") == 1) if preserve_junctions else F.lit(True)
    linked = cells.join(fed, ["grid_id", "cid"], "left").withColumn("pred", F.when(goes_on & (F.size(own) == 1), F.element_at(own, 1)["src"]))
    linked = durable(linked.select("grid_id", "cid", "i", "j", "ord", "ds", "pred"))
    heads = durable(descend(linked.select("grid_id", "cid", F.col("pred").alias("ds")), ["grid_id"], F.lit(1.0)))
    if check:
        loops = heads.where("root is null").join(cells, ["grid_id", "cid"]).select("i", "j").limit(20).collect()
        if loops:
            raise FlowCycleError([tuple(r) for r in loops])
    chain = linked.join(heads.select("grid_id", "cid", "root", "hops"), ["grid_id", "cid"])
    inner = chain.select("grid_id", "root", "hops", "i", "j")
    after = linked.select("grid_id", F.col("cid").alias("ds"), F.col("i").alias("i2"), F.col("j").alias("j2"), "pred")
    last = chain.drop("pred").where("ds is not null").join(after, ["grid_id", "ds"]).where("pred is null or pred <> cid").select("grid_id", "root", (F.col("hops") + 1).alias("hops"), F.col("i2").alias("i"), F.col("j2").alias("j"))
    vertex = F.struct("hops", F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"))
    paths = inner.unionByName(last).groupBy("grid_id", "root").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    head_order = linked.select("grid_id", F.col("cid").alias("root"), "ord")
    arcs = paths.where(F.size("v") > 1).join(head_order, ["grid_id", "root"])
    arcs = arcs.select(F.col("grid_id").alias("graph_id"), "ord", F.transform("v", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))).alias("path"), "root", F.size("v").alias("len"))
    out = ranked(arcs, ["graph_id"], ["ord", "len", "root"], "n").select("graph_id", (F.col("n") - 1).alias("arc_id"), "ord", "path")
    if check:
        missing = uncovered_edges(cells, out).limit(20).collect()
        if missing:
            raise IncompleteFlowGraphError([tuple(r) for r in missing])
    return out


def segments(arcs: DataFrame) -> DataFrame:
    """graph_id, arc_id, seq, a, b: consecutive vertices of each arc."""
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))
    return arcs.where(F.size("path") > 1).select("graph_id", "arc_id", F.posexplode(pairs).alias("seq", "s")).select("graph_id", "arc_id", "seq", "s.a", "s.b")


def uncovered_edges(cells: DataFrame, arcs: DataFrame) -> DataFrame:
    """Flow edges between selected cells that no arc holds."""
    target = cells.select("grid_id", F.col("cid").alias("ds"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    edges = cells.where("ds is not null").join(target, ["grid_id", "ds"]).select(F.col("grid_id").alias("graph_id"), "i", "j", "i2", "j2")
    held = segments(arcs).select("graph_id", F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.col("b.i").alias("i2"), F.col("b.j").alias("j2"))
    return edges.join(held, ["graph_id", "i", "j", "i2", "j2"], "left_anti")


def flowline_segments(flow: DataFrame) -> DataFrame:
    """grid_id, cid, part, gi, gj: each flow edge as cell, downstream cell and a NaN separator."""
    nan = F.lit(float("nan"))
    di, dj = F.col("ds").bitwiseAND(F.lit((1 << 31) - 1)).cast("double"), F.shiftright("ds", 31).cast("double")
    point = lambda a, b: F.struct(a.alias("gi"), b.alias("gj"))
    triple = F.array(point(F.col("i").cast("double"), F.col("j").cast("double")), point(di, dj), point(nan, nan))
    return flow.where("valid and ds is not null").select("grid_id", "cid", F.posexplode(triple).alias("part", "p")).select("grid_id", "cid", "part", "p.gi", "p.gj")


def concat_flowgraph(arcs: DataFrame) -> DataFrame:
    """One path per graph and order: its arcs in order, with a NaN vertex between two."""
    nan = F.lit(float("nan"))
    gap = F.array(F.struct(nan.alias("i"), nan.alias("j")))
    grouped = arcs.groupBy("graph_id", "ord").agg(F.array_sort(F.collect_list(F.struct("arc_id", "path"))).alias("a"))
    joined = F.flatten(F.transform("a", lambda x, n: F.when(n == 0, x["path"]).otherwise(F.concat(gap, x["path"]))))
    return grouped.select("graph_id", "ord", joined.alias("path"))


def arcs_from_arrays(spark, orders: list[int], vtxs: list[tuple[float, float]], endpts: list[tuple[int, int]], graph_id: str = "g") -> DataFrame:
    """Arcs from the flat model: vertices and inclusive ranges."""
    for a, b in endpts:
        if not 0 <= a <= b < len(vtxs):
            raise ArcRangeError(f"vertex range ({a}, {b}) of {len(vtxs)} vertices")
    rows = [(graph_id, n, o, [(float(i), float(j)) for i, j in vtxs[a : b + 1]]) for n, (o, (a, b)) in enumerate(zip(orders, endpts))]
    return spark.createDataFrame(rows, "graph_id string, arc_id int, ord int, path array<struct<i:double,j:double>>")


def flat_model(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: graph_id, vid, i, j; ranges: graph_id, arc_id, ord, first, last), without unused vertices."""
    before = F.coalesce(F.sum(F.size("path")).over(W.partitionBy("graph_id").orderBy("arc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = arcs.withColumn("first", before)
    ranges = placed.select("graph_id", "arc_id", "ord", "first", (F.col("first") + F.size("path") - 1).alias("last"))
    vertices = placed.select("graph_id", "first", F.posexplode("path").alias("n", "p")).select("graph_id", (F.col("first") + F.col("n")).alias("vid"), "p.i", "p.j")
    return vertices, ranges


def renumber(arcs: DataFrame, *order: Column | str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("graph_id").orderBy(*order)) - 1
    return arcs.withColumn("_n", number).select("graph_id", F.col("_n").alias("arc_id"), "ord", "path")


def split_where(arcs: DataFrame, at: Column) -> DataFrame:
    """Cut each arc at the positions (from 1) in ``at``; ends are ignored. Later pieces are numbered after all arcs."""
    n = F.size("path")
    inner = F.filter(F.array_sort(F.array_distinct(at)), lambda p: (p > 1) & (p < n))
    bounds = F.concat(F.array(F.lit(1)), inner, F.array(n))
    cut = arcs.withColumn("_b", bounds)
    pieces = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda k: F.slice("path", F.get(F.col("_b"), k - 1), F.get(F.col("_b"), k) - F.get(F.col("_b"), k - 1) + 1))
    out = cut.select("graph_id", "arc_id", "ord", F.posexplode(pieces).alias("_k", "path"))
    return renumber(out, F.col("_k") > 0, "arc_id", "_k")


def insert_endpt(arcs: DataFrame, i: float, j: float) -> DataFrame:
    """Split every arc at every interior occurrence of the vertex; arcs without it stay."""
    where = F.filter(F.transform("path", lambda p, n: F.when((p["i"] == i) & (p["j"] == j), n + 1)), lambda x: x.isNotNull())
    return split_where(arcs, where)


def vertex_roles(arcs: DataFrame) -> DataFrame:
    """graph_id, i, j, n (occurrences), is_end: whether any occurrence is an end."""
    v = arcs.select("graph_id", F.size("path").alias("len"), F.posexplode("path").alias("n", "p"))
    end = (F.col("n") == 0) | (F.col("n") == F.col("len") - 1)
    return v.groupBy("graph_id", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").alias("n"), F.max(end).alias("is_end"))


def graph_overlaps(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """i, j, kind (ee, ii, ie, ei), n1, n2: vertices that both graphs have, by role in each."""
    a = vertex_roles(g1).select("i", "j", F.col("n").alias("n1"), F.col("is_end").alias("e1"))
    b = vertex_roles(g2).select("i", "j", F.col("n").alias("n2"), F.col("is_end").alias("e2"))
    role = lambda e: F.when(F.col(e), "e").otherwise("i")
    return a.join(b, ["i", "j"]).select("i", "j", F.concat(role("e1"), role("e2")).alias("kind"), "n1", "n2")


def solve_graph_overlaps(g1: DataFrame, g2: DataFrame, allows_arcs_overlap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both graphs, split so that shared vertices are ends in both.

    With ``allows_arcs_overlap`` a vertex inside a shared run, one with shared vertices on
    both sides wherever it occurs in either graph, is left whole.
    """
    shared = durable(graph_overlaps(g1, g2))
    kind = F.col("kind")
    context = (kind == "ii") | ((kind == "ee") & (F.col("n1") > 1) & (F.col("n2") > 1)) | ((kind == "ei") & (F.col("n1") > 1)) | ((kind == "ie") & (F.col("n2") > 1))
    marked = shared.select("i", "j", "kind", context.alias("ctx"))

    def runs(g: DataFrame) -> DataFrame:
        v = g.select("graph_id", "arc_id", F.posexplode("path").alias("n", "p")).select("graph_id", "arc_id", "n", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
        m = v.join(marked, ["i", "j"], "left")
        w = W.partitionBy("graph_id", "arc_id").orderBy("n")
        ctx = F.coalesce("ctx", F.lit(False))
        both = F.coalesce(F.lag(ctx).over(w), F.lit(False)) & F.coalesce(F.lead(ctx).over(w), F.lit(False))
        return m.withColumn("both", both).where("kind = 'ii'").groupBy("i", "j").agg(F.min("both").alias("both"))

    if allows_arcs_overlap:
        inside = runs(g1).join(runs(g2).withColumnRenamed("both", "both2"), ["i", "j"]).where("both and both2").select("i", "j", F.lit(True).alias("keep"))
        split = shared.join(inside, ["i", "j"], "left").where("keep is null")
    else:
        split = shared
    split = durable(split.where("kind <> 'ee'").select("i", "j", "kind"))

    def cut(g: DataFrame, kinds: tuple[str, str]) -> DataFrame:
        v = g.select("graph_id", "arc_id", F.posexplode("path").alias("n", "p")).select("graph_id", "arc_id", "n", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
        at = v.join(split.where(F.col("kind").isin(*kinds)).select("i", "j"), ["i", "j"]).groupBy("graph_id", "arc_id").agg(F.collect_list(F.col("n") + 1).alias("at"))
        return split_where(g.join(at, ["graph_id", "arc_id"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>"))), F.col("at"))

    return cut(g1, ("ii", "ie")), cut(g2, ("ii", "ei"))


def topology_violations(arcs: DataFrame, bucket: float | None = None) -> DataFrame:
    """graph_i, graph_j, iarc, jarc, iseg, jseg, flag of segment pairs that meet otherwise than in shared ends.

    Segments go to every square bucket that their bounding box touches and meet there; a pair
    is judged in one bucket alone, that of the lower corner of the boxes' intersection, so
    no distinct is needed.
    """
    s = segments(arcs)
    lo, hi = (lambda c, f=f: f(F.col(f"a.{c}"), F.col(f"b.{c}")) for f in (F.least, F.greatest))
    s = durable(s.select("*", lo("i").alias("i0"), hi("i").alias("i1"), lo("j").alias("j0"), hi("j").alias("j1")))
    if bucket is None:
        mean = s.agg(F.avg(F.greatest(F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0"))).alias("m")).first().m
        bucket = max(2.0 * (mean or 1.0), 1e-9)
    cell = lambda c: F.floor(F.col(c) / bucket)
    spread = s.withColumn("bi", F.explode(F.sequence(cell("i0"), cell("i1")))).withColumn("bj", F.explode(F.sequence(cell("j0"), cell("j1"))))
    left = spread.select("bi", "bj", *(F.col(c).alias(f"l_{c}") for c in ("graph_id", "arc_id", "seq", "a", "b", "i0", "i1", "j0", "j1")))
    right = spread.select("bi", "bj", *(F.col(c).alias(f"r_{c}") for c in ("graph_id", "arc_id", "seq", "a", "b", "i0", "i1", "j0", "j1")))
    ordered = F.struct("l_graph_id", "l_arc_id", "l_seq") < F.struct("r_graph_id", "r_arc_id", "r_seq")
    boxes = (F.col("l_i0") <= F.col("r_i1")) & (F.col("r_i0") <= F.col("l_i1")) & (F.col("l_j0") <= F.col("r_j1")) & (F.col("r_j0") <= F.col("l_j1"))
    home = (F.floor(F.greatest("l_i0", "r_i0") / bucket) == F.col("bi")) & (F.floor(F.greatest("l_j0", "r_j0") / bucket) == F.col("bj"))
    flag = geo.lines_intersect(F.col("l_a"), F.col("l_b"), F.col("r_a"), F.col("r_b"), IJ)
    met = left.join(right, ["bi", "bj"]).where(ordered & boxes & home).withColumn("flag", flag).where("flag > 0")
    return met.select(F.col("l_graph_id").alias("graph_i"), F.col("r_graph_id").alias("graph_j"), F.col("l_arc_id").alias("iarc"), F.col("r_arc_id").alias("jarc"), F.col("l_seq").alias("iseg"), F.col("r_seq").alias("jseg"), "flag")


def without_shared_arcs(violations: DataFrame, arcs: DataFrame) -> DataFrame:
    """Violations but those between arcs of two graphs that are the same line, forward or reversed."""
    p = arcs.select("graph_id", "arc_id", F.when(F.col("path") <= F.reverse("path"), F.col("path")).otherwise(F.reverse("path")).alias("line"))
    p = p.select("graph_id", "arc_id", F.sha2(F.to_json("line"), 256).alias("line"))
    a = p.select(F.col("graph_id").alias("graph_i"), F.col("arc_id").alias("iarc"), F.col("line").alias("line_i"))
    b = p.select(F.col("graph_id").alias("graph_j"), F.col("arc_id").alias("jarc"), F.col("line").alias("line_j"))
    return violations.join(a, ["graph_i", "iarc"]).join(b, ["graph_j", "jarc"]).where("not (graph_i <> graph_j and line_i = line_j)").select(violations.columns)


def rdp_keep(points: np.ndarray, tol: float) -> np.ndarray:
    """Flags of the vertices that Ramer-Douglas-Peucker keeps; distances to the closed segment."""
    keep = np.zeros(len(points), bool)
    if not len(points):
        return keep
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, v = points[a + 1 : b] - points[a], points[b] - points[a]
        n = float(v @ v)
        t = np.clip(p @ v / n, 0, 1) if n else np.zeros(len(p))
        d2 = ((p - t[:, None] * v) ** 2).sum(1)
        k = int(d2.argmax())  # the first of equal ones
        if d2[k] > tol * tol:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def rdp_simplify(arcs: DataFrame, tol: float | Column = 1.0) -> DataFrame:
    """The arcs with ``keep`` (array<boolean>) and the simplified ``path``; arcs are independent, so no shuffle."""
    work = arcs.select("graph_id", "arc_id", "ord", F.col("path.i").alias("is"), F.col("path.j").alias("js"), (tol if isinstance(tol, Column) else F.lit(float(tol))).cast("double").alias("tol"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [rdp_keep(np.stack([np.asarray(i, float), np.asarray(j, float)], 1), t) for i, j, t in zip(pdf["is"], pdf["js"], pdf.tol)]
            yield pdf[["graph_id", "arc_id"]].assign(keep=keep, **{"ord": pdf["ord"], "is": pdf["is"], "js": pdf["js"]})

    out = work.mapInPandas(run, "graph_id string, arc_id int, keep array<boolean>, ord int, `is` array<double>, js array<double>")
    kept = F.filter(F.arrays_zip(F.col("is").alias("i"), F.col("js").alias("j"), F.col("keep").alias("k")), lambda x: x["k"])
    return out.select("graph_id", "arc_id", "ord", F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))).alias("path"), "keep")


def simplify_flowgraph(arcs: DataFrame, tol: float = 1.0, check_topology: bool = True, rounds: int = 4) -> DataFrame:
    """Simplified arcs with ``keep``; several graphs at once by graph_id.

    With ``check_topology`` arcs in a violation (but of lines that two graphs share) are done
    again with half the tolerance, up to ``rounds`` times, and at last restored whole.
    """
    source = durable(arcs)
    done = durable(rdp_simplify(source, tol))
    if not check_topology:
        return done
    whole = source.withColumn("keep", F.transform("path", lambda _: F.lit(True)))
    for r in range(1, rounds + 2):
        bad = durable(without_shared_arcs(topology_violations(done), done))
        if bad.isEmpty():
            break
        hit = bad.select(F.col("graph_i").alias("graph_id"), F.col("iarc").alias("arc_id")).union(bad.select("graph_j", "jarc")).distinct()
        redo = source.join(hit, ["graph_id", "arc_id"], "left_semi")
        again = rdp_simplify(redo, tol / 2**r) if r <= rounds else whole.join(hit, ["graph_id", "arc_id"], "left_semi")
        done = durable(done.join(hit, ["graph_id", "arc_id"], "left_anti").unionByName(again.select(done.columns)))
    return done


class FlowGraph:
    """A set of arcs with the edits as methods; each returns a new graph."""

    def __init__(self, arcs: DataFrame):
        self.arcs = arcs

    def concat(self) -> DataFrame:
        return concat_flowgraph(self.arcs)

    def simplify(self, tol: float = 1.0, check_topology: bool = True) -> FlowGraph:
        return FlowGraph(simplify_flowgraph(self.arcs, tol, check_topology).drop("keep"))

    def insert_endpt(self, i: float, j: float) -> FlowGraph:
        return FlowGraph(insert_endpt(self.arcs, i, j))

    def violations(self) -> DataFrame:
        return topology_violations(self.arcs)

    def to_lines(self, limit: int = 10_000) -> list[tuple[int, list[tuple[float, float]]]]:
        """(order, points) of all arcs, for plotting; an error if there are more than ``limit``."""
        rows = self.arcs.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} arcs: choose some of them, or raise the limit")
        return [(r.ord, [(p.i, p.j) for p in r.path]) for r in rows]
