"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of vectors (in hash order of their ids) gives a neighbour graph, which is
   cut into balanced parts: median bisection along principal directions, then moves that
   reduce cut edges within a capacity.
2. A small network learns to predict the parts of a vector's neighbours.
3. Every row of the index goes to its most probable part; a query goes to its several most
   probable parts, as many as reached ``aim`` recall for sample vectors kept from training.
4. Queries and index rows meet in blocks of bounded size per part and are reranked exactly.

There are ``least_parts`` parts from ``least_parts * least_sample`` rows on, and more as the rows
grow, so work is in proportion to them up to ``max_parts * rows_per_part`` rows; beyond that
the parts grow. Equal vectors are indexed by their k + 1 smallest ids:
no other copy can be among the k nearest.

Cases: null vectors and ids, zero vectors and vectors holding nulls or non-finite numbers
take no part; vectors of other dimensions than the commonest are compared with those of their
own dimension, all with all in blocks; ties go to the smaller id; repeated rows
count once, an id with several vectors by its nearest one; rows that share a query's id are
its own; with fewer candidates than k all are returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    rows_per_part: int = 2000
    least_parts: int = 8
    max_parts: int = 1024
    least_sample: int = 24
    sample_per_part: int = 160
    max_sample: int = 32_768
    graph_degree: int = 10
    hidden: int = 128
    epochs: int = 14
    aim: float = 0.95
    index_block: int = 8192
    query_block: int = 2048


@dataclass(frozen=True)
class Router:
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    parts: int
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = x
        for i, (w, b) in enumerate(self.layers):
            h = h @ w + b
            if i + 1 < len(self.layers):
                h = np.maximum(h, 0)
        return h if self.layers else np.zeros((len(x), 1))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part, repeated rows once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def unit(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that tiny and huge components neither vanish nor overflow."""
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others by cosine, for unit rows; block by block."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[lo : lo + 1024] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """A part for each node, none larger than ``slack`` times the mean, with few cut edges."""
    label = np.zeros(len(x), np.int64)

    def bisect(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        low = n // 2
        c = x[rows] - x[rows].mean(0)
        v = np.linalg.eigh(c.T @ c)[1][:, -1]
        order = rows[np.argsort(c @ v, kind="stable")]
        cut = len(rows) * low // n
        bisect(order[:cut], first, low)
        bisect(order[cut:], first + low, n - low)

    bisect(np.arange(len(x)), 0, parts)
    room = int(np.ceil(slack * len(x) / parts))
    sizes = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        near = label[graph]
        for i in np.nonzero((near != label[:, None]).sum(1) * 2 > graph.shape[1])[0]:
            votes = np.bincount(label[graph[i]], minlength=parts)
            to = int(votes.argmax())
            if votes[to] > votes[label[i]] and sizes[to] < room:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if moved < len(x) // 500:
            break
    return label


def fit_router(x: np.ndarray, parts: int, p: AnnParams) -> Router:
    """Partition the sample's graph, train the classifier on its neighbours' parts, set the probes.

    Every sixth vector is kept from training: the probes are as many as put ``aim`` of the
    kept vectors' true neighbours into the parts searched.
    """
    if parts < 2 or len(x) < 4 * parts:
        return Router((), 1, 1)
    x = unit(x).astype(np.float32)
    kept, x = x[::6], x[np.arange(len(x)) % 6 > 0]
    graph = knn_graph(x, p.graph_degree)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    np.add.at(target, (np.arange(len(x)), label), 2.0)
    target /= target.sum(1, keepdims=True)
    rng = np.random.default_rng(7)
    sizes = [x.shape[1], p.hidden, parts]
    w = [rng.normal(0, (2 / a) ** 0.5, (a, b)).astype(np.float32) for a, b in zip(sizes, sizes[1:])]
    w = [w[0], np.zeros(sizes[1], np.float32), w[1], np.zeros(sizes[2], np.float32)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(p.epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = order[lo : lo + 256]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 0.004 * (1 - epoch / p.epochs * 0.8) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(((w[0], w[1]), (w[2], w[3])), parts, 1)
    home = router.scores(x).argmax(1)
    hits = np.zeros(parts, np.int64)  # neighbours found in the n-th most probable part
    for lo in range(0, len(kept), 1024):
        q = kept[lo : lo + 1024]
        near = np.argpartition(-(q @ x.T), min(p.k, len(x)) - 1, axis=1)[:, : p.k]
        at = np.argsort(-router.scores(q), axis=1, kind="stable").argsort(1)
        hits += np.bincount(np.take_along_axis(at, home[near], 1).ravel(), minlength=parts)
    found = np.cumsum(hits) / max(hits.sum(), 1)
    return Router(router.layers, parts, int(min(np.searchsorted(found, p.aim) + 1, parts)))


def _rows(b: pa.RecordBatch) -> np.ndarray:
    col = b.column("v")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def route(rows: DataFrame, router: Router, need: np.ndarray | None, least: int) -> DataFrame:
    """(vec_id, v, part): the best part, or with ``need`` (rows per part) the parts to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            scores = router.scores(unit(_rows(b)).astype(np.float32))
            if need is None:
                i, part = np.arange(b.num_rows), scores.argmax(1)
            else:
                order = np.argsort(-scores, axis=1, kind="stable")
                seen = np.cumsum(need[order], axis=1) - need[order]
                take = (np.arange(router.parts)[None, :] < router.probes) | (seen < least)
                i, j = np.nonzero(take)
                part = order[i, j]
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, part int")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q and each row, in double precision, the same for equal rows wherever they stand."""
    big, tops = np.abs(q).max(), np.abs(x).max(1)
    if len(x) and not (1e-100 < big < 1e100 and 1e-100 < tops.min() and tops.max() < 1e100):  # squares would vanish or overflow
        q, x = q / big, x / tops[:, None]
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def nearest_in_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k nearest ids of the block for each query; exact scores, that of an id's nearest vector, ties to the smaller id."""
    order = np.argsort(xid, kind="stable")
    xid, x = xid[order], x[order]
    first = np.nonzero(np.r_[True, xid[1:] != xid[:-1]])[0]  # of each id
    rough = unit(q) @ unit(x).T
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for i in range(len(q)):
        s = np.where(xid == qid[i], -9.0, rough[i])
        ids = s if len(first) == len(s) else np.maximum.reduceat(s, first)
        kth = np.partition(ids, len(ids) - k)[len(ids) - k] if len(ids) > k else -8.0
        at = np.nonzero((s >= kth - 1e-9) & (s > -8))[0]
        exact = cosines(q[i], x[at])
        best = np.lexsort((xid[at], -exact))
        best = best[np.sort(np.unique(xid[at][best], return_index=True)[1])[:k]]
        out[0].extend([int(qid[i])] * len(best))
        out[1].extend(xid[at][best].tolist())
        out[2].extend(exact[best].tolist())
    return out


def nearest(vectors: DataFrame, is_query: Column, p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``is_query`` (on vec_id) selects."""
    every = durable(usable(vectors))
    dims = every.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    main = dims[0].d if dims else 0
    rows, n = every.where(F.size("v") == main), dims[0]["count"] if dims else 0
    parts = int(min(p.max_parts, max(p.least_parts, -(-n // p.rows_per_part))))
    parts = parts if n >= parts * p.least_sample else 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(p.max_sample, max(4096, parts * p.sample_per_part))).collect() if parts > 1 else []
    router = fit_router(np.array([r.v for r in sample]), parts, p) if sample else Router((), 1, 1)
    # of equal vectors only the smallest ids can be among the nearest, one more for the query's own
    copies = W.partitionBy("v").orderBy("vec_id")
    indexed = every.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= p.k + 1).drop("copy")
    index = durable(route(indexed.where(F.size("v") == main), router, None, 0))
    sizes = np.zeros(router.parts, np.int64)
    for r in index.groupBy("part").count().collect():  # at most max_parts rows
        sizes[r.part] = r["count"]
    queries = durable(route(rows.where(is_query), router, sizes, 8 * p.k))
    asked = np.zeros(router.parts, np.int64)
    for r in queries.groupBy("part").count().collect():
        asked[r.part] = r["count"]
    blocks = lambda counts, size: F.array(*(F.lit(max(1, -(-int(c) // size))) for c in counts))
    n_index, n_query = F.get(blocks(sizes, p.index_block), F.col("part")), F.get(blocks(asked, p.query_block), F.col("part"))
    spread = lambda df, own, other, mine, theirs: df.withColumn(mine, F.pmod(F.xxhash64("vec_id"), own).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))
    left = spread(queries, n_query, n_index, "qb", "xb")
    right = spread(index, n_index, n_query, "xb", "qb")
    if not every.where(F.size("v") != main).isEmpty():
        # the rarer dimensions, each a part of its own with a negative number
        odd = F.size("v") != main
        count = lambda df, name: df.groupBy("part").agg(F.count("*").alias(name))
        asks, holds = (df.where(odd).select("vec_id", "v", (-F.size("v")).alias("part")) for df in (every.where(is_query), indexed))
        met = count(asks, "nq").join(count(holds, "nx"), "part")
        n_q, n_x = F.ceil(F.col("nq") / p.query_block).cast("int"), F.ceil(F.col("nx") / p.index_block).cast("int")
        cols = ["vec_id", "v", "part", "qb", "xb"]
        left = left.select(cols).union(spread(asks.join(met, "part"), n_q, n_x, "qb", "xb").select(cols))
        right = right.select(cols).union(spread(holds.join(met, "part"), n_x, n_q, "xb", "qb").select(cols))
    k = p.k

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not x.num_rows:
            return schema.empty_table()
        arrays = [a for t in (q, x) for a in (t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))]
        cols = nearest_in_block(*arrays, k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    cell = ["part", "qb", "xb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score double")
    # an id with several vectors must not fill two ranks
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
