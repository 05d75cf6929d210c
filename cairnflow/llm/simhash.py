"""SimHash near-duplicates: exact links at a small Hamming radius by bit-sliced comparison.

Fingerprints are 64-bit majority votes over hashed word shingles. Equal fingerprints are one
class. Distinct fingerprints meet in buckets: with ``radius`` 2 and four 16-bit blocks, two
blocks of linked fingerprints are equal, so the six pairs of blocks give every link. A
bucket's fingerprints are compared as vertical bit planes: one XOR and a carry-save add per
plane update the distances to 64 fingerprints per word. The planes that tell most come first,
and a block of 64 by 64 is abandoned once all its counters exceed the radius. A bucket above ``tile`` rows is cut into tiles and compared tile
by tile, so no task holds more than two; within a tile only a spanning forest of the links
is emitted.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; repeated rows and ids share a class; null ids
get a class but can't name one (component null only if no id of the class is known); an
empty table gives an empty result; extra columns are ignored, and kept by ``keep_one`` under
any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fields, free_name, quoted
from .components import connected_components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 3
    seed: int = 42
    radius: int = 2
    blocks: int = 4
    tile: int = 4096


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = WORDS(text.lower())  # bytes.lower changes A-Z alone
    if not words:
        return 0
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    # a long text goes by in pieces: 64 counters, whatever its length
    counts, total = np.zeros(64, np.int64), len(words) - k + 1
    for lo in range(0, total, 65_536):
        part = words[lo : lo + 65_536 + k - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(k))))
        h = np.array([digest(s, seed) for s in joined], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: SimHashParams, name: str = "doc_id") -> DataFrame:
    """(the column ``name``, fp): fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid and x.as_buffer() is not None else b"", p.shingle, p.seed) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(name), pa.array(np.array(found, np.uint64).view(np.int64))], names=[name, "fp"])

    return docs.select(quoted(name), "text").mapInArrow(run, fields(docs, [name], fp="long"))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows: bit b of all fingerprints, 64 of them to a word."""
    width = -(-len(fps) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # n, 64
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(queries: np.ndarray, block: np.ndarray, radius: int, triangle: bool = False, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member of block) at distance ``radius`` or less, by bit-sliced counters.

    With ``triangle`` both sides are one array, and only pairs i < j come out: each 64 queries
    meet the words behind their own, and their own word apart from these. ``seen`` counts the
    blocks of 64 by 64 and those abandoned.
    """
    planes = bit_planes(block)
    words, seen = planes.shape[1], Counter() if seen is None else seen
    fill = np.zeros(words, np.uint64)  # lanes without a fingerprint count as past the radius
    if len(block) % 64:
        fill[-1] = ~np.uint64(0) << np.uint64(len(block) % 64)
    ones = np.bitwise_count(planes).sum(1, dtype=np.int64)
    bits = np.argsort(-np.minimum(ones, len(block) - ones), kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(queries), 64):
        q = queries[lo : lo + 64]
        own = lo // 64
        for cols in (np.arange(own, own + 1), np.arange(own + 1, words)) if triangle else (np.arange(words),):
            if not len(cols):
                continue
            seen["blocks"] += len(cols)
            i, j = _compare(q, planes, bits, cols, fill, radius, seen)
            if triangle and cols[0] == own:
                i, j = i[lo + i < j], j[lo + i < j]
            found.append((i + lo, j))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(q: np.ndarray, planes: np.ndarray, bits: np.ndarray, cols: np.ndarray, fill: np.ndarray, radius: int, seen: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within the radius of up to 64 queries and the words ``cols``."""
    digits = (radius + 1).bit_length()  # counters stop being told apart above 2**digits - 1
    every = ~np.uint64(0)
    over = np.repeat(fill[None, cols], len(q), 0)
    counter = [np.zeros_like(over) for _ in range(digits)]
    held = planes[:, cols]
    for n, b in enumerate(bits.tolist()):
        carry = held[b][None, :] ^ np.where(q >> np.uint64(b) & np.uint64(1), every, np.uint64(0))[:, None]
        for d in range(digits):  # carry-save: the digit keeps the sum, the carry moves up
            up = counter[d] & carry
            counter[d] ^= carry
            carry = up
        over |= carry
        if n % 8 == 7 and n < 63:
            live = (_exceeds(counter, over, radius) != every).any(0)
            if not live.all():  # every distance of the other blocks is past the radius
                seen["abandoned"] += int((~live).sum())
                if not live.any():
                    return np.zeros(0, int), np.zeros(0, int)
                cols, over, held = cols[live], over[:, live], held[:, live]
                counter = [c[:, live] for c in counter]
    near = np.ascontiguousarray(~_exceeds(counter, over, radius))
    i, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little"))
    return i, cols[lane // 64] * 64 + lane % 64


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where the bit-sliced number is larger than ``radius`` or has overflowed."""
    larger, equal = over.copy(), ~over
    for d in reversed(range(len(counter))):
        if radius >> d & 1:
            equal &= counter[d]
        else:
            larger |= equal & counter[d]
            equal &= ~counter[d]
    return larger


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that join the same nodes as all given pairs do."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def near_links(classes: DataFrame, p: SimHashParams) -> DataFrame:
    """Links (u, v) between the classes' fingerprints that connect all within the radius."""
    width = 64 // p.blocks
    block = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(p.blocks)]
    from itertools import combinations

    equal = p.blocks - p.radius  # so many blocks at least are untouched by ``radius`` differing bits
    keys = []
    for n, chosen in enumerate(combinations(range(p.blocks), equal)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = key.bitwiseOR(F.shiftleft(block[i], (chosen.index(i)) * width)) if len(chosen) * width <= 58 else F.xxhash64(key, block[i])
        keys.append(F.struct(F.lit(n).cast("int").alias("table"), key.alias("key")))
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["table", "key"])
    tiles = F.ceil(F.col("n") / p.tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    met = met.select("fp", "table", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("right"))
    sorted_rows = met.repartition("table", "key", "a", "b").sortWithinPartitions("table", "key", "a", "b")

    def links(left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
        if right is None:
            nodes = left
            i, j = within_radius(left, left, p.radius, triangle=True)
        else:
            nodes = np.concatenate([left, right])
            i, j = within_radius(left, right, p.radius)
            j = j + len(left)
        forest = _forest(i, j, len(nodes))
        u, v = (np.array([e[s] for e in forest], int) for s in (0, 1))
        signed = nodes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[u], pa.int64()), pa.array(signed[v], pa.int64())], names=["u", "v"])

    def cells(rows: np.ndarray, right: np.ndarray, cuts: np.ndarray, cross: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The links of whole cells; ``cuts`` are their bounds. Small ones are compared together: distances decide, not buckets."""
        fps = rows.view(np.uint64)
        large = np.nonzero(cross | (np.diff(cuts) > 256))[0]
        for lo, hi in zip([0, *(large + 1)], [*large, len(cross)]):
            while lo < hi:
                to = max(lo + 1, min(hi, int(np.searchsorted(cuts, cuts[lo] + 512, side="right")) - 1))
                yield links(np.unique(fps[cuts[lo] : cuts[to]]), None)
                lo = to
            if hi < len(cross):
                part, side = fps[cuts[hi] : cuts[hi + 1]], right[cuts[hi] : cuts[hi + 1]]
                if not cross[hi]:
                    yield links(part, None)
                elif side.any() and not side.all():
                    yield links(part[~side], part[side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("fp", "table", "key", "a", "b", "right")
        rest = [np.zeros(0, bool if c == "right" else np.int64) for c in names]  # the last cell, which may go on: two tiles at most
        for b in batches:
            rest = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, names)]
            new = np.any([c[1:] != c[:-1] for c in rest[1:5]], axis=0)
            starts = np.r_[0, np.nonzero(new)[0] + 1]
            if len(starts) > 1:
                yield from cells(rest[0][: starts[-1]], rest[5], starts, (rest[3] != rest[4])[starts[:-1]])
                rest = [c[starts[-1] :] for c in rest]
        if len(rest[0]):
            yield from cells(rest[0], rest[5], np.array([0, len(rest[0])]), np.array([rest[3][0] != rest[4][0]]))

    return sorted_rows.mapInArrow(run, "u long, v long")


def _named(marked: DataFrame, p: SimHashParams, **least: Column) -> DataFrame:
    """(fp, component, the minimum of each of ``least``) for each fingerprint."""
    classes = durable(marked.groupBy("fp").agg(*(F.min(c).alias(n) for n, c in least.items())))
    nodes = connected_components(near_links(classes, p))
    return classes.join(nodes, classes.fp == nodes.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), *least)


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    marked = durable(fingerprints(docs, p))
    named = _named(marked, p, lowest=F.col("doc_id"))
    best = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    lookup = named.join(best, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # many documents of one fingerprint: the join's skew handling splits them, the lookup has one row for them
    return marked.join(lookup, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """The documents with one row of each group of near-duplicates, that of the smallest id.

    Rows without an id are kept apart: of those of a group one stays. Among rows of one id, or
    of none, the hashes of the texts decide, and among repeated rows any one.
    """
    hashes = (F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(f"h{k}") for k in range(2))
    name = free_name(docs.columns, "row key")
    keyed = docs.withColumn(name, F.struct("doc_id", *hashes))
    key, without = quoted(name), quoted(name)["doc_id"].isNull()
    named = _named(fingerprints(keyed, p, name), p, known=F.when(~without, key), unknown=F.when(without, key))
    best = named.groupBy("component").agg(F.array(F.min("known"), F.min("unknown")).alias("keys"))
    best = best.select(F.explode(F.array_compact("keys")).alias(name))
    return keyed.join(best, name, "left_semi").dropDuplicates([name]).select(*map(quoted, docs.columns))
