"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed size.

Lengths are integers of at most ``capacity``, so the whole packing problem is a histogram:
best-fit decreasing runs on (length, count) with a segment tree over remaining capacities
that finds the tightest open capacity in logarithmic time, and moves many equal bins at
once. Its plan, a list of intervals of ranks per length, is the packing that document-wise
best-fit decreasing gives, but grows with ``capacity`` and not with the corpus. Each piece
then finds its sequence from its rank among the pieces of its length, which partition-wise
counts and their prefix sums give; no group is ever in one task. The plan and the counts go
to the tasks as compressed histograms, so that the pieces stay where they were made; where
those would be too large, the pieces are joined with them instead.

Cases: null and empty texts are one end token; documents longer than the capacity are cut
into full pieces and a shorter rest; repeated rows and repeated ids are packed one by one;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_RE, durable, texts_of

CHUNKS = re.compile(WORD_RE).findall
#: A plan of more rows, or histograms of more bytes, aren't sent to the tasks as a whole but joined.
PLAN_ROWS = 400_000
SENT_BYTES = 64 << 20
#: Parts whose histograms share a block, and with it one row of prefix sums.
BLOCK_PARTS = 64


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = "word_bpe_49k.json"
    capacity: int = 4096
    end_id: int = 1
    cache_chunks: int = 600_000


def tokenizer_file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def id_bytes(p: PackParams) -> int:
    """Bytes of an id in packed form: 2 if the vocabulary and the end token allow, else 4."""
    with open(tokenizer_file(p.tokenizer), encoding="utf-8") as f:
        made = json.load(f)
    vocab = made["model"]["vocab"]
    largest = max([len(vocab), p.end_id, *(t["id"] for t in made.get("added_tokens", [])), *(vocab.values() if isinstance(vocab, dict) else ())])
    return 2 if largest < 65_536 else 4


LATIN = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LOWER = r"a-z\u00df-\u00f6\u00f8-\u017f"
#: Texts of these characters alone are composed already, and lower-case within their set.
PLAIN = re.compile(rf"[\t-\r\x20-\x7e{LATIN}]*").fullmatch
#: The tokenizer's own pre-token pattern, its letter and number classes written out for that set.
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\t-\r\x200-9{LOWER}]+").findall


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(rest)}


class ChunkEncoder:
    """Token ids of whole texts from a cache of their parts.

    The tokenizer never joins characters across pre-tokens. A text of plain characters is
    lower-cased and split by the tokenizer's pattern, and each new pre-token goes to its BPE
    model; of other texts each new white-space chunk goes through the whole tokenizer, and a
    text that holds a special token's string is encoded as it is. A tokenizer of another
    make than lower-casing byte-level BPE takes the chunk way alone.
    """

    def __init__(self, p: PackParams):
        from tokenizers import Tokenizer

        path = tokenizer_file(p.tokenizer)
        assert array.array("I").itemsize == 4 and sys.byteorder == "little"
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.limit = p.cache_chunks
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
        split = [n for n in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if n.get("type") == "Split"]
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.plain = made["model"]["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and [n["pattern"].get("Regex") for n in split] == [known]
        self.symbols = byte_symbols()

    def _model(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.symbols)
        return array.array("I", [t.id for t in self.tok.model.tokenize(part)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        if self.plain and PLAIN(text):
            return self._joined(PRE_TOKENS(text.lower()), self.parts, self._model)
        return self._joined(CHUNKS(text), self.chunks, self._whole)

    def _joined(self, keys: list[str], cache: dict[str, bytes], encode: Callable[[str], bytes]) -> bytes:
        try:
            return b"".join([cache[k] for k in keys])
        except KeyError:
            pass
        out = []
        for k in keys:
            ids = cache.get(k)
            if ids is None:
                if len(cache) >= self.limit:  # bounded memory: start over
                    cache.clear()
                ids = cache[k] = encode(k)
            out.append(ids)
        return b"".join(out)


_encoders: dict[PackParams, ChunkEncoder] = {}


def encoder(p: PackParams) -> ChunkEncoder:
    """One encoder per worker process, so that tasks share its cache."""
    if p not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[p] = ChunkEncoder(p)
    return _encoders[p]


def pieces(docs: DataFrame, p: PackParams, with_ids: bool = False) -> DataFrame:
    """Every document's pieces, with the task's number and the rank among its pieces of that length.

    ``with_ids`` adds the ids as bytes: little-endian, ``id_bytes(p)`` each.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    narrow = with_ids and id_bytes(p) == 2
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", ids binary" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"] + ["ids"] * with_ids
    size, end = p.capacity, np.array([p.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            out: list[list] = [[] for _ in names]
            src = []
            for row, text in enumerate(texts_of(b)):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    n = len(piece) // 4
                    src.append(row)
                    for c, x in zip(out[1:], (k, at // 4, n, zlib.crc32(piece), part, int(seen[n]), np.frombuffer(piece, "<u4").astype("<u2").tobytes() if narrow else piece)):
                        c.append(x)
                    seen[n] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            arrays = [b.column("doc_id").take(pa.array(src, pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], types))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities: is there an open bin, and which is the tightest that fits?"""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first bin, how many)

    def _mark(self, at: int, on: int) -> None:
        at += self.size
        self.tree[at] = on
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining > 0 and count > 0:
            self.bins.setdefault(remaining, []).append((first, count))
            self._mark(remaining, 1)

    def pop(self, remaining: int) -> tuple[int, int]:
        run = self.bins[remaining].pop()
        if not self.bins[remaining]:
            del self.bins[remaining]
            self._mark(remaining, 0)
        return run

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that an open bin has, or -1."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan rows (length, first rank, first bin, pieces a bin, offset) in rank order, and the number of bins.

    The ranks from a row's first to the next row's first take the bins from its first bin on.
    """
    tree, plan, opened = CapacityTree(capacity), [], 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                first, count = tree.pop(room)
                each = room // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, first, each, capacity - room))
                tree.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left:  # the last bin takes fewer
                plan.append((length, rank, first + full, each, capacity - room))
                tree.add(room - left * length, first + full, 1)
                rank, left, rest, full = rank + left, 0, rest - 1, full + 1
            tree.add(room, first + full, rest)
    return plan, opened


def pack_counts(part: np.ndarray, length: np.ndarray, n: np.ndarray) -> bytes:
    """Histograms of some parts as compressed bytes."""
    order = np.lexsort((length, part))
    return zlib.compress(np.stack([part[order], np.diff(length[order], prepend=0), n[order]]).astype("<i4").tobytes())


def unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part, step, n = np.frombuffer(zlib.decompress(raw), "<i4").reshape(3, -1)
    return part, np.cumsum(step), n


@dataclass(frozen=True)
class RankStarts:
    """The first rank of each length in a part: prefix sums before its block, then the block's histograms."""

    capacity: int
    blocks: dict[int, tuple[bytes, bytes]]

    def of(self, number: int) -> np.ndarray:
        before, counts = self.blocks[number // BLOCK_PARTS]
        out = np.frombuffer(zlib.decompress(before), "<i8").copy()
        part, length, n = unpack_counts(counts)
        earlier = part < number
        np.add.at(out, length[earlier], n[earlier])
        return out


def rank_starts(counts: DataFrame, p: PackParams) -> RankStarts | None:
    """The parts' prefix sums in a form to send; None where they take more than ``SENT_BYTES``."""

    def squeeze(t: pa.Table) -> pa.Table:
        part, length, n = (t.column(c).to_numpy() for c in ("part", "length", "n"))
        return pa.table({"block": pa.array([int(part[0]) // BLOCK_PARTS], pa.int32()), "counts": pa.array([pack_counts(part, length, n)], pa.binary())})

    # a block is at most BLOCK_PARTS * capacity rows
    blocks = durable(counts.groupBy(F.floor(F.col("part") / BLOCK_PARTS)).applyInArrow(squeeze, "block int, counts binary"))
    if (blocks.agg(F.sum(F.length("counts")).alias("n")).first().n or 0) > SENT_BYTES:
        return None
    total, made = np.zeros(p.capacity + 1, "<i8"), {}
    for r in blocks.orderBy("block").collect():  # at most SENT_BYTES
        made[r.block] = zlib.compress(total.tobytes()), bytes(r.counts)
        _, length, n = unpack_counts(bytes(r.counts))
        np.add.at(total, length, n)
    return RankStarts(p.capacity, made)


def place(found: DataFrame, p: PackParams) -> DataFrame:
    """Add sequence_id and offset to a durable table of pieces, without moving it unless the plan is too large."""
    counts = durable(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan, _ = best_fit_decreasing(totals, p.capacity)
    starts = rank_starts(counts, p) if len(plan) <= PLAN_ROWS else None
    if starts is None:
        return _place_by_join(found, counts, plan)
    rows = np.array(plan, np.int64).reshape(-1, 5)
    first_row: dict[int, tuple[int, int]] = {}
    for i, length in enumerate(rows[:, 0]):
        lo, _ = first_row.get(int(length), (i, i))
        first_row[int(length)] = (lo, i + 1)
    kept = [c for c in found.columns if c not in ("part", "local_rank")]
    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    sent = found.sparkSession.sparkContext.broadcast((rows, first_row, starts))  # bounded by PLAN_ROWS and SENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, first_row, starts = sent.value
        known: dict[int, np.ndarray] = {}
        for b in batches:
            length, part, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "local_rank"))
            for k in np.unique(part).tolist():
                if k not in known:
                    known = {k: starts.of(k)}  # a task has one part, or few in turn
                rank = np.where(part == k, rank + known[k][length], rank)
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = first_row[int(n)]
                on = length == n
                at[on] = lo + np.searchsorted(rows[lo:hi, 1], rank[on], side="right") - 1
            inner = rank - rows[at, 1]
            each = rows[at, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(rows[at, 2] + inner // each), pa.array(rows[at, 4] + inner % each * length)], names=[*kept, "sequence_id", "offset"])

    return found.mapInArrow(run, schema)


def _place_by_join(found: DataFrame, counts: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """As ``place`` for a plan too large to send: the plan rows are merged into each length's ranks.

    Buckets of ranks keep a hot length spread: a plan row is repeated for every bucket that
    its interval of ranks meets.
    """
    spark, width = found.sparkSession, 4096
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("rank_start"))
    ranked = found.join(starts, ["length", "part"]).withColumn("rank", F.col("rank_start") + F.col("local_rank")).drop("rank_start", "local_rank", "part")
    ends = [plan[i + 1][1] - 1 if i + 1 < len(plan) and plan[i + 1][0] == r[0] else None for i, r in enumerate(plan)]
    rows = spark.createDataFrame([(*r, e) for r, e in zip(plan, ends)], "length long, lo long, first long, each long, base long, hi long")
    last = counts.groupBy("length").agg((F.sum("n") - 1).alias("top"))
    rows = rows.join(last, "length").withColumn("hi", F.coalesce("hi", "top"))
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    joined = ranked.withColumn("bucket", F.floor(F.col("rank") / width)).join(rows, ["length", "bucket"]).where("rank between lo and hi")
    inner = F.col("rank") - F.col("lo")
    out = joined.withColumn("sequence_id", F.col("first") + F.floor(inner / F.col("each"))).withColumn("offset", F.col("base") + inner % F.col("each") * F.col("length"))
    return out.drop("bucket", "lo", "hi", "first", "each", "base", "top", "rank")


def pack(docs: DataFrame, p: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    found = durable(pieces(docs, p, with_ids))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return place(found, p).select(*names)
