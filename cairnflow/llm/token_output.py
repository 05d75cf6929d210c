"""Packed token-id matrices: best-fit-decreasing packing, written as fixed-size binary rows.

A sequence is a row of ``capacity`` ids, the documents' pieces end to end and then padding;
``cu_seqlens`` are the cumulative segment lengths from 0 and ``position_ids`` start again at
0 with every segment. Documents longer than the capacity are cut without loss: their pieces
in order of ``starts`` are the document's ids.

Cases: as in ``packing``; an empty table gives no sequences and no file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from .packing import PackParams, id_bytes, pack


def packed_sequences(docs: DataFrame, p: PackParams = PackParams(), pad_id: int = 0) -> DataFrame:
    """One row per sequence: ids, segments and position resets.

    sequence_id long, doc_ids array (of doc_id's type), pieces array<int>, starts array<long>,
    cu_seqlens array<int>, n_tokens int, id_bytes int, input_ids and position_ids binary
    (``capacity`` little-endian unsigned numbers of ``id_bytes`` each), ids_crc32 long (of the
    padded row as little-endian unsigned 32-bit).
    """
    placed = pack(docs, p, with_ids=True)
    # rows of a sequence meet in one partition, in order; a sequence holds at most ``capacity`` pieces
    ordered = placed.select("sequence_id", "offset", "doc_id", "piece", "start", "length", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    stored = id_bytes(p)
    width = stored if max(pad_id, p.capacity) < 65_536 else 4
    size, kinds = p.capacity, {2: "<u2", 4: "<u4"}
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id long, doc_ids array<{key}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, n_tokens int, id_bytes int, input_ids binary, position_ids binary, ids_crc32 long"
    names = ["sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", "id_bytes", "input_ids", "position_ids", "ids_crc32"]
    steps, pad = np.arange(size).astype(kinds[width]).tobytes(), np.array([pad_id], kinds[width]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        done: list[tuple] = []

        def sequence() -> tuple:
            ids = b"".join([r[6] for r in rows])
            if width != stored:
                ids = np.frombuffer(ids, kinds[stored]).astype(kinds[width]).tobytes()
            cuts = [0, *(r[1] + r[5] for r in rows)]
            n = cuts[-1]
            ids += pad * (size - n)
            positions = b"".join([*(steps[: r[5] * width] for r in rows), bytes(width * (size - n))])
            crc = zlib.crc32(np.frombuffer(ids, kinds[width]).astype("<u4"))
            return rows[0][0], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], cuts, n, width, ids, positions, crc

        def emit(kind: pa.DataType) -> pa.RecordBatch:
            types = (pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * len(types), types)], names=names)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(2).type
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if rows and rows[-1][0] != row[0]:
                    done.append(sequence())
                    rows.clear()
                    if len(done) >= 256:
                        yield emit(kind)
                        done.clear()
                rows.append(row)
        if rows:
            done.append(sequence())
        if done:
            yield emit(kind)

    return ordered.mapInArrow(run, schema)


def write_packed(docs: DataFrame, path: str, p: PackParams = PackParams(), pad_id: int = 0) -> None:
    """Write the sequences as Parquet of fixed-size binary rows, with a description beside it.

    The columns are those of ``packed_sequences``, so a cut document is put together again
    from doc_ids, pieces and starts. Spark's commit protocol writes it, so a lost executor
    leaves no partial file.
    """
    packed_sequences(docs, p, pad_id).write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = docs.sparkSession
    note = json.dumps({"capacity": p.capacity, "dtype": "little-endian unsigned, id_bytes bytes", "pad_id": pad_id, "end_id": p.end_id, "tokenizer": p.tokenizer})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "_description"))


def read_matrix(path: str, capacity: int = 4096) -> np.ndarray:
    """The id matrix of a part file or folder that ``write_packed`` wrote, rows by sequence_id (for tests and small sets)."""
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet")) if os.path.isdir(path) else [""]
    tables = [pq.read_table(os.path.join(path, f) if f else path, columns=["sequence_id", "id_bytes", "input_ids"]) for f in files]
    rows = sorted((r for t in tables for r in zip(*(c.to_pylist() for c in t.columns))), key=lambda r: r[0])
    return np.stack([np.frombuffer(x, f"<u{n}").astype("<u4") for _, n, x in rows]) if rows else np.zeros((0, capacity), "<u4")
