"""Incremental rasters: files that arrive in a folder become cells, one grid per file.

The batch operators apply to each micro-batch through ``foreachBatch``; a grid is whole
within its batch, so no state is carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CELLS = "grid_id string, i int, j int, z double, valid boolean"


def stream_cells(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Cells of Parquet files (columns of CELLS) as they arrive."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", max_files).parquet(path)


def run_per_batch(cells: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and append its result; processes what is there, then stops."""

    def each(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
