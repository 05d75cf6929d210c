"""Helpers that the corpus operators share: durable cuts of lineage, word rule, table access."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, StructType

from ..plans.iterate import durable, shared_dir

__all__ = ["ascii_lower", "durable", "fields", "free_name", "literal_doubles", "n_words", "numbered", "quoted", "remove", "shared_dir", "table", "texts_of"]

#: A word of every contract here: a run of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it as long as a column has that name in any case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def fields(df: DataFrame, names: Iterable[str], **more: str) -> StructType:
    """The schema of ``names`` of ``df`` and then of ``more`` (name to type)."""
    out = StructType([df.schema[n] for n in names])
    for name, kind in more.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def numbered(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The columns ``names`` as c0, c1, ...: an Arrow kernel can't be handed names with dots."""
    picked = [quoted(n).alias(f"c{k}") for k, n in enumerate(names)]
    return df.select(*picked)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system that this package wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RE, -1))).cast("long")


def texts_of(batch: pa.RecordBatch, name: str | int = "text") -> Iterator[str]:
    """The texts of an Arrow batch one at a time, null as empty, never as one list of all."""
    for value in batch.column(name):
        yield value.as_py() or ""


def literal_doubles(values: tuple[float, ...]) -> Column:
    """An array<double> literal: one string that constant folding turns into the array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
