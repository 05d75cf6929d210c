"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Every source has a target number of words. The source's documents form a stream in hashed
order, passed over again as long as the target lasts, so a prefix sum says how much of each
document every pass takes. The curriculum gives a source the weight density
1 + slope * (2t - 1) over training time t in [0, 1]; its integral t + slope * (t*t - t) is
the share of the source's demand met by time t, and its inverse turns a document's place in
its stream into a training position. Sorting by position (a range shuffle) is the order of
training.

Prefix sums go by hash buckets: bucket totals are pre-aggregated and summed up, and only a
bucket's own rows meet in a task, so a source that holds a third of the corpus is spread.

Cases: null, empty and blank texts have size 0 and are taken for 0 words; null sources are
one source, last in order; null ids hash as an empty id; repeated rows are documents of
their own; a corpus without words takes nothing; an empty table gives an empty result;
extra columns are ignored, and kept by ``mixed_documents`` under any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable, n_words, quoted


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)
    slopes: tuple[float, ...] = (-0.6, 0.0, 0.6)
    total: float = 1.5
    most: float = 2.0
    bucket_digits: int = 3


def source_targets(sized: DataFrame, p: MixParams) -> DataFrame:
    """One row per source: its size, weight and target by water-filling.

    The targets are min(most * size, level * weight) with one level for all: the fixed point
    of resharing the excess by weight. Sources in order of cap / weight reach their caps
    first, so the level comes from running sums.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on; strings compare by bytes, which is by code point
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("k", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick(p.weights).cast("double")).withColumn("slope", pick(p.slopes)).withColumn("cap", F.col("source_size") * F.lit(p.most))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "k")
    below, rest, every = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * p.total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source in this order whose cap isn't reached fixes the level
    stepped = ranked.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("weight"))
    fixed = stepped.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return fixed.select("source", "source_size", "slope", target.alias("target"))


def inverse_curriculum(share: Column, slope: Column) -> Column:
    """The time t at which t + slope * (t*t - t) reaches ``share``."""
    root = F.sqrt(F.pow(1 - slope, 2) + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(F.coalesce(F.try_divide(2 * share, 1 - slope + root), F.lit(0.0)))


def mix(docs: DataFrame, p: MixParams = MixParams(), extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, and the training position of each pass.

    ``positions`` lists, for the passes that take anything of the document, the time in
    [0, 1] at which it starts; rows come sorted by the first (documents not taken last).
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("h"), *extra))
    targets = source_targets(sized, p)
    rows = sized.withColumn("bucket", F.substring("h", 1, p.bucket_digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), before.alias("before"))
    start = start.join(targets, start.b_source.eqNullSafe(targets.source)).drop("source")
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(start, placed.source.eqNullSafe(start.b_source) & (placed.bucket == start.b_bucket))
    at = F.col("before") + F.col("inside")
    whole = F.floor("target")
    passes = []
    for k in range(int(-(-p.most // 1))):
        offset = at + F.col("source_size") * k
        got = F.greatest(F.lit(0), F.least(F.col("size"), whole - offset))
        passes.append((got.cast("long"), inverse_curriculum(F.least(F.lit(1.0), F.try_divide(offset, F.col("target"))), F.col("slope"))))
    taken = passes[0][0]
    for got, _ in passes[1:]:
        taken = taken + got
    times = F.filter(F.array(*(F.when(got > 0, t) for got, t in passes)), lambda x: x.isNotNull())
    out = placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", times.alias("positions"), *extra)
    return out.orderBy(F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1).asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The documents in training order, one row per pass that takes them; columns as given.

    A document on which a source's target ends is given whole in that pass.
    """
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    key = ["doc_id", "source", "size", "text_hash"]
    twins = W.partitionBy(*key).orderBy(key[0])  # repeated rows, any of which may take another's place
    plan = mix(rows, p, ("text_hash",)).withColumn("twin", F.row_number().over(twins)).where("taken > 0")
    plan = plan.select(*(F.col(c).alias(f"m_{c}") for c in (*key, "twin")), "positions")
    rows = rows.withColumn("size", n_words(F.col("text"))).withColumn("twin", F.row_number().over(twins))
    same = rows.doc_id.eqNullSafe(plan.m_doc_id) & rows.source.eqNullSafe(plan.m_source) & (rows.text_hash == plan.m_text_hash) & (rows["size"] == plan.m_size) & (rows.twin == plan.m_twin)
    return rows.join(plan, same).select("row", F.explode("positions").alias("position")).sort("position", "row.doc_id").select("row.*")
