"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

The sketch is a log-bucketed histogram with bounded relative error (the DDSketch
construction): a value falls in bucket ceil(ln x / ln g), so merging is adding counts and
the result doesn't depend on order or partitioning. Sketches are built per (lang, source)
over the documents that pass the base rule, merged to (lang) and to the whole corpus, and a
group too small for its own quantiles takes those of the next larger one. Every cutoff is a
quantile of its group, at the level that ``METRICS`` names; no width or floor is fixed.

Cases: a null or blank text has no words and fails the base rule; null lang or source is a
group of its own; without a document that passes the base rule there are no cutoffs (null);
repeated rows, and rows of one or of no id, are judged one by one; an empty table gives an
empty result; extra columns are ignored, and kept by ``quality_filter`` under any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_RE, durable, fields, texts_of

WORDS = re.compile(WORD_RE).findall
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: metric -> (numerator, denominator, quantile level of its upper cutoff)
METRICS = {
    "word_len": ("word_chars", "n_words", 0.99),
    "symbol_rate": ("n_symbols", "n_words", 0.9),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.995),
    "repeat_rate": ("n_repeat_words", "n_words", 0.995),
}


@dataclass(frozen=True)
class QualityParams:
    """min_rows: documents that a group's own quantiles need; rows_per_salt: rows of a group that join in one task."""

    accuracy: float = 0.01
    min_rows: int = 200
    base_min_words: int = 20
    base_repeat_pct: int = 30
    least_salts: int = 8
    rows_per_salt: int = 20_000_000

    def base_failed(self) -> Column:
        return (F.col("n_words") < self.base_min_words) | (100 * F.col("n_repeat_words") > self.base_repeat_pct * F.col("n_words"))


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """The COUNTS of one text."""
    words = WORDS(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            found, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeat += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), lines, dup, repeat


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, lang, source, ``keep``, COUNTS) of every whole text."""
    names = ["doc_id", "lang", "source", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = list(zip(*map(text_counts, texts_of(b)))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, pa.int64()) for c in counts)], names=[*names, *COUNTS])

    return docs.select(*names, "text").mapInArrow(run, fields(docs, names, **dict.fromkeys(COUNTS, "long")))


def sketch(measured: DataFrame, p: QualityParams) -> DataFrame:
    """Bucket counts per (lang, source, metric): the mergeable state."""
    log_g = F.log(F.lit((1 + p.accuracy) / (1 - p.accuracy)))
    bucket = lambda x: F.when(x <= 0, F.lit(None)).otherwise(F.ceil(F.log(x) / log_g).cast("int"))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.try_divide(a, b)).alias("bucket")) for m, (a, b, _) in METRICS.items()))
    long = measured.where(~p.base_failed()).select("lang", "source", F.explode(rows).alias("r"))
    return long.groupBy("lang", "source", "r.metric", "r.bucket").count().withColumnRenamed("count", "n")


def quantile_cutoffs(sketches: DataFrame, keys: list[str], p: QualityParams) -> DataFrame:
    """One row per group of ``keys``: its size ``n`` and an upper cutoff ``hi_<metric>`` for each metric.

    A cutoff is the upper edge of the bucket that holds the quantile, so at most
    2 * accuracy / (1 - accuracy) above it in proportion, and never below.
    """
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")  # its rows are buckets: some hundreds, whatever the corpus
    ordered = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    edge = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit((1 + p.accuracy) / (1 - p.accuracy)), F.col("bucket")) * (1 + 1e-12))
    ranked = merged.select(*keys, "metric", edge.alias("v"), F.sum("n").over(ordered).alias("cum"), F.sum("n").over(group).alias("n"))
    cut = lambda m, q: F.min(F.when((F.col("metric") == m) & (F.col("cum") >= q * F.col("n")), F.col("v"))).alias(f"hi_{m}")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *(cut(m, q) for m, (_, _, q) in METRICS.items()))


def adaptive_cutoffs(sketches: DataFrame, p: QualityParams) -> DataFrame:
    """Cutoffs per (lang, source); groups under ``min_rows`` take their language's, then the corpus's."""
    own, lang, whole = (quantile_cutoffs(sketches, k, p) for k in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *(F.col(f"hi_{m}").alias(f"l_{m}") for m in METRICS))
    whole = whole.select(*(F.col(f"hi_{m}").alias(f"w_{m}") for m in METRICS))
    both = own.join(lang, own.lang.eqNullSafe(lang.l_lang), "left").join(F.broadcast(whole))  # one row: a corpus total
    pick = lambda m: F.when(F.col("n") >= p.min_rows, F.col(f"hi_{m}")).when(F.col("l_n") >= p.min_rows, F.col(f"l_{m}")).otherwise(F.col(f"w_{m}"))
    return both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(pick(m).alias(f"hi_{m}") for m in METRICS))


def judge(docs: DataFrame, p: QualityParams, *keep: str) -> DataFrame:
    """Counts, base verdict, adaptive cutoffs and ``kept`` for every document, with the ``keep`` columns."""
    measured = durable(measure(docs, *keep))  # a few numbers a document: read by the sketches and by the filter
    cutoffs = adaptive_cutoffs(sketch(measured, p), p)
    # a hot (lang, source) spreads over the salts; the cutoffs are a row per group and repeat per salt
    salts = max(p.least_salts, -(-measured.count() // p.rows_per_salt))
    salted = cutoffs.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = rows.join(salted, rows.lang.eqNullSafe(salted.g_lang) & rows.source.eqNullSafe(salted.g_source) & (rows.salt == salted.g_salt), "left")
    ok = ~F.col("base_failed")
    for m, (a, b, _) in METRICS.items():
        ok = ok & F.coalesce(F.try_divide(a, b) <= F.col(f"hi_{m}"), F.lit(True))
    return joined.withColumn("base_failed", p.base_failed()).withColumn("kept", ok)


def quality_verdicts(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, counts, base_failed, kept, lang, source, n_lines and the cutoffs for every document."""
    return judge(docs, p).select("doc_id", *(c for c in COUNTS if c != "n_lines"), "base_failed", "kept", "lang", "source", "n_lines", *(f"hi_{m}" for m in METRICS))


def quality_filter(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that are kept, with their columns.

    A verdict depends on text, language and source alone, so rows are matched by these and
    not by their ids.
    """
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select("doc_id", "lang", "source", "text", text_hash.alias("text_hash"))
    kept = judge(keyed, p, "text_hash").where("kept").select("lang", "source", "text_hash").distinct()
    key = [text_hash == kept.text_hash, docs.lang.eqNullSafe(kept.lang), docs.source.eqNullSafe(kept.source)]
    return docs.join(kept, key[0] & key[1] & key[2], "left_semi")
