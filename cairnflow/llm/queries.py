"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, mixing, packing, pii, quality, secret_scan, simhash, token_output, toxicity, urls
from .common import table



def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    learn = F.coalesce(~held_out(), F.lit(False))
    return toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def secret_model(spark: SparkSession) -> secret_scan.MarkovModel:
    return secret_scan.train_markov(secret_scan.default_samples(spark, secret_scan.MarkovParams().samples))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"), secret_model(spark))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.train_url_model(urls.rule_labels(pages)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Session setting that holds the pseudonyms' key; Spark hides settings of such names in its logs and UI.
PII_KEY = "spark.cairnflow.pii.secret"


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from ``PII_KEY``; without it the query runs under a key for test data that protects nothing."""
    key = spark.conf.get(PII_KEY, "test data only")
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.PiiParams(key.encode()), columns=("doc_id", "text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_packed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_sequences(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_quality_rules, op2_toxicity, op3_learned_partitions, op4_secret_scan, op5_url_filter, op6_simhash, op7_pii_pseudonyms, op8_best_fit_packing, op9_packed_output, op10_source_mix)
    return {f.__name__: _shipped(f) for f in all_of}


def _position(share: str) -> str:
    share = f"LEAST(1.0, {share})"
    return f"CASE WHEN ABS(slope) < 1e-9 THEN {share} ELSE 2 * {share} / (1 - slope + sqrt(pow(1 - slope, 2) + 4 * slope * {share})) END"


#: Sources by water-filling, documents by running sums in hashed order, positions by the inverted curriculum.
MIX_SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    t AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM t),
    w AS (SELECT *, CAST([3, 1, 2][k % 3 + 1] AS DOUBLE) AS weight, CAST([-0.6, 0.0, 0.6][k % 3 + 1] AS DOUBLE) AS slope, CAST(source_size AS DOUBLE) * 2 AS cap FROM r),
    l AS (SELECT *, cap / weight AS ratio, (CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5 - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / SUM(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM w),
    v AS (SELECT (SELECT step FROM l WHERE step <= ratio ORDER BY ratio, k LIMIT 1) AS level),
    g AS (SELECT source, source_size, slope, CASE WHEN level IS NULL OR level * weight >= cap THEN cap ELSE level * weight END AS target FROM l CROSS JOIN v),
    a AS (SELECT d.*, g.source_size, g.slope, g.target, CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
    b AS (SELECT *, GREATEST(0, LEAST(size, CAST(FLOOR(target) AS BIGINT) - before)) AS g0, GREATEST(0, LEAST(size, CAST(FLOOR(target) AS BIGINT) - before - source_size)) AS g1 FROM a)
    SELECT doc_id, size, source_size, target, g0 + g1 AS taken, source, CASE WHEN g1 > 0 THEN [{_position("before / target")}, {_position("(before + source_size) / target")}] WHEN g0 > 0 THEN [{_position("before / target")}] ELSE CAST([] AS DOUBLE[]) END AS positions FROM b"""


def oracle_sql() -> dict[str, str]:
    """The source mix alone: the others rest on tokenizers, XXH64 votes, match positions or trained models."""
    return {"op10_source_mix": MIX_SQL}
