"""Names of the registered queries, their builders and DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name``, with its DuckDB SQL where there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLE[name] = sql
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "a1_verdict_metrics",
    """
    SELECT d.lang, count(*) AS reviews, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS rejected,
           sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS approved,
           round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / greatest(1, count(*)), 4) AS rejection_rate,
           round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / greatest(1, count(*)), 4) AS approval_rate
    FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang
    """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts and clamped rates by language: labels joined to documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rejected = F.count_if(F.col("toxic") == 1)
    approved = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    total = F.greatest(F.lit(1), F.count("*"))
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .groupBy("lang")
        .agg(
            F.count("*").alias("reviews"),
            rejected.alias("rejected"),
            approved.alias("approved"),
            F.round(rejected / total, 4).alias("rejection_rate"),
            F.round(approved / total, 4).alias("approval_rate"),
        )
    )


from quillmill.plans import basics, logs, matching, ranks, rollups, roundtrips, texts  # noqa: E402, F401  they register their queries
