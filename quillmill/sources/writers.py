"""Sinks: appended runs, parent and child tables, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_run(df: DataFrame, path: str, kind: str, started: Column, status: Column) -> None:
    """K4: append rows of a run or audit log, by kind."""
    df.select(F.lit(kind).alias("kind"), started.alias("started_at"), status.alias("status"), F.to_json(F.struct(*df.columns)).alias("detail")).write.mode("append").partitionBy("kind").parquet(path)


def parent_child(postings: DataFrame, natural_key: list[str], children: dict[str, str]) -> dict[str, DataFrame]:
    """K3: the rows of a parent table and of its child tables, linked by a hash of the natural key.

    ``children``: table name to the array-of-struct column that holds its rows.
    """
    keyed = postings.withColumn("id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in natural_key]), 256))
    out = {"parent": keyed.drop(*children.values())}
    for name, column in children.items():
        rows = keyed.select(F.col("id").alias("parent_id"), F.posexplode(column).alias("ord", "r")).select("parent_id", "ord", "r.*")
        out[name] = rows.withColumn("id", F.sha2(F.concat_ws("|", "parent_id", F.col("ord").cast("string")), 256))
    return out


def write_csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """K5: the named columns in order, missing ones and nulls as empty text."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """K6: one JSON object for each row, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
