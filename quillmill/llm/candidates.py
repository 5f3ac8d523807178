"""From shared buckets to units whose members are compared in bounded tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import stage


def shared_buckets(placed: DataFrame, part_rows: int, part_weight: int, name: str) -> DataFrame:
    """(u, bucket, hub, parts) of the buckets that two or more hold.

    ``placed`` has a row (u, weight, bucket) for each bucket of ``u``, once
    each. Buckets of the same members are one, known by the smallest number.
    ``hub`` is the smallest member; ``parts`` is the number of parts into which
    the bucket falls for no part to have many more than ``part_rows`` members
    or a weight of ``part_weight``. Only numbers travel: counts, sums and
    hashes, combined before the shuffle.
    """
    mark = F.xxhash64("u")
    full = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.sum("weight").alias("w"), F.min("u").alias("hub"), F.sum(mark.cast("decimal(30,0)")).alias("s"), F.bit_xor(mark).alias("x"))
        .filter("m > 1")
        .groupBy("m", "w", "hub", "s", "x")
        .agg(F.min("bucket").alias("bucket"))
    )
    buckets = stage(full.select("bucket", "hub", cut("m", "w", part_rows, part_weight).alias("parts")), f"{name}-buckets")
    return stage(placed.select("u", "bucket").join(buckets, "bucket"), f"{name}-members")


def cut(members: str, weight: str, part_rows: int, part_weight: int) -> Column:
    """The number of parts of a unit of so many members that weigh so much together."""
    return F.greatest(F.ceil(F.col(members) / part_rows), F.ceil(F.col(weight) / part_weight), F.lit(1)).cast("int")


def dealt(members: DataFrame, *columns: str) -> DataFrame:
    """A row for each pair of parts (p1 <= p2) of its unit in which a member takes part.

    ``members`` has (unit, parts, u); every two parts of a unit, and each with
    itself, meet in one group (unit, p1, p2).
    """
    return (
        members.withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("unit", F.least("part", "q").alias("p1"), F.greatest("part", "q").alias("p2"), "part", "u", *columns)
    )
