"""Contiguous shards of balanced byte size, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import ranged_prefix, stage


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of near equal bytes.

    Rows stand in the order of their content (hash of the text, then
    ``id_col``), so equal texts are neighbours. Global byte prefix sums come
    from per-partition totals; the total is cut at equal targets and a row goes
    where its middle byte falls. Equal texts that a cut would part, a group for
    each cut at most, go together where the group's middle byte falls, unless
    the group is larger than the largest row: then moving it would unbalance
    the shards by more than whole rows must, and it is cut like other rows. So
    shards differ from the target by the largest row at most, and at most
    ``shards - 1`` groups of equal texts are parted, those larger than the
    largest row on which a cut falls.

    Returns ``id_col, size, text_crc32, shard, slot``: size is the text's
    UTF-8 bytes plus ``overhead`` (a null text has no bytes and the CRC of the
    empty text); slot counts from 0 without gaps in each shard. Null and
    repeated ids are ordinary rows, very long texts count whole. An empty table
    gives no rows; fewer rows than shards leave shards empty, and rows without
    a byte all go to shard 0. Columns of ``docs`` other than the two named are
    not read, so none can clash.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
    )
    group = ["hash", "crc", "size"]
    placed = stage(ranged_prefix(rows, [*group, "id"], "size", name="shard-bytes"), "shard-placed")
    sums = placed.agg(F.sum("size").alias("total"), F.max("size").alias("largest")).collect()[0]
    total, largest = sums["total"] or 1, sums["largest"] or 0

    def holds(middle: Column) -> Column:
        return F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int")

    by_row = placed.withColumn("g", F.struct(*group)).withColumn("own", holds(F.col("__before") + F.col("size") / 2))
    # two groups for each shard; those that end one shard and begin a later one are parted
    ends = by_row.groupBy("own").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    parted = ends.select("own", F.explode(F.array_distinct(F.array("low", "high"))).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    moved = (
        by_row.join(F.broadcast(parted), "g")  # at most a group for each cut
        .groupBy("g")
        .agg(F.min("__before").alias("start"), F.sum("size").alias("bytes"))
        .filter(F.col("bytes") <= largest)
        .select("g", holds(F.col("start") + F.col("bytes") / 2).alias("together"))
    )
    cut = by_row.join(F.broadcast(moved), "g", "left").withColumn("shard", F.coalesce("together", "own"))
    first = cut.groupBy("shard").agg(F.min("__index").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("__index") - F.col("first")).cast("long").alias("slot"),
    )
