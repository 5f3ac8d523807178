"""Exact duplicates by a stateful stream over digests."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._shared import free, fresh_path, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Digests that are sent to every executor as one table at most; beyond that, a shuffle.
BROADCAST_DIGESTS = 400_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, **wanted: str):
    """Session settings for the time of a block."""
    keys = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class DedupState:
    """Keyed state on disk: for each digest its largest id, locator and count.

    The state is a streaming aggregation without watermark in the RocksDB
    store, so nothing in it expires; its checkpoint lies at ``path`` in the
    shared folder. ``absorb`` runs the stream over the files in the inbox that
    it has not seen; ``rows`` reads what the state holds.
    """

    def __init__(self, spark: SparkSession, path: str, bytes_per_batch: int = 64 << 30):
        self.spark, self.path, self.bytes_per_batch = spark, path, bytes_per_batch
        self.inbox, self.checkpoint = f"{path}/inbox", f"{path}/state"

    def add(self, keys: DataFrame) -> None:
        """Append rows of (digest, id, locator) to the inbox."""
        keys.select("digest", "id", "locator").write.mode("append").parquet(self.inbox)

    def absorb(self) -> None:
        schema = self.spark.read.parquet(self.inbox).schema
        with _settings(
            self.spark,
            spark__sql__streaming__stateStore__providerClass=ROCKSDB,
            spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
            spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="128",
            spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="4",
            spark__sql__streaming__stateStore__rocksdb__blockCacheSizeMB="2",
            spark__sql__streaming__stateStore__maintenanceInterval="10s",
            spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
            spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        ):
            fresh = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", self.bytes_per_batch).parquet(self.inbox)
            state = fresh.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count("*").alias("copies"))
            run = (
                state.writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            run.awaitTermination()

    def rows(self) -> DataFrame:
        """(digest, keep_id, keep_locator, copies) of everything absorbed so far."""
        held = self.spark.read.format("statestore").load(self.checkpoint)
        value = held.schema["value"].dataType.fieldNames()
        return held.select(
            F.col("key.digest").alias("digest"),
            F.col(f"value.`{value[0]}`.id").alias("keep_id"),
            F.col(f"value.`{value[0]}`.locator").alias("keep_locator"),
            F.col(f"value.`{value[1]}`").alias("copies"),
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest) -> DataFrame:
    """Group rows of equal text; of each group the row with the largest id stays.

    Every row is reduced to (digest, id, locator) and streamed into keyed state
    on disk that never expires (``DedupState``). The locator is a second hash
    of the content with its length. Where the state counts a hit, the full
    bytes are compared: the smallest and the largest text under the digest,
    combined before the shuffle, must be the same. If one digest holds
    different texts, its rows are grouped again by the texts themselves.

    A null text counts as empty. Rows of one group that share the largest id
    (repeated rows, or all with null ids) have nothing that tells them apart:
    all are ``kept`` here, and ``drop_exact_duplicates``, which sees whole rows,
    returns one of them. Null ids sort below all others. An empty table gives no
    rows; very long texts are hashed whole. Other columns are not read, so none
    can clash. A locator that is not the keeper's shows a collision without
    reading a text; the bytes are compared all the same.

    Returns ``id_col, keep_id, group_size, kept, digest, part`` for every row.
    ``part`` is null unless digests collided; then it is the text's own
    SHA-256.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("__text")).withColumn("digest", digest(F.col("__text")))
    locator = F.struct(F.octet_length("__text").cast("long").alias("bytes"), F.xxhash64("__text").alias("hash"))
    state = DedupState(spark, fresh_path(spark, "exact-dedup"))
    state.add(source.select("digest", "id", locator.alias("locator")))
    state.absorb()
    keys, held = spark.read.parquet(state.inbox), state.rows()

    hit = stage(held.filter("copies > 1"), "exact-hits")
    few = hit.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    # The side is broadcast only when the count above bounds it; then a digest that a third of all rows have is no hot key.
    hits = F.broadcast(hit) if few else hit
    bytes_of = source.join(hits.select("digest"), "digest", "left_semi")
    checked = bytes_of.groupBy("digest").agg((F.min("__text") == F.max("__text")).alias("same"))
    located = keys.join(hits.select("digest", "keep_locator"), "digest").filter(F.col("locator") != F.col("keep_locator")).select("digest")
    clash = stage(checked.filter("not same").select("digest").unionByName(located).distinct(), "digest-clash")
    # who has a digest alone stays
    named = keys.join(hits.select("digest", "keep_id", "copies"), "digest", "left").select(
        "digest", "id", F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.lit(None).cast("string").alias("part")
    )
    if clash.isEmpty():
        out = named
    else:
        plain = named.join(clash, "digest", "left_anti")
        again = source.join(clash, "digest", "left_semi").withColumn("part", F.sha2(F.col("__text").cast("binary"), 256))
        groups = again.groupBy("digest", "part", "__text").agg(F.max("id").alias("keep_id"), F.count("*").alias("copies"))
        out = plain.select("digest", "id", "keep_id", "copies", "part").unionByName(
            again.join(groups, ["digest", "part", "__text"]).select("digest", "id", "keep_id", "copies", "part")
        )
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
        "part",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts (null counts as empty) the row with the largest id stays; a
    null id sorts below all others. Rows that share both id and text with the
    row that stays are repeats of it: the one whose columns come first as JSON
    is returned. An empty table gives no rows.
    """
    own_id, own_digest, digest, row = free(docs.columns, "__id", "__digest", "__own", "__row")
    marked = stage(
        exact_duplicates(docs, id_col, text_col)
        .filter("kept")
        .groupBy(F.col(f"`{id_col}`").alias(own_id), F.col("digest").alias(own_digest))
        .agg(F.count("*").alias("rows")),
        "exact-kept",
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn(digest, sha256_digest(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_digest))
    kept = hashed.join(marked.filter("rows = 1"), same, "left_semi").select(*columns)
    if marked.filter("rows > 1").isEmpty():
        return kept
    whole = F.struct(*columns)
    repeats = hashed.join(marked.filter("rows > 1"), same, "left_semi").groupBy(F.col(f"`{id_col}`").alias(own_id), digest)
    return kept.unionByName(repeats.agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*"))
