"""What the training-data operators share: staged tables and prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where the setting is unset, a session of one local process, as in tests,
    gets a checkpoint folder of its own; any other raises an error, since the
    executors would not share it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``taken``, whatever the case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def place_of(names: list[str], wanted: str) -> int:
    """The place of a column, by its exact name or else whatever the case."""
    if wanted in names:
        return names.index(wanted)
    found = [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    if len(found) != 1:
        raise ValueError(f"no column {wanted!r} in {names}" if not found else f"column {wanted!r} is ambiguous in {names}")
    return found[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged_prefix(df: DataFrame, order: list[str], amount: str, within: list[str] | None = None, name: str = "ranged") -> DataFrame:
    """Global prefix sums from per-partition totals.

    Rows are staged with a running number, so that what they are computed from
    is read once though the ranges are sampled first. They are range-partitioned
    by ``within + order`` (the number breaks ties, so equal rows spread too) and
    staged again with the number of their partition. The totals of each partition, one small row each, give every
    partition's offset; inside a partition a window adds the rest. Added:
    ``__before`` (sum of ``amount`` over all earlier rows of the group
    ``within``) and ``__index`` (number of earlier rows of the group).
    """
    spark = df.sparkSession
    within = within or []
    n = partitions(spark)
    keyed = stage(df.withColumn("__tie", F.monotonically_increasing_id()), name)
    staged = stage(
        keyed.repartitionByRange(n, *[F.col(c) for c in [*within, *order, "__tie"]]).withColumn("__part", F.spark_partition_id()),
        name,
    )
    totals = staged.groupBy(*within, "__part").agg(F.sum(amount).alias("__sum"), F.count("*").alias("__rows"))
    # a row for each partition and group in it; ranges are contiguous, so that
    # is at most partitions + groups rows
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)],
        F.col("__part").alias("__part_at"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum_at"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_at"),
    )
    inside = Window.partitionBy("__part", *within).orderBy(*order, "__tie")
    running = staged.withColumn("__row", F.row_number().over(inside)).withColumn(
        "__run", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    same: Column = F.col("__part") == F.col("__part_at")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"__w{i}"))
    return (
        running.join(offsets, same)
        .withColumn("__before", F.col("__sum_at") + F.col("__run") - F.col(amount))
        .withColumn("__index", F.col("__rows_at") + F.col("__row") - 1)
        .drop("__part_at", "__sum_at", "__rows_at", "__row", "__run", "__tie", "__part", *[f"__w{i}" for i in range(len(within))])
    )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether CRC-32 of the id as text (null: empty text) leaves ``remainder``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def blocks(texts: list, size: int = 4_000_000) -> Iterator[list]:
    """Consecutive texts of length ``size`` together, or a single longer one."""
    group, held = [], 0
    for t in texts:
        if group and held + (0 if t is None else len(t)) > size:
            yield group
            group, held = [], 0
        group.append(t)
        held += 0 if t is None else len(t)
    if group:
        yield group


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys, one at a time, from batches sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and (a > 0 or any(held[0].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys)):
                whole, held = pa.concat_tables(held), []
                yield whole
                del whole
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def shares_earlier(lists: pa.ChunkedArray, here: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Whether the lists at ``left`` and ``right`` share a number below ``here``, as a matrix; None if no two do."""
    whole = lists.combine_chunks()
    sizes = np.asarray(whole.value_lengths().fill_null(0))
    flat, row = whole.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    below = flat < here
    flat, row = flat[below], row[below]
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    if not shared.any():
        return None
    column, row = (np.cumsum(counts > 1) - 1)[inverse[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row, width = column[order], row[order], 1024
    out = np.zeros((len(left), len(right)), bool)
    for c in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [c, c + width])
        matrix = np.zeros((len(sizes), min(width, int(column[-1]) + 1 - c)), np.float32)
        matrix[row[a:b], column[a:b] - c] = 1
        out |= matrix[left] @ matrix[right].T > 0
    return out


def links_of(near: np.ndarray, counted: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of links of each node, smallest node of its component) from matrices over ``left`` and ``right``.

    ``near`` holds the links, ``counted`` those that count here; a link weighs
    as many as the other node's ``copies``. No list of pairs is made.
    """
    n = np.zeros(len(copies))
    n[left] += counted @ copies[right].astype(np.float64)
    n[right] += counted.T @ copies[left].astype(np.float64)
    label, none = np.arange(len(copies), dtype=np.int32), np.int32(len(copies))
    while True:
        before = label.copy()
        for matrix, rows, columns in ((near, left, right), (near.T, right, left)):
            for i in range(0, len(rows), 256):
                low = np.where(matrix[i : i + 256], label[columns][None, :], none).min(axis=1)
                label[rows[i : i + 256]] = np.minimum(label[rows[i : i + 256]], low)
        label = label[label]
        if np.array_equal(label, before):
            return n.astype(np.int64), label


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of fewer rows than Spark's default; a setting of the user's own stays.

    For applications (the registered queries, the pipeline): operators leave
    the session's settings alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def released(batches: Iterator) -> Iterator:
    """The batches; after the last one the worker, which Spark keeps, returns freed memory to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
