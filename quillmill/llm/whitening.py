"""Whitening of vectors by hierarchical merging of singular value decompositions.

A set of vectors is summed up by its size, its mean and the singular values
and vectors of its centred matrix, all of them. Two summaries are merged by
putting one's rows (value times vector) under the other's, adding one row that
corrects for the distance of the means, and decomposing again; no dimension is
dropped, so the order of merges does not matter but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quillmill.llm._shared import sorted_groups, stage

#: Rows that are decomposed at a time, at least as many as there are dimensions.
ROWS = 4096
#: Summaries that one task merges at most, and the bytes they hold together.
FAN_IN, FAN_BYTES = 16, 1 << 28
SUMMARY = "dim int, slot long, n long, q array<long>, r array<long>, factor binary"


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(number, F.lit(False))


class Summary:
    """Size, exact sums and centred factor (singular values times right vectors) of a set of whole-numbered vectors."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray):
        self.n, self.sums, self.factor = n, sums, factor

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """The summary of the rows of a matrix of whole numbers."""
        n = len(x)
        sums = [int(c) for c in x.sum(axis=0, dtype=object)] if np.abs(x).max(initial=0) > (1 << 62) // max(n, 1) else [int(c) for c in x.sum(axis=0)]
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.float64) / n
        return Summary(n, sums, _decomposed((x - whole).astype(np.float64) - rest))

    def merge(self, other: Summary) -> Summary:
        """The summary of both sets."""
        a, b = self.n, other.n
        apart = np.array([float(s // a - t // b) + ((s % a) / a - (t % b) / b) for s, t in zip(self.sums, other.sums)])
        correction = np.sqrt(a * (b / (a + b))) * apart
        stacked = np.vstack([self.factor, other.factor, correction])
        return Summary(a + b, [s + t for s, t in zip(self.sums, other.sums)], _decomposed(stacked))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors of the rows; as many rows as dimensions at most."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * vectors


def _packed(dim: int, slot: int, s: Summary) -> dict:
    # sums are sent as quotient and rest by n: they may be beyond a long
    return {"dim": dim, "slot": slot, "n": s.n, "q": [v // s.n for v in s.sums], "r": [v % s.n for v in s.sums], "factor": s.factor.tobytes()}


def _unpacked(row: dict) -> Summary:
    sums = [q * row["n"] + r for q, r in zip(row["q"], row["r"])]
    return Summary(row["n"], sums, np.frombuffer(row["factor"]).reshape(-1, row["dim"]))


_FIELDS = pa.schema([("dim", pa.int32()), ("slot", pa.int64()), ("n", pa.int64()), ("q", pa.list_(pa.int64())), ("r", pa.list_(pa.int64())), ("factor", pa.binary())])


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, row numbers, matrix) of the vectors in a column that are not empty."""
    lists = batch.column(at)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat, ends = np.asarray(lists.flatten(), np.int64), np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each number of dimensions of a task's vectors."""
    from pyspark import TaskContext

    slot = TaskContext.get().partitionId()
    held: dict[int, list[np.ndarray]] = {}
    done: dict[int, Summary] = {}

    def settle(dim: int) -> None:
        own = Summary.of(np.vstack(held.pop(dim)))
        done[dim] = done[dim].merge(own) if dim in done else own

    for batch in batches:
        for dim, _, matrix in _matrices(batch, 0):
            held.setdefault(dim, []).append(matrix)
            if sum(map(len, held[dim])) >= max(ROWS, dim):
                settle(dim)
    for dim in list(held):
        settle(dim)
    yield pa.RecordBatch.from_pylist([_packed(dim, slot, s) for dim, s in done.items()], schema=_FIELDS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of one number of dimensions and slot become one, in the order of their old slots."""
    for group in sorted_groups(batches, ["dim", "up"]):
        rows = group.to_pylist()
        total = _unpacked(rows[0])
        for row in rows[1:]:
            total = total.merge(_unpacked(row))
        yield pa.RecordBatch.from_pylist([_packed(rows[0]["dim"], rows[0]["up"], total)], schema=_FIELDS)


def fit(vectors: DataFrame, vector_col: str) -> dict[int, Summary]:
    """The summary of all vectors by their number of dimensions.

    Each task decomposes its own rows; summaries are then merged ``FAN_IN`` at a
    time, by number of dimensions, until one is left of each. Every round is
    written to the shared folder, so a lost executor repeats one round only. A
    summary has as many bytes as a square matrix of its dimensions, whatever
    the rows, and only the last one of each number of dimensions comes to the
    driver.
    """
    rows = vectors.filter(F.size(vector_col) > 0).select(F.col(vector_col).cast("array<long>").alias("v"))
    level = stage(rows.mapInArrow(_summaries, SUMMARY), "whitening-parts")
    while True:
        seen = level.groupBy("dim").agg(F.count("*").alias("n")).collect()
        if all(r["n"] <= 1 for r in seen):
            return {r["dim"]: _unpacked(r.asDict()) for r in level.collect()}
        bytes_of = F.col("dim").cast("long") * F.col("dim") * 8
        fan = F.least(F.lit(FAN_IN), F.greatest(F.lit(2), F.floor(F.lit(FAN_BYTES) / bytes_of)))
        # slots without gaps, so that each round divides their number: ranks among few rows, one a task
        ranked = level.withColumn("up", F.floor(F.col("slot") / fan).cast("long"))
        count = max(r["n"] for r in seen)
        merged = ranked.repartition(max(1, -(-count // FAN_IN)) * len(seen), "dim", "up").sortWithinPartitions("dim", "up", "slot").mapInArrow(_merged, SUMMARY)
        level = stage(merged, "whitening-merged")


class Whitener:
    """The components of a summary: unit vectors by falling variance, and what a row comes to along them."""

    def __init__(self, summary: Summary, components: int):
        self.n, self.sums = summary.n, summary.sums
        dim = len(summary.sums)
        _, values, vectors = np.linalg.svd(summary.factor, full_matrices=False)
        variances = np.zeros(dim)
        variances[: len(values)] = values**2 / self.n
        self.count = min(components, dim)
        whole = variances.sum()
        self.explained = (variances / whole if whole > 0 else variances)[: self.count].tolist()
        # directions without variance, to rounding, cannot be whitened
        least = values.max(initial=0.0) * np.finfo(float).eps * 8 * max(dim, 1)
        self.sound = [i < len(values) and values[i] > least for i in range(self.count)]
        self.turn = np.zeros((dim, self.count))
        for i in range(self.count):
            if self.sound[i]:
                self.turn[:, i] = vectors[i] / (values[i] / np.sqrt(self.n))
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([s % self.n for s in self.sums], np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows along the components, over their standard deviations."""
        return ((x - self.base).astype(np.float64) - self.part) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared; None beyond a long."""
        near = x - self.base
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = int(np.abs(near).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * near - rest) ** 2).sum(axis=1).tolist()
        found = ((self.n * near.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def _moments(models: dict[int, Whitener]):
    """Each task's size, sums and scatter about its own mean of whitened rows, as one flat array for each number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch, 0):
                z = models[dim].whitened(x)
                n, mean = len(z), z.mean(axis=0)
                scatter = (z - mean).T @ (z - mean)
                if dim in held:
                    m, other, sofar = held[dim]
                    apart = mean - other
                    scatter = scatter + sofar + np.outer(apart, apart) * (n * m / (n + m))
                    n, mean = n + m, (n * mean + m * other) / (n + m)
                held[dim] = n, mean, scatter
        rows = [{"dim": dim, "flat": [*(n * mean).tolist(), *(scatter + n * np.outer(mean, mean)).ravel().tolist()]} for dim, (n, mean, scatter) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), ("flat", pa.list_(pa.float64()))]))

    return run


def identity_errors(vectors: DataFrame, vector_col: str, models: dict[int, Whitener]) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by number of dimensions.

    Components without variance are left out. Only sums of fixed length come to the driver.
    """
    rows = vectors.filter(F.size(vector_col) > 0).select(F.col(vector_col).cast("array<long>").alias("v"))
    parts = rows.mapInArrow(_moments(models), "dim int, flat array<double>")
    sums = parts.select("dim", F.posexplode("flat").alias("at", "value")).groupBy("dim", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for dim, model in models.items():
        flat = np.zeros(model.count + model.count**2)
        for r in sums:
            if r["dim"] == dim:
                flat[r["at"]] = r["value"]
        mean = flat[: model.count] / model.n
        # the means are zero but for rounding, so taking their products off loses nothing
        cov = flat[model.count :].reshape(model.count, model.count) / model.n - np.outer(mean, mean)
        sound = np.flatnonzero(model.sound)
        out[dim] = float(np.abs(cov[np.ix_(sound, sound)] - np.eye(len(sound))).max(initial=0.0))
    return out


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "x", components: int = 32) -> DataFrame:
    """Every vector of whole numbers along the components of all of them, whitened.

    The fit covers all vectors that are not null or empty; others have no row.
    Vectors of different numbers of dimensions are fitted and whitened each among
    themselves, so ``n`` then is the number of those with as many. Components
    are unit eigenvectors of the covariance (divisor n) by falling eigenvalue. A
    direction without variance (equal or fewer rows than dimensions, an entry
    that never varies) cannot be whitened: its ``whitened`` is null and it does
    not count in ``identity_error``. Entries must be below 2**52 in absolute value.

    Returns a row for each vector and component up to ``components``: ``id_col,
    component, n, deviation`` (sum over dimensions of (n x - S) squared with S
    the sums of all vectors; null beyond a long), ``whitened, explained``
    (share of the whole variance) and ``identity_error``. Null ids and
    repeated rows are rows like others, an empty table gives no rows, and other
    columns are not read, so none can clash.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<long>").alias("v"))
    models = {dim: Whitener(s, components) for dim, s in fit(rows, "v").items()}
    errors = identity_errors(rows, "v", models)
    id_type = rows.schema["id"].dataType
    schema = StructType(
        [
            StructField("id", id_type),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", ArrayType(DoubleType())),
            StructField("explained", ArrayType(DoubleType())),
            StructField("identity_error", DoubleType()),
        ]
    )

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch, 1):
                m = models[dim]
                z = [[v if ok else None for v, ok in zip(row, m.sound)] for row in m.whitened(x).tolist()]
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array([m.n] * k, pa.int64()),
                        pa.array(m.deviation(x), pa.int64()),
                        pa.array(z, pa.list_(pa.float64())),
                        pa.array([m.explained] * k, pa.list_(pa.float64())),
                        pa.array([errors[dim]] * k, pa.float64()),
                    ],
                    names=schema.names,
                )

    found = rows.filter(F.size("v") > 0).mapInArrow(turn, schema)
    each = found.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at("explained", F.col("at") + 1).alias("explained"),
        "identity_error",
    )
