"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured: the rotated space falls into blocks, each
block has a small random code, and a direction is a choice of one code word
from each block. A vector is decoded to the list of all directions whose inner
product with it exceeds its threshold. Vectors that share a direction are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import links_of, partitions, released, shares_earlier, sorted_groups, stage
from quillmill.llm.candidates import dealt, shared_buckets
from quillmill.llm.components import components

#: Vectors of a filter that are compared in one task at most; larger filters are cut into parts.
PART = 1024
#: Random pairs by which the recall of a code is measured.
FIT_PAIRS = 4096
#: Codes of a vector at most; where more were needed, all pairs are compared.
MOST_CODES = 64


def pairs_at(cosine: float, dim: int, pairs: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Rows of random unit vectors at exactly this cosine; equal ones in one dimension."""
    rng = np.random.default_rng([seed, dim])
    x, z = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z


@dataclass(frozen=True)
class CapCode:
    """Random product codes: ``codes`` independent ones of ``blocks`` blocks with ``words`` words each.

    Lists of a common threshold are uneven for product codes (0 to over 3,000
    directions on one table), so each vector has its own threshold: that which
    exactly ``listed`` directions of each code exceed. Near vectors have near
    scores and so near thresholds.
    """

    dim: int
    words: int = 16
    codes: int = 3
    blocks: int = 4
    listed: int = 16
    seed: int = 5

    @staticmethod
    def fit(dim: int, vectors: int, min_cosine: float = 0.9, recall: float = 0.99, load: float = 0.1, **other) -> CapCode:
        """As many words as leave a vector ``load`` unrelated ones in a filter on average, 12 at least; as many codes as reach the recall.

        Filters of one vector are not sent anywhere, so a small load keeps the
        shuffle to vectors that have near ones. Filters narrow as the table
        grows, and pairs share fewer of them, so codes are added until
        ``recall`` of random pairs at exactly ``min_cosine`` share one. If more
        than ``MOST_CODES`` were needed, one filter holds all vectors and every
        pair is compared.
        """
        plain = CapCode(dim, **other)
        words = max(12, round((vectors * plain.listed / load) ** (1 / plain.blocks)))
        x, y = pairs_at(min_cosine, dim, FIT_PAIRS)
        met = np.zeros(len(x), bool)
        for codes in range(1, MOST_CODES + 1):
            code = CapCode(dim, **other | {"words": words, "codes": codes})
            met |= code.share(x, y, codes - 1)
            if met.mean() >= recall and codes >= plain.codes:
                return code
        return CapCode(dim, words=1, codes=1, blocks=1, listed=1)

    def share(self, x: np.ndarray, y: np.ndarray, *codes: int) -> np.ndarray:
        """Whether the unit vectors in each row of ``x`` and ``y`` share a direction of these codes, or of any."""
        met = np.zeros(len(x), bool)
        for c in codes or range(self.codes):
            built = [self.built_one(c)]
            for i in range(0, len(x), self.step()):
                here = slice(i, i + self.step())
                met[here] |= (self.decode(x[here], built)[:, :, None] == self.decode(y[here], built)[:, None, :]).any((1, 2))
        return met

    def step(self) -> int:
        """Vectors that are decoded at a time."""
        return max(64, min(4096, 4_000_000 // (self.listed * self.words)))

    def built(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """For each code its rotation and the words of each block, of equal length."""
        return [self.built_one(c) for c in range(self.codes)]

    def built_one(self, c: int) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng([self.seed, c, self.dim])
        rotation, _ = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
        words = []
        for part in np.array_split(np.arange(self.dim), min(self.blocks, self.dim)):
            w = rng.standard_normal((self.words, len(part)))
            words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        return rotation, words

    def decode(self, units: np.ndarray, built: list) -> np.ndarray:
        """A row for each unit vector: its directions' numbers, for all codes.

        The best sums of the blocks so far and of one more block are among the
        best of each, so lists are exact though few directions are looked at.
        """
        lists = []
        for c, (rotation, words) in enumerate(built):
            turned, at = units @ rotation, 0
            total, path = np.zeros((len(units), 1)), np.full((len(units), 1), c, np.int64)
            for w in words:
                scores = turned[:, at : at + w.shape[1]] @ w.T
                at += w.shape[1]
                total = (total[:, :, None] + scores[:, None, :]).reshape(len(units), -1)
                path = (path[:, :, None] * self.words + np.arange(len(w))).reshape(len(units), -1)
                if total.shape[1] > self.listed:
                    best = np.argpartition(-total, self.listed - 1, axis=1)[:, : self.listed]
                    total, path = np.take_along_axis(total, best, 1), np.take_along_axis(path, best, 1)
            lists.append(path)
        return np.sort(np.concatenate(lists, axis=1), axis=1)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors; the largest component is made 1 first, so that no square overflows or vanishes."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.9, code: CapCode | None = None) -> DataFrame:
    """Links and components of vectors whose cosine is ``min_cosine`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of a different number of dimensions than
    the compared one (each number is handled by itself). Equal vectors are
    grouped first and weigh as one. Each distinct vector is decoded to all
    filters that exceed its threshold. Only numbers (vector, filter) travel to
    find the filters that two or more share, and filters of the same members
    become one; a vector itself is sent to those that remain, where all pairs
    are compared in double precision. A pair counts in the smallest filter that
    both share, so no list of pairs leaves a task: only counts, and for each
    task a spanning forest of its links. Filters of more than ``PART`` vectors
    are cut into parts and every two parts meet in a task of their own.

    Returns ``id_col, n_links, component_id, kept`` for every row: other rows
    linked directly, the smallest id reachable, and whether that is the row's
    own. Repeated ids are rows of their own and link with each other if their
    vectors do. A null id takes part but cannot name a component while others
    are there. An empty table gives no rows; other columns are not read, so
    none can clash.
    """
    raw = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    groups = stage(
        raw.filter(sound).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("u", F.monotonically_increasing_id()),
        "vector-groups",
    )
    dims = [(r["d"], r["n"]) for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    counted, forests = [], []
    for dim, there in dims:
        own = code if code is not None and code.dim == dim else CapCode.fit(dim, there, min_cosine)
        counts, forest = _compare(groups.filter(F.size("v") == dim), own, min_cosine)
        counted.append(counts)
        forests.append(forest)
    if not dims:
        return raw.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts, forest = counted[0], forests[0]
    for c, f in zip(counted[1:], forests[1:]):
        counts, forest = counts.unionByName(c), forest.unionByName(f)
    linked = components(forest)
    named = (
        groups.select("u", "rep")
        .join(linked.withColumnRenamed("id", "u"), "u")
        .groupBy("component")
        .agg(F.min("rep").alias("component_id"))
    )
    facts = (
        groups.join(counts.groupBy("u").agg(F.sum("n").alias("n")), "u", "left")
        .join(linked.join(named, "component").select(F.col("id").alias("u"), "component_id"), "u", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    good = raw.filter(sound).join(facts, "v").select("id", "n_links", "component_id")
    bad = raw.filter(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compare(groups: DataFrame, code: CapCode, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """Counts (u, n) and forest links (a, b) of the distinct vectors."""
    dim = code.dim

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = code.built()
        for batch in batches:
            step = code.step()
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = code.decode(_unit(part.column(1), dim), built)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * found.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["u", "filters"])

    listed = stage(groups.select("u", "v").mapInArrow(lambda batches: released(assign(batches)), "u long, filters array<long>"), "vector-filters")
    members = shared_buckets(listed.select("u", F.lit(1).alias("weight"), F.explode("filters").alias("bucket")), PART, PART, "vector")
    # at most one entry for each filter of a vector
    places = members.groupBy("u").agg(F.collect_list(F.struct("bucket", "parts")).alias("places"))
    sent = (
        groups.select("u", "v", "copies")
        .join(places, "u")
        .select("u", "v", "copies", F.col("places.bucket").alias("filters"), F.explode("places").alias("at"))
        .select(F.col("at.bucket").alias("unit"), F.col("at.parts").alias("parts"), "u", "v", "copies", "filters")
    )
    met = dealt(sent, "v", "copies", "filters")
    keys = ["unit", "p1", "p2"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            found = _links(group, dim, min_cosine)
            if found is not None:
                yield found

    found = stage(
        met.repartition(partitions(groups.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: released(compare(batches)), "u long, n long, b long"),
        "vector-links",
    )
    return found.filter("n > 0").select("u", "n"), found.filter("u <> b").select(F.col("u").alias("a"), "b").distinct()


def _links(group: pa.Table, dim: int, min_cosine: float) -> pa.RecordBatch | None:
    """Counts and forest of one filter's vectors, or of two parts of them."""
    p1, p2, here = (group.column(c)[0].as_py() for c in ("p1", "p2", "unit"))
    part = group.column("part").to_numpy()
    left, right = np.flatnonzero(part == p1), np.flatnonzero(part == p2)
    u, copies = group.column("u").to_numpy(), group.column("copies").to_numpy()
    if not len(left) or not len(right) or (p1 == p2 and len(left) < 2):
        return None
    units = _unit(group.column("v").combine_chunks(), dim)
    near = units[left] @ units[right].T >= min_cosine
    if p1 == p2:
        near &= np.triu(np.ones(near.shape, bool), 1)
    if not near.any():
        return None
    earlier = shares_earlier(group.column("filters"), here, left, right)
    n, tree = links_of(near, near if earlier is None else near & ~earlier, left, right, copies)
    told = np.flatnonzero((n > 0) | (tree != np.arange(len(u))))
    return pa.RecordBatch.from_arrays([pa.array(u[told]), pa.array(n[told]), pa.array(u[tree[told]])], names=["u", "n", "b"])
