"""Similarity join of documents on word n-grams: MinHash banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import blocks, free, links_of, partitions, released, shares_earlier, sorted_groups, stage
from quillmill.llm.candidates import cut, dealt, shared_buckets
from quillmill.llm.components import components

#: Sets and n-grams of a part of a unit, about; two parts at a time meet in a task.
PART, PART_GRAMS = 1024, 300_000
#: Rows of (id, key) that are sent to every executor at most; beyond that, a shuffle.
BROADCAST_IDS = 200_000
#: Distinct words whose hashes a task keeps at most; then its table starts anew.
TABLE_WORDS = 200_000


def bands_for(similarity: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at ``similarity`` with at least ``recall``."""
    for rows in range(most_hashes, 0, -1):
        bands = most_hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches the recall")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word n-grams.

    Words are ``[^\\x20\\x09-\\x0D]+`` with ASCII letters in lower case. A text
    of fewer than ``n`` words but at least one has one n-gram, all its words;
    a text without words has none.
    """

    def __init__(self, n: int = 5):
        self.n, self.table = n, {}
        rng = np.random.default_rng(3)
        self.place = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        table = self.table
        if len(table) > TABLE_WORDS:
            table.clear()
        for w in set(words):
            if w not in table:
                table[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))
        out = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            out += ids[k : len(ids) - n + 1 + k] * self.place[k]
        return np.unique(_mix(out))


class BandHasher:
    """MinHash band values of a set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(17)
        self.bands, self.rows = bands, rows
        self.odd = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.join = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 2048):
            low = np.minimum(low, (grams[i : i + 2048, None] * self.odd).min(axis=0))
        value = (_mix(low).reshape(self.bands, self.rows) * self.join).sum(axis=1, dtype=np.uint64)
        return _mix(value + np.arange(1, self.bands + 1, dtype=np.uint64)).view(np.int64)


def _key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """Documents whose sets of word ``n``-grams have a Jaccard similarity of ``similarity`` or more.

    1. Each text becomes the key of its n-gram set and ``bands`` hashes;
       documents of one set are grouped and weigh as one from here on.
    2. A shuffle on band hashes finds the buckets of two sets or more. Only
       counts and numbers travel, whatever the bucket's size.
    3. Sets that buckets connect form a candidate component. It is verified as
       a whole, or bucket by bucket where that moves fewer rows (a pair then
       counts in the smallest bucket both share). A unit of more than ``PART``
       sets is cut into parts, and every two parts meet in a task of their own.
    4. Texts of candidates are shingled again and all pairs of a unit are
       verified on their full sets. No list of pairs leaves a task: only the
       number of links of each set and a spanning forest of the links.

    Returns ``id_col, rep_id, class_id, n_links`` for every row: the smallest
    id with the same n-gram set, the smallest id that links lead to, and the
    number of other rows linked directly (copies included). Texts that are null
    or have no words link with nothing; very long texts are read whole. Repeated
    rows count as rows of their own. Null ids sort above all others, so one
    names a class only if no member has an id. An empty table gives no rows;
    other columns are not read, so none can clash. Pairs whose similarity is
    exactly the threshold are found with probability ``recall`` or more, closer
    ones more surely.
    """
    return _classes(docs, id_col, text_col, n, similarity, recall).select(
        F.col("id").alias(id_col),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("rep_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): with a hash of the text, by which rows of one id are told apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """(id, mark, key, n_links, rep, class) of every row; ``rep`` and ``class`` are (no_id, id, mark) of the row that names them."""
    bands, rows = bands_for(similarity, recall)
    source = _marked(docs, id_col, text_col)
    width = partitions(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(n), BandHasher(bands, rows)
        for batch in batches:
            keys, sizes, values = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                grams = shingler.of(text)
                keys.append(_key(grams) if len(grams) else None)
                sizes.append(len(grams))
                values.append(hasher.of(grams).tolist() if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["id", "mark", "key", "size", "bands"]
            )

    id_type = source.schema["id"].dataType.simpleString()
    sketches = stage(source.mapInArrow(lambda batches: released(sketch(batches)), f"id {id_type}, mark long, key binary, size long, bands array<long>"), "ngram-sketches")
    reps = stage(
        sketches.filter("key is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("rep"),
            F.count("*").alias("copies"),
            F.min("size").alias("weight"),
            F.first("bands").alias("bands"),
        )
        .withColumn("u", F.monotonically_increasing_id()),
        "ngram-sets",
    )
    counts, forest = _verified(source, reps, _units(reps), n, similarity, width)
    linked = components(forest)
    named = reps.select("u", "rep").join(linked.withColumnRenamed("id", "u"), "u").groupBy("component").agg(F.min("rep").alias("class"))
    facts = (
        reps.select("key", "u", "rep", "copies")
        .join(counts.groupBy("u").agg(F.sum("n").alias("n")), "u", "left")
        .join(linked.join(named, "component").select(F.col("id").alias("u"), "class"), "u", "left")
        .select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class", "rep").alias("class"))
    )
    return sketches.select("id", "mark", "key").join(facts, "key", "left")


def _units(reps: DataFrame) -> DataFrame:
    """(unit, parts, u, buckets): what is verified together; ``buckets`` is null for whole components."""
    members = shared_buckets(reps.select("u", "weight", F.explode("bands").alias("bucket")), PART, PART_GRAMS, "ngram")
    joined = components(members.filter("u <> hub").select(F.col("u").alias("a"), F.col("hub").alias("b")).distinct())
    grouped = members.groupBy("u").agg(F.collect_list(F.struct("bucket", "parts")).alias("buckets"), F.sum("parts").alias("rows_by_bucket"))
    labelled = stage(grouped.join(joined, F.col("u") == F.col("id")).join(reps.select("u", "weight"), "u").select("u", "weight", "component", "buckets", "rows_by_bucket"), "ngram-labelled")
    sizes = labelled.groupBy("component").agg(F.count("*").alias("m"), F.sum("weight").alias("w"), F.sum("rows_by_bucket").alias("r"))
    sizes = sizes.withColumn("parts", cut("m", "w", PART, PART_GRAMS)).withColumn("whole", F.col("m") * F.col("parts") <= F.col("r"))
    decided = labelled.join(sizes.select("component", "parts", "whole"), "component")
    whole = decided.filter("whole").select(F.col("component").alias("unit"), "parts", "u", F.lit(None).cast("array<long>").alias("buckets"))
    apart = decided.filter("not whole").select("u", F.col("buckets.bucket").alias("all"), F.explode("buckets").alias("b"))
    return whole.unionByName(apart.select(F.col("b.bucket").alias("unit"), F.col("b.parts").alias("parts"), "u", F.col("all").alias("buckets")))


def _verified(source: DataFrame, reps: DataFrame, units: DataFrame, n: int, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    units = stage(units.withColumn("by_bucket", F.col("buckets").isNotNull()), "ngram-units")
    wanted = stage(reps.select("key", "rep", "u", "copies").join(units.select("u").distinct(), "u"), "ngram-wanted")
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("rep.id").alias("rep"), F.col("rep.mark").alias("rep_mark"), "u", "key", "copies")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            start = 0
            for group in blocks(batch.column(0).cast(pa.large_binary()).to_pylist(), 2_000_000):
                grams = [shingler.of(t) for t in group]
                part = batch.slice(start, len(group))
                start += len(group)
                right = pa.array([_key(g) == k for g, k in zip(grams, part.column(2).to_pylist())])
                made = pa.RecordBatch.from_arrays([part.column(1), part.column(3), pa.array([g.tobytes() for g in grams], pa.binary())], names=["u", "copies", "grams"])
                yield made.filter(right)  # ids that repeat with another text

    texts = source.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))).select("text", "u", "key", "copies")
    sets = texts.mapInArrow(lambda batches: released(shingle(batches)), "u long, copies long, grams binary")
    keys = ["unit", "by_bucket", "p1", "p2"]
    met = dealt(sets.join(units, "u"), "by_bucket", "copies", "grams", "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            found = _links(group, similarity)
            if found is not None:
                yield found

    found = stage(met.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: released(compare(batches)), "u long, n long, b long"), "ngram-links")
    return found.filter("n > 0").select("u", "n"), found.filter("u <> b").select(F.col("u").alias("a"), "b").distinct()


def _links(group: pa.Table, similarity: float) -> pa.RecordBatch | None:
    """Counts and forest of the links in a unit, or between two of its parts."""
    _, once = np.unique(group.column("u").to_numpy(), return_index=True)
    group = group.take(pa.array(np.sort(once)))
    p1, p2, here = (group.column(c)[0].as_py() for c in ("p1", "p2", "unit"))
    part, u, copies = (group.column(c).to_numpy() for c in ("part", "u", "copies"))
    left, right = np.flatnonzero(part == p1), np.flatnonzero(part == p2)
    if not len(left) or not len(right) or (p1 == p2 and len(left) < 2):
        return None
    flat, sizes = flattened(group.column("grams"))
    near = jaccard_at_least(flat, sizes, left, right, similarity)
    del flat
    if p1 == p2:
        near &= np.triu(np.ones(near.shape, bool), 1)
    if not near.any():
        return None
    counted = near
    if group.column("by_bucket")[0].as_py():
        earlier = shares_earlier(group.column("buckets"), here, left, right)
        counted = near if earlier is None else near & ~earlier
    count, tree = links_of(near, counted, left, right, copies)
    told = np.flatnonzero((count > 0) | (tree != np.arange(len(u))))
    return pa.RecordBatch.from_arrays([pa.array(u[told]), pa.array(count[told]), pa.array(u[tree[told]])], names=["u", "n", "b"])


def flattened(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all sets one after the other, size of each set) of a binary column, without a copy."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64) // 8
    data = whole.buffers()[2]
    flat = np.frombuffer(data, np.uint64, len(data) // 8) if data is not None else np.zeros(0, np.uint64)
    return flat[ends[0] : ends[-1]], np.diff(ends)


def jaccard_at_least(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets at ``left`` and ``right`` are that similar, as a matrix.

    Exact: n-grams held by two sets or more become columns, and products of
    0/1 matrices, some hundred columns at a time, count what two sets share.
    ``flat`` holds the n-grams of all sets one after the other. Beside the
    matrices some 40 bytes are held for each n-gram.
    """
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    del order
    fresh = flat[1:] != flat[:-1]
    alone = np.concatenate(([True], fresh)) & np.concatenate((fresh, [True])) if len(flat) else np.zeros(0, bool)
    flat, row = flat[~alone], row[~alone]
    column = np.cumsum(np.concatenate(([False], flat[1:] != flat[:-1])), dtype=np.int32) if len(flat) else np.zeros(0, np.int32)
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24 are exact
    width = 1024
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        matrix = np.zeros((len(sizes), min(width, int(column[-1]) + 1 - c)), np.float32)
        matrix[row[a:b], column[a:b] - c] = 1
        both += matrix[left] @ matrix[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= similarity * union - 1e-9


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that name their class, with all their columns: the smallest id of each class stays.

    A row stays by its id and its text, so of rows that share an id (or have
    none) only those with the naming text stay; rows that repeat both stay
    together. Texts that are null or have no words are classes of their own.
    An empty table gives no rows; columns may have any names.
    """
    found = _classes(docs, id_col, text_col, **how)
    names = F.col("key").isNull() | (F.col("id").eqNullSafe(F.col("class.id")) & (F.col("mark") == F.col("class.mark")))
    own_id, own_mark = free(docs.columns, "__id", "__mark")
    kept = found.filter(names).select(F.col("id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (mark == F.col(own_mark)), "left_semi")
