"""Mixing of sources to target weights by equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import free, ranged_prefix, stage

#: Blocks that a source has at least, if it has as many words.
LEAST_BLOCKS = 256
#: Sources of a mix at most, and sources of which the quotas are broadcast.
MOST_SOURCES, BROADCAST_SOURCES = 1_000_000, 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``cap`` times its size.

    What a capped source cannot take goes to the others by weight, again and
    again until none is above its cap.
    """
    sizes, weights = np.asarray(sizes, np.int64), np.asarray(weights, float)
    capped = np.zeros(len(sizes), bool)
    while True:
        left, share = total - cap * int(sizes[capped].sum()), weights[~capped].sum()
        unit = left / share if share else 0.0
        above = ~capped & (weights * unit > cap * sizes)
        if not above.any():
            return np.where(capped, cap * sizes, weights * unit).astype(float)
        capped |= above


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), none beyond ``most``, ties to the earlier source.

    A divisor is found by halving above which just fewer than ``seats``
    quotients lie; only the few quotients of each source next to it are put in
    order. So the cost does not depend on the number of seats.
    """
    votes = np.asarray(votes, float)
    most = np.where(votes > 0, seats if most is None else most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))

    def given(divisor: float) -> np.ndarray:
        # quotients above the divisor: v / (2 k + 1) > divisor
        return np.minimum(most, np.maximum(0, np.ceil((votes / divisor - 1) / 2)).astype(np.int64))

    if not seats:
        return np.zeros(len(votes), np.int64)
    # one vote has no more seats than votes / (2 divisor) and a half
    low, high = max(float(votes.sum()) / (2.0 * (seats + len(votes) + 1)) * 0.5, 1e-300), float(votes.max()) + 1.0
    while int(np.minimum(given(low), most).sum()) < seats:
        low /= 16
    for _ in range(100):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if int(given(middle).sum()) > seats:
            low = middle
        else:
            high = middle
    # two quotients on either side make up for the rounding of the division above
    first, last = np.maximum(given(high) - 2, 0), np.minimum(given(low) + 2, most)
    source = np.repeat(np.arange(len(votes)), last - first)
    seat = np.arange(len(source)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[source]
    best = np.lexsort((source, -(votes[source] / (2 * seat + 1))))[: seats - int(first.sum())]
    return first + np.bincount(source[best], minlength=len(votes)).astype(np.int64)


@dataclass(frozen=True)
class MixPlan:
    """What the mix takes of each source; ``upto[i, s]`` words of source i go to the first s shards together."""

    sizes: np.ndarray
    targets: np.ndarray
    block: np.ndarray
    n_blocks: np.ndarray
    upto: np.ndarray
    step: np.ndarray
    shift: np.ndarray

    @property
    def quotas(self) -> np.ndarray:
        return self.upto[:, -1]

    @property
    def shard_quotas(self) -> np.ndarray:
        return np.diff(self.upto, axis=1)


def plan_mix(sizes: list[int], weights: list[float], block: int, shards: int = 8, cap: float = 3.0, seed: int = 11) -> MixPlan:
    """Quotas of words for every source and shard.

    Targets are apportioned by highest quotients in seats of one word, the
    blocks of equal size that even the smallest source has. The seats in the
    order of their quotients are dealt to the shards in runs of equal length, so
    the first s shards together hold an apportionment of their own; quotas of
    single shards are integers, add up to the source's quota, and all shards
    have as many words, but for one. What fills a quota are blocks of ``block``
    words, or shorter ones in a source that has fewer than ``LEAST_BLOCKS`` of
    them. Blocks of a source stand in a seeded order (``step * j + shift`` modulo
    their number, step coprime to it), which the mix goes through as often as
    the quota asks; shard after shard takes its quota of that order.
    """
    n = np.asarray(sizes, np.int64)
    whole = int(n.sum())
    targets = capped_targets(n, np.asarray(weights, float), whole, cap)
    most = np.floor(cap * n).astype(np.int64)
    upto = np.stack([sainte_lague(targets, whole * s // shards, most) for s in range(shards + 1)], axis=1) if len(n) else np.zeros((0, shards + 1), np.int64)
    length = np.clip(n // LEAST_BLOCKS, 1, block)
    count = -(-n // length)
    # Multipliers that spread consecutive numbers.
    at = np.arange(1, len(n) + 1, dtype=np.int64)
    step, shift = (at * 2654435761 + seed * 40503) % (1 << 20), (at * 40503 + seed * 2654435761) % (1 << 20)
    one = np.maximum(count, 1)
    step = np.where(step % one == 0, 1, step % one)
    while (open_ := np.gcd(step, one) != 1).any():
        step[open_] += 1
    return MixPlan(n, targets, length, count, upto, step, shift % one)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = 64,
    shards: int = 8,
    cap: float = 3.0,
    seed: int = 11,
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
) -> DataFrame:
    """How many words of every document a mix of all sources takes.

    The words of a source form one stream, its documents in a seeded order;
    prefix sums over per-partition totals give every document its place, so a
    source with a third of all rows is spread like any other. The stream falls
    into blocks of ``block`` words or fewer (the last one shorter). Targets share
    all words by weight with a cap of ``cap`` times the source; Sainte-Lague turns
    them into integer quotas of words for each source and shard, and each shard
    takes its quota of the source's blocks in their seeded order, the last block
    in part. So a source's words are its target, rounded, and words of all
    sources add up. A document is taken for its words in those blocks, at most
    ``cap`` times each.

    Sources are ordered by code point, null last, and weigh ``cycle`` in turn.
    They are counted first: names and sizes of up to ``MOST_SOURCES`` come to the
    driver, more raise an error. Their quotas are broadcast up to
    ``BROADCAST_SOURCES`` and else joined, where adaptive execution splits a large source.
    Texts that are null or have no word have size 0 and are never taken; very
    long texts count whole. Null ids are ids like others; repeated rows are rows
    of their own. An empty table gives no rows. Other columns are not read, so
    none can clash.

    Returns ``id_col, size, source_size, target, taken, shard_words, copies``
    for every row. ``shard_words`` has the words that each shard takes and
    ``taken`` is their sum. ``copies`` is ``taken`` in whole documents, rounded
    up or down by a seeded draw so that the expected words of a source stay
    those taken.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    return _taken(rows, block, shards, cap, seed, cycle).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "shard_words", "copies")


def _taken(rows: DataFrame, block: int = 64, shards: int = 8, cap: float = 3.0, seed: int = 11, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The mix of rows of (id, source, size); other columns pass through."""
    spread = F.xxhash64(F.lit(seed), "id", "size")
    placed = stage(ranged_prefix(rows.withColumn("spread", spread), ["spread", "id", "size"], "size", within=["source"], name="mix"), "mix-placed")
    totals = placed.groupBy("source").agg(F.sum("size").cast("long").alias("n"))
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"a mix is for at most {MOST_SOURCES} sources")
    named = totals.toArrow()
    # strings are ordered by their bytes in UTF-8, which is by code point
    named = named.take(pc.sort_indices(named, sort_keys=[("source", "ascending")], null_placement="at_end"))
    plan = plan_mix(named.column("n").to_numpy(), [cycle[i % len(cycle)] for i in range(named.num_rows)], block, shards, cap, seed)
    last = plan.n_blocks - 1
    columns = {
        "p_source": named.column("source"), "source_size": pa.array(plan.sizes), "target": pa.array(plan.targets), "length": pa.array(plan.block), "n_blocks": pa.array(plan.n_blocks),
        "upto": pa.array(list(plan.upto), pa.list_(pa.int64())), "step": pa.array(plan.step), "shift": pa.array(plan.shift),
        # the last block may be short: its place in the seeded order, and the words it lacks
        "short_rank": pa.array((plan.step * last + plan.shift) % np.maximum(plan.n_blocks, 1)), "lacks": pa.array(plan.n_blocks * plan.block - plan.sizes),
    }
    table = rows.sparkSession.createDataFrame(pa.table(columns))
    joined = placed.join(F.broadcast(table) if named.num_rows <= BROADCAST_SOURCES else table, F.col("source").eqNullSafe(F.col("p_source")))
    length, n = F.col("length"), F.col("source_size")
    end = F.col("__before") + F.col("size")
    first_block, last_block = F.floor(F.col("__before") / length), F.floor((end - 1) / length)

    def place(j: Column) -> Column:
        """The words of a document in block j: where they stand in a lap through the seeded order, and how many."""
        rank = F.pmod(F.col("step") * j + F.col("shift"), F.col("n_blocks"))
        begin = F.greatest(F.col("__before"), j * length)
        lap = rank * length - F.when(rank > F.col("short_rank"), F.col("lacks")).otherwise(0) + begin - j * length
        return F.struct((F.least(end, (j + 1) * length) - begin).alias("words"), lap.alias("lap"))

    def words_of(upto: Column) -> Column:
        """Words that the first ``upto`` of the endless laps take of a document."""
        full, rest = F.floor(upto / n), F.pmod(upto, n)
        return F.aggregate("places", F.lit(0).cast("long"), lambda acc, p: acc + (p["words"] * full + F.greatest(F.lit(0), F.least(p["words"], rest - p["lap"]))).cast("long"))

    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), F.lit(1 << 20)) / (1 << 20)
    none = F.array().cast("array<struct<words:bigint,lap:bigint>>")
    return (
        joined.withColumn("places", F.when(F.col("size") > 0, F.transform(F.sequence(first_block, last_block), place)).otherwise(none))
        .withColumn("so_far", F.transform("upto", words_of))
        .withColumn("shard_words", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.element_at("so_far", s + 1) - F.element_at("so_far", s)))
        .withColumn("taken", F.element_at("so_far", -1))
        .withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(0).cast("int"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of a mix, with all their columns, whatever their names: each row as often as the mix takes it.

    Rows of one id, source and text (repeated rows) are each taken as often as
    the one taken least; rows that share only an id, or have none, are told
    apart by source and text. Documents that the mix does not take, those
    without a word among them, are left out; an empty table gives no rows.
    """
    id_, source, mark, copies, time = free(docs.columns, "__id", "__source", "__mark", "__copies", "__time")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), marked.alias("mark"))
    plan = _taken(rows, **how).groupBy(F.col("id").alias(id_), F.col("source").alias(source), F.col("mark").alias(mark)).agg(F.min("copies").alias(copies)).filter(F.col(copies) > 0)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(source)) & (marked == F.col(mark))
    return docs.join(plan, same).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
