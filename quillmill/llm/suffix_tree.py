"""Language-model scores by a probabilistic suffix tree.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with ASCII letters in lower case, and
one end after each text. The tree's symbols are the common words, the end, and
for all other words classes by their last bytes: a token's probability is that
of its symbol after the longest retained suffix of the symbols before it, times
that of the word among the words of its symbol. So contexts stay well counted
while every word has its own probability.

The tree is never whole in one place. All contexts that end in one symbol are a
branch, and what a token needs lies in the branch of the symbol before it; so
tokens travel once, with the symbols before them, to the part of the corpus that
has their branch, which grows it and scores them. Contexts too common for one
part are counted before, and their tokens dealt by the symbol before them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import blocks, gathered, held_out, partitions, released, sorted_groups, stage

END = b"\n"
#: Bytes of text whose words share one table.
BLOCK_BYTES = 32_000_000
#: Bits of a symbol in a key; the number of a context stands above them.
BITS = np.uint64(32)
#: Classes of the words that are not common.
CLASSES = 2048
#: Distinct keys that a counting task holds at most; then it hands on what it has.
TASK_KEYS = 2_000_000
#: Parts of the vocabulary at least; as many as the session has shuffle partitions where those are more.
BUCKETS = 256
#: Tokens of a part of the tree on average; a context before as many training tokens is dealt to parts of its own.
PART_TOKENS = 1_500_000
#: Tokens of the texts that are coded and dealt at once.
CHUNK_TOKENS = 1_000_000


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one kind, each byte of them compressed apart."""
    codec, out = pa.Codec("zstd", 1), []
    for numbers in columns:
        planes = np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T)
        parts = [codec.compress(x.tobytes(), asbytes=True) for x in planes]
        out += [np.array([len(numbers), *map(len, parts)], np.int64).tobytes(), *parts]
    return b"".join(out)


def columns_of(data: bytes, kind=np.int32) -> list[np.ndarray]:
    """The columns that ``packed`` was given."""
    codec, width, at, out = pa.Codec("zstd"), np.dtype(kind).itemsize, 0, []
    while at < len(data):
        n, *sizes = np.frombuffer(data, np.int64, 1 + width, at).tolist()
        at += 8 * (1 + width)
        planes = np.empty((n, width), np.uint8)
        for i, size in enumerate(sizes):
            planes[:, i] = np.frombuffer(codec.decompress(data[at : at + size], n, asbytes=True), np.uint8)
            at += size
        out.append(planes.reshape(-1).view(kind))
    return out


def unpacked(data: bytes, kind=np.int32) -> np.ndarray:
    return columns_of(data, kind)[0]


@dataclass(frozen=True)
class Alphabet:
    """Symbol numbers: 0 the end, then classes, then the common words by their place in the bucket, then the bucket.

    Words have places by falling count, so frequent ones have low numbers,
    which take few bytes. Equal counts follow each other: ``starts`` and
    ``counts``, the runs of equal training counts of each bucket, tell the
    count of any word. ``common`` has the buckets' common words, ``times`` the
    classes' training tokens, ``inside`` their words besides (the end first,
    which is its only word).
    """

    common: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    times: np.ndarray
    inside: np.ndarray

    @staticmethod
    def of(ends: int, buckets: list, size: int) -> Alphabet:
        """From the rows of ``_vocabulary`` that sum up the ``size`` buckets."""
        common, times, inside = np.zeros(size, np.int64), np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
        inside[0], times[0] = ends + (ends > 0), ends
        starts, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for row in sorted(buckets, key=lambda r: r["bucket"]):
            n, w = unpacked(row["class_n"], np.int64), unpacked(row["class_w"], np.int64)
            times[1:] += n
            inside[1:] += n + w
            common[row["bucket"]] = row["common"]
            starts.append((row["bucket"] << 32) + unpacked(row["run"], np.int64))
            counts.append(unpacked(row["run_c"], np.int64))
        if (common.max() + 1) * size + CLASSES >= 1 << 31:
            raise ValueError("too many common words; raise min_context")
        return Alphabet(common, np.concatenate(starts), np.concatenate(counts), times, inside)

    def __len__(self) -> int:
        return CLASSES + 1 + int(self.common.sum())

    def number(self, bucket: int, place: np.ndarray) -> np.ndarray:
        return CLASSES + 1 + place * len(self.common) + bucket

    def seen(self, symbols: np.ndarray) -> np.ndarray:
        """Training tokens of each symbol."""
        symbols = symbols.astype(np.int64)
        place, bucket = np.divmod(np.maximum(symbols - CLASSES - 1, 0), len(self.common))
        own = self.counts[np.searchsorted(self.starts, (bucket << 32) + place, "right") - 1]
        return np.where(symbols <= CLASSES, self.times[np.minimum(symbols, CLASSES)], own)

    def frequent(self, least: int) -> np.ndarray:
        """The symbols with at least so many training tokens."""
        out = [np.flatnonzero(self.times >= least)]
        for i in np.flatnonzero(self.counts >= max(least, 1)):
            bucket, place = self.starts[i] >> 32, self.starts[i] & 0xFFFFFFFF
            last = i + 1 < len(self.starts) and self.starts[i + 1] >> 32 == bucket
            out.append(self.number(bucket, np.arange(place, self.starts[i + 1] & 0xFFFFFFFF if last else self.common[bucket])))
        return np.sort(np.concatenate(out))

    def root(self, symbols: np.ndarray, total: int) -> np.ndarray:
        """log10 probabilities of symbols without context."""
        return np.log10((self.seen(symbols) + 1.0) / (total + len(self) + 1))


def laid_out(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, places of coded symbols, lengths of their longest contexts, their texts): an end before and after each text."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    stream = np.zeros(int(sizes.sum()), np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(stream)) - starts[owner]
    inner = (place > 0) & (place < sizes[owner] - 1)
    stream[inner] = np.concatenate(texts) if texts else 0
    coded = np.flatnonzero(place > 0)
    return stream, coded, np.minimum(place[coded], depth), owner[coded]


class Index:
    """Places of distinct 64-bit keys, by open addressing; an array at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.mask = np.int64((1 << (64 - int(self.shift))) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        todo, at = np.arange(len(keys)), self._start(self.keys)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = free  # of keys for one slot the last stays
            todo = todo[self.slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is a key, the key's place)."""
        place = np.zeros(len(wanted), np.int64)
        found = np.zeros(len(wanted), bool)
        if not len(self.keys):
            return found, place
        at = self._start(wanted)
        slot = self.slots[at]
        found = (slot >= 0) & (self.keys[slot] == wanted)
        place = np.where(found, slot, 0)
        todo = np.flatnonzero(~found & (slot >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == wanted[todo])
            found[todo[hit]] = True
            place[todo[hit]] = slot[hit]
            on = ~hit & (slot >= 0)
            todo, at = todo[on], at[on]
        return found, place


class Numbered(dict):
    """Numbers of words: a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes], kind) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


@dataclass
class Level:
    """Candidate contexts of one length, numbered by their place in ``nodes``.

    ``nodes`` has (number of the context shorter by its oldest symbol, that
    symbol) as keys; ``seen`` has (number, next symbol) with the log10
    probabilities ``value``. Only contexts that are ``kept`` are the tree's.
    """

    nodes: Index
    kept: np.ndarray
    leave: np.ndarray
    seen: Index
    value: np.ndarray


@dataclass
class SuffixTree:
    """log10 probabilities of symbols after the longest retained suffix of what is before them."""

    unseen: float
    single: Index
    single_value: np.ndarray
    levels: list[Level] = field(default_factory=list)

    def log10(self, symbols: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
        """Of each symbol; ``nodes[k]`` is the number of its context of k + 1 symbols, -1 where that is no candidate."""
        out, todo = np.zeros(len(symbols)), np.arange(len(symbols))
        for level, node in zip(self.levels[: len(nodes)][::-1], nodes[::-1]):
            own = node[todo]
            there = own >= 0
            there[there] = level.kept[own[there]]
            here, own = todo[there], own[there]
            found, place = level.seen.find((own.astype(np.uint64) << BITS) | symbols[here])
            out[here[found]] += level.value[place[found]]
            out[here[~found]] += level.leave[own[~found]]
            there[there] = found
            todo = todo[~there]
        found, place = self.single.find(symbols[todo])
        out[todo] += np.where(found, self.single_value[place] if len(self.single_value) else 0.0, self.unseen)
        return out


def walk(indexes: list[Index], stream: np.ndarray, at: np.ndarray, longest: np.ndarray) -> list[np.ndarray]:
    """For each length the numbers of the contexts before the places ``at``, -1 where there is none."""
    out, node = [], np.zeros(len(at), np.int64)
    for k, index in enumerate(indexes, 1):
        here = np.flatnonzero((longest >= k) & (node >= 0))
        found, place = index.find((node[here].astype(np.uint64) << BITS) | stream[at[here] - k])
        node = np.full(len(at), -1, np.int64)
        node[here[found]] = place[found]
        out.append(node)
    return out


def root(symbols: np.ndarray, n: np.ndarray, size: int) -> SuffixTree:
    """The tree without contexts: a symbol has (c + 1) / (all + ``size`` + 1)."""
    total = float(n.sum())
    return SuffixTree(-float(np.log10(total + size + 1)), Index(symbols), np.log10((n + 1.0) / (total + size + 1)))


def grow(tree: SuffixTree, nodes: np.ndarray, m: np.ndarray, d: np.ndarray, key: np.ndarray, n: np.ndarray, min_gain: float) -> None:
    """Add the contexts of one more symbol to the tree, and say which are retained.

    ``nodes`` are the keys of the candidates, ``m`` and ``d`` the tokens and
    the distinct symbols seen after each; ``key``, ``n`` the listed entries
    (number, next symbol). In a context a listed symbol has
    (c + d P') / (m + d) with P' from the longest retained shorter context;
    what remains goes to the others in proportion to P', so probabilities add
    up. A context is retained if its distribution makes the tokens seen in it
    more likely than the shorter context does, by ``min_gain`` nats and one
    more for each listed symbol (count times divergence, less what fitting so
    many numbers gains by itself).
    """
    group, symbol = (key >> BITS).astype(np.int64), key & np.uint64((1 << int(BITS)) - 1)
    above, parent = [], (nodes >> BITS).astype(np.int64)[group]
    for level in reversed(tree.levels):
        above.insert(0, parent)
        parent = (level.nodes.keys >> BITS).astype(np.int64)[parent] if len(level.nodes.keys) else parent
    kept, leave, value = tested(group, n, m, d, tree.log10(symbol, above), min_gain)
    own = kept[group]
    tree.levels.append(Level(Index(nodes), kept, leave, Index(key[own]), value[own]))


def tested(group: np.ndarray, n: np.ndarray, m: np.ndarray, d: np.ndarray, shorter: np.ndarray, min_gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether contexts are retained, log10 of what they leave, log10 probabilities of their listed symbols), as ``grow`` says.

    ``group`` and ``n`` are the contexts and counts of the listed symbols, ``shorter`` their log10 P'.
    """
    n, m, d, shorter = n.astype(np.float64), m.astype(np.float64), d.astype(np.float64), 10**shorter
    p = (n + d[group] * shorter) / (m + d)[group]
    size = len(m)
    leave = np.log(np.maximum(1 - np.bincount(group, p, size), 1e-12) / np.maximum(1 - np.bincount(group, shorter, size), 1e-12))
    gain = np.bincount(group, n * np.log(p / shorter), size) + (m - np.bincount(group, n, size)) * leave
    return gain >= min_gain + np.bincount(group, minlength=size), leave / np.log(10), np.log10(p)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each key among the distinct ones, a place of each distinct key)."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def grown(last: np.ndarray, before: list[np.ndarray], training: np.ndarray, shared: list[tuple[np.ndarray, np.ndarray]], root, min_gain: float, min_context: int, min_entry: int) -> np.ndarray:
    """log10 probabilities of the symbols ``last`` under the tree that all tokens of their branches make.

    ``before[k]`` is the symbol k + 1 places before each (-1: none). Contexts
    of the first lengths may be ``shared``: the same for all ``last`` and more
    tokens elsewhere, so that all symbols after them (ascending) come with their counts.
    """
    value = root(last)
    listed_before = value_before = None
    for symbols, n in shared:
        shorter = root(symbols) if value_before is None else value_before[np.searchsorted(listed_before, symbols)]
        listed = n >= min_entry
        kept, leave, own = tested(np.zeros(int(listed.sum()), np.int64), n[listed], np.array([n.sum()]), np.array([len(n)]), shorter[listed], min_gain)
        if kept[0]:
            found = np.minimum(np.searchsorted(symbols, last), len(symbols) - 1)
            value, shorter = value + leave[0], shorter + leave[0]
            shorter[listed] = own
            there = (symbols[found] == last) & listed[found]
            value[there] = shorter[found[there]]
        listed_before, value_before = symbols, shorter
    at, node = np.arange(len(last)), np.zeros(len(last), np.int64)
    for k in range(len(shared), len(before)):
        on = before[k][at] >= 0
        at, node = at[on], node[on]
        if not len(at):
            break
        node, _ = _numbered((node << int(BITS)) | before[k][at])
        m = np.bincount(node, training[at])
        on = m[node] >= min_context  # longer contexts of others are rarer still
        at = at[on]
        if not len(at):
            break
        node, there = _numbered(node[on])
        m = np.bincount(node, training[at])
        entry, one = _numbered((node << int(BITS)) | last[at])
        n, group = np.bincount(entry, training[at]), node[one]
        d = np.bincount(group, n > 0, len(m))
        listed = n >= min_entry
        kept, leave, own = tested(group[listed], n[listed], m, d, value[at[one[listed]]], min_gain)
        log = np.full(len(n), np.nan)
        log[listed] = own
        log = log[entry]
        value[at] = np.where(kept[node], np.where(np.isnan(log), value[at] + leave[node], log), value[at])
    return value


def longer(indexes: list[Index], paths: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node keys, paths) of contexts made of a context and a symbol seen after it, from entries ``key``.

    ``paths`` has the symbols of every context of the last length, oldest
    first. A context so long is known by its oldest symbol and the number of
    the rest, which is at least as common and so a candidate too (unless the
    bound on listed symbols left it out; then this context is none).
    """
    return _longer(indexes, paths, key, key)[:2]


def _longer(indexes: list[Index], paths: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``longer``, and ``n`` of the entries that are left."""
    made = np.column_stack([paths[(key >> BITS).astype(np.int64)], key & np.uint64((1 << int(BITS)) - 1)])
    node, there = np.zeros(len(made), np.int64), np.ones(len(made), bool)
    for k, index in enumerate(indexes, 1):
        found, node = index.find((node.astype(np.uint64) << BITS) | made[:, -k])
        there &= found
    return ((node.astype(np.uint64) << BITS) | made[:, 0])[there], made[there], n[there]


def _source(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), held_out(F.col(f"`{id_col}`"), modulus, remainder).alias("held"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _tables(source: DataFrame, buckets: int) -> DataFrame:
    """Texts as word numbers, and the words of each block of texts with their training counts.

    Rows of three kinds: a document's id and whether it is held out; some
    texts' lengths and word numbers; the words of a block that fall into a
    bucket. Words are numbered from 1 by falling count in the block; ``order``
    has their numbers in the order of the buckets. 0 is the end.
    """
    id_type = source.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in gathered(batches, BLOCK_BYTES):
            start, id_t = 0, batch.schema.field(0).type
            for group in blocks(batch.column(2).cast(pa.large_binary()).to_pylist(), BLOCK_BYTES):
                part = batch.slice(start, len(group))
                start += len(group)
                block += 1
                table = Numbered()
                texts = [table.of(text.lower().split(), np.int32) for text in group]
                words = list(table)
                bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
                often = np.bincount(np.concatenate(texts), minlength=len(words))
                number = np.empty(len(words), np.int32)
                number[np.argsort(-often, kind="stable")] = np.arange(1, len(words) + 1, dtype=np.int32)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                c, at = np.zeros(len(words) + 1, np.int64), 0
                yield _rows(block, id_t, at=pa.array(np.arange(len(group))), id=part.column(0), held=part.column(1))
                for some in blocks(texts, CHUNK_TOKENS):
                    sizes, own = np.array([len(t) for t in some], np.int32), held[at : at + len(some)]
                    ids = number[np.concatenate(some)]
                    c += np.bincount(ids[~np.repeat(own, sizes)], minlength=len(c))
                    yield _rows(block, id_t, at=pa.array([at]), sizes=[packed(sizes)], held_ones=[packed(own)], ids=[packed(ids)])
                    at += len(some)
                order = np.argsort(bucket, kind="stable")
                yield _rows(block, id_t, order=[packed(number[order])])
                c = c[number[order]]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    i, j = ends[b], ends[b + 1]
                    yield _rows(block, id_t, bucket=pa.array([b], pa.int32()), words=[b" ".join([words[x] for x in order[i:j]])], counts=[packed(c[i:j])])

    return stage(source.mapInArrow(lambda batches: released(split(batches)), f"block long, at long, id {id_type}, held boolean, sizes binary, held_ones binary, ids binary, order binary, bucket int, words binary, counts binary"), "lm-tables")


def _rows(block: int, id_t: pa.DataType, **columns) -> pa.RecordBatch:
    kinds = {"at": pa.int64(), "id": id_t, "held": pa.bool_(), "sizes": pa.binary(), "held_ones": pa.binary(), "ids": pa.binary(), "order": pa.binary(), "bucket": pa.int32(), "words": pa.binary(), "counts": pa.binary()}
    m = len(next(iter(columns.values())))
    there = {k: x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, block, np.int64)), *(there.get(k, pa.nulls(m, t)) for k, t in kinds.items())], names=["block", *kinds])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[bytes], np.ndarray, list[np.ndarray]]]:
    """(bucket, its rows, its words by falling training count, these counts, the places of each row's words)."""
    for group in sorted_groups(batches, ["bucket"]):
        table, places, c = Numbered(), [], []
        for row in group.column("words"):
            places.append(table.of(row.as_py().split(b" "), np.int64))
        for row in group.column("counts"):
            c.append(unpacked(row.as_py(), np.int64))
        total = np.bincount(np.concatenate(places), np.concatenate(c), len(table)).astype(np.int64)
        words = list(table)
        order = np.argsort(-total, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield group.column("bucket")[0].as_py(), group, [words[i] for i in order], total[order], [place[x] for x in places]


def _buckets(df: DataFrame) -> int:
    return max(BUCKETS, partitions(df.sparkSession))


def _dealt(tables: DataFrame) -> DataFrame:
    return tables.filter("words is not null").select("block", "bucket", "words", "counts").repartition(min(_buckets(tables), 2 * partitions(tables.sparkSession)), "bucket").sortWithinPartitions("bucket", "block")


def _word_counts(tables: DataFrame) -> DataFrame:
    """The training count of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, total, _ in _merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array(total)], names=["c"])

    return stage(_dealt(tables).mapInArrow(lambda batches: released(count(batches)), "c long"), "lm-counts")


def _vocabulary(tables: DataFrame, least: int) -> DataFrame:
    """Replies to the blocks' words, and a row that sums up each bucket.

    A reply has for each word its place in the bucket if it is common, else
    -1 - (class * ``least`` + its count); common words stand ``least`` times.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"block": pa.int64(), "bucket": pa.int32(), "reply": pa.binary(), "common": pa.int64(), "seen": pa.int64(), "n": pa.int64(), "class_n": pa.binary(), "class_w": pa.binary(), "run": pa.binary(), "run_c": pa.binary()}
        for bucket, group, words, total, places in _merged(batches):
            common = int(np.searchsorted(-total, -least, "right"))
            kind = np.fromiter((zlib.crc32(w[-3:]) % CLASSES for w in words[common:]), np.int64, len(words) - common)
            code = np.concatenate([np.arange(common), -1 - (kind * least + total[common:])])
            for block, place in zip(group.column("block").to_pylist(), places):
                row = {"block": block, "bucket": bucket, "reply": packed(code[place])}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(k)], t) for k, t in kinds.items()], names=list(kinds))
            run = np.flatnonzero(np.diff(total[:common], prepend=-1))
            row = {"bucket": bucket, "common": common, "seen": int((total > 0).sum()), "n": int(total.sum()), "run": packed(run), "run_c": packed(total[run])}
            row |= {"class_n": packed(np.bincount(kind, total[common:], CLASSES).astype(np.int64)), "class_w": packed(np.bincount(kind, total[common:] > 0, CLASSES).astype(np.int64))}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(k)], t) for k, t in kinds.items()], names=list(kinds))

    return stage(_dealt(tables).mapInArrow(lambda batches: released(merge(batches)), "block long, bucket int, reply binary, common long, seen long, n long, class_n binary, class_w binary, run binary, run_c binary"), "lm-vocabulary")


def _bound(counted: DataFrame, column: str, least: int, most: int) -> int:
    """``least``, doubled until at most ``most`` rows have as much in ``column``."""
    steps = [least << i for i in range(24)]
    there = counted.agg(*[F.count_if(F.col(column) >= x).alias(f"s{i}") for i, x in enumerate(steps)]).collect()[0]
    return next((x for i, x in enumerate(steps) if there[f"s{i}"] <= most), steps[-1])


def _texts(batch: pa.RecordBatch, training: bool = False) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(block, number of the first, symbols, which are held out) of the texts of each row of ``_coded``."""
    for block, at, sizes, held, symbols in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "sizes", "held_ones", "symbols"))):
        texts, held = np.split(unpacked(symbols), np.cumsum(unpacked(sizes))[:-1]), unpacked(held, bool)
        yield block, at, [t for t, h in zip(texts, held) if not h] if training else texts, held


def _followers(coded: DataFrame, indexes: list[Index], name: str) -> DataFrame:
    """How often each symbol stands after each context of the last of ``indexes`` in training texts: ``key, n``."""
    sent, k = coded.sparkSession.sparkContext.broadcast(indexes), len(indexes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            for _, _, texts, _ in _texts(batch, training=True):
                for group in blocks(texts, 500_000):
                    stream, at, longest, _ = laid_out(group, k)
                    at = at[longest >= k]
                    node = walk(sent.value, stream, at, np.full(len(at), k))[-1]
                    on = node >= 0
                    held.append((node[on].astype(np.uint64) << BITS) | stream[at[on]])
                    waiting += int(on.sum())
                    if waiting > 1_000_000:
                        found, held, waiting = _added(found, np.unique(np.concatenate(held), return_counts=True)), [], 0
                        if len(found[0]) > TASK_KEYS:
                            yield from _counts(found)
                            found = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if held:
            found = _added(found, np.unique(np.concatenate(held), return_counts=True))
        yield from _counts(found)

    counted = coded.select("block", "at", "sizes", "held_ones", "symbols").mapInArrow(lambda batches: released(count(batches)), "key long, n long")
    return stage(counted.groupBy("key").agg(F.sum("n").alias("n")), name)


def learn_tree(coded: DataFrame, single: tuple[np.ndarray, np.ndarray], size: int, depth: int, min_gain: float, min_context: int, min_entry: int, most_entries: int) -> SuffixTree:
    """The tree of all training texts within a bound, grown by one symbol of context at a time.

    For callers that want a tree which driver and tasks can hold. ``coded`` has
    the texts' symbols. Candidates are the contexts that stand ``min_context``
    times, and the next symbols seen ``min_entry`` times after one are listed;
    what is rarer is shared in what the context leaves. Each length takes one
    pass over the symbols, whose counts Spark sums. The passes end when no
    longer context is a candidate or ``depth`` is reached. Where more than
    ``most_entries`` next symbols of a length would be listed, the bound on
    them doubles until they fit.
    """
    order = np.argsort(single[0])
    symbols, n = single[0][order].astype(np.uint64), single[1][order]
    tree = root(symbols, n, size)
    nodes = symbols[n >= min_context]
    paths = nodes[:, None]
    for _ in range(depth):
        if not len(nodes):
            break
        counted = _followers(coded, [*(level.nodes for level in tree.levels), Index(nodes)], "lm-follow")
        heads = counted.groupBy(F.shiftright("key", int(BITS)).alias("node")).agg(F.sum("n").alias("m"), F.count("*").alias("d")).toArrow()
        m, d = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        m[heads["node"].to_numpy()], d[heads["node"].to_numpy()] = heads["m"].to_numpy(), heads["d"].to_numpy()
        key, n = _collected(counted.filter(F.col("n") >= _bound(counted, "n", min_entry, most_entries)))
        grow(tree, nodes, m, d, key, n, min_gain)
        nodes, paths = longer([level.nodes for level in tree.levels], paths, key[n >= min_context])
    return tree


def _collected(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    entries = counted.toArrow()
    key, n = entries["key"].to_numpy(), entries["n"].to_numpy()
    order = np.argsort(key)
    return key[order].astype(np.uint64), n[order]


@dataclass
class Deal:
    """Which part a token goes to: that of the longest context before it that is one of the ``indexes``, else of the symbol before it.

    The first ``parts`` are for the latter. Context ``i`` of length k has
    ``many[k - 1][i]`` parts from ``first[k - 1][i]`` on, dealt by the next
    symbol of its context, or by the token itself where no longer context is.
    """

    parts: int
    depth: int
    indexes: list[Index] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    many: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, nodes: np.ndarray, n: np.ndarray) -> None:
        many = -(-n // PART_TOKENS)
        self.size = self.size or self.parts
        self.indexes.append(Index(nodes))
        self.first.append(self.size + np.cumsum(many) - many)
        self.many.append(many)
        self.size += int(many.sum())

    def part(self, last: np.ndarray, before: list[np.ndarray], nodes: list[np.ndarray]) -> np.ndarray:
        def mixed(x):
            return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

        out = mixed(before[0]) % self.parts
        for k, node in enumerate(nodes, 1):
            on = np.flatnonzero(node >= 0)
            by = np.where(before[k] < 0, last, before[k]) if k < self.depth else last
            out[on] = self.first[k - 1][node[on]] + mixed(by[on]) % self.many[k - 1][node[on]]
        return out

    def readers(self) -> list[tuple[int, int, int]]:
        """(length, context, part) for every part that needs what stands after the context."""
        out = []
        for k, (first, many) in enumerate(zip(self.first, self.many), 1):
            for i in range(len(first)):
                node = i
                for j in range(k, 0, -1):
                    out += [(j, node, int(first[i]) + r) for r in range(int(many[i]))]
                    node = int(self.indexes[j - 1].keys[node] >> BITS)
        return out


def _deal(coded: DataFrame, alphabet: Alphabet, tokens: int, depth: int) -> tuple[Deal, list[DataFrame]]:
    """How tokens are dealt, and what stands after the contexts that are too common for a part, by length."""
    deal, after = Deal(max(1, -(-tokens // PART_TOKENS)), depth), []
    nodes = alphabet.frequent(PART_TOKENS).astype(np.uint64)
    n, paths = alphabet.seen(nodes), nodes[:, None]
    while len(nodes) and len(after) < depth:
        deal.add(nodes, n)
        after.append(_followers(coded, deal.indexes, "lm-common"))
        if len(after) == depth:
            break
        key, n = _collected(after[-1].filter(F.col("n") >= PART_TOKENS))
        nodes, paths, n = _longer(deal.indexes, paths, key, n)
    return deal, after


def _windows(coded: DataFrame, deal: Deal) -> DataFrame:
    """Every token with the symbols before it, by part: ``part, length (0), block, at`` and the numbers."""
    sent = coded.sparkSession.sparkContext.broadcast(deal)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = sent.value
        for batch in batches:
            for block, first, texts, held in _texts(batch):
                start = 0
                for some in blocks(texts, 2 * CHUNK_TOKENS):
                    stream, at, longest, owner = laid_out(some, deal.depth)
                    nodes = walk(deal.indexes, stream, at, longest)
                    stream = stream.astype(np.int32)
                    before = [np.where(longest >= k, stream[np.maximum(at - k, 0)], np.int32(-1)) for k in range(1, deal.depth + 1)]
                    last, owner = stream[at], (owner + start).astype(np.int32)
                    part = deal.part(last, before, nodes)
                    order = np.argsort((part << 32) | before[0], kind="stable")
                    first_before, *columns = (x[order] for x in (before[0], last, (owner + np.int32(first)) * 2 + held[owner], *before[1:]))
                    part = part[order]
                    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                    data = [packed(np.diff(first_before[i:j], prepend=np.int32(0)), *(x[i:j] for x in columns)) for i, j in zip(cuts, cuts[1:])]
                    m = len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, block)), pa.array(np.full(m, first + start)), pa.array(data, pa.binary())], names=["part", "length", "block", "at", "data"])
                    start += len(some)

    return coded.select("block", "at", "sizes", "held_ones", "symbols").mapInArrow(lambda batches: released(cut(batches)), "part long, length int, block long, at long, data binary")


def _sent_on(after: DataFrame, length: int, readers: list) -> DataFrame:
    """What stands after common contexts of one length, for each part that reads it, as rows like those of ``_windows``."""
    to: dict[int, list[int]] = {}
    for k, node, part in readers:
        if k == length:
            to.setdefault(node, []).append(part)
    sent = after.sparkSession.sparkContext.broadcast(to)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, i = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 16_000_000):
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(key)
            key, n = key[order], n[order]
            node = key >> int(BITS)
            cuts = np.append(np.flatnonzero(np.diff(node, prepend=-1)), len(node))
            for a, b in zip(cuts, cuts[1:]):
                data, parts, i = packed(key[a:b] & ((1 << int(BITS)) - 1), n[a:b]), sent.value[int(node[a])], i + 1
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(np.full(m, length, np.int32)), pa.array(np.full(m, task, np.int64)), pa.array(np.full(m, i, np.int64)), pa.array([data] * m, pa.binary())], names=["part", "length", "block", "at", "data"])

    return after.mapInArrow(lambda batches: released(send(batches)), "part long, length int, block long, at long, data binary")


def _scored_by_parts(coded: DataFrame, alphabet: Alphabet, total: int, tokens: int, depth: int, min_gain: float, min_context: int, min_entry: int) -> DataFrame:
    """log10 probabilities of the symbols of texts, summed in each part: ``block, part, texts, sums``."""
    deal, after = _deal(coded, alphabet, tokens, depth)
    rows = _windows(coded, deal)
    for k, counted in enumerate(after, 1):
        rows = rows.unionByName(_sent_on(counted, k, deal.readers()))
    sent = coded.sparkSession.sparkContext.broadcast(alphabet)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):  # a part is a task
            length, block = group.column("length").to_numpy(), group.column("block").to_numpy()
            here = np.flatnonzero(length == 0)
            if not len(here):
                continue
            shared = []
            for k in range(1, int(length.max()) + 1):
                some = [columns_of(group.column("data")[int(i)].as_py(), np.int64) for i in np.flatnonzero(length == k)]
                symbols, n = map(np.concatenate, zip(*some))
                order = np.argsort(symbols)
                shared.append((symbols[order], n[order]))
            some = [columns_of(group.column("data")[int(i)].as_py()) for i in here]
            part, block, sizes = group.column("part")[0].as_py(), block[here], [len(x[0]) for x in some]
            del group
            for x in some:
                x[0] = np.cumsum(x[0], dtype=np.int32)
            before, last, text, *more = map(np.concatenate, zip(*some))
            before = [before, *more]
            del some
            value = grown(last, before, text % 2 == 0, shared, lambda x: sent.value.root(x, total), min_gain, min_context, min_entry)
            owner, one = _numbered((np.repeat(block, sizes) << 32) | (text >> 1))
            sums, block, text = np.bincount(owner, value), np.repeat(block, sizes)[one], (text >> 1)[one]
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            pairs = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[cuts[:-1]]), pa.array(np.full(len(pairs), part)), pa.array([packed(text[i:j]) for i, j in pairs], pa.binary()), pa.array([packed(sums[i:j]) for i, j in pairs], pa.binary())], names=["block", "part", "texts", "sums"]
            )

    dealt = rows.repartitionById(deal.size or deal.parts, F.col("part").cast("int")).sortWithinPartitions("part", "length", "block", "at")
    return dealt.mapInArrow(lambda batches: released(score(batches)), "block long, part long, texts binary, sums binary")


def _scored_by_tree(coded: DataFrame, tree: SuffixTree) -> DataFrame:
    """The same by a tree that every task holds."""
    model = coded.sparkSession.sparkContext.broadcast(tree)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [level.nodes for level in model.value.levels]
        for batch in batches:
            for block, first, texts, _ in _texts(batch):
                for some in blocks(texts, 200_000):
                    stream, at, longest, owner = laid_out(some, len(indexes))
                    sums = np.bincount(owner, model.value.log10(stream[at], walk(indexes, stream, at, longest)), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0]), pa.array([packed(np.arange(first, first + len(some), dtype=np.int32))], pa.binary()), pa.array([packed(sums)], pa.binary())], names=["block", "part", "texts", "sums"])
                    first += len(some)

    return coded.select("block", "at", "sizes", "held_ones", "symbols").mapInArrow(lambda batches: released(score(batches)), "block long, part long, texts binary, sums binary")


def _counts(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in found], names=["key", "n"])


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    depth: int = 3,
    min_gain: float = 8.0,
    min_context: int = 2,
    min_entry: int = 1,
    most_words: int | None = None,
    most_entries: int | None = None,
) -> DataFrame:
    """log10 probabilities of every whole text, under the tree and under word counts.

    Training rows are those whose CRC-32 of the id leaves another rest than
    ``remainder``. The words of each block of texts are numbered once; the
    blocks' distinct words, not the tokens, go to the buckets of the vocabulary
    and come back as counts and symbols. Texts are then held as symbols, and
    each token goes with the ``depth`` symbols before it to the part that grows
    its branch of the tree.

    Words that stand ``min_context`` times are symbols of their own; contexts
    of up to ``depth`` symbols that stand as often are tested, and all next
    symbols seen ``min_entry`` times are listed, whatever the size of the
    corpus. Only a caller who wants a tree that driver and tasks can hold gives
    ``most_entries``, the most next symbols listed for a length, or
    ``most_words``, the most common words: the counts asked for then double
    until the bounds hold.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for every row. ``base_score`` adds log10((c + 1) / (N + V + 1)) over
    tokens; a word has (c + 1) / (C + W + 1) of its symbol's probability, with
    C training tokens and W distinct words of that symbol. Null texts count as
    empty: one token, the end. Very long texts are read whole. Without training
    rows all symbols are equally likely. Null ids are ids like others; repeated
    ids are rows of their own. An empty table gives no rows; other columns are
    not read, so none can clash.
    """
    min_context, min_entry = max(1, min_context), max(1, min_entry)
    size = _buckets(docs)
    tables = _tables(_source(docs, id_col, text_col, modulus, remainder), size)
    ends = tables.filter("not held").count()
    common = min_context if most_words is None else _bound(_word_counts(tables), "c", min_context, most_words)
    vocabulary = _vocabulary(tables, common)
    buckets = vocabulary.filter("run is not null").drop("block", "reply").collect()
    alphabet = Alphabet.of(ends, buckets, size)
    n, v = ends + sum(r["n"] for r in buckets), (ends > 0) + sum(r["seen"] for r in buckets)
    coded = _coded(tables, vocabulary.filter("reply is not null").select("block", "bucket", "reply"), alphabet, ends, n + v + 1, common)
    if most_entries is None and depth:
        tokens = int(coded.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).collect()[0]["t"])
        sums = _scored_by_parts(coded, alphabet, n, tokens, depth, min_gain, min_context, min_entry)
    else:
        symbols = alphabet.frequent(1)
        sums = _scored_by_tree(coded, learn_tree(coded, (symbols, alphabet.seen(symbols)), len(alphabet), depth, min_gain, min_context, min_entry, most_entries))

    id_type = tables.schema["id"].dataType.simpleString()
    rows = tables.filter("held is not null").select("block", "at", "id", "held")
    rows = rows.unionByName(coded.select("block", "at", "sizes", "stats"), allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["block"]):
            texts = group.filter(pc.is_valid(group.column("held"))).sort_by("at")
            stats, score = np.zeros((4, texts.num_rows)), np.zeros(texts.num_rows)
            for at, data in zip(*(group.filter(pc.is_valid(group.column("stats"))).column(c).to_pylist() for c in ("at", "stats"))):
                own = unpacked(data, np.float64).reshape(4, -1)
                stats[:, at : at + own.shape[1]] = own
            for own, data in zip(*(group.filter(pc.is_valid(group.column("sums"))).column(c).to_pylist() for c in ("texts", "sums"))):
                score[unpacked(own)] += unpacked(data, np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(texts.column(c).combine_chunks() for c in ("id", "held")), *(pa.array(x.astype(np.int64)) for x in stats[:2]), pa.array(stats[2]), pa.array(score + stats[3])], names=["id", "held", "n_tokens", "n_known", "base", "score"]
            )

    there = max(1, 2 * tables.select("block").distinct().count())
    scored = rows.repartition(there, "block").sortWithinPartitions("block", "part", "at").mapInArrow(lambda batches: released(gather(batches)), f"id {id_type}, held boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )


def _coded(tables: DataFrame, replies: DataFrame, alphabet: Alphabet, ends: int, weight: int, common: int) -> DataFrame:
    """Texts as symbols, some texts a row; ``stats`` are their tokens, known tokens, base scores, and what their words have of their symbols."""
    there = tables.select("block").distinct().count()
    both = tables.filter("ids is not null or `order` is not null").select("block", "at", "sizes", "held_ones", "ids", "order").unionByName(replies, allowMissingColumns=True)
    sent = tables.sparkSession.sparkContext.broadcast(alphabet)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = sent.value
        for group in sorted_groups(batches, ["block"]):
            number, total, symbol, inside = [np.zeros(1, np.int32)], [np.array([ends])], [np.zeros(1, np.int64)], [alphabet.inside[:1]]
            number += [unpacked(x) for x in group.column("order").drop_null().to_pylist()]
            answers = group.filter(pc.is_valid(group.column("reply"))).select(["bucket", "reply"])
            for bucket, reply in zip(answers.column("bucket").to_pylist(), answers.column("reply").to_pylist()):
                own = unpacked(reply, np.int64)
                rare = -1 - own
                found = np.where(own >= 0, alphabet.number(bucket, own), 1 + rare // common)
                c = np.where(own >= 0, alphabet.seen(found), rare % common)
                symbol.append(found)
                total.append(c)
                inside.append(np.where(own >= 0, c + 1, alphabet.inside[np.minimum(found, CLASSES)]))
            by = np.argsort(np.concatenate(number))
            total, symbol, inside = (np.concatenate(x)[by] for x in (total, symbol, inside))
            symbol, known, base, share = symbol.astype(np.int32), total > 0, np.log10((total + 1) / weight), np.log10((total + 1) / (inside + 1))
            rows = group.filter(pc.is_valid(group.column("ids"))).select(["at", "sizes", "held_ones", "ids"])
            block = group.column("block")[0].as_py()
            del answers, group
            for i in range(rows.num_rows):
                at, sizes, held, ids = (rows.column(c)[i].as_py() for c in rows.column_names)
                words, ids = unpacked(sizes), unpacked(ids)
                owner = np.repeat(np.arange(len(words)), words)
                stats = np.array([words + 1.0, *(np.bincount(owner, x[ids], len(words)) + x[0] for x in (known, base, share))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([at]), pa.array([sizes], pa.binary()), pa.array([held], pa.binary()), pa.array([len(ids) + len(words)]), pa.array([packed(stats.reshape(-1))], pa.binary()), pa.array([packed(symbol[ids])], pa.binary())],
                    names=["block", "at", "sizes", "held_ones", "tokens", "stats", "symbols"],
                )

    # blocks are of bounded size, so their number gives tasks of a block or two, whatever the size of the corpus
    dealt = both.repartition(max(1, 2 * there), "block").sortWithinPartitions("block", "bucket", "at")
    return stage(dealt.mapInArrow(lambda batches: released(code(batches)), "block long, at long, sizes binary, held_ones binary, tokens long, stats binary, symbols binary"), "lm-coded")
