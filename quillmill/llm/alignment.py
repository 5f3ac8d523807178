"""Alignment of two tokenizers' tokens over the same bytes.

The tokens of both sides are read in turn by a transducer whose state is the
side that leads and its dangling suffix, the bytes that the other side has not
matched yet. The side that lags reads its next token; where the suffix becomes
empty both sides end at one byte and the group closes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quillmill.llm._shared import blocks, released, stage

MARK = "▁"
#: Both sides have a token boundary in front of a space that follows no white space.
CUT = re.compile(r"(?<=\S) ")
UNEVEN = re.compile(r"\s ")
#: Distinct chunks that a task keeps at most; then its table starts anew.
TABLE_CHUNKS = 250_000
#: Chunks that are coded in one call.
JOINED = 500
#: Transitions that a task keeps at most; then they start anew.
MOST_MOVES = 400_000
#: Pairs of ids whose counts are broadcast at a time; more are met block by block.
BLOCK_PAIRS = 4_000_000


class Transducer:
    """Groups of two token sequences over the same bytes.

    A state is the dangling suffix and the side that lags; state 0 has no suffix,
    odd states wait for the left side. What a pair of tokens opens and where a
    token leads from a state is kept, so bytes are looked at once for each.
    """

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.left, self.right = left, right
        self.left_text, self.right_text = [str(i) for i in range(len(left))], [str(i) for i in range(len(right))]
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[bytes, int], int] = {}
        self.suffixes: list[bytes] = [b"", b""]
        self.opened: dict[int, int] = {}
        self.moves: dict[tuple[int, int], int] = {}

    def _state(self, one: bytes, other: bytes) -> int:
        """The state after the left side has read ``one`` and the right side ``other``; -1 where they differ."""
        if one == other:
            return 0
        if one.startswith(other):
            suffix, waits = one[len(other) :], 0
        elif other.startswith(one):
            suffix, waits = other[len(one) :], 1
        else:
            return -1
        found = self.states.get((suffix, waits))
        if found is None:
            found = self.states[suffix, waits] = len(self.suffixes) + waits
            self.suffixes += [suffix, suffix]
        return found

    def _open(self, a: int, b: int) -> int:
        one, other = self.left[a], self.right[b]
        found = self.opened[a * len(self.right) + b] = self._state(one, other) if one and other else -1
        return found

    def _move(self, state: int, token: int) -> int:
        suffix = self.suffixes[state]
        read = (self.left if state & 1 else self.right)[token]
        found = self._state(read, suffix) if state & 1 else self._state(suffix, read)
        self.moves[state, token] = found if read else -1
        return self.moves[state, token]

    def read(self, left: list[int], right: list[int]) -> tuple[list[str], list[int]] | None:
        """(each group as text, links as left id times the number of right ids plus right id); None where the bytes differ."""
        opened, moves, n_right = self.opened, self.moves, len(self.right)
        a_text, b_text = self.left_text, self.right_text
        groups: list[str] = []
        links: list[int] = []
        i = j = 0
        n, m = len(left), len(right)
        while i < n and j < m:
            a, b = left[i], right[j]
            pair = a * n_right + b
            state = opened.get(pair)
            if state is None:
                state = self._open(a, b)
            if not state:
                i += 1
                j += 1
                groups.append(f"{a_text[a]}|{b_text[b]}")
                links.append(pair)
                continue
            first, other = i, j
            i += 1
            j += 1
            while state > 0:
                if state & 1:
                    if i == n:
                        return None
                    token = left[i]
                    i += 1
                else:
                    if j == m:
                        return None
                    token = right[j]
                    j += 1
                now = moves.get((state, token))
                state = self._move(state, token) if now is None else now
            if state:
                return None
            ones, others = left[first:i], right[other:j]
            groups.append(f"{','.join([a_text[x] for x in ones])}|{','.join([b_text[x] for x in others])}")
            links += [x * n_right + y for x in ones for y in others]
        if len(self.moves) + len(self.opened) > MOST_MOVES:
            self.clear()
        return (groups, links) if i == n and j == m else None


def byte_level_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Fixed values: bytes that print stand for themselves, the others for the characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def byte_level_tokens(tokenizer_json: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    known = byte_level_characters()
    vocab = json.loads(tokenizer_json)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(known[c] for c in entry) if all(c in known for c in entry) else entry.encode()
    return out


def piece_tokens(lib) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    out = []
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else piece.replace(MARK, " ").encode())
    return out


class ChunkAligner:
    """Aligns texts through a table of distinct chunks.

    A text is cut in front of each space that follows no white space. Neither
    side has a token across such a place, nor do tokens depend on what stands
    beyond it, so each distinct chunk is coded and aligned once and groups of
    texts are those of their chunks in order.
    """

    def __init__(self, tokenizer_json: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_str(tokenizer_json)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.transducer = Transducer(byte_level_tokens(tokenizer_json), piece_tokens(self.right))
        self.n_right = len(self.transducer.right)
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.transducer.left, self.transducer.right)]
        made = json.loads(tokenizer_json)
        plain = made.get("normalizer") is None and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and made["pre_tokenizer"].get("use_regex", True)
        pieces = (self.right.id_to_piece(i) for i in range(self.n_right))
        #: Whether texts may be cut; others are coded whole.
        self.separable = plain and self.right.normalize("a  b ") == f"{MARK}a{MARK}{MARK}b{MARK}" and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.groups: list[str] = []
        #: For each chunk: tokens of both sides, groups, links; -1 tokens where the bytes differ.
        self.facts = array("q")
        self.ends, self.pairs = array("q", [0]), array("q")

    def _cut(self, ids: list[int], side: int, ends: np.ndarray) -> list[list[int]] | None:
        """Ids by the chunks that end at these bytes; None if a token crosses an end."""
        upto = np.cumsum(self.sizes[side][ids])
        at = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[at] != ends).any():
            return None
        cuts = [0, *(at + 1).tolist()]
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def _coded(self, chunks: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """(chunk, ids of both sides). Chunks behind each other are a text that would be cut into them, so many are coded in one call."""
        joined = [c for c in chunks if c and not c[-1].isspace()] if self.separable else []
        alone = [c for c in chunks if not c or c[-1].isspace()] if self.separable else chunks
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            text = " ".join(part)
            ends = np.cumsum([len(c.encode()) + 1 for c in part])
            left = self._cut(self.left.encode(" " + text, add_special_tokens=False).ids, 0, ends)
            right = self._cut(self.right.encode(text), 1, ends)
            if left is None or right is None:
                alone += part
            else:
                yield from zip(part, left, right)
        mark = [self.right.piece_to_id(MARK)]
        for chunk in alone:
            yield chunk, self.left.encode(" " + chunk, add_special_tokens=False).ids, self.right.encode(chunk) if chunk else mark

    def add(self, chunks: list[str]) -> None:
        """Code and align chunks that the table does not hold; each stands behind a space."""
        tokens = self.transducer.left
        for chunk, left, right in self._coded(chunks):
            self.table[chunk] = len(self.groups)
            found = self.transducer.read(left, right)
            if found is None or b"".join([tokens[i] for i in left]) != b" " + chunk.encode():
                self.groups.append("")
                self.facts.extend((-1, 0, 0, 0))
            else:
                groups, links = found
                self.groups.append(";".join(groups))
                self.facts.extend((len(left), len(right), len(groups), len(links)))
                self.pairs.extend(links)
            self.ends.append(len(self.pairs))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(facts of each text, digests of groups, ends of each text's pairs, pairs, links of each pair)."""
        cut: list[list[str]] = []
        for t in texts:
            if not t or MARK in t:
                cut.append([])
            elif not self.separable:
                cut.append([t])
            elif t[0] == " " or UNEVEN.search(t):
                cut.append(CUT.split(t))
            else:
                cut.append(t.split(" "))
        if len(self.table) > TABLE_CHUNKS:
            self.clear()
        table = self.table
        new = {c for chunks in cut for c in chunks} - table.keys()
        if new:
            self.add(list(new))
        numbers = [[table[c] for c in chunks] for chunks in cut]
        facts = np.frombuffer(self.facts, np.int64).reshape(-1, 4)
        ends, pairs = np.frombuffer(self.ends, np.int64), np.frombuffer(self.pairs, np.int64)
        told = np.zeros((len(texts), 4), np.int64)
        digests, lists, sizes = [], [], np.zeros(len(texts), np.int64)
        for i, own in enumerate(numbers):
            at = np.array(own, np.int64)
            if len(at):
                rows = facts[at]
                if (rows[:, 0] < 0).any():
                    at = at[:0]
                else:
                    told[i] = rows.sum(axis=0)
            digests.append(hashlib.sha256(";".join([self.groups[k] for k in own]).encode()).hexdigest() if len(at) else "")
            lists.append(at)
            sizes[i] = len(at)
        chunk = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        # a chunk's links weigh as often as the text holds it
        key, times = np.unique(text * np.int64(len(self.groups) or 1) + chunk, return_counts=True)
        text, chunk = np.divmod(key, np.int64(len(self.groups) or 1))
        width = ends[chunk + 1] - ends[chunk]
        begin = np.cumsum(width) - width
        flat = pairs[np.repeat(ends[chunk] - begin, width) + np.arange(int(width.sum()))]
        weight = np.repeat(times, width)
        order = np.lexsort((flat, np.repeat(text, width)))
        flat, owner, weight = flat[order], np.repeat(text, width)[order], weight[order]
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(first)
        weights = np.add.reduceat(weight, starts) if len(starts) else weight
        upto = np.searchsorted(owner[starts], np.arange(len(texts) + 1))
        return told, digests, upto, flat[starts], weights


_aligners: dict[tuple[int, int], ChunkAligner] = {}


def _aligner(tokenizer_json: str, piece_model: bytes) -> ChunkAligner:
    """One aligner in each Python worker, whatever number of tasks it runs."""
    key = hash(tokenizer_json), hash(piece_model)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = ChunkAligner(tokenizer_json, piece_model)
    return _aligners[key]


def _coded(sent: Broadcast):
    """Each text's facts, digest and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or _aligner(*sent.value)
            start = 0
            for group in blocks(batch.column(1).to_pylist()):
                told, digests, upto, pairs, times = aligner.align(group)
                rows = batch.slice(start, len(group))
                start += len(group)
                lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values)) for values in (pairs.astype(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(told[:, k]) for k in range(4)), pa.array(digests), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times"])

    return lambda batches: released(run(batches))


def _weighed(sent: Broadcast):
    """Add what a block of pair counts says to ``n_best`` and ``count_sum``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), np.asarray(batch.column("times").flatten(), np.int64)
            flat, sizes = np.asarray(pairs.flatten()), np.asarray(pairs.value_lengths())
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            here = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            columns = dict(zip(batch.schema.names, batch.columns))
            for name, value in (("n_best", best), ("count_sum", counts)):
                worth = np.concatenate([[0], np.cumsum(np.where(here, times * (value[at] if len(known) else 0), 0))])
                columns[name] = pa.array(np.asarray(columns[name]) + worth[ends[1:]] - worth[ends[:-1]])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def align_documents(docs: DataFrame, tokenizer_json: str | None = None, piece_model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links between the tokens that two tokenizers give every whole text.

    Side A is a byte-level tokenizer over a space and the text, side B a
    SentencePiece model that puts the space in front itself; strings of special
    tokens inside texts are plain text. Tokens are cut into groups where both
    sides end at the same byte, and all tokens of a group are linked with each
    other. The count of a pair of ids is the number of documents that hold it
    linked. A text that is null or empty, or whose tokens' bytes on either side
    are not those of the space and the text, has no tokens.

    Each text is coded once; its distinct pairs are staged as one array, and the
    pairs are counted over the corpus with map-side sums, so a pair that all
    documents hold is no hot key. The counts go back in blocks of
    ``BLOCK_PAIRS`` at most, each broadcast by itself, so what is sent at a time
    has a fixed size.

    Returns ``id_col, n_a, n_b, n_groups, n_links, n_best`` (links whose count
    is the highest of their A id, ties included), ``count_sum`` (over links) and
    ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3`` in order; '' without tokens).
    Null ids and repeated rows are rows of their own, an empty table gives no
    rows, and other columns are not read, so none can clash.
    """
    if tokenizer_json is None or piece_model is None:
        import public_tokenizers

        tokenizer_json = tokenizer_json or public_tokenizers.path("byte_bpe_50k.json")
        piece_model = piece_model or public_tokenizers.path("piece_bpe_32k.model")
    with open(tokenizer_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
        files = a.read(), b.read()
    import sentencepiece

    n_right = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType(
        [
            StructField("id", rows.schema["id"].dataType),
            *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
            StructField("digest", StringType()),
            StructField("pairs", ArrayType(LongType())),
            StructField("times", ArrayType(IntegerType())),
        ]
    )
    coded = stage(rows.mapInArrow(_coded(context.broadcast(files)), schema), "aligned")
    counts = coded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stage(counts.withColumn("a", F.floor(F.col("pair") / n_right)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    facts = stage(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "pair-facts")
    parts = -(-facts.count() // BLOCK_PAIRS)
    out = coded.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for p in range(parts):
        here = facts if parts == 1 else facts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == p)
        table = here.toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        sent = context.broadcast(tuple(table.column(c).to_numpy()[order].astype(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.int8))))
        out = out.mapInArrow(_weighed(sent), out.schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
