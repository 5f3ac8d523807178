"""SentencePiece ids by tables of distinct chunks.

Where no piece holds a white-space marker after another character, merges
never cross the place in front of a marker run, so a normalised text falls
into chunks (a run of markers and the characters up to the next run) whose
segmentations do not touch each other. Each distinct chunk of a block of
texts is segmented once by the library; ids return to the texts by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillmill.llm._shared import blocks, free, released

MARK = "▁"
#: Distinct chunks that a task keeps at most; then its table starts anew.
TABLE_CHUNKS = 150_000
#: Chunks beyond this length are segmented where they stand and not kept.
LONG_CHUNK = 200


class ChunkCoder:
    """Encodes and decodes texts through a table of distinct chunks."""

    def __init__(self, model_file: str | None = None, model_bytes: bytes | None = None):
        import sentencepiece

        args = {"model_proto": model_bytes} if model_bytes is not None else {"model_file": model_file}
        self.lib = sentencepiece.SentencePieceProcessor(**args)
        self.ids: dict[str, tuple[int, str, str]] = {}
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        # chunks are only taken apart if the model's own normaliser leaves a text
        # alone but for markers, and puts one marker in front
        plain = self.lib.normalize("a  b ") == f"{MARK}a{MARK}{MARK}b{MARK}" and self.lib.normalize("ﬁ Å x\n") == f"{MARK}ﬁ{MARK}Å x\n"
        self.separable = plain and not crossing

    def _segment(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and their text; ``chunk`` starts with a space."""
        # the library puts the marker in front again, but not before an empty text
        ids = self.lib.encode(chunk[1:]) if chunk != " " else [self.lib.piece_to_id(MARK)]
        return len(ids), ",".join(map(str, ids)), " " + self.lib.decode(ids)

    def code(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a whole text."""
        if not text:
            return 0, "", ""
        if not self.separable:
            ids = self.lib.encode(text)
            return len(ids), ",".join(map(str, ids)), self.lib.decode(ids)
        words = (" " + text.replace(MARK, " ")).split(" ")
        # empty strings are the further markers of a run, whose last one opens the next word
        table = self.ids
        if len(table) > TABLE_CHUNKS:
            table.clear()
        found = []
        run = 1
        last = len(words) - 1
        for i in range(1, last + 1):
            word = words[i]
            if not word and i < last:
                run += 1
                continue
            try:
                found.append(table[word] if run == 1 else table[" " * (run - 1) + word])
            except KeyError:
                chunk = " " * (run - 1) + word
                got = self._segment(" " + chunk)
                if len(chunk) <= LONG_CHUNK:
                    table[chunk] = got
                found.append(got)
            run = 1
        counts, ids, texts = zip(*found)
        return sum(counts), ",".join(ids), "".join(texts)[1:]


def encode_documents(docs: DataFrame, model_file: str | None = None, text_col: str = "text", keep: list[str] | None = None, digests_only: bool = False) -> DataFrame:
    """Encode every whole text and decode it again, without begin and end ids.

    Adds ``n_tokens``, ``ids`` (decimal ids joined by commas), ``decoded``,
    ``ids_sha256`` and ``decoded_sha256``, replacing columns of these names;
    ``digests_only`` leaves the two texts out. Columns in ``keep`` (all by
    default) pass through. A null text counts as empty and has no ids; very
    long texts are coded whole; repeated rows get equal results; an empty table
    gives no rows. The model is read once on the driver and sent to the tasks, so executors need
    no file of it; it has a fixed size.
    """
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = [] if digests_only else ["ids", "decoded"]
    added = ["n_tokens", *texts, "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in added and (keep is None or f.name in keep)]
    schema = StructType([*kept, *(StructField(c, LongType() if c == "n_tokens" else StringType()) for c in added)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(model_bytes=sent.value)
        for batch in batches:
            start = 0
            for group in blocks(batch.column(batch.num_columns - 1).to_pylist()):
                counts, ids, decoded, id_sums, text_sums = [], [], [], [], []
                for text in group:
                    n, joined, back = coder.code(text or "")
                    counts.append(n)
                    id_sums.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sums.append(hashlib.sha256(back.encode()).hexdigest())
                    if not digests_only:
                        ids.append(joined)
                        decoded.append(back)
                made = [pa.array(counts, pa.int64()), *([pa.array(ids, pa.string()), pa.array(decoded, pa.string())] if texts else []), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                part = batch.slice(start, len(group))
                start += len(group)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*batch.schema.names[:-1], *added])

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias(free(docs.columns, "__text")[0]))
    return source.mapInArrow(lambda batches: released(code(batches)), schema)
