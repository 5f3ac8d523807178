"""Benchmark decontamination by a suffix automaton of all test items.

Normalised items make one automaton: its states are the classes of word runs
that occur in the items, and a training text is streamed through it word by
word while the length of the longest run that ends here is tracked. Where the
length reaches a window, those words stand in an item.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._shared import blocks, free, released

#: Words are runs of ASCII digits and letters and of all characters beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Item words in one automaton; larger sets of items are cut into several, read one after the other.
PART_WORDS = 1_000_000
#: Words of one piece of an item; longer items are cut, with a window less one word in common.
PIECE_WORDS = 100_000

#: Every byte to what it counts as: A-Z to a-z, other ASCII but digits and letters to a space. The length stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_words(text: Column) -> Column:
    """Normalised words of a text in order (null: none)."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


class SuffixAutomaton:
    """All word runs of a set of items (id, words) and where windows of ``window`` words end.

    An item with fewer words is one window of all its words.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.go)
        #: For each state the items whose windows of full length end there, by the state that holds the window.
        self.full: list[set[str]] = [set() for _ in range(n)]
        short: list[dict[int, set[str]]] = [{} for _ in range(n)]
        for name, words in items:
            if not words:
                continue
            need = min(window, len(words))
            state = 0
            for i, w in enumerate(words):
                state = self.go[state][w]
                if i + 1 >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    if need == window:
                        self.full[at].add(name)
                    else:
                        short[at].setdefault(need, set()).add(name)
        # a state's link is shorter, so that by length each state's link is settled first
        self.anchor = [0] * n
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.length[up] >= window else s
            self.short[s] = (*self.short[up], *((m, frozenset(names)) for m, names in sorted(short[s].items())))
        self.any_short = any(self.short)

    def _extend(self, last: int, w: bytes) -> int:
        """Add ``w`` after the run of ``last``; the state of the longer run."""
        go, link, length = self.go, self.link, self.length
        there = go[last].get(w)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, w, there)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = go[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the runs of ``q`` that are at most one word longer than those of ``p``."""
        twin = self._state(self.length[p] + 1, dict(self.go[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, go: dict[bytes, int]) -> int:
        self.go.append(go)
        self.link.append(-1)
        self.length.append(length)
        return len(self.go) - 1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(spans of hit words as (first, end), items hit, longest match that reached a window) of a text."""
        go, link, length, window, short = self.go, self.link, self.length, self.window, self.short
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = state = matched = 0

        def hit(first: int, end: int) -> None:
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, end))

        for i, w in enumerate(words):
            there = go[state].get(w)
            if there is None:
                while there is None and state:
                    state = link[state]
                    there = go[state].get(w)
                if there is None:
                    matched = 0
                    continue
                matched = length[state]
            state = there
            matched += 1
            if matched >= window:
                hit(i + 1 - matched, i + 1)
                found |= self.full[self.anchor[state]]
                longest = max(longest, matched)
            if short[state]:
                for m, names in short[state]:
                    if m <= matched:
                        hit(i + 1 - m, i + 1)
                        found |= names
                        longest = max(longest, m)
        return spans, found, longest


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], window: int) -> SuffixAutomaton:
    """The automaton of a part, built once in each Python worker; one at a time is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton([(name, joined.encode().split(b" ") if joined else []) for name, joined in items], window)
    return _built[key]


def _item_parts(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, str]]]:
    """Items as (id, words joined by spaces) in parts of some ``PART_WORDS`` words, each of which the driver reads by itself."""
    step = PIECE_WORDS
    words = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), item_words(F.col(f"`{text_col}`")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - window) / step)).cast("int"))
    pieces = words.select("id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i * step + 1, F.lit(step + window - 1)), " "))).alias("piece"))
    size = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).collect()[0][0]
    parts = -(-size // PART_WORDS)
    for p in range(parts):
        here = pieces if parts == 1 else pieces.filter(F.pmod(F.xxhash64("id", "piece"), F.lit(parts)) == p)
        yield sorted((r["id"], r["piece"]) for r in here.toLocalIterator())


HITS = "struct<first:int,end:int>"


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
) -> DataFrame:
    """Where every whole document repeats ``window`` consecutive words of a test item.

    Texts are lower-cased (A-Z) and cut into words of ASCII digits, letters and
    all characters beyond ASCII. An item of fewer words, but not none, is found
    where all of it stands. Every document streams once through the automaton
    of the items; nothing is shuffled, so a passage that many documents share
    is no hot key. Test sets are counted first: up to ``PART_WORDS`` words make
    one automaton, which every Python worker builds once from the broadcast
    words; larger sets are cut into several, through which the documents
    stream one after the other. Items of over ``PIECE_WORDS`` words are cut with
    a window less one in common, so no window is lost; ``longest`` then does not
    reach across the cut.

    Returns ``id_col`` and the columns in ``keep``, and ``n_words``, ``n_hit``
    (words inside an occurrence of a window), ``coverage`` (their share; 0
    without words), ``longest`` (longest match that reached a window),
    ``spans`` (runs of hit words: first and end, counted from 0) and
    ``item_ids`` (distinct ids as sorted strings; an item without an id counts
    as ''). Null texts have no words, empty tables give no rows, repeated rows are rows of
    their own. Columns of other names are not read, so none can clash.
    """
    names = ["id", *[f"k{i}" for i in range(len(keep or []))]]
    carried = [F.col(f"`{c}`").alias(n) for c, n in zip([id_col, *(keep or [])], names)]
    source = docs.select(*carried, F.col(f"`{text_col}`").cast("string").alias("text"))
    found = source.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(0).alias("longest"), F.array().cast(f"array<{HITS}>").alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    schema = found.schema
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(part) for part in _item_parts(items, item_id_col, item_text_col, window)] or [context.broadcast([])]
    for part in sent:
        found = found.mapInArrow(_streamed(part, window, len(names)), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))
    out = found.withColumn("n_hit", hit)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, [id_col, *(keep or [])])],
        "n_words",
        "n_hit",
        F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0).alias("coverage"),
        "longest",
        "spans",
        F.array_sort("item_ids").alias("item_ids"),
    )


def _streamed(part, window: int, at: int):
    """The step that streams documents (text is column ``at``) through one part's automaton and adds to what earlier parts found."""

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            if automaton is None:
                automaton = _automaton(key, part.value, window)
            start = 0
            for group in blocks(batch.column(at).cast(pa.binary()).to_pylist()):
                rows = batch.slice(start, len(group))
                start += len(group)
                spans, ids = rows.column(at + 3).to_pylist(), rows.column(at + 4).to_pylist()
                longest = rows.column(at + 2).to_pylist()
                counts = []
                for i, text in enumerate(group):
                    words = text.translate(FOLD).split() if text else []
                    counts.append(len(words))
                    own, names, reach = automaton.stream(words)
                    if own:
                        spans[i] = merged([*((s["first"], s["end"]) for s in spans[i]), *own])
                        ids[i] = sorted({*ids[i], *names})
                        longest[i] = max(longest[i], reach)
                made = [pa.array(counts, pa.int64()), pa.array(longest, pa.int32()), pa.array(spans, batch.schema.field(at + 3).type), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rows.columns[: at + 1], *made], names=batch.schema.names)

    return lambda batches: released(run(batches))


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs that cover the same words, in order and without overlap."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [{"first": a, "end": b} for a, b in out]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these runs and what stands between them; the rest stays byte for byte."""
    raw = text.encode()
    places = [m.span() for m in WORD_BYTES.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def remove_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    min_words: int = 10,
    max_coverage: float = 0.5,
) -> DataFrame:
    """The documents without their spans of test items, with all their columns.

    Hit runs of at least ``min_words`` words are cut out of the text; documents of
    which hit words are more than ``max_coverage`` go whole. Others, null
    and empty ones among them, pass unchanged. Spans and texts stay in their
    row, so repeated rows and null ids are no matter.
    """
    kept = [c for c in docs.columns if c != text_col]
    label = free(docs.columns, "__row")[0]
    found = find_contamination(docs.withColumn(label, F.lit(0)), items, label, text_col, item_id_col, item_text_col, window, keep=[*kept, text_col])
    names = [f"c{i}" for i in range(len(kept))]
    flat = found.toDF("__row", *names, "text", "n_words", "n_hit", "coverage", "longest", "spans", "item_ids").filter(F.col("coverage") <= max_coverage)
    flat = flat.withColumn("spans", F.filter("spans", lambda s: s["end"] - s["first"] >= min_words)).select(*names, F.col("text").cast("string").alias("text"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(len(names) + 1).to_pylist(), batch.column(len(names))
            if any(spans):
                left = [without_spans(t, [(s["first"], s["end"]) for s in runs]) if runs else t for t, runs in zip(texts.to_pylist(), spans)]
                texts = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], texts], names=[*names, "text"])

    back = flat.mapInArrow(cut, flat.drop("spans").schema)
    return back.select(*[F.col("text" if c == text_col else names[kept.index(c)]).alias(c) for c in docs.columns])
