"""Language identification by prediction by partial matching over bytes.

One variable-order context tree for each language. A text is the sequence of
its words (``[^\\x20\\x09-\\x0D]+``, ASCII letters in lower case); each word is
coded byte by byte and closed by a space. The context of a byte is the word so
far with a space before it, the last ``order`` bytes at most, so no context
crosses white space and each distinct word has one exact code length.

Coding with frozen statistics, method C: in a context seen n times with d
distinct next bytes, a seen byte costs -log2(c / (n + d)), anything else costs
the escape -log2(d / (n + d)) and goes on in the next shorter context; a
context without statistics is passed at no cost; below the empty context all
257 symbols are equal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillmill.llm._shared import blocks, free, held_out, place_of, released

if TYPE_CHECKING:  # scoring does without pandas
    import pandas as pd

LETTER, ASCII_LETTER = regex.compile(r"\p{L}"), re.compile(rb"[A-Za-z]")
#: Words whose code lengths a task keeps at most; then its table starts anew.
TABLE_WORDS = 200_000


@dataclass
class Trees:
    """The frozen trees of all languages, as sorted keys with a row of code lengths each.

    ``pairs[k]``: keys (context of k bytes, byte) that any language has seen,
    with the exact cost in bits for every language from this context on.
    ``escapes[k]``: contexts of k bytes with every language's escape cost (0
    where the language has no statistics for it).
    """

    langs: list[str]
    order: int
    pairs: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]
    base: float

    def cost(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word and its closing space, a column for each language."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        stream = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(stream)) - np.repeat(starts, sizes)  # in the word, its space in front is 0
        coded = np.flatnonzero(place > 0)
        bits = self._symbols(stream, coded, np.minimum(place[coded], self.order))
        return np.add.reduceat(bits, np.searchsorted(coded, starts + 1), axis=0) if len(words) else np.zeros((0, len(self.langs)))

    def _symbols(self, stream: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(self.langs)))
        todo = np.arange(len(at))
        for k in range(self.order, -1, -1):
            here = todo[depth[todo] >= k]
            if not len(here):
                continue
            context = np.zeros(len(here), np.uint64)
            for back in range(k, 0, -1):
                context = (context << np.uint64(8)) | stream[at[here] - back]
            keys, rows = self.pairs[k]
            found, where = _find(keys, (context << np.uint64(8)) | stream[at[here]])
            out[here[found]] += rows[where[found]]
            missed = here[~found]
            keys, rows = self.escapes[k]
            known, where = _find(keys, context[~found])
            out[missed[known]] += rows[where[known]]
            done = np.zeros(len(at), bool)
            done[here[found]] = True
            todo = todo[~done[todo]]
        out[todo] += self.base
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[where] == wanted, where


def context_counts(words: Counter, order: int) -> pd.DataFrame:
    """(k, key, n): how often each context of k bytes is followed by each byte."""
    import pandas as pd

    parts = []
    items = list(words.items())
    for i in range(0, len(items), 20_000):
        block = items[i : i + 20_000]
        names = [w for w, _ in block]
        sizes = np.fromiter(map(len, names), np.int64, len(names)) + 2
        weight = np.repeat(np.array([n for _, n in block], np.int64), sizes)
        stream = np.frombuffer(b" " + b"  ".join(names) + b" ", np.uint8).astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(stream)) - np.repeat(starts, sizes)
        for k in range(order + 1):
            at = np.flatnonzero(place >= max(1, k))
            key = np.zeros(len(at), np.uint64)
            for back in range(k, -1, -1):
                key = (key << np.uint64(8)) | stream[at - back]
            keys, inverse = np.unique(key, return_inverse=True)
            parts.append(pd.DataFrame({"k": k, "key": keys.astype(np.int64), "n": np.bincount(inverse, weight[at]).astype(np.int64)}))
    if not parts:
        return pd.DataFrame({"k": [], "key": [], "n": []}).astype("int64")
    return pd.concat(parts).groupby(["k", "key"], as_index=False)["n"].sum()


def freeze(counts: pd.DataFrame, order: int) -> Trees:
    """The trees of all languages from rows of (lang, k, key, n)."""
    langs = sorted(counts["lang"].unique())
    base = float(np.log2(257))
    pairs, escapes = [], []
    for k in range(order + 1):
        rows = counts[counts["k"] == k]
        keys = np.unique(rows["key"].to_numpy(np.uint64))
        contexts = np.unique(keys >> np.uint64(8))
        n = np.zeros((len(keys), len(langs)))
        for j, lang in enumerate(langs):
            own = rows[rows["lang"] == lang]
            n[np.searchsorted(keys, own["key"].to_numpy(np.uint64)), j] = own["n"]
        inside = np.searchsorted(contexts, keys >> np.uint64(8))
        total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, inside, n)
        np.add.at(distinct, inside, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            seen = -np.log2(n / (total + distinct)[inside])
        if k:  # what an escape leads to: the same byte after a context shorter by its first byte
            shorter = keys & np.uint64((1 << (8 * k)) - 1)
            lower = np.zeros((len(keys), len(langs)))
            found, where = _find(pairs[k - 1][0], shorter)
            lower[found] = pairs[k - 1][1][where[found]]
            if not found.all():
                raise ValueError("counts of a shorter context are missing")
        else:
            lower = np.full((len(keys), len(langs)), base)
        pairs.append((keys, np.where(n > 0, seen, escape[inside] + lower)))
        escapes.append((contexts, escape))
    return Trees(langs, order, pairs, escapes, base)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, order: int = 3, modulus: int = 4, remainder: int = 2, sample_rows: int = 20_000) -> Trees:
    """Learn the trees from labelled rows that are not held out.

    The classifier is fitted on a bounded sample: about ``sample_rows`` rows
    in all, those of the smallest hash of their id (all rows where there are
    fewer). Each task counts its contexts and Spark sums them; the sums, whose
    number the sample bounds, become the frozen trees.
    """
    usable = docs.filter(
        F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`"), modulus, remainder)
    )
    there = usable.count()
    share = 1.0 if there <= sample_rows else sample_rows / there
    # 31 bits of a hash against the share
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(7), F.col(f"`{id_col}`")), F.lit(1 << 31)) < F.lit(int(share * (1 << 31))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                words.setdefault(lang, Counter()).update(text.encode().lower().split())
        for lang, found in words.items():
            yield context_counts(found, order).assign(lang=lang)[["lang", "k", "key", "n"]]

    counted = (
        chosen.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
        .mapInPandas(lambda batches: released(count(batches)), "lang string, k int, key long, n long")
        .groupBy("lang", "k", "key")
        .agg(F.sum("n").alias("n"))
    )
    return freeze(counted.toPandas(), order)


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits`` (code length under the chosen language).

    ``score`` is the share of the chosen language when every language is as
    likely as its code length says (2 to the power of minus the bits). Ties go
    to the first language by name. A text that is null or has no letter (or a
    table without labelled rows to learn from) gets ``und`` with score 0 and
    null bits. Whole texts are read, very long ones too; repeated rows get
    equal results each. An empty table gives no rows. Other columns pass
    through; columns of the three added names are replaced. The text column is
    found whatever its case.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    added = {"lang_pred": "string", "score": "double", "bits": "double"}
    kept = [f for f in docs.schema.fields if f.name.lower() not in added]
    schema = StructType([*kept, *(StructField(c, kind()) for c, kind in (("lang_pred", StringType), ("score", DoubleType), ("bits", DoubleType)))])
    place = place_of([f.name for f in kept], text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen: Trees = sent.value
        prices = WordPrices(frozen)
        for batch in batches:
            texts = [t if t and has_letter(t) else None for t in batch.column(place).cast(pa.large_binary()).to_pylist()]
            preds, scores, lengths = [], [], []
            for b in prices.of(texts) if frozen.langs else [None] * len(texts):
                best = None if b is None else int(np.argmin(b))
                preds.append("und" if b is None else frozen.langs[best])
                scores.append(0.0 if b is None else float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
                lengths.append(None if b is None else float(b[best]))
            extra = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    return docs.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(lambda batches: released(score(batches)), schema)


def has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or LETTER.search(text.decode("utf-8", "replace")) is not None


class WordPrices:
    """Code lengths of texts, by a table of the distinct words met so far."""

    def __init__(self, trees: Trees):
        self.trees, self.table, self.costs = trees, {}, np.zeros((0, len(trees.langs)))

    def of(self, texts: list[bytes | None]) -> Iterator[np.ndarray | None]:
        """The bits of each text in every language, None for None, in order."""
        for group in blocks(texts):
            split = [None if t is None else t.lower().split() for t in group]
            if len(self.table) > TABLE_WORDS:
                self.table, self.costs = {}, self.costs[:0]
            self._price(set().union(*(w for w in split if w is not None)))
            for words in split:
                if words is None:
                    yield None
                else:
                    yield self.costs[np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def _price(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.table]
        if fresh:
            self.costs = np.concatenate([self.costs, *(self.trees.cost(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000))])
            self.table.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))


def keep_identified(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with their own columns only, whatever their names.

    If no language could be learned, those whose text has a letter. Null and
    empty texts have none; repeated rows stay together; an empty table gives no
    rows.
    """
    if not trees.langs:
        place = place_of(docs.columns, text_col)

        def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([bool(t) and has_letter(t) for t in batch.column(place).cast(pa.large_binary()).to_pylist()], pa.bool_()))

        return docs.mapInArrow(lambda batches: released(lettered(batches)), docs.schema)
    # columns of the added names are out of the way meanwhile
    names = free([*docs.columns, "lang_pred", "score", "bits"], *docs.columns)
    spare = docs.toDF(*names)
    marked = identify(spare, trees, id_col, names[place_of(docs.columns, text_col)])
    return marked.filter(F.col("lang_pred") != "und").select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])
