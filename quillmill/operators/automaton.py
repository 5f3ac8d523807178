"""Many names sought in many texts at once, by an Aho-Corasick automaton in each task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Characters of names in one automaton, and so at most broadcast at a time.
PART_CHARS = 4_000_000

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a part of the names, built once in each Python worker; one at a time is kept."""
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for n in names:
            made.add_word(n, n)
        made.make_automaton()
        _built[key] = made
    return _built[key]


def counts(automaton: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """Occurrences of each name that do not overlap others of the same name, from the left."""
    found: dict[str, int] = {}
    free: dict[str, int] = {}
    for end, name in automaton.iter(text):
        start = end - len(name) + 1
        if start >= free.get(name, 0):
            found[name] = found.get(name, 0) + 1
            free[name] = end + 1
    return found


def occurrences(df: DataFrame, ident: str, text: Column, names: DataFrame, name: Column) -> DataFrame:
    """(ident, name, times) for each name that a text holds, also inside words.

    Names (blank ones are left out) are measured first; those of up to
    ``PART_CHARS`` characters make one automaton, through which every text is
    read once, whatever the number of names. More are cut into several
    automata by hash, and texts are read once for each. Nothing is shuffled. A
    null text holds nothing.
    """
    wanted = names.select(name.cast("string").alias("name")).filter("name <> ''").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).collect()[0][0]
    parts = max(1, -(-size // PART_CHARS))
    rows = df.select(F.col(ident).alias("ident"), text.cast("string").alias("text")).filter("text <> ''")
    schema = StructType([StructField("ident", rows.schema["ident"].dataType), StructField("name", StringType()), StructField("times", LongType())])
    out = None
    for p in range(parts):
        here = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == p)
        sent = df.sparkSession.sparkContext.broadcast([r["name"] for r in here.toLocalIterator()])
        found = rows.mapInArrow(_sought(sent, uuid.uuid4().hex), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("ident").alias(ident), "name", "times")


def _sought(sent, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        automaton = _automaton(key, names) if names else None
        for batch in batches:
            at, found, times = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist() if automaton else []):
                for n, k in counts(automaton, text).items():
                    at.append(i)
                    found.append(n)
                    times.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["ident", "name", "times"])

    return run
