"""Labels from the layout of a document's lines, as folds over its lines in order (T7d).

A classification is written in levels (large, middle, small, detail). The label
wanted is that of one level; where it stands depends on the layout: beside its
header, below a stack of headers, or in a run of codes with names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X

#: Fixed value: a code of one or two digits, a dot or bracket, and a name up to the next code.
PAIR = r"(?<![0-9])([0-9]{1,2})\s*[.)]\s*([^0-9]+?)(?=(?<![0-9])[0-9]{1,2}\s*[.)]|$)"

NAMES = "array<string>"


def _lines(text: Column) -> Column:
    return F.split(X.text_or_empty(text), "\n")


def clean_name(c: Column) -> Column:
    """A name without bracketed parts, outer punctuation and runs of white space."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\s+", " ")
    return F.regexp_replace(bare, r"^[ ,:;|\-]+|[ ,:;|\-]+$", "")


def _names(line: Column, headers: tuple[str, ...], group: int = 2) -> Column:
    """Names of the pairs on a line; headers and numbers are none."""
    found = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(group)), clean_name)
    return F.filter(found, lambda n: (n != "") & ~n.isin(*headers) & ~n.rlike("^[0-9]+$"))


def header_positions(df: DataFrame, doc: str, text: str, headers: tuple[str, ...], wanted: int) -> DataFrame:
    """Labels of level ``wanted`` by where its header stands.

    The first line that begins with the header and goes on gives the names of
    its pairs, or else its parts between commas, slashes, bars or dots. Without such a
    line, headers that stand alone on lines, one after another in order, open a
    block: at least as many as reach ``wanted``. The first line below with two or three pairs gives the
    second of them; lines with one pair are passed by, and one with more ends the search. Each label once for
    each document, numbered as it stands. A document without any has no row.
    """
    header, levels = headers[wanted], len(headers)
    spaced = r"\s*".join(header)
    beside = F.transform(_lines(F.col(text)), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"\s+", " ")), rf"^{spaced}\s*[:： ]\s*(.+)$", 1))

    def values(rest: Column) -> Column:
        parts = F.filter(F.transform(F.split(rest, "[,/|·]"), clean_name), lambda n: (n != "") & ~n.isin(*headers))
        return F.when(F.size(_names(rest, headers)) > 0, _names(rest, headers)).otherwise(parts)

    across = F.filter(F.transform(F.filter(beside, lambda r: r != ""), values), lambda v: F.size(v) > 0)
    # how many headers have come in order, the line of the last, and the line at hand
    state = "struct<seen:int,end:int,at:int>"

    def step(s: Column, line: Column) -> Column:
        compact = F.regexp_replace(line, r"\s+", "")
        expected = F.get(F.array(*[F.lit(h) for h in headers]), s["seen"])
        seen = F.when(s["seen"] >= levels, s["seen"]).when(compact == expected, s["seen"] + 1).when(compact.isin(*headers), 0).otherwise(s["seen"])
        end = F.when((s["seen"] < levels) & (compact == expected), s["at"]).otherwise(s["end"])
        return F.struct(seen.cast("int").alias("seen"), end.cast("int").alias("end"), (s["at"] + 1).cast("int").alias("at")).cast(state)

    start = F.struct(F.lit(0).alias("seen"), F.lit(-1).alias("end"), F.lit(0).alias("at")).cast(state)
    walked = F.aggregate("__lines", start, step)
    below = F.slice("__lines", F.col("__state.end") + 2, F.size("__lines"))
    rows = F.filter(F.transform(below, lambda x: _names(x, headers)), lambda n: F.size(n) > 1)
    row = F.get(rows, F.lit(0))
    down = F.when((F.col("__state.seen") > wanted) & F.size(row).between(2, 3), F.slice(row, 2, 1)).otherwise(F.array().cast(NAMES))
    labels = F.coalesce(F.get("__across", F.lit(0)), down)
    told = df.select(doc, _lines(F.col(text)).alias("__lines"), across.alias("__across")).withColumn("__state", walked)
    return told.select(doc, F.posexplode(F.array_distinct(labels)).alias("pos", "label"))


def code_pairs(df: DataFrame, doc: str, text: str, headers: tuple[str, ...], wanted: int, known: Column | None = None) -> DataFrame:
    """Labels of level ``wanted`` in runs of codes with names.

    Where some line has two pairs or more, pairs are taken row by row: a row of
    the table is full when all levels have come, maybe over several lines, and
    its name at ``wanted`` is a label (each time the row grows beyond it). Where every
    line has one pair, levels come in turn: the name at ``wanted``, or, if more of
    them are ``known`` (a column of the names, ``name``), each second name from there on.
    """
    pairs = F.filter(F.transform(_lines(F.col(text)), lambda x: _names(x, headers)), lambda n: F.size(n) > 0)
    state = f"struct<row:{NAMES},out:{NAMES}>"

    def step(s: Column, names: Column) -> Column:
        row = F.concat(s["row"], names)
        out = F.when(F.size(row) > wanted, F.concat(s["out"], F.slice(row, wanted + 1, 1))).otherwise(s["out"])
        return F.struct(F.when(F.size(row) >= len(headers), F.array().cast(NAMES)).otherwise(row).alias("row"), out.alias("out")).cast(state)

    none = F.array().cast(NAMES)
    by_row = F.aggregate("__pairs", F.struct(none.alias("row"), none.alias("out")).cast(state), step)["out"]
    flat = F.flatten("__pairs")
    one = F.slice(flat, wanted + 1, 1)
    turns = F.filter(flat, lambda _, i: (i >= wanted) & ((i - wanted) % 2 == 0))
    if known is not None:
        valid = lambda names: F.size(F.array_distinct(F.array_intersect(names, known)))
        one = F.when(valid(turns) > F.size(F.array_distinct(one)), F.array_intersect(turns, known)).otherwise(one)
    wide = F.coalesce(F.array_max(F.transform("__pairs", lambda n: F.size(n))), F.lit(0)) > 1
    told = df.select(doc, *([known.alias("__known")] if known is not None else []), pairs.alias("__pairs"))
    return told.select(doc, F.posexplode(F.array_distinct(F.when(wide, by_row).otherwise(one))).alias("pos", "label"))


def vertical_blocks(df: DataFrame, doc: str, text: str, headers: tuple[str, ...], wanted: int, stop: str) -> DataFrame:
    """Labels of level ``wanted`` in values that stand line by line below its header.

    From the header's line on, the codes of the pairs are followed: a run begins
    at code 1 and goes on while each code is one more than the last; a
    code that does not fit ends the run, so that a deeper level that starts
    again from 1 is left out. A line that fits ``stop`` ends the document's values. Each
    line that names a level above opens the next block.
    """
    header, above = headers[wanted], headers[wanted - 1] if wanted else None
    state = f"struct<open:boolean,last:int,done:boolean,out:{NAMES}>"

    def step(s: Column, line: Column) -> Column:
        compact = F.regexp_replace(line, r"\s+", "")
        opens = compact.contains(header)
        again = compact.contains(above) if above else F.lit(False)
        code = F.regexp_extract(line, PAIR, 1)
        name = clean_name(F.regexp_extract(line, PAIR, 2))
        number = F.when(code != "", code.cast("int"))
        fits = s["open"] & ~s["done"] & (name != "") & (number == s["last"] + 1)
        ended = F.when(line.rlike(stop), True).when(opens | again, False).otherwise(s["done"] | (s["open"] & number.isNotNull() & ~F.coalesce(fits, F.lit(False)) & (s["last"] > 0)))
        return F.struct(
            (s["open"] | opens).alias("open"),
            F.when(opens | again, 0).when(F.coalesce(fits, F.lit(False)), number).otherwise(s["last"]).cast("int").alias("last"),
            F.coalesce(ended, F.lit(False)).alias("done"),
            F.when(F.coalesce(fits, F.lit(False)) & ~opens, F.concat(s["out"], F.array(name))).otherwise(s["out"]).alias("out"),
        ).cast(state)

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("last"), F.lit(False).alias("done"), F.array().cast(NAMES).alias("out")).cast(state)
    told = df.select(doc, F.aggregate(_lines(F.col(text)), start, step)["out"].alias("labels"))
    return told.select(doc, F.posexplode(F.array_distinct("labels")).alias("pos", "label"))
