"""Search for near texts by an inverted index, and greedy acceptance in rounds.

A sequence ratio of r between texts of n and m letters needs r (n + m) / 2
letters in common (each as often as both have it). So of its letters, rarest
first, a text must share one of the first few with any text that near; only
texts that meet in such a posting are compared.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from quillmill.functions import kernels
from quillmill.functions import text as X
from quillmill.functions.udfs import near_texts, ratio_reaches
from quillmill.sources.staging import stage

log = logging.getLogger(__name__)

#: Rows of a block that are settled in order at a time, at first and at most.
FIRST_BATCH, LAST_BATCH = 125, 1000
#: Accepted rows that are broadcast at a time.
SENT_ROWS = 50_000


@F.pandas_udf(ArrayType(StringType()))
def numbered_letters(texts: pd.Series) -> pd.Series:
    """The letters of a text, each with the number of its occurrence: texts share as many as they have letters in common."""

    def one(t: str | None) -> list[str]:
        seen: Counter = Counter()
        out = []
        for c in t or "":
            seen[c] += 1
            out.append(f"{c}{seen[c]}")
        return out

    return texts.map(one)


def _rarest(texts: DataFrame, tokens: Column, size: Column, counts: DataFrame) -> DataFrame:
    """(id, s, token) of the ``size`` rarest tokens of each text; ``counts`` has (s, token, n)."""
    each = texts.select("id", "s", tokens.alias("tokens")).select("id", "s", size.alias("size"), F.explode("tokens").alias("token"))
    # the tokens of one text: as many as it has letters
    told = each.join(counts, ["s", "token"], "left").groupBy("id", "s", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("sorted"))
    return told.select("id", "s", F.explode(F.slice("sorted", F.lit(1), F.col("size"))).alias("x")).select("id", "s", F.col("x.token").alias("token"))


def posted(queries: DataFrame, corpus: DataFrame, tokens: Column, shares: float) -> tuple[DataFrame, DataFrame]:
    """Postings (id, s, token, length, o) of both sides, of the tokens by which texts that matter must meet.

    ``queries`` and ``corpus`` have (id, s, t, o). Of its n tokens a text must
    share ``shares`` * n, rounded up, with each text that matters, so one of the
    n - that + 1 rarest of both is shared.
    """
    size = (F.size("tokens") - F.ceil(F.lit(shares) * F.size("tokens") - kernels.ROUNDING) + 1).cast("int")
    spread = corpus.select("s", F.explode(tokens).alias("token")).groupBy("s", "token").agg(F.count("*").alias("n"))
    one = lambda df: stage(_rarest(df, tokens, size, spread).join(df.select("id", F.length("t").alias("length"), "o"), "id"), "near-postings")
    b = one(corpus)
    a = b if queries is corpus else one(queries)
    return a, b.select("s", "token", *[F.col(c).alias(f"b_{c}") for c in ("id", "length", "o")])


def met(a: DataFrame, b: DataFrame, shares: float, earlier: bool) -> DataFrame:
    """Distinct pairs (id, other) that meet in a posting, of lengths that allow it; with ``earlier`` only others of smaller ``o``."""
    pairs = a.join(b, ["s", "token"]).filter(F.least("length", "b_length") >= shares * F.greatest("length", "b_length") - kernels.ROUNDING)
    if earlier:
        pairs = pairs.filter(F.col("b_o") < F.col("o"))
    return pairs.select("id", F.col("b_id").alias("other")).distinct()


def _edges(t: Column, left: float, right: float) -> Column:
    """A share of a text's letters from its beginning and one from its end."""
    n = F.length(t)
    return F.concat(F.left(t, F.ceil(n * left).cast("int")), F.lit(" "), F.right(t, F.ceil(n * right).cast("int")))


def with_near(queries: DataFrame, corpus: DataFrame, least: float, earlier: bool = False, jaccard: bool = False) -> DataFrame:
    """Ids of the queries that have a near text in the corpus: of the same ``s`` and of a ratio of ``least`` or more.

    Both have (id, s, t, o), t without blanks or nulls; with ``earlier`` only texts
    of smaller ``o`` count; with ``jaccard`` a Jaccard similarity of 3-grams of
    ``least`` is near too. Whether there is one is all that is asked, so most
    texts are settled by a few tries: the first text with the same beginning, the
    same end or the same of both, then the first one of each posting. Only
    those left meet whole postings, so candidates do not grow with the square
    of a group of near texts.
    """
    near = (near_texts if jaccard else ratio_reaches)("t", "bt", F.lit(least))
    tried = None
    for left, right in ((0.6, 0.0), (0.0, 0.6), (0.35, 0.35)):
        part = _edges(F.col("t"), left, right).alias("part")
        first = corpus.groupBy("s", part).agg(F.min(F.struct("o", "t")).alias("f")).select("s", "part", F.col("f.o").alias("bo"), F.col("f.t").alias("bt"))
        one = queries.select("*", part).join(first, ["s", "part"])
        one = (one.filter("bo < o") if earlier else one).select("id", "t", "bt")
        tried = one if tried is None else tried.unionByName(one)
    settled = stage(tried.filter(near).select("id").distinct(), "near-tried")
    open_ = stage(queries.join(settled, "id", "left_anti"), "near-open")
    share = least / (2 - least)
    # (tokens, share of them that near texts have in common)
    kinds = [(numbered_letters("t"), share), *([(X.char_ngram_set(F.col("t")), least)] if jaccard else [])]
    postings = [posted(queries if queries is corpus else open_, corpus, tokens, shares) for tokens, shares in kinds]
    for heads in (True, False):
        pairs = None
        for (a, b), (_, shares) in zip(postings, kinds):
            if heads:
                b = b.groupBy("s", "token").agg(F.min(F.struct("b_o", "b_id", "b_length")).alias("f")).select("s", "token", "f.*")
            found = met(a.join(open_.select("id"), "id", "left_semi"), b, shares, earlier)
            pairs = found if pairs is None else pairs.unionByName(found)
        full = pairs.distinct().join(open_.select("id", "t"), "id").join(corpus.select(F.col("id").alias("other"), F.col("t").alias("bt")), "other")
        new = stage(full.select("id", "t", "bt").filter(near).select("id").distinct(), "near-found")
        settled = settled.unionByName(new)
        if heads:
            open_ = stage(open_.join(new, "id", "left_anti"), "near-open")
    return settled


Clash = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def accept_in_order(rows: DataFrame, clash: Clash, target: int | None = None) -> DataFrame:
    """Ids of the rows that a loop over each block would accept: in order, unless they clash with a row accepted before.

    ``rows`` have (id, block, ord) and what ``clash`` reads, block without nulls; ties of ``ord`` go by id.
    ``clash(later, earlier)`` tells, as a matrix, which rows of one frame clash
    with which of another. The result is the lexicographically first maximal
    independent set. It is found in rounds: the first ``FIRST_BATCH`` open rows of
    every block are settled among themselves, in one task a block and round; all
    that clash with one accepted are struck from the open rows, wherever these
    are; then twice as many, up to ``LAST_BATCH``. No task sees a whole block, and a
    block that has ``target`` rows is done. Open rows are staged each round, so a
    lost executor repeats one round only.
    """
    spark = rows.sparkSession
    open_ = stage(rows, "greedy-open")
    schema = open_.schema
    found: list[DataFrame] = []
    have = spark.createDataFrame([], "block string, have long")
    batch, turn = FIRST_BATCH, 0

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], kind="stable").reset_index(drop=True)
        near = clash(pdf, pdf)
        ok = np.zeros(len(pdf), bool)
        for k in range(len(pdf)):
            ok[k] = not (near[k] & ok).any()
        return pdf.assign(accepted=ok)

    while True:
        ranked = open_.withColumn("__rn", F.row_number().over(Window.partitionBy("block").orderBy("ord", "id"))).filter(F.col("__rn") <= batch).drop("__rn")
        kind = schema.simpleString()[len("struct<") : -1]
        decided = stage(ranked.groupBy("block").applyInPandas(settle, f"{kind},accepted:boolean"), "greedy-decided")
        new = decided.filter("accepted").drop("accepted")
        if target is not None:
            have_now = have.withColumnRenamed("block", "hb")
            place = F.row_number().over(Window.partitionBy("block").orderBy("ord", "id"))
            new = new.join(have_now, F.col("block").eqNullSafe(F.col("hb")), "left").withColumn("__p", place + F.coalesce("have", F.lit(0))).filter(F.col("__p") <= target).drop("hb", "have", "__p")
        new = stage(new, "greedy-accepted")
        found.append(new.select("id"))
        rest = open_.join(decided.select("id"), "id", "left_anti")
        if target is not None:
            have = stage(have.unionByName(new.groupBy("block").agg(F.count("*").alias("have"))).groupBy("block").agg(F.sum("have").alias("have")), "greedy-have")
            done = have.filter(F.col("have") >= target).select(F.col("block").alias("hb"))
            rest = rest.join(done, F.col("block").eqNullSafe(F.col("hb")), "left_anti")
        rest = struck(rest, new, clash)
        open_ = stage(rest, "greedy-open")
        left = open_.count()
        turn += 1
        log.info("round %d: %d rows a block settled, %d rows open", turn, batch, left)
        if not left:
            break
        batch = min(2 * batch, LAST_BATCH)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def struck(rows: DataFrame, accepted: DataFrame, clash: Clash) -> DataFrame:
    """The rows that clash with no accepted row of their block; accepted rows go out in parts of ``SENT_ROWS``."""
    names = rows.columns
    parts = ceil(accepted.count() / SENT_ROWS)
    for p in range(parts):
        here = accepted if parts == 1 else accepted.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        sent = rows.sparkSession.sparkContext.broadcast(dict(list(here.toPandas().groupby("block", dropna=False))))
        rows = rows.mapInArrow(_not_clashing(sent, clash, names), rows.schema)
    return rows


def _not_clashing(sent, clash: Clash, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            keep = np.ones(len(pdf), bool)
            for block, own in pdf.groupby("block", dropna=False):
                near = sent.value.get(block)
                if near is not None:
                    keep[own.index] = ~clash(own.reset_index(drop=True), near.reset_index(drop=True)).any(axis=1)
            yield batch.filter(pa.array(keep))

    return run


def accept_disjoint(rows: DataFrame) -> DataFrame:
    """Ids of the rows that a loop over each block would accept: in order, unless a key was seen with an accepted row.

    ``rows`` have (id, block, ord, keys). In each round a row that is the first
    open one of all its keys is accepted, and rows that share a key with it are
    struck; both are sums and joins by key, so a key that many rows have makes
    no pairs. Rounds are as many as the longest chain of rows that wait for
    each other. Rows without keys are never accepted.
    """
    each = rows.filter(F.size("keys") > 0).select("id", "ord", "block", F.explode(F.array_distinct("keys")).alias("key"))
    open_ = stage(each, "disjoint-open")
    found: list[DataFrame] = []
    turn = 0
    while True:
        first = open_.groupBy(F.col("block").alias("b"), F.col("key").alias("k")).agg(F.min(F.struct("ord", "id")).alias("first"))
        own = open_.join(first, F.col("block").eqNullSafe(F.col("b")) & F.col("key").eqNullSafe(F.col("k")))
        new = stage(own.groupBy("id").agg(F.bool_and(F.col("first.id") == F.col("id")).alias("ok")).filter("ok").select("id"), "disjoint-accepted")
        found.append(new)
        # an accepted row is the only one of each of its keys, so this join does not multiply rows
        taken = open_.join(new, "id", "left_semi").select(F.col("block").alias("b"), F.col("key").alias("k"))
        gone = open_.join(taken, F.col("block").eqNullSafe(F.col("b")) & F.col("key").eqNullSafe(F.col("k"))).select("id").distinct()
        open_ = stage(open_.join(gone, "id", "left_anti"), "disjoint-open")
        left = open_.select("id").distinct().count()
        turn += 1
        log.info("round %d: %d rows open", turn, left)
        if not left:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
