"""Similar texts: predicates, repeats, histories and greedy diverse sets."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import kernels
from quillmill.functions import text as X
from quillmill.functions.udfs import sequence_ratio
from quillmill.operators.nearness import accept_disjoint, accept_in_order, with_near
from quillmill.sources.staging import stage


def similar_sets(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """D4 without the sequence ratio: equal keys, enough shared tokens, or near 3-gram sets."""
    ka, kb = X.question_key(a), X.question_key(b)
    ta, tb = X.question_tokens(a, stop), X.question_tokens(b, stop)
    ga, gb = X.char_ngram_set(a), X.char_ngram_set(b)
    shared = F.size(F.array_intersect(ta, tb))
    close = ((X.overlap(ta, tb) >= 0.62) & (shared >= 5)) | ((shared >= 4) & (X.jaccard(ta, tb) >= 0.8)) | ((F.size(ga) > 0) & (F.size(gb) > 0) & (X.jaccard(ga, gb) >= 0.68))
    return (ka != "") & (kb != "") & ((ka == kb) | ((F.size(ta) > 0) & (F.size(tb) > 0) & close))


def similar_texts(a: Column, b: Column, stop: tuple[str, ...] = (), least_ratio: float = 0.92) -> Column:
    """D4 with the sequence ratio of the keys."""
    ka, kb = X.question_key(a), X.question_key(b)
    return similar_sets(a, b, stop) | ((ka != "") & (kb != "") & (sequence_ratio(ka, kb) >= least_ratio))


def not_in_history(df: DataFrame, text: str, history: DataFrame, past: str) -> DataFrame:
    """D3: rows whose normalised text the history does not hold."""
    known = history.select(X.question_key(F.col(past)).alias("__h")).filter("__h <> ''").distinct()
    return df.withColumn("__k", X.question_key(F.col(text))).join(known, F.col("__k") == F.col("__h"), "left_anti").drop("__k")


def repeats(df: DataFrame, key: str, signature: Column, text: Column, order: str, least: float = 0.88, general: str = "general") -> DataFrame:
    """Whether an earlier row of the same signature is near, or the signature is a general one.

    Every earlier row counts, not only accepted ones. Rows of one text and
    signature are one text: all but its first are repeats, and the first is one
    if an earlier text is near. That is searched with an index of rare letters,
    so texts of a signature are not compared with all others.
    """
    rows = df.select(F.col(key).alias("k"), signature.alias("s"), X.question_key(text).alias("t"), F.col(order).alias("o")).filter("s <> ''")
    # of a general signature all but the first are repeats, whatever their texts: they count as one that no key is; a blank text repeats nothing
    shown = rows.withColumn("t", F.when(F.col("s").endswith(general), "*").otherwise(F.col("t"))).filter("t <> ''")
    texts = stage(shown.groupBy("s", "t").agg(F.min("o").alias("o")).withColumn("id", F.monotonically_increasing_id()), "repeat-texts")
    compared = texts.filter("t <> '*'")
    near = with_near(compared, compared, least, earlier=True).withColumn("near", F.lit(True))
    facts = texts.join(near, "id", "left").select(F.col("s").alias("fs"), F.col("t").alias("ft"), F.col("o").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    told = shown.join(facts, (F.col("s") == F.col("fs")) & (F.col("t") == F.col("ft"))).filter(F.col("near") | (F.col("o") > F.col("first")))
    found = told.select(F.col("k").alias("__key")).distinct().withColumn("repeated", F.lit(True))
    return df.join(found, F.col(key) == F.col("__key"), "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))).drop("__key")


def history_duplicates(df: DataFrame, key: str, text: str, history: DataFrame, past: str, signature: Callable[[Column], Column], least: float = 0.86) -> DataFrame:
    """Equal keys, or the same scenario and a ratio or 3-gram Jaccard at the bar; blank texts count as duplicates."""
    rows = stage(df.select(F.col(key).alias("k"), X.surface_key(F.col(text)).alias("t"), signature(F.col(text)).alias("s")).withColumn("s", F.coalesce("s", F.lit(""))), "history-rows")
    old = history.select(X.surface_key(F.col(past)).alias("t"), F.coalesce(signature(F.col(past)), F.lit("")).alias("s")).filter("t <> ''").distinct()
    numbered_ = lambda d, name: stage(d.withColumn("id", F.monotonically_increasing_id()).withColumn("o", F.col("id")), name)
    texts, known = numbered_(rows.filter("t <> ''").select("s", "t").distinct(), "history-texts"), numbered_(old, "history-known")
    near = texts.join(with_near(texts, known, least, jaccard=True), "id", "left_semi").select(F.col("s").alias("ns"), F.col("t").alias("nt"))
    same = rows.join(known.select(F.col("t").alias("nt")).distinct(), F.col("t") == F.col("nt"), "left_semi").select("k")
    close = rows.join(near, (F.col("s") == F.col("ns")) & (F.col("t") == F.col("nt")), "left_semi").select("k")
    hit = rows.filter("t = ''").select("k").unionByName(same).unionByName(close).distinct().withColumn("duplicate", F.lit(True))
    return df.join(hit.withColumnRenamed("k", "__key"), F.col(key) == F.col("__key"), "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("__key")


def numbered(df: DataFrame, order: str, name: str, ranges: int = 200) -> DataFrame:
    """Rows numbered from 0 by a numeric column, without one task that sees all.

    Quantiles cut the column into ``ranges`` ranges at most; rows are numbered
    in each, and counts of the ranges before, which come to the driver, are
    added.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.002)))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("__range", F.size(F.filter(bounds, lambda c: F.col(order) > c)))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before, starts = 0, []
    for k in sorted(counts):
        starts.append((k, before))
        before += counts[k]
    offsets = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return placed.withColumn(name, inside).join(F.broadcast(offsets), "__range").withColumn(name, (F.col(name) + F.col("__start")).cast("int")).drop("__range", "__start")


def remap_children(parents: DataFrame, index: str, keep: Column, children: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """Kept parents numbered anew from 0, and their children with the new number; orphans go."""
    renumbered = numbered(parents.filter(keep), index, "new_index")
    return renumbered, children.join(renumbered.select(F.col(index).alias(parent), "new_index"), parent)


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two results hold the same rows, by counts of row digests."""
    digest = lambda df: df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    odd = digest(a).alias("a").join(digest(b).alias("b"), "h", "full_outer").filter(~F.col("a.n").eqNullSafe(F.col("b.n")))
    return odd.agg((F.count("*") == 0).alias("same"))


def similar_keys(later: list[str], earlier: list[str], stop: frozenset[str] = frozenset(), least_ratio: float = 0.92) -> np.ndarray:
    """D4 for question keys, each of one list with each of the other, as a matrix; a blank key is like none."""
    texts = later + earlier
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(later)), np.arange(len(earlier)) + len(later), indexing="ij"))
    out = kernels.ratios_reach(texts, i, j, least_ratio).reshape(len(later), len(earlier))
    words = [{t for t in k.split() if len(t) >= 2 and t not in stop} for k in texts]
    grams = [kernels.char_grams(k.replace(" ", "")) for k in texts]
    cut = len(later)
    both = kernels.shared(words[:cut], words[cut:])
    n, m = np.array([len(w) for w in words[:cut]])[:, None], np.array([len(w) for w in words[cut:]])[None, :]
    some = (n > 0) & (m > 0)
    near = ((both >= 5) & (both / np.maximum(1, np.minimum(n, m)) >= 0.62)) | ((both >= 4) & (both / np.maximum(1, n + m - both) >= 0.8))
    g, h = np.array([len(w) for w in grams[:cut]])[:, None], np.array([len(w) for w in grams[cut:]])[None, :]
    common = kernels.shared(grams[:cut], grams[cut:])
    near |= (g > 0) & (h > 0) & (common / np.maximum(1, g + h - common) >= 0.68)
    told = np.array([k != "" for k in texts])
    return (out | (some & near)) & told[:cut, None] & told[None, cut:]


def _numbered_rows(df: DataFrame, block: str, order: str, **columns: Column) -> DataFrame:
    """Rows as (id, block, ord, ...); a null block is one of its own."""
    return stage(
        df.select(F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("")).alias("block"), F.col(order).cast("long").alias("ord"), *[c.alias(n) for n, c in columns.items()]).withColumn("id", F.monotonically_increasing_id()),
        "greedy-rows",
    )


def _marked(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """(block, ord, accepted) of every row."""
    found = rows.join(accepted.withColumn("accepted", F.lit(True)), "id", "left")
    return found.select(F.when(F.col("block") != "", F.substr("block", F.lit(2))).alias("block"), "ord", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def diverse_set(df: DataFrame, block: str, text: str, order: str, target: int | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """Accept in order unless similar to an accepted text of the block, until ``target`` are accepted."""
    words = frozenset(stop)
    rows = _numbered_rows(df, block, order, key=X.question_key(F.col(text)))

    def clash(later: pd.DataFrame, earlier: pd.DataFrame) -> np.ndarray:
        return similar_keys(later["key"].tolist(), earlier["key"].tolist(), words)

    return _marked(rows, accept_in_order(rows.filter("key <> ''"), clash, target))


def scoped_unique(df: DataFrame, scope: str, scenario: Column, context: Column, text: str, order: str, least: float = 0.84, context_bar: float = 0.45, shortest: int = 24) -> DataFrame:
    """Accept in order unless near an accepted text of the same scope, of compatible scenario and context.

    A text of fewer than ``shortest`` characters is always accepted.
    """
    rows = _numbered_rows(df, scope, order, key=X.surface_key(F.col(text)), scenario=F.coalesce(scenario, F.lit("")), context=F.coalesce(context, F.lit("")))

    def clash(later: pd.DataFrame, earlier: pd.DataFrame) -> np.ndarray:
        keys = later["key"].tolist() + earlier["key"].tolist()
        cut = len(later)
        long_ = (later["key"].str.len() >= shortest).to_numpy()[:, None]
        scenes = [d["scenario"].to_numpy(object) for d in (later, earlier)]
        fits = long_ & ~((scenes[0] != "")[:, None] & (scenes[1] != "")[None, :] & (scenes[0][:, None] != scenes[1][None, :]))
        grams = [kernels.char_grams(k) or {k} for k in keys]
        common = kernels.shared(grams[:cut], grams[cut:])
        g, h = np.array([len(w) for w in grams[:cut]])[:, None], np.array([len(w) for w in grams[cut:]])[None, :]
        near = fits & (common / (g + h - common) >= least)
        i, j = np.nonzero(fits & ~near)
        near[i, j] = kernels.ratios_reach(keys, i, j + cut, least)
        # contexts are looked at where texts are near; equal pairs of contexts once
        i, j = np.nonzero(near)
        abouts, place = np.unique(np.concatenate([later["context"].to_numpy(object)[i], earlier["context"].to_numpy(object)[j]]).astype(object), return_inverse=True)
        pairs, back = np.unique(np.stack([place[: len(i)], place[len(i) :]]), axis=1, return_inverse=True)
        told = [not (abouts[a] and abouts[b]) or SequenceMatcher(None, abouts[a], abouts[b]).ratio() >= context_bar for a, b in pairs.T]
        near[i, j] = np.array(told, bool)[back.ravel()] if len(i) else False
        return near

    return _marked(rows, accept_in_order(rows, clash))


def unseen_keys(df: DataFrame, block: str, keys: Column, order: str) -> DataFrame:
    """Accept in order unless any key of the row was seen with an accepted one; a row without keys is not accepted."""
    rows = _numbered_rows(df, block, order, keys=keys)
    return _marked(rows, accept_disjoint(rows))
