"""Row filters, lookups and first-wins selection. Input order is an explicit ordinal column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X


def first_wins(df: DataFrame, keys: list[Column], order: list[Column], drop_blank: bool = True) -> DataFrame:
    """Of rows with the same key the first in order stays; rows whose key is blank go."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    if drop_blank:
        keyed = keyed.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(n).cast("string"), F.lit("")) != "" for n in names]))
    return keyed.withColumn("__rn", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).filter("__rn = 1").drop("__rn", *names)


def union_first_wins(frames: list[DataFrame], keys: list[Column], ordinal: str) -> DataFrame:
    """Ordered union of row lists, the first of equal keys stays. ``__source`` is the list's number."""
    ranked = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    return first_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), keys, [F.col("__source"), F.col(ordinal)])


def active_listing(df: DataFrame, active: Column, code: str, name: str, fields: list[str], query: str = "", limit: int = 100) -> DataFrame:
    """active rows with code and name whose joined fields contain the query, by code."""
    found = df.filter(active & X.blank_to_null(F.col(code)).isNotNull() & X.blank_to_null(F.col(name)).isNotNull())
    if query.strip():
        found = found.filter(F.lower(F.concat_ws(" ", *fields)).contains(query.strip().lower()))
    return found.orderBy(code).limit(min(1000, max(1, limit)))


def factor_lookup(df: DataFrame, code: str, wanted: str, texts: list[Column], order: list[Column], longest: int = 120, limit: int = 30) -> DataFrame:
    """factors of one unit: the first filled text, first of equal ones without regard to spaces, cut and limited."""
    rows = df.filter(F.col(code) == wanted).withColumn("factor", X.first_filled(*texts))
    kept = first_wins(rows, [X.squeeze(F.col("factor"))], order)
    return kept.withColumn("factor", F.substring("factor", 1, longest)).orderBy(*order).limit(limit)


def exact_lookup(df: DataFrame, conditions: dict[str, str], order: list[Column]) -> DataFrame:
    """the first row whose columns equal the values without regard to spaces."""
    same = [F.replace(F.trim(c), F.lit(" "), F.lit("")) == F.lit(v.strip().replace(" ", "")) for c, v in conditions.items()]
    return df.filter(reduce(lambda a, b: a & b, same)).orderBy(*order).limit(1)


def negative_feedback(df: DataFrame, verdict: str, active: Column, text: str, newest: list[Column], code: str | None = None, codes: list[str] | None = None, limit: int = 50) -> DataFrame:
    """active rejections and edits with a text, newest first."""
    found = df.filter(F.col(verdict).isin("reject", "needs_edit") & active & F.col(text).isNotNull())
    if codes:
        found = found.filter(F.col(code).isin(*codes))
    return found.orderBy(*newest).limit(min(200, max(1, limit)))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the names of the rules they break)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    checked = df.withColumn("errors", broken)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def options(df: DataFrame, value: str, limit: int, fallback: list[str], longest: int = 60) -> DataFrame:
    """distinct valid values in order, limited; the fallback if there is none."""
    spark = df.sparkSession
    c = X.blank_to_null(F.col(value))
    valid = df.select(c.alias("option")).filter(F.col("option").isNotNull() & (F.length("option") <= longest) & ~F.col("option").rlike(r"[<>{}]|�"))
    found = valid.distinct().orderBy("option").limit(limit)
    spare = spark.createDataFrame([(v,) for v in fallback], "option string")
    none = found.agg(F.count("*").alias("__n")).filter("__n = 0")
    return found.unionByName(spare.join(F.broadcast(none), F.lit(True), "inner").drop("__n"))


def plausible_label(c: Column, longest: int = 40, stop: tuple[str, ...] = ()) -> Column:
    """the reason why a text is no label, or null."""
    t = F.trim(X.text_or_empty(c))
    return (
        F.when(t == "", "blank")
        .when(F.length(t) > longest, "too_long")
        .when(F.length(X.label_key(t)) < 2, "too_short")
        .when(t.rlike(r"^[0-9.\-() ]+$"), "number_only")
        .when(t.rlike(r"[.!?]$"), "sentence")
        .when(F.lower(t).isin(*stop) if stop else F.lit(False), "stop_word")
    )


def merge_terms(base: DataFrame, added: DataFrame, removed: DataFrame, term: str = "term", ordinal: str = "ord") -> DataFrame:
    """base and added terms, first of equal keys, without the removed ones."""
    merged = union_first_wins([base, added], [X.dedup_key(F.col(term))], ordinal)
    gone = removed.select(X.dedup_key(F.col(term)).alias("__gone")).distinct()
    return merged.join(gone, X.dedup_key(F.col(term)) == F.col("__gone"), "left_anti")


def prune(df: DataFrame, age: Column, most_age: float, newest: list[Column], most: int) -> DataFrame:
    """K7: rows not older than the limit, the newest ``most`` of them."""
    return df.filter(age <= most_age).orderBy(*newest).limit(most)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], deactivate: str | None = None) -> DataFrame:
    """K1, K2: rows by natural key; a filled new value wins, a blank one keeps the old.

    With ``deactivate`` all rows that ``new`` does not hold become inactive in
    that column. The result is a new version of the table, to be written beside
    the old one. Of repeated keys in ``new`` the largest row counts.
    """
    one = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("__n"))
    joined = old.join(one, key, "full_outer")
    picked = [F.coalesce(F.nullif(F.col(f"__n.{c}").cast(old.schema[c].dataType), F.lit("").cast(old.schema[c].dataType)) if old.schema[c].dataType.simpleString() == "string" else F.col(f"__n.{c}"), F.col(c)).alias(c) for c in columns]
    state = [F.col("__n").isNotNull().alias(deactivate)] if deactivate else []
    return joined.select(key, *picked, *state)
