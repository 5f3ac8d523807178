"""Roll-ups: verdicts, checks, histograms, gates, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Share with the denominator held at 1 or more."""
    return F.round(part / F.greatest(F.lit(1), whole), digits)


def check_counts(items: DataFrame, statuses: str) -> DataFrame:
    """A1: pass, fail and not-applicable counts of each check, with the failure rate over those that apply."""
    each = items.select(F.explode(statuses).alias("check", "status"))
    n = lambda s: F.count_if(F.col("status") == s)
    return each.groupBy("check").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("not_applicable").alias("not_applicable")).withColumn("failure_rate", rate(F.col("failed"), F.col("passed") + F.col("failed")))


def issue_counts(df: DataFrame, issues: Column, allowed: list[str] | None = None) -> DataFrame:
    """A2: rows with each issue, each row once; only allowed issues."""
    each = df.select(F.explode(F.array_distinct(issues)).alias("issue"))
    return (each.filter(F.col("issue").isin(*allowed)) if allowed else each).groupBy("issue").agg(F.count("*").alias("n"))


def first_row(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """A3: the first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("__r")).select(key, "__r.*")


def collisions(df: DataFrame, scope: list[str], surface: Column, factor: Column) -> DataFrame:
    """A4: surfaces shared by several factors within each scope: groups of them, and variants beyond the first."""
    per = df.groupBy(*scope, surface.alias("__s")).agg(F.count_distinct(factor).alias("k"))
    return per.groupBy(*scope).agg(F.count_if(F.col("k") > 1).alias("collision_groups"), F.sum(F.col("k") - 1).alias("variants"))


def matrix(df: DataFrame, keys: list[str], ready: Column, score: Column, text: Column, order: str) -> DataFrame:
    """A5: total, ready and failed counts, ready rate, mean score, exact duplicates and the first sample of each cell."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ready).alias("ready"),
        F.count_if(~ready).alias("failed"),
        rate(F.count_if(ready), F.count("*")).alias("ready_rate"),
        F.round(F.avg(score), 2).alias("average_score"),
        (F.count(text) - F.count_distinct(text)).alias("duplicates"),
        F.min_by(text, F.col(order)).alias("sample"),
    )


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``value=count`` pairs of each group in one text, by value."""
    counts = df.filter(value.isNotNull()).groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__v", "__n"))), lambda x: F.concat(x["__v"].cast("string"), F.lit("="), x["__n"].cast("string"))), "; ").alias("histogram"))


def split_counts(df: DataFrame, key: str, issues: str, delimiter: str = r"\s*[;|]\s*") -> DataFrame:
    """Counts of the parts of a delimited column for each key."""
    return df.select(key, F.explode(F.split(issues, delimiter)).alias("issue")).filter("issue <> ''").groupBy(key, "issue").agg(F.count("*").alias("n"))


def gate_failures(one_row: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """Names of the gates whose rate is null or below its minimum."""
    failed = [F.when(F.coalesce(F.col(column) < least, F.lit(True)), F.lit(name)) for name, (column, least) in gates.items()]
    return one_row.withColumn("failures", F.array_compact(F.array(*failed)))


def most_common(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The ``n`` most common values, ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def sample_summary(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """A10: sorted distinct values of two columns and whether all of the first are among the second."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(a)).alias("a"), F.sort_array(F.collect_set(b)).alias("b"))
    return sets.withColumn("subset", F.size(F.array_except("a", "b")) == 0)


def nested(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows of each key as a list of structs in input order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("items"))


def set_summary(df: DataFrame, keys: list[str], checks: dict[str, Column], score: Column) -> DataFrame:
    """Whether all rows pass each check, and the mean score; null counts as a failure."""
    return df.groupBy(*keys).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()], F.round(F.coalesce(F.avg(score), F.lit(0.0)), 1).alias("score"))


def decisions(reviews: DataFrame, run: str, question: str, verdict: str, questions: Column, escalated: Column) -> DataFrame:
    """The state of each run from its active reviews."""
    facts = reviews.groupBy(run).agg(
        F.bool_or(F.col(verdict) == "reject").alias("__r"), F.bool_or(F.col(verdict) == "needs_edit").alias("__e"),
        F.count_distinct(F.when(F.col(verdict) == "approve", F.col(question))).alias("__a"), F.max(questions).alias("__q"), F.bool_or(escalated).alias("__x"), F.count(verdict).alias("__n"),
    )
    state = F.when(F.col("__r"), "rejected").when(F.col("__e"), "needs_edit").when((F.col("__a") >= F.col("__q")) & ~F.col("__x"), "approved").when(F.col("__n") > 0, "reviewing").otherwise("draft")
    return facts.select(run, state.alias("decision"))


def stage_reached(df: DataFrame, key: str, stage: str, order: str, verified: Column) -> DataFrame:
    """The highest stage before which, and in which, every gate is verified; null for none."""
    each = df.groupBy(key, stage).agg(F.bool_and(verified).alias("__ok"), F.min(order).alias("__o"))
    upto = each.withColumn("__all", F.bool_and("__ok").over(Window.partitionBy(key).orderBy("__o")))
    return upto.groupBy(key).agg(F.max_by(stage, F.when(F.col("__all"), F.col("__o"))).alias("stage"))


def reverse_index(df: DataFrame, label: str, value: str) -> DataFrame:
    """The sorted set of values of each label."""
    return df.groupBy(label).agg(F.sort_array(F.collect_set(value)).alias("values"))


def simulation_summary(df: DataFrame, case: str, text: Column, repaired: Column) -> DataFrame:
    """Generated, unique and repaired counts of each case, and whether nothing repeats."""
    return df.groupBy(case).agg(F.count("*").alias("generated"), F.count_distinct(text).alias("unique"), F.count_if(repaired).alias("repaired")).withColumn("no_duplicates", F.col("generated") == F.col("unique"))
