"""Row-level rules over texts: checks, issues, controls, alignment, repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.streaming.reviewlog import in_order


def statuses(checks: dict[str, tuple[Column, Column]]) -> Column:
    """A map of check name to pass, fail or not_applicable, from (holds, applies) each."""
    parts: list[Column] = []
    for name, (holds, applies) in checks.items():
        parts += [F.lit(name), F.when(~F.coalesce(applies, F.lit(False)), "not_applicable").when(F.coalesce(holds, F.lit(False)), "pass").otherwise("fail")]
    return F.create_map(*parts)


def quality_report(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Q1: statuses, score = pass / applicable (2 digits, 1 if nothing applies) and ready = nothing fails."""
    out = df.withColumn("statuses", statuses(checks))
    values = F.map_values("statuses")
    passed, failed = (F.size(F.filter(values, lambda v: v == F.lit(s))) for s in ("pass", "fail"))  # noqa: B023
    return out.withColumn("score", F.round(F.when(passed + failed > 0, passed / (passed + failed)).otherwise(1.0), 2)).withColumn("ready", failed == 0)


def weighted_realism(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """Q2: 100 less the weights of the checks that fail, 0 at least, with their names."""
    lost = sum((F.when(F.coalesce(c, F.lit(False)), 0).otherwise(w) for c, w in checks.values()), F.lit(0))
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, (c, _) in checks.items()]))
    return df.withColumn("realism", F.greatest(F.lit(0), 100 - lost)).withColumn("realism_issues", names)


def demand_metrics(df: DataFrame, text: Column, actions: tuple[str, ...], most: int) -> DataFrame:
    """Q3: distinct action words and question marks of a text, and whether it demands too much."""
    low = F.lower(X.text_or_empty(text))
    found = F.array_compact(F.array(*[F.when(low.contains(a), F.lit(a)) for a in actions]))
    marks = F.regexp_count(low, F.lit(r"\?"))
    return df.withColumn("actions", found).withColumn("question_marks", marks).withColumn("overloaded", (F.size(found) > most) | (marks > most))


def groups_hit(text: Column, groups: list[tuple[str, ...]]) -> Column:
    """Q4: whether every group of markers has a hit."""
    low = F.lower(X.text_or_empty(text))
    out = F.lit(True)
    for g in groups:
        out &= X.contains_any(low, g)
    return out


def precision_grounding(df: DataFrame, key: str, text: Column, demands: dict[str, str], materials: DataFrame, material_key: str, material_text: Column) -> DataFrame:
    """Q5: clauses that demand precision, and whether the row's trusted material holds the numbers they name.

    ``demands`` are ordered (kind, pattern); a clause has the first kind that
    fits. A clause without numbers, or with numbers that the material holds, is
    allowed.
    """
    clauses = df.select(key, F.posexplode(F.split(X.text_or_empty(text), r"[,.;?!\n]+")).alias("clause_no", "clause")).withColumn("clause", F.trim("clause")).filter("clause <> ''")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(demands.items())):
        kind = F.when(F.col("clause").rlike(pattern), F.lit(name)).otherwise(kind)
    asked = clauses.withColumn("kind", kind).filter("kind is not null").withColumn("values", F.array_distinct(F.regexp_extract_all("clause", F.lit("[0-9]+"), F.lit(0))))
    held = materials.select(F.col(material_key).alias("__m"), F.array_distinct(F.regexp_extract_all(X.text_or_empty(material_text), F.lit("[0-9]+"), F.lit(0))).alias("__v"))
    joined = asked.join(held, F.col(key) == F.col("__m"), "left")
    ok = F.size(F.array_except("values", F.coalesce("__v", F.array().cast("array<string>")))) == 0
    return joined.withColumn("allowed", ok).drop("__m", "__v")


def material_grounding(df: DataFrame, key: str, text: Column, demands: dict[str, tuple[str, tuple[str, ...]]], materials: DataFrame, material_key: str, ref: str, provides: str, material_text: Column, trusted: Column, stop: tuple[str, ...] = ()) -> DataFrame:
    """Q5: clauses that demand precision against a registry of materials: whether trusted ones that share a word (beyond ``stop``) with the clause provide all kinds it requires.

    ``demands`` are ordered (kind: pattern, required kinds); a clause has the
    first that fits. A material row has the text's key, its ``ref``, an array of
    the kinds that it ``provides`` and its text. Returns the clause, its kind,
    ``allowed``, the refs that provide and the first ``reason`` that it fails:
    missing_material, untrusted_material, semantic_mismatch, kind_mismatch; or
    grounded. A text's materials are held as one array.
    """
    clauses = df.select(key, F.posexplode(F.split(X.text_or_empty(text), r"[,.;?!\n]+")).alias("clause_no", "clause")).withColumn("clause", F.trim("clause")).filter("clause <> ''")
    kind, needed = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (pattern, kinds) in reversed(list(demands.items())):
        fits = F.col("clause").rlike(pattern)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        needed = F.when(fits, F.array(*[F.lit(k) for k in kinds])).otherwise(needed)
    asked = clauses.withColumn("kind", kind).withColumn("__needed", needed).filter("kind is not null")
    known = materials.select(F.col(material_key).alias("__m"), F.struct(F.col(ref).alias("ref"), F.coalesce(F.col(provides), F.array().cast("array<string>")).alias("gives"), X.tokens(X.text_or_empty(material_text), stop).alias("words"), F.coalesce(trusted, F.lit(False)).alias("ok")).alias("m"))
    held = known.groupBy("__m").agg(F.array_sort(F.collect_list("m")).alias("__held"))
    joined = asked.join(held, F.col(key) == F.col("__m"), "left")
    safe = F.filter("__held", lambda m: m["ok"])
    near = F.filter(safe, lambda m: F.arrays_overlap(m["words"], X.tokens(F.col("clause"), stop)))
    found = joined.withColumn("__safe", F.size(safe)).withColumn("__near", near)
    gives = lambda k: F.exists("__near", lambda m: F.array_contains(m["gives"], k))
    reason = (
        F.when(F.col("__held").isNull(), "missing_material").when(F.col("__safe") == 0, "untrusted_material").when(F.size("__near") == 0, "semantic_mismatch")
        .when(~F.forall("__needed", gives), "kind_mismatch").otherwise("grounded")
    )
    refs = F.transform(F.filter("__near", lambda m: F.arrays_overlap(m["gives"], "__needed")), lambda m: m["ref"])
    return found.select(key, "clause_no", "clause", "kind", reason.alias("reason"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs")).withColumn("allowed", F.col("reason") == "grounded")


def alignment(df: DataFrame, key: str, points: str, question: Column, least_pass: float = 1.0) -> DataFrame:
    """Q6: evaluation points against the clauses of a question by shared tokens: pass, review or fail for each row.

    An atom (a part of a point) is elicited if a clause shares a token with it;
    all atoms make a pass, none a failure.
    """
    atoms = df.select(key, F.explode(F.array_distinct(F.flatten(F.transform(points, lambda p: F.split(p, r"\s*[,/;]\s*"))))).alias("atom"), X.tokens(question).alias("__q")).filter("trim(atom) <> ''")
    hit = atoms.withColumn("hit", F.arrays_overlap(X.tokens(F.col("atom")), "__q"))
    facts = hit.groupBy(key).agg(F.count("*").alias("atoms"), F.count_if("hit").alias("elicited"))
    state = F.when(F.col("elicited") >= F.col("atoms") * least_pass, "pass").when(F.col("elicited") > 0, "review").otherwise("fail")
    return facts.withColumn("alignment", state)


def control(df: DataFrame, triggers: list[tuple[str, Column, bool]]) -> DataFrame:
    """Q7: (code, condition, escalates): ordered distinct codes, whether a review and an escalation are due."""
    codes = F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c, _ in triggers])))
    escalates = [code for code, _, e in triggers if e]
    return df.withColumn("trigger_codes", codes).withColumn("review_required", F.size("trigger_codes") > 0).withColumn("escalation_required", F.arrays_overlap("trigger_codes", F.array(*[F.lit(c) for c in escalates])) if escalates else F.lit(False))


class History(list):
    """Accepted texts in order; whether a text is among them is known at once."""

    def __init__(self):
        super().__init__()
        self._held: set[str] = set()

    def append(self, text: str) -> None:
        super().append(text)
        self._held.add(text)

    def __contains__(self, text: object) -> bool:
        return text in self._held


def repair_loop(df: DataFrame, block: str, text: str, order: str, audit: Callable[[str, list[str]], list[str]], repair: Callable[[str, list[str], int], str], attempts: int = 6) -> DataFrame:
    """Q8: audit, repair up to ``attempts`` times and audit again, in order; accepted texts join the history.

    Sequential within a block by definition; blocks run in parallel. A task
    goes through a block's rows in sorted batches and holds its accepted texts,
    so blocks may have any number of rows. ``audit`` only reads the history.
    """

    def step(history: History, row: tuple) -> tuple:
        b, o, t = row
        tries, issues = 0, audit(t, history)
        while issues and tries < attempts:
            tries += 1
            t = repair(t, issues, tries)
            issues = audit(t, history)
        if not issues:
            history.append(t)
        return b, o, t, tries, not issues

    shaped = df.select(F.col(block).cast("string").alias("block"), F.col(order).cast("long").alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_order(shaped, ["block"], [F.col("ord").asc_nulls_last()], "block string, ord long, text string, tries int, ready boolean", lambda _: History(), step)


def evidence_locks(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Q9: expected evidence ids against actual ones at the same place; a missing one is a mismatch."""
    return expected.join(actual.select(*keys, F.col(value).alias("actual")), keys, "left").withColumn("locked", F.coalesce(F.col("actual") == F.col(value), F.lit(False)))


def shape_issues(question: Column, follow_ups: Column, points: Column) -> Column:
    """Q10: codes of what is wrong with a question's form, its follow-ups or its evaluation points."""
    q = X.text_or_empty(question)
    return F.array_compact(F.array(
        F.when(~q.rlike(r"[?？]\s*$"), "no_question_mark"),
        F.when(F.length(q) < 20, "too_short"),
        F.when(F.coalesce(F.size(follow_ups), F.lit(0)) < 1, "no_follow_up"),
        F.when(F.size(F.array_distinct(follow_ups)) < F.size(follow_ups), "repeated_follow_up"),
        F.when(F.coalesce(F.size(F.filter(points, lambda p: F.length(p) >= 2)), F.lit(0)) < 2, "few_points"),
    ))


def register_run(items: DataFrame, run: str, text: str, code: str, order: str) -> DataFrame:
    """Q11: for each run the digests of its texts in order, its distinct codes in order, and its size."""
    firsts = items.groupBy(run, code).agg(F.min(order).alias("__o"))
    codes = firsts.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", code))), lambda x: x[code]).alias("codes"))
    hashed = items.groupBy(run).agg(F.count("*").alias("question_count"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.sha2(text, 256).alias("h")))), lambda x: x["h"]).alias("hashes"))
    return hashed.join(codes, run)


def feedback_text(events: DataFrame, code: str, verdict: str, text: str, newest: str, most: int = 5) -> DataFrame:
    """Q12: for each code the newest rejected or edited texts, golden ones left out, joined by line feeds."""
    rn = F.row_number().over(Window.partitionBy(code).orderBy(F.desc(newest)))
    kept = events.filter(F.col(verdict).isin("reject", "needs_edit")).withColumn("__rn", rn).filter(F.col("__rn") <= most)
    return kept.groupBy(code).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", text))), lambda x: F.concat(F.lit("- "), x[text])), "\n").alias("context"))


def surface_issues(c: Column, longest: int = 60) -> Column:
    """Codes of what is wrong with a short surface text."""
    t = X.text_or_empty(c)
    return F.array_compact(F.array(
        F.when(F.trim(t) == "", "blank"), F.when(t != F.trim(t), "outer_space"), F.when(t.contains("  "), "double_space"), F.when(F.length(t) > longest, "too_long"),
        F.when((F.length(F.trim(t)) < 2) & (F.trim(t) != ""), "too_short"), F.when(t.rlike(r"[<>{}]"), "markup"), F.when(t.contains("�"), "broken_character"),
        F.when(t.rlike(r"[.!?]$"), "sentence_end"), F.when(t.rlike(r"^[0-9]"), "leading_digit"), F.when(t.rlike(r"[(\[][^)\]]*$"), "open_bracket"),
    ))
