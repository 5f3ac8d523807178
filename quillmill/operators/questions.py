"""The checks of a question's quality report and of its realism, over one schema of questions.

Columns: ``set_id, ord, method, question, follow_ups, points, code, competency,
detail, focus, evidence (array of code, text), evidence_id, evidence_required,
source, preserved, labels, repeated, grounded``, ``conditions`` (struct of
instruction, standardization, outputs, materials, time_plan (phase, minutes),
facts, rows (source, field, value), authority) and ``guide`` (struct of levels
(score, label, anchor), instruction). A null is an empty text, list or struct.
What words stand for is a ``Vocabulary``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.functions.udfs import ratio_reaches
from quillmill.operators import quality as Q

# What a failed realism check costs.
WEIGHTS = {
    "no_generic_template_scaffolding": 20, "no_candidate_checklist": 20, "natural_ksa_surface": 15, "answer_adaptive_follow_ups": 15, "concrete_scenario": 20,
    "not_raw_deterministic_provenance": 10, "no_label_like_metadata_exposure": 15, "no_presumed_experience": 15, "no_prescribed_answer": 15, "no_instruction_injection_artifact": 25,
}
# Checks that a model's own draft need not pass, since they look for a template's words.
REPLACED = (
    "method_shape", "main_question_method_shape", "main_question_job_context", "follow_up_quality", "evaluation_points_quality",
    "ksa_grounded", "official_sample_format", "operating_conditions_separated", "job_specific_context",
)


@dataclass(frozen=True)
class Vocabulary:
    """Methods and their words. ``patterns`` names what each pattern tells; one that is left out tells nothing."""

    methods: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    patterns: dict[str, str]
    debate: str = ""
    inbasket: str = ""
    task_methods: tuple[str, ...] = ()
    timed_methods: tuple[str, ...] = ()
    authority_methods: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    consequences: tuple[str, ...] = ()
    measures: tuple[tuple[str, ...], ...] = ()
    levels: tuple[str, ...] = ("5", "4", "3", "2", "1")
    model_sources: tuple[str, ...] = ()
    rule_sources: tuple[str, ...] = ()

    def tells(self, name: str, c: Column) -> Column:
        return c.rlike(self.patterns[name]) if name in self.patterns else F.lit(False)

    def count(self, name: str, c: Column) -> Column:
        return F.regexp_count(c, F.lit(self.patterns[name])) if name in self.patterns else F.lit(0)


def _filled(c: Column) -> Column:
    return F.trim(X.text_or_empty(c)) != ""


def _list(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def _texts(name: str) -> Column:
    return F.filter(_list(name), _filled)


def _visible(*lists: Column) -> Column:
    return F.concat_ws("\n", X.text_or_empty(F.col("question")), *lists)


def _holds(c: Column, part: str) -> Column:
    return F.exists(c, lambda x: x.contains(part))


def _all_in(c: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in terms:
        out &= c.contains(t)
    return out


def realism_checks(v: Vocabulary) -> dict[str, tuple[Column, int]]:
    """Q2: the ten checks and their weights, for ``weighted_realism``."""
    q, follow, points = X.text_or_empty(F.col("question")), _texts("follow_ups"), _texts("points")
    seen, read = _visible(follow), _visible(follow, points)
    parts = sum((q.rlike(p).cast("int") for p in v.components), F.lit(0))
    checklist = (v.count("enumerator", q) >= 3) | ((parts >= 4) & v.tells("directive", q))
    adaptive = F.size(F.filter(follow, lambda x: v.tells("adaptive", x)))
    keys = F.transform(follow, lambda x: F.lower(F.regexp_replace(x, r"\s+", "")))
    artifacts = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(v.patterns["artifact"]), F.lit(0)))) if "artifact" in v.patterns else F.lit(0)
    incident = v.tells("incident", q)
    concrete = (v.tells("quantified", q) & (incident | (artifacts > 0))) | v.tells("actor", q) | ((artifacts >= 2) & incident)
    source = F.lower(X.text_or_empty(F.col("source")))
    holds = {
        "no_generic_template_scaffolding": _filled(q) & ~v.tells("scaffold", seen),
        "no_candidate_checklist": ~checklist,
        "natural_ksa_surface": ~v.tells("mechanical", seen),
        "answer_adaptive_follow_ups": (adaptive * 3 >= 2 * F.size(follow)) & (F.size(F.array_distinct(keys)) == F.size(keys)),
        "concrete_scenario": ~F.col("method").isin(*v.task_methods) | (concrete & v.tells("dilemma", q)),
        "not_raw_deterministic_provenance": ~source.isin(*v.rule_sources),
        "no_label_like_metadata_exposure": ~F.exists(_texts("labels"), lambda x: (F.length(x) >= 4) & read.contains(x)),
        "no_presumed_experience": ~v.tells("presumed", seen),
        "no_prescribed_answer": ~v.tells("prescribed", q),
        "no_instruction_injection_artifact": ~v.tells("injection", read),
    }
    return {name: (F.coalesce(c, F.lit(True)), WEIGHTS[name]) for name, c in holds.items()}


def _alike(a: Column, b: Column) -> Column:
    return ratio_reaches(a, b, F.lit(0.82))


def report_checks(v: Vocabulary, first: Column, alike: Callable[[Column, Column], Column] = _alike) -> dict[str, tuple[Column, Column]]:
    """Q1: the 33 checks as (holds, applies); ``first`` tells whether a question is the first of its key in its set, ``alike`` whether two neighbouring anchors are too similar."""
    q, follow, points = X.text_or_empty(F.col("question")), _texts("follow_ups"), _texts("points")
    compact, merged = F.regexp_replace(q, r"\s+", ""), _visible(follow, points)
    low, method, cond = X.squeezed(q), F.col("method"), F.col("conditions")
    evidence = F.filter(_list("evidence", "struct<code:string,text:string>"), lambda e: (e["code"] == F.col("code")) & _filled(F.col("code")))
    shape, main, hits, terms = F.lit(False), F.lit(False), F.lit(0), []
    for name, (required, anchors) in v.methods.items():
        shape = F.when(method == name, _all_in(F.regexp_replace(merged, r"\s+", ""), required)).otherwise(shape)
        main = F.when(method == name, _all_in(compact, required)).otherwise(main)
        found = sum((_holds(points, a).cast("int") for a in anchors), F.lit(0))
        hits = F.when(method == name, found).otherwise(hits)
    terms = F.filter(F.array(*[X.squeezed(F.col(c)) for c in ("competency", "detail", "focus")]), lambda t: F.length(t) >= 2)
    named = lambda c: F.exists(terms, lambda t: c.contains(t))
    levels = F.coalesce(F.col("guide.levels"), F.array().cast("array<struct<score:int,label:string,anchor:string>>"))
    anchor = lambda i: X.text_or_empty(F.get(levels, F.lit(i))["anchor"])
    apart = F.lit(True)
    for i in range(4):
        apart &= ~alike(anchor(i), anchor(i + 1))
    kept = lambda name: F.filter(F.coalesce(cond[name], F.array().cast("array<string>")), _filled)
    plan = F.coalesce(cond["time_plan"], F.array().cast("array<struct<phase:string,minutes:int>>"))
    rows = F.filter(F.coalesce(cond["rows"], F.array().cast("array<struct<source:string,field:string,value:string>>")), lambda r: _filled(r["source"]) & _filled(r["field"]) & _filled(r["value"]))
    timed = ~method.isin(*v.timed_methods) | ((F.size(plan) > 0) & F.forall(plan, lambda r: _filled(r["phase"]) & F.coalesce(r["minutes"] > 0, F.lit(False))))
    long_ = lambda c, n: F.length(F.trim(X.text_or_empty(c))) >= n
    counted = lambda c: F.size(F.filter(c, lambda x: v.tells("quantified", x)))
    authority = X.text_or_empty(cond["authority"])
    facts = F.concat_ws("\n", kept("facts"), F.transform(rows, lambda r: r["value"]))
    consequences = sum((compact.rlike(p).cast("int") for p in v.consequences), F.lit(0))
    realism = F.lit(True)
    for c, _ in realism_checks(v).values():
        realism &= c
    always, debate = F.lit(True), method == v.debate
    task, source = method.isin(*v.task_methods), F.lower(X.text_or_empty(F.col("source")))
    drafted = source.isin(*v.model_sources)
    tokens = X.tokens(merged)
    checks = {
        "supported_method": (method.isin(*v.methods), always),
        "method_shape": (shape, always),
        "main_question_method_shape": (main, always),
        "main_question_job_context": ((F.size(terms) == 0) | named(low), F.coalesce(F.col("preserved"), F.lit(False))),
        "follow_up_depth": (F.size(follow) >= 3, always),
        "follow_up_quality": ((F.size(follow) >= 3) & (F.size(F.array_distinct(follow)) == F.size(follow)) & F.forall(follow, lambda x: (F.length(x) >= 10) & x.rlike(r"[?？.]\s*$")), always),
        "evaluation_points": (F.size(points) == 4, always),
        "evaluation_points_quality": ((F.size(points) == 4) & ~F.exists(points, lambda p: v.tells("vague", p)) & (hits >= 2) & (F.size(F.filter(points, lambda p: v.tells("assessable", p))) >= 3), always),
        "ncs_grounded": (_filled(F.col("code")) & _filled(F.col("competency")), always),
        "detail_grounded": (_filled(F.col("detail")), always),
        "ksa_grounded": (F.exists(evidence, lambda e: F.arrays_overlap(X.tokens(e["text"]), tokens)), always),
        "evidence_linked": (_filled(F.col("evidence_id")), F.coalesce(F.col("evidence_required"), F.lit(False))),
        "ksa_measurement_task": (Q.groups_hit(q, list(v.measures)), always),
        "candidate_surface_safe": (~F.exists(evidence, lambda e: (F.length(X.squeezed(e["text"])) >= 6) & X.squeezed(merged).contains(X.squeezed(e["text"]))), always),
        "official_sample_format": (F.size(Q.shape_issues(F.col("question"), F.col("follow_ups"), F.col("points"))) == 0, always),
        "blind_hiring_safe": (~v.tells("blind", merged), always),
        "unique_question": ((X.dedup_key(q) != "") & first & ~F.coalesce(F.col("repeated"), F.lit(False)), always),
        "specific_context": (~v.tells("generic", q), always),
        "job_specific_context": (named(low) | F.exists(follow, lambda x: named(X.squeezed(x))), always),
        "natural_wording": (~v.tells("unnatural", _visible(follow)), always),
        "focus_scenario_coherence": (F.arrays_overlap(X.tokens(F.col("focus")), X.tokens(q)), debate),
        "decision_dilemma_quality": ((v.count("option", q) >= 2) & v.tells("decision", q) & (consequences >= 2) & v.tells("incident", q), debate),
        "debate_option_defensibility": (~v.tells("strawman", q), debate),
        "debate_outcome_flexibility": (v.tells("open_outcome", q), debate),
        "debate_case_neutrality": (cond.isNotNull() & (~v.tells("approval", F.concat_ws("\n", q, facts)) | ~v.tells("answer_label", facts)), debate),
        "operating_conditions_separated": (_filled(q) & ~v.tells("operating", q), task),
        "standardized_task_conditions": (long_(cond["instruction"], 25) & long_(cond["standardization"], 25) & (F.size(kept("outputs")) >= 2) & (F.size(kept("materials")) >= 1) & timed, always),
        "case_materials_sufficient": (
            (F.size(kept("materials")) >= 2) & (F.size(kept("facts")) >= 3) & (F.size(F.array_distinct(kept("facts"))) == F.size(kept("facts"))) & (counted(kept("facts")) >= 2)
            & (F.size(rows) >= 1) & (counted(F.transform(rows, lambda r: r["value"])) >= 1) & F.forall(rows, lambda r: F.array_contains(kept("materials"), r["source"])),
            task,
        ),
        "decision_authority_context": (v.tells("role", authority) & v.tells("delegated", authority) & v.tells("approver", authority), method.isin(*v.authority_methods)),
        "inbasket_authority_context": (v.tells("role", authority) & v.tells("own_limit", authority) & v.tells("approver", authority), method == v.inbasket),
        "behavior_anchored_evaluation": (
            (F.concat_ws(",", F.transform(levels, lambda x: x["score"].cast("string"))) == "5,4,3,2,1") & (F.concat_ws(",", F.transform(levels, lambda x: x["label"])) == ",".join(v.levels))
            & F.forall(levels, lambda x: long_(x["anchor"], 40) & x["anchor"].endswith(".")) & apart & long_(F.col("guide.instruction"), 30),
            always,
        ),
        "field_realism": (realism, drafted | source.isin(*v.rule_sources)),
        "precision_grounding": (F.coalesce(F.col("grounded"), F.lit(True)), always),
    }
    return {name: (F.coalesce(holds, F.lit(False)), applies & ~drafted if name in REPLACED else applies) for name, (holds, applies) in checks.items()}


def question_report(questions: DataFrame, v: Vocabulary, alike: Callable[[Column, Column], Column] = _alike) -> DataFrame:
    """Q1: ``set_id, ord, statuses, score, ready, issues`` of every question; blank questions repeat nothing."""
    keyed = questions.withColumn("__key", X.dedup_key(X.text_or_empty(F.col("question"))))
    # a null or blank key is no repeat; it fails the check by itself
    order = Window.partitionBy("set_id", "__key").orderBy("ord")
    marked = keyed.withColumn("__first", F.row_number().over(order) == 1)
    report = Q.quality_report(marked, report_checks(v, F.col("__first"), alike))
    issues = F.map_keys(F.map_filter("statuses", lambda _, s: s == "fail"))
    return report.select("set_id", "ord", "statuses", "score", "ready", issues.alias("issues"))


def set_summary(report: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Q1: of each set the questions, the ready ones, the mean score (2 digits) and whether all are ready and as many as ``expected`` (set_id, expected; 0 or null: any number)."""
    sums = report.groupBy("set_id").agg(F.count("*").alias("question_count"), F.count_if("ready").alias("ready_count"), F.round(F.avg("score"), 2).alias("average_score"))
    asked = sums.join(expected, "set_id", "left") if expected is not None else sums.withColumn("expected", F.lit(0))
    fits = (F.coalesce("expected", F.lit(0)) <= 0) | (F.col("expected") == F.col("question_count"))
    return asked.withColumn("count_matches_plan", fits).withColumn("needs_review_count", F.col("question_count") - F.col("ready_count")).withColumn("passed", fits & (F.col("ready_count") == F.col("question_count"))).drop("expected")
