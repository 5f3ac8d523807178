"""Q6: decisions of items by hand."""

from pyspark.sql import functions as F

from quillmill.operators import elicitation as E
from quillmill.operators import questions as K

KINDS = E.Kinds({"cause": "why|cause", "record": "record|log", "risk": "risk"}, traits="sincer|diligen")

ITEMS = {
    "pass": (["cause and record", "risk of delay"], ["Explain why it broke, and what you log.", "Name each risk"], [], []),
    "missing": (["cause", "record kept"], ["Explain why"], [], ["unelicited_atom"]),
    "one": (["cause, record"], ["Tell one of why and what to log"], [], ["quantifier_scope_mismatch"]),
    "one of one": (["cause"], ["Tell one of why and what to log"], [], []),
    "both": (["cause, record"], ["Tell one of why and log", "Explain the cause and the record"], [], []),
    "two of three": (["cause, record, risk"], ["Tell 2 of cause, log, risk"], [], ["quantifier_scope_mismatch"]),
    "three of three": (["cause, record, risk"], ["Tell 3 of cause, log, risk"], [], []),
    "open": (["cause, record"], ["Say which of why or log you check"], [], ["ambiguous_quantifier_scope"]),
    "open elsewhere": (["cause, record"], ["Say why and log, which of them all"], [], []),
    "trait": (["sincere manner"], ["Be sincere in manner"], [], ["unobservable_trait"]),
    "words": (["painting tools", "ladders"], ["Which painting and ladders do you use?"], [], []),
    "no prompt": (["cause"], [], [], ["missing_demand", "unelicited_atom"]),
    "no points": (None, ["why"], [], []),
    "drift": (["cause"], ["why"], ["knows the cause", "names the risk"], ["guide_scope_drift"]),
}


def test_each_decision_is_reached(spark):
    rows = [(k, p, q, a) for k, (p, q, a, _) in ITEMS.items()]
    df = spark.createDataFrame(rows, "k string, points array<string>, prompts array<string>, anchors array<string>")
    out = {r.k: r for r in E.elicitation(df, "k", "points", "prompts", KINDS, count=None, anchors="anchors").collect()}
    assert {k: list(r.issues) for k, r in out.items()} == {k: v[3] for k, v in ITEMS.items()}
    assert {k: r.decision for k, r in out.items()} == {k: "pass" if not v[3] else "review" if v[3] == ["ambiguous_quantifier_scope"] else "fail" for k, v in ITEMS.items()}
    assert (out["pass"].atoms, out["pass"].matched) == (3, 3) and (out["open"].review, out["one"].unmatched) == (2, 2)
    counted = {r.k: r for r in E.elicitation(df, "k", "points", "prompts", KINDS, count=2).collect()}
    assert counted["pass"].decision == "pass" and "point_count_mismatch" in counted["one of one"].issues


def test_sets_sum_up_their_questions(spark):
    rows = [("a", 90, True), ("a", 80, True), ("b", 50, False), ("b", 61, True), ("c", 70, True)]
    report = spark.createDataFrame(rows, "set_id string, score int, ready boolean")
    plan = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3)], "set_id string, expected int")
    out = {r.set_id: (r.question_count, r.ready_count, r.average_score, r.count_matches_plan, r.needs_review_count, r.passed) for r in K.set_summary(report, plan).collect()}
    assert out == {"a": (2, 2, 85.0, True, 0, True), "b": (2, 1, 55.5, True, 1, False), "c": (1, 1, 70.0, False, 0, False)}
    assert {r.set_id: r.passed for r in K.set_summary(report.filter(F.col("ready"))).collect()} == {"a": True, "b": True, "c": True}
