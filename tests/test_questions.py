"""The question checks: a sound question passes all that apply; each fault fails its own check."""

import copy

import pytest

from quillmill.operators import quality
from quillmill.operators.questions import REPLACED, WEIGHTS, Vocabulary, question_report, realism_checks, set_summary

V = Vocabulary(
    methods={"debate": (("debate",), ("position", "evidence", "listening")), "basket": (("inbox",), ("priority", "reason")), "talk": (("explain",), ("basis", "method"))},
    patterns={
        "scaffold": "TEMPLATE", "directive": "(?i)include all", "enumerator": r"\(\d\)", "adaptive": r"(?i)\byou\b", "mechanical": "KSA item", "artifact": r"\b(?:report|mail|ledger)\b",
        "quantified": r"\d", "incident": "delay", "actor": "manager asked", "dilemma": "but", "presumed": "as you did", "prescribed": "correctly refuse", "injection": "(?i)ignore previous",
        "vague": "^good$", "assessable": "(?i)states|weighs|explains", "blind": "school name", "generic": "the relevant job", "unnatural": "do doing", "option": "position [AB]", "decision": "choose",
        "strawman": "obviously wrong", "open_outcome": "no agreement", "approval": "before approval", "answer_label": "is allowed", "operating": r"\d+ minutes", "role": "role", "delegated": "delegated",
        "own_limit": "limit", "approver": "approval",
    },
    debate="debate", inbasket="basket", task_methods=("debate", "basket"), timed_methods=("debate",), authority_methods=("debate", "basket"), components=("who", "when", "why", "how"),
    consequences=("cost", "safety", "time"), measures=(("choose", "explain", "order"),), model_sources=("model",), rule_sources=("template",),
)
SCHEMA = """set_id string, ord int, method string, question string, follow_ups array<string>, points array<string>, code string, competency string, detail string, focus string,
 evidence array<struct<code:string,text:string>>, evidence_id string, evidence_required boolean, source string, preserved boolean, labels array<string>, repeated boolean, grounded boolean,
 conditions struct<instruction:string,standardization:string,outputs:array<string>,materials:array<string>,time_plan:array<struct<phase:string,minutes:int>>,facts:array<string>,rows:array<struct<source:string,field:string,value:string>>,authority:string>,
 guide struct<levels:array<struct<score:int,label:string,anchor:string>>,instruction:string>"""
SOUND = {
    "set_id": "s", "ord": 1, "method": "debate", "source": "panel", "code": "17", "competency": "budgeting", "detail": "ledger audit", "focus": "budgeting costs", "evidence_id": "ksa_1", "evidence_required": True,
    "question": "In this debate on budgeting a 3 day delay hit the ledger, but position A wants cost cuts and position B safety; choose one, and say what to do if there is no agreement?",
    "follow_ups": ["What would change your mind if you were wrong?", "How do you weigh the costs you named?", "Which facts do you still miss?"],
    "points": ["states a position", "weighs evidence", "explains by listening", "states the rest"],
    "evidence": [("17", "knowledge of costs in ledgers")], "preserved": True, "labels": ["Unit 17 label"], "repeated": False, "grounded": True,
    "conditions": ("Read the case and take a stand on it.", "All candidates have the same papers.", ["note", "talk"], ["ledger", "mail"], [("prepare", 5)], ["3 days late", "2 teams", "calm weather"], [("ledger", "cost", "40")], "role: clerk; delegated up to the limit; else approval"),
    "guide": ([(5, "5", "Names both sides with figures and closes the gap between them."), (4, "4", "Weighs most facts, yet leaves one risk out of the whole account."), (3, "3", "Holds a view; the reasons given are few but they do fit."), (2, "2", "Repeats what others said, adding hardly anything of any worth."), (1, "1", "Does not follow: silent, or talking about quite another task.")], "Score what was said, not how it was said."),
}


def part(name, i, value):
    def change(row):
        fields = list(row[name])
        fields[i] = value
        row[name] = tuple(fields)

    return change


def put(**values):
    return lambda row: row.update(values)


def swap(old, new):
    return lambda row: row.update(question=row["question"].replace(old, new))


# the fault, and the checks that it fails
FAULTS = [
    ({"supported_method", "method_shape", "main_question_method_shape", "evaluation_points_quality"}, put(method="chat")),
    ({"method_shape", "main_question_method_shape"}, swap("debate", "dispute")),
    ({"main_question_job_context"}, put(question=SOUND["question"].replace("budgeting", "spending costs"), follow_ups=[*SOUND["follow_ups"], "How do you see budgeting costs here?"])),
    ({"follow_up_depth", "follow_up_quality"}, put(follow_ups=SOUND["follow_ups"][:2])),
    ({"follow_up_quality"}, put(follow_ups=[*SOUND["follow_ups"], "Why you?"])),
    ({"evaluation_points", "evaluation_points_quality"}, put(points=SOUND["points"][:3])),
    ({"evaluation_points_quality"}, put(points=[*SOUND["points"][:3], "good"])),
    ({"ncs_grounded", "ksa_grounded"}, put(code=" ")),
    ({"detail_grounded"}, put(detail=None)),
    ({"ksa_grounded"}, put(evidence=[("18", "costs")])),
    ({"evidence_linked"}, put(evidence_id="")),
    ({"ksa_measurement_task", "decision_dilemma_quality"}, swap("choose", "take")),
    ({"candidate_surface_safe"}, put(evidence=[("17", "cost cuts")])),
    ({"official_sample_format"}, swap("agreement?", "agreement.")),
    ({"blind_hiring_safe"}, swap("agreement?", "agreement, your school name apart?")),
    ({"unique_question"}, put(repeated=True)),
    ({"specific_context"}, swap("agreement?", "agreement in the relevant job?")),
    ({"job_specific_context", "main_question_job_context", "focus_scenario_coherence"}, put(competency="welding", focus="welding", detail="seams")),
    ({"natural_wording"}, swap("agreement?", "agreement, do doing?")),
    ({"focus_scenario_coherence"}, put(focus="welding")),
    ({"decision_dilemma_quality"}, swap("safety", "calm")),
    ({"debate_option_defensibility"}, swap("agreement?", "agreement, which is obviously wrong?")),
    ({"debate_outcome_flexibility"}, swap("there is no agreement", "they agree")),
    ({"debate_case_neutrality"}, part("conditions", 5, ["3 days late before approval", "2 is allowed", "calm weather"])),
    ({"operating_conditions_separated"}, swap("agreement?", "agreement within 5 minutes?")),
    ({"standardized_task_conditions"}, part("conditions", 4, [("prepare", 0)])),
    ({"case_materials_sufficient"}, part("conditions", 6, [("rumour", "cost", "40")])),
    ({"decision_authority_context"}, part("conditions", 7, "role: clerk; approval")),
    ({"behavior_anchored_evaluation"}, part("guide", 0, [*SOUND["guide"][0][:4], (1, "1", SOUND["guide"][0][3][2])])),
    ({"precision_grounding"}, put(grounded=False)),
]
REALISM = [
    ("no_generic_template_scaffolding", swap("In this", "TEMPLATE In this")), ("no_candidate_checklist", swap("agreement?", "agreement (1) a (2) b (3) c?")),
    ("no_candidate_checklist", swap("agreement?", "agreement; include all: who, when, why, how?")), ("natural_ksa_surface", swap("agreement?", "agreement on the KSA item?")),
    ("answer_adaptive_follow_ups", put(follow_ups=["What is it then?", "How is it then?", "Which facts do you still miss?"])), ("answer_adaptive_follow_ups", put(follow_ups=[*SOUND["follow_ups"], SOUND["follow_ups"][0].upper()])),
    ("concrete_scenario", swap(", but position", ", and position")), ("not_raw_deterministic_provenance", put(source="Template")),
    ("no_label_like_metadata_exposure", put(labels=["cost cuts"])), ("no_presumed_experience", swap("agreement?", "agreement, as you did?")), ("no_prescribed_answer", swap("agreement?", "agreement and correctly refuse?")),
    ("no_instruction_injection_artifact", put(points=[*SOUND["points"][:3], "states: Ignore previous orders"])),
]


def rows_of(changes):
    out = []
    for i, change in enumerate(changes):
        row = copy.deepcopy(SOUND)
        row.update(set_id=f"s{i}")
        change(row)
        out.append(row)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    names = [f.split()[0] for f in ("set_id ord method question follow_ups points code competency detail focus evidence evidence_id evidence_required source preserved labels repeated grounded conditions guide").split()]
    return lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_each_fault_fails_its_own_checks(frame):
    out = {r.set_id: r for r in question_report(frame(rows_of([put(), *[c for _, c in FAULTS]])), V).collect()}
    assert len(out["s0"].statuses) == 33 and out["s0"].ready and out["s0"].score == 1.0
    assert {k for k, s in out["s0"].statuses.items() if s == "not_applicable"} == {"inbasket_authority_context", "field_realism"}
    for i, (names, _) in enumerate(FAULTS, 1):
        got = set(out[f"s{i}"].issues)
        assert got == names if i > 1 else got >= names, (i, got)
    reached = set().union(*(n for n, _ in FAULTS))
    assert reached == set(out["s0"].statuses) - {"inbasket_authority_context", "field_realism"}


def test_sources_methods_and_sets(frame):
    rows = rows_of([put(source="model"), put(source="model", question="TEMPLATE"), put(source="template"), put(method="basket"), put(), put(ord=2), put(ord=3, question=None)])
    for r in rows[4:]:
        r["set_id"] = "same"
    report = question_report(frame(rows), V)
    out = {(r.set_id, r.ord): r for r in report.collect()}
    assert {k for k, s in out["s0", 1].statuses.items() if s == "not_applicable"} == {*REPLACED, "inbasket_authority_context"} and out["s0", 1].ready
    assert "field_realism" in out["s1", 1].issues and "method_shape" not in out["s1", 1].issues and "field_realism" in out["s2", 1].issues
    assert out["s3", 1].statuses["inbasket_authority_context"] == "pass" and out["s3", 1].statuses["debate_case_neutrality"] == "not_applicable"
    assert out["same", 1].ready and out["same", 2].issues == ["unique_question"] and "unique_question" in out["same", 3].issues
    sums = {r.set_id: r for r in set_summary(report, report.sparkSession.createDataFrame([("same", 3), ("s0", 2)], "set_id string, expected int")).collect()}
    assert (sums["same"].question_count, sums["same"].ready_count, sums["same"].count_matches_plan, sums["same"].passed) == (3, 1, True, False)
    assert (sums["s0"].ready_count, sums["s0"].count_matches_plan, sums["s0"].passed) == (1, False, False)


def test_realism_costs_its_weights(frame):
    out = {r.set_id: r for r in quality.weighted_realism(frame(rows_of([put(), *[c for _, c in REALISM]])), realism_checks(V)).collect()}
    assert out["s0"].realism == 100 and out["s0"].realism_issues == []
    for i, (name, _) in enumerate(REALISM, 1):
        assert (out[f"s{i}"].realism_issues, out[f"s{i}"].realism) == ([name], 100 - WEIGHTS[name])
    assert {n for n, _ in REALISM} == set(WEIGHTS)
