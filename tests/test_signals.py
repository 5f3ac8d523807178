"""Q3 and Q4: signals by hand, relations against a search of all places, each of the nine checks."""

import random
import re

from pyspark.sql import functions as F

from quillmill.operators import signals as S

RULES = S.Scenario(
    quantified="[0-9]", incident="broke", artifact="ledger|report", actor="refuses", dilemma="either", conflict="differs from",
    stances={"rule or case": ("one rule", "by case")}, relations={"less for more": ("half the staff", "all orders"), "rule or case": ("one rule", "by case")},
)


def test_signals_of_a_scenario(spark):
    texts = {
        "none": None, "blank": "", "number alone": "There are 5.", "number and artifact": "The Report has 5 lines", "two artifacts": "report and ledger, report", "artifacts and incident": "It broke: report, LEDGER.",
        "conflict": "The ledger differs from it", "stances": "One rule, or by case?", "relation": "half the staff for all orders", "actor": "She refuses", "dilemma": "either way",
    }
    out = {r.k: r for r in S.scenario_signals(spark.createDataFrame(list(texts.items()), "k string, t string"), F.col("t"), RULES).collect()}
    assert {k for k, r in out.items() if r.concrete_fact} == {"number and artifact", "artifacts and incident", "stances", "relation", "actor"}
    assert {k for k, r in out.items() if r.dilemma} == {"conflict", "stances", "relation", "dilemma"}
    assert {k for k, r in out.items() if r.incident} == {"artifacts and incident", "conflict"} and {k for k, r in out.items() if r.actor_action} == {"stances", "actor"}
    assert (out["two artifacts"].artifact_count, out["none"].artifact_count) == (2, 0) and out["stances"].relations == ["rule or case"] and out["none"].stances == []


def test_no_rules_tell_nothing(spark):
    row = S.scenario_signals(spark.createDataFrame([("a 5",)], "t string"), F.col("t"), S.Scenario()).first()
    assert not any((row.quantified_fact, row.incident, row.actor_action, row.dilemma, row.concrete_fact)) and row.artifact_count == 0


DEMANDS = S.Demands(sentence="[?]", asks="what|how|why", action="check|decide", nominal="next steps?", families={"look": "check", "choose": "decide", "say": "tell", "keep": "note"}, outputs={"rule": "one rule"}, reach=20)


def slots(text):
    """Demands of a text, its slots and its nouns, one place after the other."""
    d = " ".join(s for s in re.findall(r"[^.?!\n]+[.?!\n]?", (text or "").lower()) if "?" in s).strip()
    found = set()
    for m in re.finditer("what|how|why", d):
        tail = d[m.end() : m.end() + 20]
        hit = re.search("check|decide", tail) or re.search(r"\w{2,20}", tail)
        found.add((m.group(), hit.group() if hit else ""))
    return d, max(len(found), len({x.replace(" ", "") for x in re.findall("next steps?", d)}))


def test_demands_equal_a_walk(spark):
    rng = random.Random(5)
    words = ["what", "how", "why", "check", "decide", "tell", "note", "next step", "next steps", "one rule", "x", ".", "?", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(120)] + ["", None, "why", "how?"]
    out = {r.k: r for r in S.demand_overload(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), F.col("t"), DEMANDS).collect()}
    for k, t in enumerate(texts):
        d, n = slots(t)
        families = sum(w in d for w in ("check", "decide", "tell", "note"))
        assert (out[k].demand_length, out[k].demand_slots, out[k].demand_families, out[k].demand_outputs) == (len(d), n, families, int("one rule" in d))
        assert out[k].overload_warning == (n >= 5 and families >= 4)
    assert len({r.overload_warning for r in out.values()}) == 2


def test_long_texts_of_many_outputs_demand_too_much(spark):
    v = S.Demands(sentence="[?]", asks="what", action="a", nominal="zz", families={"a": "a", "b": "b"}, outputs={c: c for c in "abcd"})
    texts = ["abcd" * 80 + "?", "abcd" * 60 + "?", "abc" * 120 + "?", "." * 300 + "abcd" * 10 + "?"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.overload_warning for r in S.demand_overload(df, F.col("t"), v).orderBy("k").collect()] == [True, False, False, False]


def places(text, group, negation=None):
    out = []
    for m in group:
        m = "".join(m.lower().split())
        at = text.find(m)
        while at >= 0:
            if not (negation and re.match(negation, text[at + len(m) :])):
                out.append((at, at + len(m)))
            at = text.find(m, at + 1)
    return out


def related(text, r, negation):
    bare = "".join((text or "").lower().split())
    objects, actions = [places(bare, g) for g in r.objects], [places(bare, g, negation) for g in r.actions]
    if not all(objects) or not all(actions):
        return False
    gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[1], b[1]))
    return any(gap(a, o) <= r.distance for g in objects for o in g for h in actions for a in h)


def test_relations_equal_a_search_of_all_places(spark):
    rng = random.Random(9)
    words = ["map", "pap", "apply", "ap", "not", "use", "a", "zz ", "(x)", "."]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(300)] + ["", None, "map use", "M A P apply"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    seen = set()
    for distance in (0, 1, 4, 100):
        for objects, actions in ((("map", "(x)"),), (("apply",), ("use",))), ((("map",), ("a",)), (("ap ply", "use"),)):
            r = S.Relation(objects, actions, distance)
            for row in df.select("k", S.relation_hit(F.col("t"), r, "not").alias("hit")).collect():
                assert row.hit == related(texts[row.k], r, "not"), (texts[row.k], r)
                seen.add(row.hit)
    assert seen == {True, False}


def test_relations_within_a_clause(spark):
    df = spark.createDataFrame([("the map. use it",), ("use the map. go",), (None,)], "t string")
    r = S.Relation((("map",),), (("use",),), 100, same_clause=True)
    assert [x.hit for x in df.select(S.relation_hit(F.col("t"), r).alias("hit")).collect()] == [False, True, False]
    assert df.select(S.relation_hit(F.col("t"), S.Relation((), (("use",),))).alias("hit")).distinct().collect() == [(False,)]


MEASURES = S.Measurement(
    methods={"case": (("when", "if"), ("decide",)), "talk": (("tell",),)}, kinds={"skill": (("check", "test"),)}, asks="[?]", relations={"case": S.Relation((("plan",),), (("draft",),), 10)},
    shallow="what do you know of", report="experience", idle=("skill",), least=30,
)
GOOD = "When the stock map skill fails, how do you check it and decide?"


def test_each_check_fails_alone(spark):
    cases = {
        "good": (GOOD, "case", "stock map", "skill", None, None, []),
        "relation": ("Draft the plan: how is the stock map to be checked now?", "case", "stock map", "skill", None, None, []),
        "method": (GOOD, "quiz", "stock map", "skill", None, None, ["has_supported_method", "observable_task"]),
        "words": ("When the map of stock fails, how do you check it and decide?", "case", "stock map", "", None, False, []),
        "one word": ("When the map fails, how do you check it and decide today?", "case", "stock map", None, None, False, ["focus_visible"]),
        "idle": ("When the skill fails, how do you check it and decide today?", "case", "a skill", None, None, False, ["focus_visible"]),
        "no focus": (GOOD, "case", None, None, None, False, ["focus_visible"]),
        "kind": ("When the check map fails, how do you mend it and decide?", "case", "check map", "skill", None, False, ["ksa_type_operationalized"]),
        "task": ("With the stock map, how do you check it, and tell me?", "case", "stock map", "skill", None, False, ["observable_task"]),
        "asks": (GOOD.replace("?", "."), "case", "stock map", "skill", None, False, ["elicits_response"]),
        "short": ("If map, check, decide?", "case", "map", "skill", None, False, ["sufficient_task_detail"]),
        "shallow": ("What do you know of stock map when you check it and decide?", "case", "stock map", "skill", None, False, ["not_ksa_restatement"]),
        "report": ("When, in your stock map experience, did you check and decide?", "case", "stock map", "skill", None, False, ["not_ksa_restatement"]),
        "evidence": (GOOD, "case", "stock map", "skill", " ", True, ["evidence_linked"]),
        "linked": (GOOD, "case", "stock map", "skill", "e1", True, []),
        "signs": ("When a.b*(c) \\E fails, how do you check it and decide on it?", "case", "a.b*(c) \\E", "skill", None, None, []),
        "null": (None, None, None, None, None, None, ["has_question", "has_supported_method", "focus_visible", "observable_task", "elicits_response", "sufficient_task_detail"]),
    }
    df = spark.createDataFrame([(k, *v[:6]) for k, v in cases.items()], "k string, q string, m string, f string, kind string, e string, r boolean")
    out = {r.k: r for r in S.measurement(df, *[F.col(c) for c in ("q", "m", "f", "kind", "e", "r")], MEASURES).collect()}
    assert {k: list(r.issues) for k, r in out.items()} == {k: v[6] for k, v in cases.items()}
    assert all(r.passed == (not r.issues) for r in out.values()) and out["good"].group_hits == [True, True] and out["null"].group_hits == []
    assert set(S.CHECKS) == {i for r in out.values() for i in r.issues}
