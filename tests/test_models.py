"""Operators whose queries have no SQL, against models written as loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.functions.udfs import ratio_reaches
from quillmill.operators import dedup, documents, match, quality
from quillmill.plans import catalog
from quillmill.sources import readers
from quillmill.streaming import reviewlog

#: Queries without SQL, and the test that holds their operator against a model.
MODELS = {
    "l1_review_stream": "test_streams_equal_batches", "l4_admitted": "test_rejected_requests_do_not_enter_the_window", "l4_admitted_stream": "test_streams_equal_batches",
    "q6_elicitation": "test_each_decision_is_reached", "q1_set_summary": "test_sets_sum_up_their_questions", "l5_session_stream": "test_sessions_end_by_timer", "l2_rollback_replay": "test_replay_equals_a_loop", "j10_fuzzy_classes": "test_fuzzy_classes_equal_a_loop",
    "j17_near_pairs": "test_repeats_equal_a_loop", "d5_diverse_set": "test_greedy_set_equals_a_loop", "d6_scoped_unique": "test_scoped_unique_equals_a_loop",
    "d7_repeats": "test_repeats_equal_a_loop", "d8_history_duplicates": "test_history_duplicates_equal_a_loop", "d9_unseen_keys": "test_unseen_keys_equal_a_loop",
    "x7_sequence_ratio": "test_sequence_ratio_is_difflib", "x9_stems": "test_stems_and_particles", 
    "x16_task_surface": "test_task_surface_equals_a_loop", "x22_json_slice": "test_json_is_sliced",
    "t2d_table_cells": "test_cells_equal_a_walk", "t4d_anchor_classes": "test_anchor_classes_equal_a_walk", "t8d_full_bundle": "test_bundle_lists", "t8d_candidate_bundle": "test_bundle_equals_a_loop", "q5_precision_grounding": "test_precision_grounding_equals_a_loop",
    "q1_question_report": "test_each_fault_fails_its_own_checks", "q2_realism_checks": "test_realism_costs_its_weights", "q5_material_grounding": "test_materials_ground_clauses",
    "q8_repair_loop": "test_repair_loop_stops", "flagship_ranked_evidence": "test_factors_reserve_slots",
}


def test_every_query_has_sql_or_a_model():
    import pathlib

    tests = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("test_*.py"))
    open_ = set(catalog.queries()) - set(catalog.oracle_sql())
    assert open_ == set(MODELS)
    assert all(f"def {t}(" in tests for t in MODELS.values())


def grams(x):
    return {x[i : i + 3] for i in range(len(x) - 2)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


WORDS = ["red", "read", "ring", "rings", "bolt", "promo", "small", "anvil", "17"]


def sentences(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))) for _ in range(n)]


def test_ratio_reaches_is_the_ratio_at_a_bar(spark):
    rows = list(zip(sentences(150, 1), sentences(150, 2))) + [("", ""), (None, "a"), ("가나다", "가나")]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", ratio_reaches("a", "b", F.lit(0.7)).alias("r")).collect()
    assert any(r.r for r in out) and all(r.r == (SequenceMatcher(None, r.a or "", r.b or "").ratio() >= 0.7) for r in out)


def test_history_duplicates_equal_a_loop(spark):
    now, past = sentences(60, 3) + ["", None], sentences(40, 4)
    sign = lambda c: X.signature(F.lower(c), (("promo", ("promo",)), ("small", ("small",))))
    signature = lambda t: "+".join(m for m in ("promo", "small") if m in t)
    df = spark.createDataFrame(list(enumerate(now)), "k int, t string")
    out = dedup.history_duplicates(df, "k", "t", spark.createDataFrame([(p,) for p in past], "p string"), "p", sign, 0.8).collect()
    key = lambda t: (t or "").replace(" ", "")

    def duplicate(t):
        if not key(t):
            return True
        for p in past:
            a, b = key(t), key(p)
            if b and (a == b or (signature(t) == signature(p) and max(SequenceMatcher(None, a, b).ratio(), jaccard(grams(a), grams(b))) >= 0.8)):
                return True
        return False

    assert {r.k: r.duplicate for r in out} == {k: duplicate(t) for k, t in enumerate(now)}


def test_scoped_unique_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.choice(["", "promo", "small"]), rng.choice(["", "about red", "about bolts"]), t) for i, t in enumerate(sentences(80, 6))]
    df = spark.createDataFrame(rows, "ord long, scope string, scene string, about string, t string")
    out = {r.ord: r.accepted for r in dedup.scoped_unique(df, "scope", F.col("scene"), F.col("about"), "t", "ord", shortest=6).collect()}
    chosen = {"x": [], "y": []}
    for i, scope, scene, about, t in rows:
        k = t.replace(" ", "")
        near = len(k) >= 6 and any(
            not (scene and s and s != scene) and not (about and c and SequenceMatcher(None, about, c).ratio() < 0.45)
            and (jaccard(grams(k) or {k}, grams(o) or {o}) >= 0.84 or SequenceMatcher(None, k, o).ratio() >= 0.84)
            for o, s, c in chosen[scope]
        )
        if not near:
            chosen[scope].append((k, scene, about))
        assert out[i] == (not near)


def test_unseen_keys_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("xy"), [rng.choice(WORDS) for _ in range(rng.randrange(0, 3))]) for i in range(60)]
    out = {r.ord: r.accepted for r in dedup.unseen_keys(spark.createDataFrame(rows, "ord long, b string, k array<string>"), "b", F.col("k"), "ord").collect()}
    seen = {"x": set(), "y": set()}
    for i, b, keys in rows:
        ok = bool(keys) and not seen[b] & set(keys)
        seen[b] |= set(keys) if ok else set()
        assert out[i] == ok


def test_fuzzy_classes_equal_a_loop(spark):
    terms, names = ["red rings", "anvil", "bolts 17", "Red Ring", "zzz", ""], ["red ring", "anvils", "bolt", "17 bolts", "small"]
    out = match.fuzzy_classes(spark.createDataFrame(list(enumerate(terms)), "o int, t string"), "t", "o", spark.createDataFrame([(i, n) for i, n in enumerate(names)], "c int, n string"), "n", "c", "c").collect()
    key = lambda t: t.lower().replace(" ", "")
    expected, used = {}, set()
    for t in terms:
        scored = []
        for c, n in enumerate(names):
            a, b = key(t), key(n)
            if a:
                scored.append((1.0 if a == b else 0.86 if a in b or b in a else round(SequenceMatcher(None, a, b).ratio(), 6), -c))
        best = max((s for s in scored if s[0] >= 0.62), default=None)
        if best and -best[1] not in used:
            used.add(-best[1])
            expected[t] = (-best[1], best[0])
    assert {r.t: (r.c, r.confidence) for r in out} == expected


def test_cells_equal_a_walk(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |\nplain\n| x | y | z |\n| - | - | - |\n| 4 | 5 | 6 |"
    out = documents.table_cells(spark.createDataFrame([(1, text), (2, None), (3, "no table")], "d int, t string"), "d", "t").collect()
    expected, head, lines = [], None, text.split("\n")
    for i, line in enumerate(lines):
        if "|" not in line:
            continue
        cells = [c.strip() for c in line.strip("|").split("|")]
        if set(line) <= set("|:- "):
            continue
        if i + 1 < len(lines) and set(lines[i + 1]) <= set("|:- "):
            head = cells
            continue
        expected += [(1, i, k, head[k], c) for k, c in enumerate(cells) if c]
    assert sorted((r.d, r.line, r.column, r.header, r.value) for r in out) == sorted(expected)


def test_names_are_found_inside_words_and_apart(spark):
    docs = spark.createDataFrame([(1, "직업: 경영기획 담당\n경 영 기 획 업무", "경영기획.pdf"), (2, "재경영기획실 | 경영기획", "x")], "d int, t string, f string")
    names = spark.createDataFrame([("경영기획", "plan", True), ("기획", "plan", False), ("용접", "weld", True)], "alias string, label string, official boolean")
    c = F.col("content")
    out = documents.dictionary_scores(docs, "d", "t", names, "alias", "label", "official", c.contains(":"), c.contains("|"), hints=F.array(F.lit("경영 기획")), filename=F.col("f")).collect()
    got = {(r.d, r.label): r.score for r in out}
    assert got == {(1, "plan"): round((1.2 + 0.9) + (0.9 + 0.9) + 1.2 + 0.9 + 0.8 + 0.6 + 0.6, 4), (2, "plan"): round(2 * (1.2 + 0.5) + 2 * (0.9 + 0.5) + 0.8, 4)}


def test_precision_grounding_equals_a_loop(spark):
    rows = [(1, "hold 5 mm, and wait; about 30 seconds"), (2, "hold 7 mm. go on"), (3, None), (4, "wait")]
    held = [(1, "tolerance 5"), (2, "tolerance 5 and 7"), (4, "")]
    out = quality.precision_grounding(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), {"size": "mm", "time": "wait|seconds"}, spark.createDataFrame(held, "m int, v string"), "m", F.col("v")).collect()
    assert {(r.k, r.clause, r.kind, r.allowed) for r in out} == {
        (1, "hold 5 mm", "size", True), (1, "and wait", "time", True), (1, "about 30 seconds", "time", False), (2, "hold 7 mm", "size", True), (4, "wait", "time", True),
    }


def test_materials_ground_clauses(spark):
    texts = [(1, "hold 5 mm, wait for oil; share the load"), (2, "hold 7 mm"), (3, "hold 8 mm"), (4, "hold 9 mm"), (5, None)]
    held = [(1, "a", ["size"], "hold the plate", True), (1, "b", ["time", "ratio"], "load share", True), (1, "c", ["time"], "wait", False), (2, "d", ["size"], "hold", False), (3, "e", ["size"], "paint", True), (1, "f", None, None, True)]
    demands = {"size": ("mm", ("size",)), "time": ("wait", ("time",)), "share": ("share", ("ratio", "size"))}
    materials = spark.createDataFrame(held, "k int, ref string, gives array<string>, body string, ok boolean")
    out = quality.material_grounding(spark.createDataFrame(texts, "k int, t string"), "k", F.col("t"), demands, materials, "k", "ref", "gives", F.col("body"), F.col("ok"), stop=("the",)).collect()
    assert {(r.k, r.clause, r.kind, r.allowed, r.reason, tuple(r.refs)) for r in out} == {
        (1, "hold 5 mm", "size", True, "grounded", ("a",)), (1, "wait for oil", "time", False, "semantic_mismatch", ()), (1, "share the load", "share", False, "kind_mismatch", ("b",)),
        (2, "hold 7 mm", "size", False, "untrusted_material", ()), (3, "hold 8 mm", "size", False, "semantic_mismatch", ()), (4, "hold 9 mm", "size", False, "missing_material", ()),
    }


@pytest.mark.parametrize(("a", "b", "a_key", "b_key", "match"), [
    (["plan"], ["planning"], "plan", "x", True), (["pl"], ["plan"], "pl", "x", False), (["qc"], ["qc"], "qc", "x", True), (["ab", "cd"], ["abc", "cde"], "abcd", "x", True),
    (["zz"], ["yy"], "oven", "hot oven", True), (["zz"], ["yy"], "ove", "hot oven", False), ([], [], "", "", False), (["plan"], None, None, None, False),
])
def test_prefix_anchors(spark, a, b, a_key, b_key, match):
    row = spark.createDataFrame([(a, b, a_key, b_key)], "a array<string>, b array<string>, ak string, bk string")
    assert row.select(X.lexically_matches(F.col("a"), F.col("b"), F.col("ak"), F.col("bk"), ("qc",)).alias("m")).collect()[0].m is match


def test_bundle_equals_a_loop(spark):
    found = catalog.queries()["t8d_candidate_bundle"](spark, "/root/testdata/sf0.001").collect()
    names = [("the", "english", 1.2), ("und", "german", 1.2), ("que", "romance", 1.2), ("of", "english", 0.9)]
    expected = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        scores = {}
        for line in (r.text or "").split("\n"):
            low = "".join(c for c in line.lower() if c not in " \t\r\n\f\x0b")
            bonus = 0.9 if ":" in line else 0.5 if "|" in line else 0.0
            for alias, label, weight in names:
                if alias in low:
                    scores[label] = scores.get(label, 0.0) + low.count(alias) * (weight + bonus)
        conf = {k: round(min(1.0, max(0.62, round(s, 4) / 4.5)), 4) for k, s in scores.items()}
        best = max(conf.values(), default=0)
        near = sorted((k for k in conf if conf[k] >= 0.62 and best - conf[k] <= 0.2 + 1e-9), key=lambda k: (-conf[k], k))[:3]
        expected |= {(r.doc_id, k) for k in near}
    assert {(r.doc_id, r.label) for r in found} == expected


def test_replay_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice("qr"), e, rng.choice(["review", "review", "rollback"]), rng.choice(["approve", "reject"]), rng.choice([None, None, -1])) for e in range(1, 120)]
    out = {r.event: (r.outcome, r.active) for r in reviewlog.replay(spark.createDataFrame(rows, reviewlog.ACTIONS)).collect()}
    stacks = {}
    for run, question, event, action, verdict, expected in rows:
        stack = stacks.setdefault((run, question), [])
        top = stack[-1] if stack else None
        if action == "rollback":
            said = "replay" if top is None else "conflict" if expected is not None and expected != top[0] else "rolled_back"
            if said == "rolled_back":
                stack.pop()
        else:
            said = "replay" if top and top[1] == verdict else "conflict" if expected is not None and expected != (top[0] if top else 0) else "accepted"
            if said == "accepted":
                stack.append((event, verdict))
        assert out[event][0] == said and (out[event][1] or 0) == (stack[-1][0] if stack else 0)


def test_task_surface_equals_a_loop(spark):
    import re

    from quillmill.functions.udfs import rewriter

    rules = ((r"\s+", " "), (r"^(?:the|a) ", ""), (r"(\w+)ing\b", r"\1"))
    texts = ["the  mixing of parts", "a plan", "plain", "", None, "holding\ttight "]
    for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", rewriter(rules)("t").alias("r")).collect():
        t, first = texts[r.k] or "", None
        for i, (p, new) in enumerate(rules):
            before, t = t, re.sub(p, new, t)
            first = i if first is None and t != before else first
        assert (r.r.text, r.r.rule) == (t.strip(), first)


def test_rows_are_numbered_without_one_task(spark):
    rows = [(i * 7919 % 1000 - 300,) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int").repartition(5)
    out = dedup.numbered(df, "k", "n", ranges=16)
    assert [r.n for r in out.orderBy("k").collect()] == list(range(1000))
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert dedup.numbered(df.filter("k > 5000"), "k", "n").count() == 0


def test_lines_of_several_files_stay_in_order(spark, tmp_path):
    for name, lines in (("b.csv", ["k,v", "1,late", "2,only"]), ("a.csv", ["k,v", *(f"{9 + i},x{i}" for i in range(50)), "1,early"])):
        (tmp_path / name).write_text("\n".join(lines))
    out = readers.read_catalogue_csv(spark, str(tmp_path), ["k", "v"], ["k"], ["k"]).collect()
    assert {r.k: r.v for r in out}["1"] == "early" and len(out) == 52


@pytest.mark.parametrize(
    ("body", "result", "error"),
    [
        ('{"result": {"a": 1}}', '{"a":1}', None),
        ('data: {"result": {"a": 1}}\n\ndata: {"result": {"a": 2}}\ndata: [DONE]\n', '{"a":2}', None),
        ('{"result": [1, 2]}', '{"value":[1,2]}', None),
        ('{"result": null, "error": null}', '{"value":null}', None),
        ('{"error": {"message": "no"}}', None, "no"),
        ('data: oops\ndata: {"result": {"a": 3}}\ndata: [1]', '{"a":3}', None),
        ("<html>", None, "unreadable response"),
        (None, None, "unreadable response"),
    ],
)
def test_rpc_bodies(spark, body, result, error):
    row = spark.createDataFrame([(body,)], "b string").select(readers.decode_rpc(F.col("b")).alias("r")).collect()[0].r
    assert (row.result, row.error) == (result, error)


def test_requests_of_hot_and_null_keys_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, "c"]), rng.choice(["b", "x", None]), rng.choice([None, *range(0, 90_000_000, 500_000)])) for i in range(900)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key's rows come in many batches
    try:
        out = {r.event: r.admitted for r in reviewlog.admitted(spark.createDataFrame(rows, "id long, c string, b string, at long"), "c", "b", F.col("at"), "id", {"b": 3}, default=5, seconds=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    kept = {}
    for i, c, b, at in sorted(rows, key=lambda r: (-1 if r[3] is None else r[3], r[0])):
        window = [t for t in kept.get((c, b), []) if at is not None and t > at - 5_000_000]
        ok = at is not None and len(window) < {"b": 3}.get(b, 5)
        if at is not None:
            kept[c, b] = window + [at] * ok
        assert out[i] == ok
