"""Window forms of greedy loops against models written as loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import dedup, quality, ranking, rows
from quillmill.streaming import reviewlog


def loop_diversified(items, k, cap, bar):
    chosen, counts = [], {}
    for test in (lambda c, s: s >= bar and counts.get(c, 0) < cap, lambda c, s: counts.get(c, 0) < cap, lambda c, s: True):
        for i, (c, s) in enumerate(items):
            if len(chosen) < k and i not in chosen and test(c, s):
                chosen.append(i)
                counts[c] = counts.get(c, 0) + 1
    return chosen


def test_diversified_equals_three_passes(spark):
    rng = random.Random(1)
    for _ in range(6):
        items = [(rng.choice("abc"), rng.choice([0.0, 0.01, 0.5])) for _ in range(rng.randrange(1, 25))]
        k, cap = rng.randrange(1, 12), rng.randrange(1, 4)
        df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(items)], "rank long, cls string, sim double")
        got = [r["rank"] for r in ranking.diversified(df, "cls", "sim", [F.col("rank")], k, cap).collect()]
        assert got == loop_diversified(items, k, cap, 0.02)


def loop_factors(items, cap, n):
    kinds = {}
    for u, t in items:
        if t:
            kinds.setdefault(u, set()).add(t)
    taken, seen, out = {}, {}, []
    for i, (u, t) in enumerate(items):
        seen.setdefault(u, set())
        new = bool(t) and t not in seen[u]
        waiting = len(kinds.get(u, set()) - seen[u])
        room = cap - taken.get(u, 0)
        if room > 0 and (new or room > waiting):
            out.append(i)
            taken[u] = taken.get(u, 0) + 1
            if new:
                seen[u].add(t)
    return out[:n]


def test_factors_reserve_slots(spark):
    rng = random.Random(2)
    for _ in range(6):
        items = [(rng.choice("uv"), rng.choice(["K", "S", "A", ""])) for _ in range(rng.randrange(1, 20))]
        cap = rng.randrange(3, 6)
        df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(items)], "rank long, unit string, kind string")
        got = [r["rank"] for r in ranking.rank_factors(df, "unit", "kind", [F.col("rank")], cap, 15).collect()]
        assert got == loop_factors(items, cap, 15)


def test_balanced_is_round_robin(spark):
    rng = random.Random(3)
    items = [rng.choice(["지식", "기술", "태도", "", None]) for _ in range(30)]
    pools = {t: [i for i, x in enumerate(items) if x == t] for t in ("지식", "기술", "태도")}
    expected = []
    while any(pools.values()):
        for t in ("지식", "기술", "태도"):
            if pools[t]:
                expected.append(pools[t].pop(0))
    expected += [i for i, x in enumerate(items) if not x]
    df = spark.createDataFrame(list(enumerate(items)), "ord long, kind string")
    assert [r["ord"] for r in ranking.balanced(df, "kind", "ord", ["지식", "기술", "태도"], 20).collect()] == expected[:20]


def test_merge_stops_at_the_key_that_fills_the_list(spark):
    items = [("a", 0.5), ("b", 0.4), ("a", 0.9), ("c", 0.3), ("b", 0.99)]
    df = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(items)], "ord long, key string, conf double")
    got = [(r["position"], r["ord"]) for r in ranking.merge_candidates(df, "key", "conf", "ord", 3).orderBy("position").collect()]
    assert got == [(0, 2), (1, 1), (3, 3)]


def test_min_max_without_a_range(spark):
    df = spark.createDataFrame([(0.4,), (7.0,), (-2.0,)], "x double").select(ranking.min_max(F.col("x"), F.col("x"), F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [0.4, 1.0, 0.0]


def test_greedy_set_equals_a_loop(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    chosen = []
    for t in texts:
        if not chosen or not dedup.similar_keys([t], chosen).any():
            chosen.append(t)
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "ord long, block string, text string")
    accepted = {r["ord"] for r in dedup.diverse_set(df, "block", "text", "ord").filter("accepted").collect()}
    assert [texts[i] for i in sorted(accepted)] == chosen


def test_similar_sets_agrees_with_the_python_predicate(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select(dedup.similar_sets(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [(bool(a) and a == b) or bool(dedup.similar_keys([a], [b], least_ratio=2.0)[0, 0]) for a, b in pairs]


def test_blocks_of_any_size_are_settled(spark):
    df = spark.range(30_000).select(F.col("id").alias("ord"), F.lit("b").alias("block"), F.lit("one text").alias("text"))
    out = dedup.diverse_set(df, "block", "text", "ord")
    assert [r.ord for r in out.filter("accepted").collect()] == [0] and out.count() == 30_000


def test_rollback_makes_the_predecessor_active():
    stack = []
    assert reviewlog.fold(stack, 1, "review", "approve", None) == "accepted"
    assert reviewlog.fold(stack, 2, "review", "approve", None) == "replay"
    assert reviewlog.fold(stack, 3, "review", "reject", 9) == "conflict"
    assert reviewlog.fold(stack, 4, "review", "reject", 1) == "accepted"
    assert reviewlog.fold(stack, 5, "rollback", None, None) == "rolled_back" and stack == [(1, "approve")]
    assert reviewlog.fold(stack, 6, "rollback", None, 1) == "rolled_back" and reviewlog.fold(stack, 7, "rollback", None, None) == "replay"


def test_streams_equal_batches(spark):
    from quillmill.plans import catalog, logs

    sf = "/root/testdata/sf0.001"
    for batch, stream in (("l2_rollback_replay", "l1_review_stream"), ("l4_admitted", "l4_admitted_stream")):
        a, b = (sorted(map(tuple, catalog.queries()[q](spark, sf).collect()), key=repr) for q in (batch, stream))
        assert a == b and a
    assert logs.actions(spark, sf).count() == len(catalog.queries()["l2_rollback_replay"](spark, sf).collect())


def test_rejected_requests_do_not_enter_the_window(spark):
    df = spark.createDataFrame([(i, "c", "b", i * 1_000_000) for i in range(10)], "id long, client string, bucket string, at long")
    out = {r.event: r.admitted for r in reviewlog.admitted(df, "client", "bucket", F.col("at"), "id", {"b": 2}, seconds=5).collect()}
    assert [out[i] for i in range(10)] == [True, True, False, False, False, True, True, False, False, False]


def test_repair_loop_stops(spark):
    df = spark.createDataFrame([(0, "b", "x" * 9), (1, "b", "ok"), (2, "b", "ok")], "ord long, block string, text string")
    audit = lambda t, h: (["long"] if len(t) > 5 else []) + (["seen"] if t in h else [])
    out = quality.repair_loop(df, "block", "text", "ord", audit, lambda t, issues, k: t[:-1] if "long" in issues else f"{t}{k}").orderBy("ord").collect()
    assert [(r.tries, r.ready, r.text) for r in out] == [(4, True, "xxxxx"), (0, True, "ok"), (1, True, "ok1")]


def test_first_wins_skips_blank_keys(spark):
    df = spark.createDataFrame([(0, "A b"), (1, "ab"), (2, None), (3, " "), (4, "c")], "ord long, t string")
    from quillmill.functions.text import dedup_key

    assert sorted(r["ord"] for r in rows.first_wins(df, [dedup_key(F.col("t"))], [F.col("ord")]).collect()) == [0, 4]


def test_upsert_keeps_old_values_where_new_ones_are_blank(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n int")
    new = spark.createDataFrame([(1, "", 9), (3, "c", None)], "k long, s string, n int")
    out = {r.k: (r.s, r.n, r.on) for r in rows.upsert(old, new, "k", ["s", "n"], deactivate="on").collect()}
    assert out == {1: ("a", 9, True), 2: ("b", 2, False), 3: ("c", None, True)}


WHOLE = ["d5_diverse_set", "d6_scoped_unique", "d7_repeats", "d9_unseen_keys", "j17_near_pairs", "q8_repair_loop"]


@pytest.mark.parametrize("name", WHOLE)
def test_queries_read_parts_of_any_id(spark, tmp_path, name):
    from quillmill.plans import catalog

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 1000).write.parquet(f"{tmp_path}/part.parquet")
    key = "ord" if name in ("d5_diverse_set", "d6_scoped_unique", "d9_unseen_keys", "q8_repair_loop") else "p_partkey"
    found, moved = ([r.asDict() for r in catalog.queries()[name](spark, d).collect()] for d in (sf, str(tmp_path)))
    assert len(found) == 200
    assert sorted(tuple((r | {key: r[key] + 1000}).items()) for r in found) == sorted(tuple(r.items()) for r in moved)


def test_all_later_parts_are_held_against_the_history(spark, tmp_path):
    from quillmill.plans import catalog

    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    p.unionByName(p.withColumn("p_partkey", F.col("p_partkey") + 1000)).write.parquet(f"{tmp_path}/part.parquet")
    found = {r.p_partkey: r.duplicate for r in catalog.queries()["d8_history_duplicates"](spark, str(tmp_path)).collect()}
    assert found == {i + 1000: True for i in range(200)}


def test_repeats_equal_a_loop(spark):
    from difflib import SequenceMatcher

    texts = ["why red", "why read", "why bed", "", "red tin", "why red", "red tins", None, "why red"]
    rows = [(i, ("x", "y", "general")[i % 7 % 3], texts[i % 9], i // 2) for i in range(40)]
    out = dedup.repeats(spark.createDataFrame(rows, "id int, s string, t string, o int"), "id", F.col("s"), F.col("t"), "o", 0.8).collect()
    ratio = lambda a, b: bool(a and b) and SequenceMatcher(None, a, b).ratio() >= 0.8
    expected = {k: any(s == s2 and o2 < o and (s == "general" or ratio(t, t2)) for _, s2, t2, o2 in rows) for k, s, t, o in rows}
    assert {r.id: r.repeated for r in out} == expected
