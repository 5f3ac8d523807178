"""Many names in many texts, and the operators on top, against loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmill.operators import automaton, documents, match


def names_and_texts(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abA 가나") for _ in range(rng.randrange(0, n)))
    return sorted({say(5) for _ in range(40)} | {"", "aa"}), [say(60) for _ in range(60)] + [None, ""]


@pytest.mark.parametrize("part", [4_000_000, 9])
def test_occurrences_equal_counts(spark, monkeypatch, part):
    monkeypatch.setattr(automaton, "PART_CHARS", part)  # several automata
    names, texts = names_and_texts(1)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = automaton.occurrences(df, "k", F.col("t"), spark.createDataFrame([(n,) for n in names] * 2, "n string"), F.col("n")).collect()
    assert sorted((r.k, r.name, r.times) for r in found) == sorted((k, n, t.count(n)) for k, t in enumerate(texts) if t for n in names if n and n in t)
    assert automaton.occurrences(df, "k", F.col("t"), spark.createDataFrame([], "n string"), F.col("n")).count() == 0


def test_catalogue_counts_equal_a_loop(spark):
    names, texts = names_and_texts(2)
    hints = [["x"] if k % 3 else ["B oss", None] for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, hints))], "k int, t string, h array<string>")
    out = documents.catalogue_counts(df, "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n", F.col("h"), spark.createDataFrame([("boss", "a a"), ("boss", "no such name")], "alias string, target string"), most=3)
    squeeze = lambda t: "".join((t or "").lower().split())
    expected = {}
    for k, t in enumerate(texts):
        scored = []
        for n in names:
            key = squeeze(n)
            times = squeeze(t).count(key) if len(key) >= 2 else 0
            score = max(float(times), 0.95 if key == "aa" and k % 3 == 0 else 0.0)
            if score:
                scored.append((-score, -len(n), n, times, round(min(1.0, max(0.62, score / 3 if score > 1 else score)), 4)))
        for _, _, n, times, confidence in sorted(scored)[:3]:
            expected[k, n] = (times, confidence)
    assert {(r.k, r.n): (r.times, r.confidence) for r in out.collect()} == expected
    assert {c for _, c in expected.values()} == {1.0, 0.6667, 0.95}


def test_fuzzy_classes_over_a_whole_catalogue_equal_a_loop(spark):
    """Part names of the table, some misspelt: more pairs than a small catalogue, no refusal."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    names = sorted({r[0] for r in part.select(F.concat_ws(" ", "p_name", "p_type")).collect()})
    rng = random.Random(3)
    terms = sorted({n[: rng.randrange(4, len(n))] + rng.choice(["", "x", " y"]) + n[rng.randrange(4, len(n)) :] for n in names[:40]} | {"zzz", names[3].upper(), ""})
    asked = spark.createDataFrame(list(enumerate(terms)), "o int, t string")
    out = match.fuzzy_classes(asked, "t", "o", spark.createDataFrame([(i, n) for i, n in enumerate(names)], "c int, n string"), "n", "c", "c").collect()
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    expected, used = {}, set()
    for t in terms:
        a = key(t)
        scored = [(1.0 if a == key(n) else 0.86 if a in key(n) or key(n) in a else round(SequenceMatcher(None, a, key(n)).ratio(), 6), -c) for c, n in enumerate(names) if a]
        best = max((s for s in scored if s[0] >= 0.62), default=None)
        if best and -best[1] not in used:
            used.add(-best[1])
            expected[t] = (-best[1], best[0])
    assert {r.t: (r.c, r.confidence) for r in out} == expected and len(expected) > 10
