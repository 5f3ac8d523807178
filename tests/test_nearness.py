"""The kernels, the index of rare letters and acceptance in rounds."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import kernels
from quillmill.operators import dedup, nearness

WORDS = ["red", "read", "ring", "rings", "bolt", "promo", "small", "anvil", "17", "가나", "다"]


def sentences(n, seed, longest=22):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, longest))) for _ in range(n)]


def test_kernels_equal_difflib_and_sets():
    texts = [*sentences(60, 1), "", "a" * 64, "a" * 63 + "b", "a" * 250 + "b", "ab"]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts)), indexing="ij"))
    for least in (0.6, 0.85, 1.0):
        assert (kernels.ratios_reach(texts, i, j, least) == [SequenceMatcher(None, texts[a], texts[b]).ratio() >= least for a, b in zip(i, j)]).all()
        grams = [kernels.char_grams(t) for t in texts]
        assert (kernels.jaccards_reach(texts, i, j, least) == [bool(grams[a] and grams[b]) and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= least for a, b in zip(i, j)]).all()
    assert (kernels.shared(grams, grams) == [[len(a & b) for b in grams] for a in grams]).all()


@pytest.mark.parametrize("jaccard", [False, True])
def test_index_finds_what_all_pairs_find(spark, jaccard):
    rng = random.Random(3)
    past, now = ([t for t in sentences(90, seed, 9) if t] for seed in (4, 5))
    table = lambda texts, at: spark.createDataFrame([(at + k, rng.choice("xy"), t, k) for k, t in enumerate(texts)], "id long, s string, t string, o long")
    known, asked = table(past, 0).cache(), table(now, 1000).cache()
    near = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.8 or (jaccard and len(kernels.char_grams(a) & kernels.char_grams(b)) >= 0.8 * len(kernels.char_grams(a) | kernels.char_grams(b)) > 0)
    rows = known.collect()
    expected = {r.id for r in asked.collect() if any(k.s == r.s and near(r.t, k.t) for k in rows)}
    assert {r.id for r in nearness.with_near(asked, known, 0.8, jaccard=jaccard).collect()} == expected != set()
    earlier = {r.id for r in rows if any(k.s == r.s and k.o < r.o and near(r.t, k.t) for k in rows)}
    assert {r.id for r in nearness.with_near(known, known, 0.8, earlier=True, jaccard=jaccard).collect()} == earlier != set()


def test_a_group_of_near_texts_does_not_reach_whole_postings(spark, monkeypatch):
    """Of near copies only the first is left when whole postings are met, however many there are."""
    rng = random.Random(6)
    left = {}
    for n in (50, 400):
        rows = [(k, "s", "the same long sentence about bolts and rings " + "".join(rng.choice("abcdef") for _ in range(4)), k) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, s string, t string, o long").dropDuplicates(["t"])
        counts = []
        stage = nearness.stage
        monkeypatch.setattr(nearness, "stage", lambda d, name: (counts.append((name, d.count())), stage(d, name))[1])
        assert nearness.with_near(df, df, 0.8, earlier=True).count() == df.count() - 1
        monkeypatch.setattr(nearness, "stage", stage)
        left[n] = [c for name, c in counts if name == "near-open"][-1]
    assert left == {50: 1, 400: 1}


def greedy(rows, near, target=None):
    chosen, out = {}, {}
    for i, block, text in rows:
        own = chosen.setdefault(block, [])
        ok = text != "" and (target is None or len(own) < target) and not any(near(text, c) for c in own)
        own += [text] * ok
        out[i] = ok
    return out


@pytest.mark.parametrize("target", [None, 3])
def test_rounds_accept_what_a_loop_accepts(spark, monkeypatch, target):
    monkeypatch.setattr(nearness, "FIRST_BATCH", 3)
    monkeypatch.setattr(nearness, "LAST_BATCH", 7)
    monkeypatch.setattr(nearness, "SENT_ROWS", 5)
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "x", "y", None]), t) for i, t in enumerate(sentences(120, 8, 7))]
    df = spark.createDataFrame(rows, "i long, b string, t string")
    near = lambda a, b: bool(dedup.similar_keys([a], [b])[0, 0])
    out = {r.ord: r.accepted for r in dedup.diverse_set(df, "b", "t", "i", target).collect()}
    assert out == greedy(rows, near, target)
    assert {r.block for r in dedup.diverse_set(df, "b", "t", "i", target).collect()} == {"x", "y", None}


def test_similar_keys_are_d4():
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rng = random.Random(9)
    keys = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(60)]

    def similar(a, b):
        x, y = ({t for t in k.split() if len(t) >= 2} for k in (a, b))
        g, h = (kernels.char_grams(k.replace(" ", "")) for k in (a, b))
        both = len(x & y)
        words_near = bool(x and y) and ((both >= 5 and both / min(len(x), len(y)) >= 0.62) or (both >= 4 and both / len(x | y) >= 0.8) or bool(g and h and len(g & h) / len(g | h) >= 0.68))
        return bool(a and b) and (SequenceMatcher(None, a, b).ratio() >= 0.92 or words_near)

    assert dedup.similar_keys(keys, keys).tolist() == [[similar(a, b) for b in keys] for a in keys]


def test_chains_of_keys_take_as_many_rounds_as_needed(spark):
    # each row shares a key with the next: every other one is accepted; a key that all of a block share leaves the first
    rows = [(i, "chain", [f"k{i}", f"k{i + 1}"]) for i in range(9)] + [(100 + i, "hot", ["same", f"o{i}"]) for i in range(50)] + [(200, None, ["k1"]), (201, None, ["k1", None]), (202, "chain", None)]
    df = spark.createDataFrame(rows, "i long, b string, k array<string>")
    out = {r.ord: r.accepted for r in dedup.unseen_keys(df, "b", F.col("k"), "i").collect()}
    assert {i for i, ok in out.items() if ok} == {0, 2, 4, 6, 8, 100, 200} and len(out) == len(rows)
