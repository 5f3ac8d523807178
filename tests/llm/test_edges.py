"""Every operator on the edge rows, on an empty table, and against plain models."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import cap_filters, exact_dedup, langid, line_dedup, mixing, ngram_join, pieces, sharding, suffix_tree, toxicity
from tests.llm.helpers import ROWS, documents, empty


def words(text):
    return (text or "").encode().lower().split()


# 1 n-gram Jaccard join


def gram_set(text, n=5):
    w = words(text)
    m = min(n, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()


def brute_classes(rows, similarity=0.8):
    sets = [gram_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        text = [rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 120))]
        for _ in range(n):
            t = list(text)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("part", [3, 1024])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = near_copies(14)
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out.collect()) == brute_classes(rows)


def test_ngram_join_edges(spark):
    out = {(r.doc_id, r.class_id): r for r in ngram_join.similar_documents(documents(spark)).collect()}
    assert out[(1, 1)].n_links == 2 and out[(2, 1)].n_links == 2
    assert all(out[(i, i)].n_links == 0 for i in (3, 4, 5, 6, 7, 8, 9))
    assert ngram_join.similar_documents(documents(spark)).count() == len(ROWS)
    assert ngram_join.similar_documents(empty(spark)).count() == 0
    kept = ngram_join.keep_one_of_each_class(documents(spark))
    assert kept.columns == documents(spark).columns and kept.filter("doc_id = 2").count() == 0


def test_bands_reach_their_recall():
    for s, r in ((0.8, 0.99), (0.9, 0.999), (0.5, 0.9)):
        bands, rows = ngram_join.bands_for(s, r)
        assert 1 - (1 - s**rows) ** bands >= r and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.999999)


# 2 source mixing


def test_sainte_lague_equals_one_seat_at_a_time():
    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 6))]
        most = [rng.randrange(0, 30) for _ in votes]
        seats = rng.randrange(0, 60)
        got = [0] * len(votes)
        while sum(got) < seats:
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        assert mixing.sainte_lague([float(v) for v in votes], seats, most).tolist() == got, (votes, seats, most)


def test_targets_stop_at_three_times_the_size():
    t = mixing.capped_targets([1000, 1000, 10], [1, 2, 3], 2010, 3)
    assert t[2] == 30 and abs(sum(t) - 2010) < 1e-9 and abs(t[1] / t[0] - 2) < 1e-9
    assert mixing.capped_targets([], [], 0, 3).tolist() == []


def test_shard_quotas_add_up():
    plan = mixing.plan_mix([10_000, 3_000, 500], [1, 2, 3], 64, shards=7)
    assert (plan.shard_quotas.sum(axis=1) == plan.quotas).all() and plan.shard_quotas.min() >= 0 and plan.quotas.sum() == 13_500
    per_shard = plan.shard_quotas.sum(axis=0)
    assert per_shard.max() - per_shard.min() <= 1
    plan = mixing.plan_mix([10_000, 30], [1, 9], 16, cap=2.5)
    assert (plan.quotas <= 2.5 * plan.sizes).all()


def mix_of(spark, sizes, seed=4):
    """(words taken, target) of each source, its documents of 1 to 40 words."""
    rng, rows = random.Random(seed), []
    for source, size in sizes.items():
        while size:
            n = min(size, rng.randrange(1, 41))
            rows.append((len(rows), "w " * n, source))
            size -= n
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert 0 <= r.taken <= 3 * r.size and sum(r.shard_words) == r.taken
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    return taken, target


def test_small_sources_get_their_words(spark):
    sizes = {"a": 10_000, "b": 10, "c": 4, "d": 1, "e": 63, "f": 65, None: 7}
    taken, target = mix_of(spark, sizes)
    assert sum(taken.values()) == sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 1 and taken[s] <= 3 * n for s, n in sizes.items())


def test_many_sources_get_their_words(spark):
    rows = [(i, "one two three four", f"host{i:06d}") for i in range(20_000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    total, off = out.agg(F.sum("taken"), F.max(F.abs(F.col("taken") - F.col("target")))).collect()[0]
    assert total == 80_000 and off <= 1


def test_a_hundred_thousand_sources_are_apportioned_quickly():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 10_000, 100_000)
    began = time.perf_counter()
    plan = mixing.plan_mix(sizes, [1.0 + i % 3 for i in range(len(sizes))], 64)
    assert time.perf_counter() - began < 60
    assert plan.quotas.sum() == sizes.sum() and np.abs(plan.quotas - plan.targets).max() <= 1 and (plan.quotas <= 3 * sizes).all()


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="at most 2 sources"):
        mixing.mix_sources(documents(spark))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 9)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.mix_sources(documents(spark)).count() == len(ROWS)


def test_mix_comes_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 200))), rng.choice(["a", "b", None, "c"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, block=16).collect()
    again = mixing.mix_sources(docs.repartition(3), block=16).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in out:
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mix_edges(spark):
    out = mixing.mix_sources(documents(spark)).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix_sources(empty(spark)).count() == 0
    kept = mixing.mixed_documents(documents(spark))
    assert kept.columns == documents(spark).columns and mixing.mixed_documents(empty(spark)).count() == 0


# 3 sharding


def test_shards_are_balanced_and_gapless(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(0, 500)) for i in range(3000)] + [(5000 + i, "same text") for i in range(1500)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size, slots, sums = {i: len(t) + 16 for i, t in rows}, defaultdict(list), Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode())
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert len(out) == len(rows) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(size.values()) / 8
    assert all(abs(v - target) <= 0.02 * target + 1100 for v in sums.values())


def test_equal_texts_stay_together_unless_balance_forbids_it(spark):
    rows = [(i, f"text {i // 3} " + "y" * 200) for i in range(900)] + [(9000, "z" * 700)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    shards = defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    rows = [(i, "same text") for i in range(4000)] + [(5000 + i, f"own {i}") for i in range(4000)]
    sums, shards = Counter(), defaultdict(set)
    for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect():
        sums[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
    assert max(sums.values()) - min(sums.values()) <= 2 * 25 and sum(len(s) > 1 for s in shards.values()) == 1


def test_shard_edges(spark):
    out = sharding.shard_by_bytes(documents(spark), 40).collect()
    assert len(out) == len(ROWS) and {r.size for r in out if r.doc_id == 3} == {16}
    assert sharding.shard_by_bytes(empty(spark), 40).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(documents(spark), 0)


# 4 LM scoring


def test_base_score_and_counts(spark):
    rows = [(i, t) for i, t in near_copies(5)] + [(900, None), (901, "")]
    out = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in out:
        w = [*words(dict(rows)[r.doc_id]), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_tree_probabilities_add_up_and_use_contexts():
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 6, 4000)
    stream[1::2] = (stream[0::2] + 1) % 6  # every second symbol follows from the one before
    pairs = Counter(zip(stream[:-1].tolist(), stream[1:].tolist()))
    tree = suffix_tree.root(np.arange(6, dtype=np.uint64), np.bincount(stream, minlength=6), 6)
    entries = sorted((a << int(suffix_tree.BITS) | b, n) for (a, b), n in pairs.items() if n > 40)
    m, d = ([sum(f(n) for (x, _), n in pairs.items() if x == a) for a in range(6)] for f in (lambda n: n, lambda n: 1))
    suffix_tree.grow(tree, np.arange(6, dtype=np.uint64), np.array(m), np.array(d), np.array([k for k, _ in entries], np.uint64), np.array([n for _, n in entries]), 8.0)
    assert tree.levels[0].kept.all()
    for a in range(6):
        p = 10 ** tree.log10(np.arange(6, dtype=np.uint64), [np.full(6, a)])
        assert p.argmax() == (a + 1) % 6 and p.sum() == pytest.approx(1, abs=0.01)


def plain_tree_scores(rows, depth, min_gain, min_context, min_entry):
    """Scores by dictionaries, a context at a time: the rules of ``grow`` and ``score_documents``."""
    training = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in training for w in [*t, b"\n"])
    common = {w for w, n in c.items() if n >= min_context} | {b"\n"}
    symbol = lambda w: w if w in common else zlib.crc32(w[-3:]) % suffix_tree.CLASSES
    streams = [[b"\n", *map(symbol, t), b"\n"] for t in training]
    single = Counter(x for s in streams for x in s[1:])
    size, total = len(common) + suffix_tree.CLASSES, sum(single.values())
    follow = defaultdict(Counter)
    for s in streams:
        for at in range(1, len(s)):
            for k in range(1, depth + 1):
                if at >= k:
                    follow[tuple(s[at - k : at])][s[at]] += 1
    kept = {}

    def p(x, before, most):
        scale = 1.0
        for k in range(min(most, len(before)), 0, -1):
            own = kept.get(tuple(before[-k:]))
            if own:
                if x in own[0]:
                    return scale * own[0][x]
                scale *= own[1]
        return scale * (single[x] + 1) / (total + size + 1)

    for k in range(1, depth + 1):
        fresh = {}
        for context, after in follow.items():
            m, d = sum(after.values()), len(after)
            if len(context) != k or (m if k > 1 else single[context[0]]) < min_context:
                continue
            shorter = {x: p(x, context[1:], k - 1) for x, n in after.items() if n >= min_entry}
            own = {x: (after[x] + d * q) / (m + d) for x, q in shorter.items()}
            leave = max(1 - sum(own.values()), 1e-12) / max(1 - sum(shorter.values()), 1e-12)
            gain = sum(after[x] * math.log(own[x] / shorter[x]) for x in own) + (m - sum(after[x] for x in own)) * math.log(leave)
            if gain >= min_gain + len(own):
                fresh[context] = (own, leave)
        kept |= fresh
    members = defaultdict(set)
    for _, t in rows:
        for w in [*words(t), b"\n"]:
            members[symbol(w)].add(w)
    inside = {x: sum(c[w] for w in ws) + sum(c[w] > 0 for w in ws) + 1 for x, ws in members.items()}
    out = {}
    for i, t in rows:
        before, score = [b"\n"], 0.0
        for w in [*words(t), b"\n"]:
            x = symbol(w)
            score += math.log10(p(x, before, depth)) + math.log10((c[w] + 1) / inside[x])
            before.append(x)
        out[i] = score
    return out, Counter(len(k) for k in kept)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_scores_equal_a_plain_suffix_tree(spark, depth):
    rng = random.Random(13)
    phrases = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 7))] for _ in range(30)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(0, 9)) for w in rng.choice(phrases)) + (f" rare{i}" if i % 3 else "")) for i in range(150)] + [(900, None), (901, "Unseen words")]
    expected, kept = plain_tree_scores(rows, depth, 4.0, 3, 2)
    out = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, min_gain=4.0, min_context=3, min_entry=2).collect()
    assert len(out) == len(rows) and all(kept[k] for k in range(1, min(depth, 3) + 1))
    for r in out:
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9), r


def test_bounds_of_the_tree_hold(spark, monkeypatch):
    rows = [(i, t) for i, t in near_copies(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_tree, "TASK_KEYS", 10)
    whole, bound = (sum(r.score for r in suffix_tree.score_documents(docs, min_context=2, min_entry=2, **more).collect()) for more in ({}, {"most_entries": 30, "most_words": 20}))
    assert whole > bound


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_parts_of_the_tree_are_the_whole_tree(spark, monkeypatch, depth):
    rng = random.Random(31)
    phrases = [[f"w{int(rng.random() ** 3 * 60)}" for _ in range(rng.randrange(2, 7))] for _ in range(9)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(0, 12)) for w in rng.choice(phrases))) for i in range(80)] + [(900, None), (901, "Unseen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, kept = plain_tree_scores(rows, depth, 4.0, 3, 2)
    lengths = []
    deal = suffix_tree._deal
    monkeypatch.setattr(suffix_tree, "_deal", lambda *args: lengths.append(deal(*args)) or lengths[-1])
    monkeypatch.setattr(suffix_tree, "PART_TOKENS", 12)
    monkeypatch.setattr(suffix_tree, "BUCKETS", 5)
    out = suffix_tree.score_documents(docs, depth=depth, min_gain=4.0, min_context=3, min_entry=2).collect()
    assert len(lengths[0][0].indexes) == depth and lengths[0][0].parts > 50  # contexts of every length are too common for a part
    assert len(out) == len(rows) and kept[depth]
    for r in out:
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9), r


def test_starts_of_many_texts_are_dealt_to_many_parts():
    deal, last = suffix_tree.Deal(1, 3), np.arange(2049, 3049)
    deal.add(np.zeros(1, np.uint64), np.array([5 * suffix_tree.PART_TOKENS]))
    none = np.full(1000, -1)
    part = deal.part(last, [np.zeros(1000, np.int64), none, none], [np.zeros(1000, np.int64)])
    assert deal.size == 6 and set(part) == set(range(1, 6))


def test_columns_survive_packing():
    rng = np.random.default_rng(8)
    for kind in (bool, np.int32, np.int64, np.float64):
        columns = [(rng.normal(size=n) * 9).astype(kind) for n in (0, 1, 999)]
        found = suffix_tree.columns_of(suffix_tree.packed(*columns), kind)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, found, strict=True))


def test_no_count_asked_for_grows_with_the_corpus(spark):
    rng = random.Random(17)
    phrases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(6)) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(12))) for i in range(260)]
    expected, kept = plain_tree_scores(rows, 3, 8.0, 2, 1)
    out = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert out[0].train_tokens > 13_000 and kept[2]
    for r in out:
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9), r


def test_index_finds_what_it_holds():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        keys = np.concatenate([keys, np.arange(n, dtype=np.uint64)])
        wanted = np.concatenate([rng.permutation(keys), rng.integers(1 << 62, 1 << 63, 300, dtype=np.uint64)])
        found, place = suffix_tree.Index(keys).find(wanted)
        assert found[: len(keys)].all() and not found[len(keys) :].any()
        assert (keys[place[: len(keys)]] == wanted[: len(keys)]).all()


def test_lm_edges(spark):
    out = suffix_tree.score_documents(documents(spark)).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (3, 4, 5)} == {1}
    assert suffix_tree.score_documents(empty(spark)).count() == 0


# 5 toxicity


def toxic_rows(n=600, seed=3):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["vilezor", "vilezan", "grumdok", "idiot"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.learn(docs, marks)).collect()}
    held = [(out[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([s >= 0.7 for s, t in held if t]) >= 0.9 and np.mean([s >= 0.7 for s, t in held if not t]) <= 0.02


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def votes_of(n=6000, seed=5):
    rng = np.random.default_rng(seed)
    label = rng.random(n) < 0.2
    good = [rng.random(n) < np.where(label, r, 0.02) for r in (0.6, 0.5, 0.7, 0.4)]
    noise = rng.random(n) < 0.15
    return label, np.column_stack([*good, good[0], good[0], noise])


def test_label_model_learns_from_agreement_alone():
    label, votes = votes_of()
    model = toxicity.fit_label_model(votes, 0.2)
    assert model.accuracy == pytest.approx([label[v].mean() for v in votes.T], abs=0.2)
    assert abs(model.accuracy[6] - 0.2) < 0.05  # who speaks by chance tells nothing
    assert model.correlations[0, 4] > 0.95 and model.share[0] < 0.4 < 0.8 < model.share[6]
    alone = model.posterior(np.eye(7, dtype=bool))  # rows of one vote start from the prior
    assert (alone[1:4] > 0.8).all() and abs(alone[6] - 0.2) < 0.05
    assert np.mean((model.posterior(votes) > 0.5) == label) > 0.92


def plain_log_odds(model, row):
    out = math.log(model.prior / (1 - model.prior))
    for v, spoken in enumerate(row):
        if spoken:
            out += math.log(model.rates[v, 1] / model.rates[v, 0]) / max(1.0, sum(c * c for c in model.correlations[v]))
    return out


def test_posteriors_equal_a_plain_sum_and_labels_only_turn_them():
    label, votes = votes_of(800)
    model = toxicity.fit_label_model(votes, 0.2)
    odds = model.log_odds(votes)
    assert odds == pytest.approx([plain_log_odds(model, r) for r in votes])
    slope, shift = toxicity.calibrated(odds, label.astype(float))
    other, back = toxicity.calibrated(odds, 1.0 - label)
    assert slope > 0 > other and np.mean(((slope * odds + shift) > 0) == label) > 0.88


def test_toxicity_edges(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (7, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = toxicity.score_documents(docs, toxicity.learn(docs, labels))
        assert out.count() == len(ROWS) and out.filter("score between 0 and 1").count() == len(ROWS)
    assert toxicity.score_documents(empty(spark), toxicity.learn(empty(spark), none)).count() == 0


# 7 embedding near-duplicates


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "PART", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 24))
    rows = [(i, (base[i % 20] + rng.standard_normal(24) * (0.05 if i % 3 else 0.3)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    out = sorted(map(tuple, cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
    ids = np.array([i for i, _ in rows])
    expected = sorted((int(ids[i]), int(near[i].sum()), int(ids[label[i]]), bool(label[i] == i)) for i in range(len(rows)))
    assert np.mean([a == b for a, b in zip(out, expected)]) >= 0.99
    assert all(a[1] <= b[1] for a, b in zip(out, expected))


@pytest.mark.parametrize("vectors", [31_000, 1_000_000, 100_000_000])
def test_recall_holds_at_every_number_of_vectors(vectors):
    code = cap_filters.CapCode.fit(64, vectors)
    x, y = cap_filters.pairs_at(0.9, 64, 1000, seed=77)
    built, step = code.built(), 200
    shared = [bool(set(a) & set(b)) for i in range(0, 1000, step) for a, b in zip(code.decode(x[i : i + step], built), code.decode(y[i : i + step], built))]
    assert np.mean(shared) >= 0.98


def test_all_pairs_where_codes_do_not_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "MOST_CODES", 1)
    rng = np.random.default_rng(3)
    u = rng.standard_normal((60, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(u)]
    out = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), min_cosine=0.3).collect()
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expected = (u @ u.T >= 0.3).sum(axis=1) - 1
    assert expected.any() and all(r.n_links == expected[r.vec_id] for r in out)


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    out = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = {(r.vec_id, r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows) and {(1, 2, 1), (2, 2, 1)} <= found
    assert all((i, 0, i) in found for i in (3, 4, 5, 6, 7, 8, 9))
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 8 language ID


def plain_bits(text, counts, order):
    total = 0.0
    for w in text.lower().split():
        s = b" " + w + b" "
        for i in range(1, len(s)):
            done = False
            for k in range(min(order, i), -1, -1):
                seen = counts[k].get(s[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total -= math.log2(seen[s[i]] / (n + d))
                    done = True
                    break
                total -= math.log2(d / (n + d))
            if not done:
                total += math.log2(257)
    return total


def test_code_lengths_equal_a_plain_coder():
    rng = random.Random(8)
    texts = {lang: b" ".join(bytes(rng.choice(abc) for _ in range(rng.randrange(1, 9))) for _ in range(400)) for lang, abc in (("aa", b"abcd"), ("bb", b"cdefg"))}
    import pandas as pd

    frames, models = [], {}
    for lang, text in texts.items():
        frames.append(langid.context_counts(Counter(text.split()), 3).assign(lang=lang))
        models[lang] = [defaultdict(Counter) for _ in range(4)]
        for w in text.split():
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for k in range(min(3, i) + 1):
                    models[lang][k][s[i - k : i]][s[i]] += 1
    trees = langid.freeze(pd.concat(frames), 3)
    tests = [b"abc", b"zebra", b"dddd cde ab", "é".encode()]
    for t in tests:
        got = trees.cost(t.split()).sum(axis=0)
        for j, lang in enumerate(trees.langs):
            assert got[j] == pytest.approx(plain_bits(t, models[lang], 3)), (t, lang)


def test_texts_stay_where_no_language_could_be_learned(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    trees = langid.learn(docs, "doc_id", "text", "lang")
    kept = langid.keep_identified(docs, trees)
    assert not trees.langs and kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 7, 8, 9]


def test_language_edges(spark):
    docs = documents(spark)
    out = langid.identify(docs, langid.learn(docs, "doc_id", "text", "lang")).collect()
    assert len(out) == len(ROWS) and all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (3, 4, 5, 6))
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.learn(empty(spark), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), nothing).count() == 0
    kept = langid.keep_identified(docs, langid.learn(docs, "doc_id", "text", "lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, 9, None}


# 9 exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    return sorted((key(i), key(max(groups[t or ""], key=key)), len(groups[t or ""]), key(i) == max(map(key, groups[t or ""]))) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2))])
def test_exact_dedup_even_if_digests_collide(spark, digest):
    rng = random.Random(9)
    rows = [(i, rng.choice(["", None, "a", "b "]) if i % 3 else f"text {rng.randrange(200)}") for i in range(700)]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == exact_brute(rows)


def test_state_absorbs_more_files(spark, tmp_path):
    state = exact_dedup.DedupState(spark, f"file://{tmp_path}/dedup")
    frame = lambda ids: spark.createDataFrame([(bytes([i % 5]), i, (1, 1)) for i in ids], "digest binary, id long, locator struct<bytes:long,hash:long>")
    state.add(frame(range(20)))
    state.absorb()
    state.add(frame(range(20, 33)))
    state.absorb()
    assert {r.digest[0]: (r.keep_id, r.copies) for r in state.rows().collect()} == {k: (max(i for i in range(33) if i % 5 == k), sum(i % 5 == k for i in range(33))) for k in range(5)}


def test_exact_dedup_edges(spark):
    docs = documents(spark)
    assert exact_dedup.exact_duplicates(docs).count() == len(ROWS)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


# 10 line dedup


def test_lines_equal_a_plain_count(spark):
    rng = random.Random(10)
    rows = [(i, f"https://h{rng.randrange(4)}.org/x", "\n".join(rng.choice(["menu", "menu", " foot ", f"own {i}", "rare", ""]) for _ in range(rng.randrange(8)))) for i in range(120)]
    rows += [(200, "no url", "menu"), (201, None, "menu\nmenu"), (202, "https://single.org", "menu"), (204, "https://two.org/a", "menu\na"), (205, "https://two.org/b", "menu\nb"), (203, "https://h1.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, body string")
    for limit in (line_dedup.BROADCAST_BYTES, -1):
        line_dedup.BROADCAST_BYTES, before = limit, line_dedup.BROADCAST_BYTES
        out = line_dedup.drop_site_lines(pages, "page_id", line_dedup.url_host(F.col("url")), line_dedup.text_lines(F.col("body"))).collect()
        line_dedup.BROADCAST_BYTES = before
        lines = {i: [x.strip() for x in (b or "").split("\n") if x.strip()] for i, _, b in rows}
        host = {i: (u.split("/")[2] if u and "//" in u else "") for i, u, _ in rows}
        total, has = Counter(host.values()), Counter((host[i], x) for i in lines for x in set(lines[i]))
        for r in out:
            h = host[r.page_id]
            kept = [x for x in lines[r.page_id] if not (h and has[(h, x)] > 1 and has[(h, x)] / total[h] > 0.3)]
            assert (r.host, r.n_lines, r.n_dropped, r.text) == (h, len(lines[r.page_id]), len(lines[r.page_id]) - len(kept), "\n".join(kept))
        assert len(out) == len(rows)


def test_line_edges(spark):
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert line_dedup.drop_site_lines(empty_pages, "page_id", line_dedup.url_host(F.col("url")), line_dedup.page_lines(F.col("html"))).count() == 0
    page = spark.createDataFrame([("<html><script>x\ny</script><p>one &amp; <b>two</b></p><!-- c -->three<br>four",), (None,)], "html string")
    assert [r[0] for r in page.select(line_dedup.page_lines(F.col("html"))).collect()] == [["one &amp; two", "three", "four"], []]


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in near_copies(6)] + [(800, None, "en", "s0", 0), (801, "12 34", "en", "s0", 5)]
    docs = spark.createDataFrame(rows + [(900, rows[0][1], "en", "s1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES:
        before = held
        held = step(spark, held, str(tmp_path))
        held.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in held.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held.columns == before.columns
    assert not seen[0] & {800, 801} and 0 not in seen[1] and 900 in seen[1]
    survivors = [(r[0], r[1]) for r in [*rows, (900, rows[0][1])] if r[0] in seen[1]]
    assert seen[2] == {d for d, c, _ in brute_classes(survivors) if d == c}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/n-gram Jaccard join")).collect() if r.copies}
    assert Counter(r.doc_id for r in spark.read.parquet(f"{tmp_path}/source mixing").collect()) == plan
    assert Counter(r.doc_id for r in held.collect()) == plan
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held.count()


def test_chunk_digest(spark):
    out = pieces.encode_documents(documents(spark), keep=["doc_id"], digests_only=True).collect()
    assert {r.ids_sha256 for r in out if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}


# whole results against plain models that follow the same order


def test_mix_equals_a_plain_mix(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90))), rng.choice(["b", "a", None, "é"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, seed = 16, 11
    spread = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", mixing.n_words(F.col("text"))).alias("h")).collect()}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {i: len(t.split()) for i, t, _ in rows}
    totals = [sum(size[i] for i, _, x in rows if x == s) for s in names]
    plan = mixing.plan_mix(totals, [1.0, 2.0, 3.0, 1.0], block, seed=seed)
    expected = {}
    for k, name in enumerate(names):
        own = sorted((i for i, _, s in rows if s == name), key=lambda i: (spread[i], i, size[i]))
        words = [i for i in own for _ in range(size[i])]
        length, n_blocks = int(plan.block[k]), int(plan.n_blocks[k])
        order = sorted(range(n_blocks), key=lambda j: (plan.step[k] * j + plan.shift[k]) % n_blocks)
        lap = [i for j in order for i in words[j * length : (j + 1) * length]]
        upto = plan.upto[k].tolist()
        taken = {i: [0] * 8 for i in own}
        for place in range(upto[-1]):
            taken[lap[place % len(lap)]][sum(place >= u for u in upto[1:])] += 1
        expected |= {i: (totals[k], sum(t), t) for i, t in taken.items()}
    out = mixing.mix_sources(docs, block=block, seed=seed).collect()
    assert {r.doc_id: (r.source_size, r.taken, r.shard_words) for r in out} == expected
    copies = {r.doc_id: r.copies for r in out}
    kept = Counter(r.doc_id for r in mixing.mixed_documents(docs, block=block, seed=seed).collect())
    assert kept == {i: n for i, n in copies.items() if n} and all(0 <= copies[i] - expected[i][1] // max(1, size[i]) <= 1 for i in copies)


def test_shards_equal_a_plain_walk(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["same", "other " * 30, f"own {i} " * rng.randrange(1, 40)])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = {r.doc_id: (r.h, zlib.crc32(dict(rows)[r.doc_id].encode()), len(dict(rows)[r.doc_id]) + 16, r.doc_id) for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    walk = sorted(order, key=order.get)
    size = {i: len(t) + 16 for i, t in rows}
    total, n = sum(size.values()), 6
    before, at = {}, 0
    for i in walk:
        before[i] = at
        at += size[i]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    expected, slots = {}, Counter()
    for i in walk:
        own = groups[dict(rows)[i]]
        whole = len(own) * size[i] <= max(size.values())
        middle = min(before[j] for j in own) + len(own) * size[i] / 2 if whole else before[i] + size[i] / 2
        shard = min(n - 1, int(middle * n // total))
        expected[i] = (shard, slots[shard])
        slots[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs, n).collect()} == expected


CLASHES = ["__id", "__own", "__digest", "__words", "__time", "__copies", "__mark", "__source", "__row", "__text", "id", "u", "mark", "key", "size", "block", "held", "SCORE", "lang_pred_", "rows", "class"]


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "one two three four five six", "a", "en"), (1, "one two three four five six", "a", "en"), (2, "one two three four five six", "b", "en"), (None, "seven eight nine", None, "de"), (None, "other words here", "a", None)]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASHES)) for k, r in enumerate(rows)], ["doc_id", "Text", "source", "lang", *CLASHES])
    trees = langid.learn(docs, "doc_id", "Text", "lang")
    scorer = toxicity.learn(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"), text_col="Text")
    before = {tuple(r) for r in docs.collect()}
    for found in (
        exact_dedup.drop_exact_duplicates(docs, text_col="Text"),
        ngram_join.keep_one_of_each_class(docs, text_col="Text"),
        mixing.mixed_documents(docs, text_col="Text", block=2),
        langid.keep_identified(docs, trees, text_col="text"),
    ):
        assert found.columns == docs.columns and {tuple(r) for r in found.collect()} <= before
    assert toxicity.score_documents(docs, scorer, text_col="text").count() == len(rows)
    assert langid.identify(docs, trees, text_col="text").count() == pieces.encode_documents(docs).count() == len(rows)
    for found in (
        ngram_join.similar_documents(docs, text_col="Text"), mixing.mix_sources(docs, text_col="Text"), sharding.shard_by_bytes(docs, 3, text_col="Text"),
        suffix_tree.score_documents(docs, text_col="Text"), exact_dedup.exact_duplicates(docs, text_col="Text"),
    ):
        assert found.count() == len(rows)
    stays = exact_dedup.drop_exact_duplicates(docs, text_col="Text").collect()
    assert sorted(r.doc_id or 0 for r in stays) == [0, 0, 2]
    repeats = exact_dedup.drop_exact_duplicates(docs.filter("doc_id = 1"), text_col="Text").collect()
    assert [r["__own"] for r in repeats] == ["__own0"]


def test_rows_without_an_id_are_told_apart(spark):
    near = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, near, "a"), (None, near + " x", "a"), (None, "quite another text of some words", "b"), (None, None, "b"), (5, "w", "b")], "doc_id long, text string, source string")
    kept = ngram_join.keep_one_of_each_class(docs)
    assert kept.count() == 4
    mixed = mixing.mixed_documents(docs, block=8)
    plan = mixing.mix_sources(docs, block=8).filter("copies > 0").agg(F.sum("copies")).collect()[0][0]
    assert mixed.count() == plan


def test_long_near_copies_are_compared_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_GRAMS", 9000)
    base = [f"w{i}" for i in range(4000)]
    rows = [(k, " ".join([*base, *(f"own{k}x{i}" for i in range(20))])) for k in range(25)]
    compare = ngram_join.jaccard_at_least
    flat = np.concatenate([np.arange(5), np.arange(1, 6), np.arange(50, 60)]).astype(np.uint64)
    assert compare(flat, np.array([5, 5, 10]), np.array([0, 1]), np.array([1, 2]), 0.6).tolist() == [[True, False], [True, False]]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 24)}


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [1.0, -1.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_openers_that_never_close_are_read_once(spark):
    junk = [mark * (5_000_000 // len(mark)) for mark in ("<!--", "<script ", "<style ", "<", "<p ")]
    pages = spark.createDataFrame([("head --> </script> </style> > " + j,) for j in junk], "html string")
    began = time.perf_counter()
    assert pages.select(F.max(F.size(line_dedup.page_lines(F.col("html"))))).collect()[0][0] >= 1
    assert time.perf_counter() - began < 25


@pytest.mark.parametrize("seed", [1, 2])
def test_tags_are_stripped_as_by_the_plain_patterns(spark, seed):
    import re

    rng = random.Random(seed)
    bits = ["<script x>", "</script>", "<SCRIPT>", "<style>", "</style>", "<!--", "-->", "<p>", "</p", ">", "<", "a", "b\n", "<br/>", "<scripts>", "--", "<i "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    def plain(t):
        t = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "", t)
        t = re.sub(r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>", "\n", t)
        return [x for x in (y.strip("\t\x0b\x0c\r ") for y in re.sub(r"<[^>]*>", "", t).split("\n")) if x]
    out = spark.createDataFrame([(t,) for t in texts], "html string").select("html", line_dedup.page_lines(F.col("html")).alias("l")).collect()
    assert all(r.l == plain(r.html) for r in out)


def test_dotted_and_case_clashing_names(spark):
    docs = documents(spark).toDF("doc.id", "the.text", "the.lang", "Source", "score", "digest").withColumn("TEXT", F.lit("no")).withColumn("x.y", F.lit(1))
    assert exact_dedup.exact_duplicates(docs, "doc.id", "the.text").filter("kept").count() > 0
    trees = langid.learn(docs, "doc.id", "the.text", "the.lang")
    assert trees is not None
    assert suffix_tree.score_documents(docs, "doc.id", "the.text").count() == len(ROWS)
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b")], "`v.id` long, `e.m` array<double>, V string")
    assert cap_filters.near_vectors(vectors, "v.id", "e.m").filter("kept").count() == 1


def test_rows_without_an_id_are_all_kept_or_one_of_them(spark):
    docs = spark.createDataFrame([(None, "", "a"), (None, None, "b"), (3, "x", "c")], "doc_id long, text string, n string")
    out = exact_dedup.exact_duplicates(docs).collect()
    assert [(r.group_size, r.kept) for r in out if r.doc_id is None] == [(2, True), (2, True)]
    assert exact_dedup.drop_exact_duplicates(docs).count() == 2
