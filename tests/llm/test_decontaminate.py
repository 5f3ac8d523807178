import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontaminate as D
from tests.llm.helpers import LONG, ROWS, documents, empty


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    """Each window of each item at each place of each text."""
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            iw = words(item)
            m = min(window, len(iw))
            windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if iw else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found.add("" if name is None else str(name))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def result(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def planted(seed, n_docs=60, n_items=25, vocabulary=6):
    """Texts over few words, so that items overlap, repeat and hold each other; short items and none among them."""
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["A", "b", "c", "é", "10", "Zz"][:vocabulary]) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 4, 5, 9, 14, 30]))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        parts = [say(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(0, len(w) + 1)
            parts += [" ".join(w[a : a + rng.randrange(0, 12)]), say(rng.randrange(0, 3))]
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("part", [1_000_000, 40])
def test_windows_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART_WORDS", part)  # several automata, one after the other
    monkeypatch.setattr(D, "PIECE_WORDS", 8 if part == 40 else 100_000)
    for seed, vocabulary in ((1, 6), (2, 2)):
        docs, items = planted(seed, vocabulary=vocabulary)
        found = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
        assert result(found) == brute(docs, items, 5)


def test_automaton_follows_the_longest_match():
    a = D.SuffixAutomaton([("x", b"a b c d e f".split()), ("y", b"c d e q".split())], 3)
    assert a.stream(b"z b c d e q q d e f".split()) == ([(1, 6), (7, 10)], {"x", "y"}, 4)
    assert a.stream([]) == ([], set(), 0)
    rng = random.Random(3)
    for _ in range(200):
        items = [(str(k), [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 9))]) for k in range(4)]
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(30)]
        runs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        longest = max((len(r) for r in runs if len(r) >= 3 and any(tuple(text[i : i + len(r)]) == r for i in range(len(text)))), default=0)
        long_items = [(k, w) for k, w in items if len(w) >= 3]
        assert D.SuffixAutomaton(long_items, 3).stream(text)[2] == (longest if long_items else 0)


def test_edges(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away", "x"), (2, None, "y"), (3, "...", "z"), (None, "der Schnelle braune Fuchs", "z"), (5, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10", "w")], "item_id long, text string, doc_id string")
    docs = documents(spark)
    found = D.find_contamination(docs, items)
    rows = [(r[0], r[1]) for r in ROWS]
    assert result(found) == brute(rows, [(r.item_id, r.text) for r in items.collect()], 10)
    by = {r.doc_id: r for r in found.collect()}
    assert by[8].item_ids == [""] and by[8].coverage == 0.8 and by[8].longest == 4
    assert by[7].n_hit == brute([(7, LONG)], [(5, " ".join(f"word{i}" for i in range(1, 11)))], 10)[0][2]
    assert by[3].n_words == 0 and by[3].coverage == 0.0 and by[3].spans == []
    assert D.find_contamination(empty(spark), items).count() == 0
    none = D.find_contamination(docs, items.limit(0))
    assert none.count() == len(ROWS) and none.filter("n_hit > 0").count() == 0


def test_spans_are_removed(spark):
    say = "Keep this! One, two three four five six; seven eight nine ten eleven. And this."
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, say, "a"), (2, item, "b"), (3, None, "c"), (4, "clean", "d"), (None, say, "e")], "doc_id long, text string, `x.y` string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    out = D.remove_contamination(docs, items, max_coverage=0.8)
    assert out.columns == docs.columns
    kept = sorted(((r[0], r[1], r[2]) for r in out.collect()), key=lambda r: r[2])
    assert kept == [(1, "Keep this! . And this.", "a"), (3, None, "c"), (4, "clean", "d"), (None, "Keep this! . And this.", "e")]
    # longer limits leave the span, a lower coverage drops the row
    assert D.remove_contamination(docs, items, min_words=12, max_coverage=0.8).filter("doc_id = 1").collect()[0].text == say
    assert D.remove_contamination(docs, items, max_coverage=0.5).filter(F.col("text") != "clean").count() == 0
    assert D.remove_contamination(docs.limit(0), items).count() == 0
