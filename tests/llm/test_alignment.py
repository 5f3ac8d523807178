import bisect
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmill.llm import alignment as A
from tests.llm.helpers import LONG, ROWS, documents, empty

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    left = Tokenizer.from_file(JSON)
    left.encode_special_tokens = True
    with open(JSON, encoding="utf-8") as f:
        tokens = A.byte_level_tokens(f.read())
    right = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return left, right, tokens, A.piece_tokens(right)


def brute(libraries, docs):
    """Groups by byte offsets, links and counts of whole texts coded in one call."""
    left, right, a_bytes, b_bytes = libraries
    groups, facts, counts = [], [], Counter()
    for _, text in docs:
        found = []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            if b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
                ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((a_bytes, a), (b_bytes, b))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                found = [([], []) for _ in cuts]
                for side, ids in enumerate((a, b)):
                    for i, e in zip(ids, ends[side]):
                        found[bisect.bisect_left(cuts, e)][side].append(i)
        links = [(x, y) for one, other in found for x in one for y in other]
        counts.update(set(links))
        groups.append(links)
        said = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, other))}" for one, other in found)
        facts.append((sum(len(one) for one, _ in found), sum(len(o) for _, o in found), len(found), len(links), hashlib.sha256(said.encode()).hexdigest() if found else ""))
    best = defaultdict(int)
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return [(d, *f[:4], sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), f[4]) for (d, _), f, links in zip(docs, facts, groups)]


def key(r):
    return (r[0] is None, r[0] or 0, r)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=key)


EDGES = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "a\n\nb c", "▁x ▁ y", "\t a", "\x00a b", "café 你好 \U0001f600\U0001f600 end", "  x　y", "a" * 3000, "ﬁ x", " \n ", "<|endoftext|> x <s> </s>", "don't  we'll\n can't", "x  y\x1c z\x85 w", "a\r\n b", "Ünḯ 한국어 텍스트", "1234567 89 !!! ???", "<0x41> <unk>"]


@pytest.mark.parametrize("block", [4_000_000, 7])
def test_links_equal_whole_texts(spark, libraries, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_PAIRS", block if block > 100 else 400)  # several blocks of counts
    monkeypatch.setattr(A, "JOINED", 500 if block > 100 else 3)
    rng = random.Random(5)
    alphabet = " ab\né▁一.'s1\t Straßen "
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + [" ".join(rng.choice(["the", "naïve", "it's", "x1", "tokenization", "한국"]) for _ in range(30)) for _ in range(20)]
    docs = list(enumerate(texts))
    out = A.align_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert result(out) == sorted(brute(libraries, docs), key=key)


def test_edge_rows(spark, libraries):
    rows = [(r[0], r[1]) for r in ROWS]
    assert result(A.align_documents(documents(spark))) == sorted(brute(libraries, rows), key=key)
    assert A.align_documents(empty(spark)).count() == 0
    assert LONG in [t for _, t in rows]


def test_transducer_closes_on_an_empty_suffix():
    t = A.Transducer([b"a", b"ab", b"bc", b"c", b""], [b"a", b"b", b"abc", b"x"])
    assert t.read([0, 2], [2]) == (["0,2|2"], [2, 10])
    assert t.read([1, 3, 0], [0, 1, 0]) is None  # the right side has no c
    assert t.read([1, 0], [0, 1, 0]) == (["1|0,1", "0|0"], [4, 5, 0])
    assert t.read([1], [0, 3]) is None and t.read([1], [0]) is None and t.read([4], [0]) is None
    assert t.read([], []) == ([], [])
    opened = len(t.opened), len(t.moves)
    t.read([1, 0], [0, 1, 0])
    assert (len(t.opened), len(t.moves)) == opened


def test_table_starts_anew(libraries, monkeypatch):
    monkeypatch.setattr(A, "TABLE_CHUNKS", 3)
    monkeypatch.setattr(A, "MOST_MOVES", 5)
    with open(JSON, encoding="utf-8") as a, open(MODEL, "rb") as b:
        aligner = A.ChunkAligner(a.read(), b.read())
    assert aligner.separable
    docs = [(k, t) for k, t in enumerate(["one two three four", "five six", "one six one", "", None, "two  two"])]
    told = [aligner.align([t]) for _, t in docs]
    assert [(d, *(int(v) for v in f[0]), g[0]) for (d, _), (f, g, *_rest) in zip(docs, told)] == [(r[0], *r[1:5], r[7]) for r in brute(libraries, docs)]


def test_other_models_are_coded_whole():
    with open(JSON, encoding="utf-8") as a, open(MODEL, "rb") as b:
        made, model = json.load(a), b.read()
    made["normalizer"] = {"type": "Lowercase"}
    aligner = A.ChunkAligner(json.dumps(made), model)
    assert not aligner.separable
    facts, digests, *_ = aligner.align(["lower case", "Upper case"])
    assert facts[0, 0] > 0 and digests[0] and not facts[1].any() and not digests[1]
