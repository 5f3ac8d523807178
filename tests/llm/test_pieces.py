import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quillmill.llm.pieces import MARK, ChunkCoder, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


EDGES = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "a\n\nb c", f"{MARK}x {MARK} y", "\t a", "\x00a b", "café 你好 \U0001f600\U0001f600 end", "  x　y", "a" * 3000, "   ", "ﬁ x", " \n ", "a  " * 40]


def test_codes_equal_the_library(lib):
    coder = ChunkCoder(MODEL)
    assert coder.separable
    rng = random.Random(5)
    texts = EDGES + ["".join(rng.choice(" ab\né▁一.") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        ids = lib.encode(t)
        assert coder.code(t) == (len(ids), ",".join(map(str, ids)), lib.decode(ids)), repr(t)


def test_documents_keep_rows_and_columns(spark, lib):
    rows = [(1, None, "x"), (2, "two words", "y"), (2, "two words", "y"), (None, "", None)]
    out = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(out) == 4
    for r in out:
        ids = lib.encode(r.text or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest()
        assert r.decoded == lib.decode(ids)
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
