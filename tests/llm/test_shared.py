"""The helpers of the training-data operators."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import _shared
from quillmill.llm.components import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 7))
def test_sorted_groups_are_whole(values, size):
    keys = np.sort(np.array(values, np.int64))
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    batches = table.to_batches(max_chunksize=size)
    groups = list(_shared.sorted_groups(iter(batches), ["k"]))
    assert [g.column("k")[0].as_py() for g in groups] == sorted(set(values))
    assert [x for g in groups for x in g.column("v").to_pylist()] == list(range(len(keys)))
    assert sum(b.num_rows for b in _shared.gathered(iter(batches), 64)) == len(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=9)), max_size=30), st.integers(1, 20))
def test_blocks_keep_order_and_size(texts, size):
    groups = list(_shared.blocks(texts, size))
    assert [t for g in groups for t in g] == texts
    assert all(len(g) == 1 or sum(len(t or "") for t in g) <= size for g in groups)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(7, 12)), max_size=30))
def test_links_are_counted_and_named_by_the_smallest(links):
    left, right, copies = np.arange(7), np.arange(7, 13), np.arange(1, 14)
    near = np.zeros((7, 6), bool)
    for a, b in links:
        near[a, b - 7] = True
    n, label = list(range(13)), list(range(13))
    n = [sum(copies[b] for a, b in set(links) if a == k) + sum(copies[a] for a, b in set(links) if b == k) for k in range(13)]
    for _ in range(13):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = _shared.links_of(near, near, left, right, copies)
    assert found[0].tolist() == n and found[1].tolist() == label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6, unique=True), min_size=2, max_size=9), st.integers(0, 10))
def test_shared_earlier_numbers(lists, here):
    half = len(lists) // 2
    left, right = np.arange(half), np.arange(half, len(lists))
    found = _shared.shares_earlier(pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))]), here, left, right)
    expected = [[any(x < here for x in set(lists[a]) & set(lists[b])) for b in right] for a in left]
    assert (np.zeros((len(left), len(right)), bool) if found is None else found).tolist() == expected


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums_within_groups(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 50, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, n long")
    out = _shared.ranged_prefix(df, ["o"], "n", within=["g"]).collect()
    assert len(out) == 300
    for g in (None, 0, 1, 2):
        own = sorted((r["__index"], r["__before"], r["o"], r["n"]) for r in out if r["g"] == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[2] for x in own] == sorted(x[2] for x in own)
        assert [x[1] for x in own] == np.concatenate(([0], np.cumsum([x[3] for x in own])[:-1])).tolist()


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", _shared.held_out(F.col("id"), 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)
