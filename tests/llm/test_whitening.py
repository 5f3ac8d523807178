import random

import numpy as np
import pytest

from quillmill.llm import whitening as W


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, x array<long>, n string")


def brute(matrix, components):
    """(deviation, whitened, explained) by the covariance in one piece."""
    n, sums = len(matrix), matrix.sum(axis=0)
    centred = matrix - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return ((n * matrix - sums) ** 2).sum(axis=1), centred @ vectors[:, :components] / np.sqrt(values[:components]), values / values.sum()


@pytest.mark.parametrize(("rows_at_a_time", "fan_in"), [(4096, 16), (5, 2)])
def test_whitened_rows_equal_one_piece(spark, monkeypatch, rows_at_a_time, fan_in):
    monkeypatch.setattr(W, "ROWS", rows_at_a_time)
    monkeypatch.setattr(W, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    matrix = np.floor(rng.standard_normal((200, 6)) * [40, 20, 10, 5, 2.5, 2] + rng.standard_normal((200, 1)) * 9).astype(np.int64) + 1_000_000
    out = W.whitened_rows(table(spark, [(i, r.tolist(), "x") for i, r in enumerate(matrix)]).repartition(9), components=4).toPandas()
    deviation, white, explained = brute(matrix, 4)
    assert len(out) == 800 and set(out.component) == {1, 2, 3, 4} and set(out.n) == {200}
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - sign * white).max() < 1e-9
    first = out[out.component == 1].sort_values("vec_id")
    assert (first.deviation.to_numpy() == deviation).all()
    told = out.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(told / explained[:4] - 1).max() < 1e-10 and out.identity_error.max() < 1e-10


def test_merges_lose_nothing():
    rng = np.random.default_rng(5)
    matrix = (rng.integers(-9, 9, (60, 5)) + 10**6).astype(np.int64)
    whole = W.Summary.of(matrix)
    for seed in range(5):
        cuts = sorted(random.Random(seed).sample(range(1, 60), 4))
        parts = [W.Summary.of(m) for m in np.split(matrix, cuts)]
        total = parts[0]
        for p in parts[1:]:
            total = total.merge(p)
        assert (total.n, total.sums) == (60, matrix.sum(axis=0).tolist())
        assert np.allclose(total.factor.T @ total.factor, whole.factor.T @ whole.factor, rtol=1e-12, atol=1e-9)


def test_edges(spark):
    rows = [(1, [5, 0, 2], "a"), (1, [5, 0, 2], "a"), (2, None, "b"), (3, [], "c"), (None, [1, 0, 4], "d"), (4, [9, 0, 1], None), (5, [7, 7], "e"), (6, [9, 7], "f")]
    out = W.whitened_rows(table(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {1, None, 4, 5, 6} and len(by[1]) == 6 and len(by[5]) == 2 and by[1][0].n == 4 and by[5][0].n == 2
    # the middle entry never varies, and two vectors vary along one direction only
    assert [r.whitened is None for r in sorted(by[4], key=lambda r: r.component)] == [False, False, True]
    assert [r.whitened is None for r in sorted(by[6], key=lambda r: r.component)] == [False, True]
    assert sorted(abs(r.whitened) for r in by[5] + by[6] if r.whitened is not None) == pytest.approx([1, 1])
    assert all(r.identity_error < 1e-9 for r in out)
    one = W.whitened_rows(table(spark, [(1, [3, 4], "x")])).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in one] == [(None, 0.0, 0), (None, 0.0, 0)]
    assert W.whitened_rows(table(spark, [])).count() == 0
    huge = W.whitened_rows(table(spark, [(1, [2**51, 0], "x"), (2, [-(2**51), 0], "x")])).collect()
    assert {r.deviation for r in huge} == {None} and max(abs(r.whitened) for r in huge if r.whitened is not None) == pytest.approx(1)


def test_query_drops_what_is_not_finite(spark, tmp_path):
    from quillmill.llm.queries import op12_whitening

    rows = [(1, [0.5, 0.25], None), (2, [float("nan"), 1.0], None), (3, [None, 1.0], None), (4, None, None), (5, [-0.02, 1.0], None), (6, [float("inf"), 1.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op12_whitening(spark, str(tmp_path)).collect()
    x = np.array([[1_000_032, 1_000_016], [999_998, 1_000_064]])
    assert {(r.vec_id, r.deviation) for r in out} == {(v, int(d)) for v, d in zip((1, 5), ((2 * x - x.sum(axis=0)) ** 2).sum(axis=1))}
