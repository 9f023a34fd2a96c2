from __future__ import annotations

import numpy as np
import pytest

from glyphmill.llm import nra_topk as N


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        s = sorted((-float(v.astype(float) @ w.astype(float)), j) for j, w in zip(ids, x) if j != i)
        out[i] = [j for _, j in s[:k]]
    return out


@pytest.mark.parametrize("kind", ["skewed", "normal", "ties", "zeros"])
def test_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    if kind == "skewed":
        x[:, 1:] *= 0.01
    if kind == "ties":
        x = np.repeat(np.round(x[:60]), 5, axis=0)
    if kind == "zeros":
        x[x < 0.8] = 0
    ids = [int(i) for i in rng.permutation(1000)[:300]]
    df = spark.createDataFrame([(i, v.tolist(), 0.5) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in sorted(N.top_k(df, 5, block=100).collect(), key=lambda r: (r.vec_id, r.rank)):
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    assert got == brute(ids, x, 5)


def search(x, k, blocks):
    best = N.Best(np.arange(len(x)), x, k)
    for part in np.array_split(np.arange(len(x)), blocks):
        best.search(part, N.Lists(x[part]))
    return best


@pytest.mark.parametrize("scale", [0.001, 0.05, 1.0])
def test_reads_no_more_than_it_needs(scale):
    """The more the first dimension says, the less is read; results are those of scoring all."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 6)).astype(np.float32) * np.array([1, *[scale] * 5], np.float32)
    best = search(x, 5, 3)
    scores = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(scores, -np.inf)
    assert (np.sort(best.item, axis=1) == np.sort(np.argsort(-scores, axis=1)[:, :5], axis=1)).all()
    share = (best.read + best.resolved) / best.all
    assert share < {0.001: 0.3, 0.05: 0.5, 1.0: 1.0}[scale]


def test_blocks_out_of_question_are_not_read():
    """Blocks by ranges of the dimension that says most: for most queries one end is enough."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 4)).astype(np.float32) * np.array([1, 0.001, 0.001, 0.001], np.float32)
    x = x[np.argsort(-x[:, 0])]
    best = N.Best(np.arange(400), x[:400], 5)
    for part in np.array_split(np.arange(4000), 10):
        best.search(part, N.Lists(x[part]))
    assert (best.read + best.resolved) / best.all < 0.05


def test_defined_results(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (1, [0.0, 0.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.rank, r.neighbor_id, r.score) for r in N.top_k(df).collect()) == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]
    assert N.top_k(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0] * 4) for i in range(900)], "vec_id long, embedding array<float>").withColumnRenamed("embedding", "v").selectExpr("vec_id", "v", "v as V_", "'x' as ids")
    got = N.top_k(same, 2, block=100, embedding="v").collect()
    assert len(got) == 1800 and all(r.neighbor_id == [x for x in (0, 1, 2) if x != r.vec_id][r.rank - 1] for r in got)


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """Isotropic vectors leave many to look up; single precision decides about nearly all of them."""
    x = np.random.default_rng(7).standard_normal((3000, 64)).astype(np.float32)
    pairs, candidates = [], N.Best._candidates
    monkeypatch.setattr(N.Best, "_candidates", lambda *a: (found := candidates(*a), pairs.append(len(found[0])))[0])
    best = search(x, 10, 3)
    scores = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(scores, -np.inf)
    assert (best.item == np.argsort(-scores, axis=1, kind="stable")[:, :10]).all()
    assert sum(pairs) < 3 * len(x) * 11 * 1.1  # from each block ten and the query itself


def test_lists_are_sorted_once(monkeypatch):
    """Blocks bring their ranks along, so that not each pair of blocks sorts again."""
    x = np.round(np.random.default_rng(8).standard_normal((700, 5)).astype(np.float32), 1)
    ranks = N.ranked(x)
    monkeypatch.setattr(N.np, "argsort", None)
    monkeypatch.setattr(N.np, "sort", None)
    lists = N.Lists(x, ranks)
    best = N.Best(np.arange(700), x, 5)
    best.search(np.arange(700), lists)
    monkeypatch.undo()
    for j in range(5):
        assert (x[np.argsort(ranks[:, j]), j] == np.sort(x[:, j])).all()
    assert best.item.tolist() == list(brute(range(700), x, 5).values())


@pytest.mark.parametrize("dim, scale", [(1, 1.0), (3, 1e-25), (64, 1e19), (8, 1e30), (300, 1.0)])
def test_any_size_of_values(dim, scale):
    """Products beyond single precision leave nothing out."""
    x = (np.random.default_rng(9).standard_normal((400, dim)) * scale).astype(np.float32)
    assert search(x, 4, 3).item.tolist() == list(brute(range(400), x, 4).values())
