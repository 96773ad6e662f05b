import numpy as np
import pytest

from tidewright.llm import topk
from tidewright.llm.topk import BallTree, Best, top_k


def brute(vectors, k):
    """vectors: (id, list of whole numbers) of one length."""
    out = []
    for n, (i, v) in enumerate(vectors):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(vectors) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5) * 10.0 ** rng.integers(0, 6))]) for i in range(500)] + [(500, [20000.0, 1.0, 0.0, 0.0, 1e6]), (600, [-1e6] * 5), (700, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, top_k(df, "vec_id % 100 = 0", 10, 100).collect())) == brute(whole, 10)


def test_a_score_beyond_a_long_is_an_error(spark):
    rows = [(i, [float(i) + 1, 2.0]) for i in range(30)] + [(100, [1e15, 0.0]), (101, [1e15, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(df, "vec_id = 100").collect()
    assert top_k(df, "vec_id = 7").count() == 10


def test_search_leaves_most_nodes_unvisited(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 32)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 6)) * 4000
    points = np.floor(centres[rng.integers(60, size=8000)] + rng.normal(size=(8000, 6)) * 100)
    tree = BallTree.load(BallTree(points, np.arange(8000), np.arange(8000)).save())
    for n in range(0, 8000, 400):
        best = Best(10)
        tree.search(points[n], n, best)
        scores = points @ points[n]
        scores[n] = -np.inf
        assert best.found == sorted((-int(s), i) for i, s in enumerate(scores) if np.isfinite(s))[:10]
    assert tree.visited < 0.2 * 20 * len(tree.lows)
    before = tree.visited
    tree.search(points[0], 0, Best(10, 10**15))
    assert tree.visited == before


def test_clashing_names_repeats_and_empties(spark):
    rows = [(100, [1.0, 2.0], 3), (100, [1.0, 2.0], 4), (5, [2.0, 1.0], 5), (None, [2.0, 1.0], 5), (7, [], 5), (200, [], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").selectExpr("vec_id", "embedding", "n", "n AS dim", "n AS number", "n AS v")
    got = sorted((r.query_id, r.rank, str(r.vec_id), r.score) for r in top_k(df, "vec_id % 100 = 0").collect())
    own, other = 5 * 1024 * 1024, 4 * 1024 * 1024
    assert got == [(100, 1, "100", own), (100, 1, "100", own), (100, 2, "None", other), (100, 2, "None", other), (100, 3, "5", other), (100, 3, "5", other), (200, 1, "7", 0)]
