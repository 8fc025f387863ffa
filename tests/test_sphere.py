"""Nearest vectors by angle against all pairs."""

import numpy as np
import pytest

from scenewright.operators import similarity as S
from scenewright.operators import sphere


def rows_of(matrix, first=0):
    return [(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)]


def clustered(seed, n, dims, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))


def plain(rows, k, digits=6):
    rows = [(i, np.array(v) / np.linalg.norm(v)) for i, v in sorted(rows) if np.any(np.array(v) != 0)]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = []
    for at, (i, v) in enumerate(rows):
        cosine = np.round(m @ v, digits)
        ranked = [j for j in np.lexsort((ids, -cosine)) if j != at][:k]
        out += [(i, r + 1, int(ids[j])) for r, j in enumerate(ranked)]
    return out


def found(spark, rows, k):
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    out, compared, all_pairs = sphere.nearest_by_angle(df, k)
    return sorted((r["id"], r["rank"], r["neighbour"]) for r in out.collect()), compared / max(all_pairs, 1)


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(sphere, "SMALL_ROWS", 0)
    if small:  # several parts in a cluster, several shares of the queries
        monkeypatch.setattr(sphere, "PART_ROWS", 30)
        monkeypatch.setattr(sphere, "QUERY_ROWS", 50)
    rng = np.random.default_rng(4)
    near = clustered(1, 300, 6, 8, 0.1)
    rows = rows_of(near) + rows_of(rng.normal(size=(100, 6)), 1000) + rows_of([near[0]] * 150, 2000) + rows_of(2 * near[:30], 3000)
    rows += [(4000, [0.0] * 6)]
    got, _ = found(spark, rows, 5)
    assert got == plain(rows, 5)


def test_clusters_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(sphere, "SMALL_ROWS", 0)
    rows = rows_of(clustered(2, 1500, 8, 40, 0.02))
    got, share = found(spark, rows, 3)
    assert got == plain(rows, 3)
    assert share < 0.2


def test_small_tables_are_compared_whole(spark):
    rows = rows_of(clustered(3, 200, 5, 4, 0.1)) + rows_of([[1.0] * 5] * 20, 900)
    assert found(spark, rows, 4) == (plain(rows, 4), 1.0)


def test_few_vectors(spark):
    assert found(spark, [], 3)[0] == []
    assert found(spark, [(7, [1.0, 0.0])], 3)[0] == []
    assert found(spark, [(7, [1.0, 0.0]), (9, [0.0, 1.0])], 3)[0] == [(7, 1, 9), (9, 1, 7)]
