"""Vector operators against brute force."""

import numpy as np
import pytest

from corpuslens.llm.ann_tree import every_hundredth, nearest_neighbours
from corpuslens.llm.components import connected_components
from corpuslens.llm.embedding_dedup import near_duplicate_vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 16))
    x[300:360] = x[0] + 0.05 * rng.normal(size=(60, 16))  # a crowd of near copies
    x[400:440] = x[1]  # and of exact ones
    x[500:520] = 3 * x[2] + 0.3 * rng.normal(size=(20, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0]), (None, [1.0] * 16), (2400, [None] * 16), (2500, [float("inf")] * 16)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)


def test_nearest_neighbours(vectors):
    x, df = vectors
    rows = nearest_neighbours(df, every_hundredth(df)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 900, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(900), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(by)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = nearest_neighbours(df, every_hundredth(df)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours(df.limit(0), every_hundredth(df.limit(0))).count() == 0


def test_near_duplicates(vectors):
    x, df = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(900)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], 900).min(axis=1))
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    assert len(got) == 907
    assert [got[i].n_links for i in range(900)] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(900)] == label.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in range(900))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (2000, 2100, 2200, 2300, 2400, 2500, None))
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_of_planted_links(spark):
    """Pairs at a cosine of 0.95 to 0.96 among many vectors without links: nine of ten found at least, nothing else; a
    crowd of near copies in more than one block has all its links."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    side = unit(rng.normal(size=(600, 64)))
    side = unit(side - (side * x[:600]).sum(axis=1, keepdims=True) * x[:600])
    cosine = rng.uniform(0.9505, 0.96, size=(600, 1))
    crowd = unit(x[5999] + 0.01 * rng.normal(size=(1500, 64)))
    vectors = np.concatenate([x, cosine * x[:600] + np.sqrt(1 - cosine**2) * side, crowd])
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, cid string")
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    found = sum(got[6000 + i].component_id == i for i in range(600))
    assert found >= 0.9 * 600
    assert all(got[i].n_links == 0 for i in range(600, 5999))
    assert all(got[i].n_links == 1500 and got[i].component_id == 5999 for i in [5999, *range(6600, 8100)])


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5), (2, 1)] + [(100, i) for i in range(101, 140)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
