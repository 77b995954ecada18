"""The projection forest against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from tradewind.llm import projection_forest as pf
from tradewind.llm.common import table
from tradewind.llm.queries import queries


def brute(rows, k=20, step=20):
    """{query id: [(id, score)]}, rows of (id, vector) with unique ids."""
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, vectors = np.array([i for i, _ in sound]), np.stack([v for _, v in sound])
    result = {}
    for i, v in sound:
        if i % step == 0:
            scores = (vectors * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            result[i] = [(int(ids[j]), scores[j]) for j in order]
    return result


def answers(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in near}) / len(near) for q, near in want.items()])


def test_query_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(pf, "LEAF_ROWS", 64)  # 5 levels over 2,000 rows
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    by_id = {i: np.array(v) for i, v in rows}
    found, want = answers(queries()["op12_projection_forest"](spark, folder)), brute(rows)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.9
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(score == (by_id[q] * by_id[i]).sum() for i, score in near)


def test_clustered_lengths_differ_and_leaves_in_blocks(spark, monkeypatch):
    """Clusters of vectors of very different lengths, a hot vector, units of few rows."""
    for name, value in {"LEAF_ROWS": 32, "UNIT_ROWS": 10, "UNIT_QUERIES": 3}.items():
        monkeypatch.setattr(pf, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    rows = [(k, (centres[k % 12] * rng.uniform(0.2, 5) + 0.2 * rng.normal(size=10)).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[7][1]) for k in range(700)]  # a third are copies
    want = brute(rows)
    found = answers(pf.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert recall(found, want) >= 0.9
    copies = [q for q in found if q >= 2000]
    assert copies and len({tuple(found[q]) for q in copies}) == 1
    assert all(found[q] == want[q] for q in found if recall({q: found[q]}, {q: want[q]}) == 1)


def test_small_odd_and_repeated_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (40, []), (60, [0.0, 0.0]), (5, [None, 1.0]),
        (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (9, [1.0, 1.0]),
        (9, [1.0, 1.0]), (120, [-1.0, -0.0]), (140, [1e200, 1e200]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, found string")
    unique = [r for k, r in enumerate(rows) if k != 12 and r[0] != 7]
    found, want = answers(pf.nearest_vectors(df)), brute(unique)
    assert found == want and len(found) == 4
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 4.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<float>")
    assert answers(pf.nearest_vectors(twice)) == {0: [(2, 5.0), (1, 3.0)]}
    assert pf.nearest_vectors(df.limit(0)).count() == 0


def test_queue_takes_leaves_of_all_trees_in_order():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(4000, 6))
    largest = np.abs(rows).max()
    forest = pf.fit_forest(rows, 64 * pf.LEAF_ROWS, largest, np.linalg.norm(rows / largest, axis=1).max(), trees=2)
    places = forest.projected(forest.augmented(rows[:5]))
    leaves = forest.leaves(rows[:5])
    for place, own in zip(places, leaves):
        walked = list(forest.walk(place))
        assert [p for p, _, _ in walked] == sorted(p for p, _, _ in walked)
        assert len({(t, leaf) for _, t, leaf in walked}) == 2 << forest.levels
        assert {(t, leaf) for p, t, leaf in walked[:2]} == set(enumerate(own.tolist()))
    assert np.bincount(forest.leaves(rows)[:, 0]).max() <= 2 * len(rows) / (1 << forest.levels)
