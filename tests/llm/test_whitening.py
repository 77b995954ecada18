"""Whitening against exact fractions."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tradewind.llm.common import table
from tradewind.llm.queries import queries
from tradewind.llm.whitening import (
    centred,
    column_sums,
    pair_names,
    pair_square_sums,
    row_squares,
    square_sums,
    whiten,
)


def plain(rows, components=16):
    """The contract in fractions: {(id, component): (n, deviation, whitened, explained)}, signs as they fall."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in sound]
    fit = sorted({x for _, x in xs})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(dims)] for i in range(dims)]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1].T
    trace = float(sum(cov[k][k] for k in range(dims)))
    found = {}
    for i, x in xs:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        away = np.array([float(a - b) for a, b in zip(x, mean)])
        for k in range(min(components, dims)):
            found[i, k + 1] = (n, deviation, away @ vectors[k] / math.sqrt(values[k]), values[k] / trace)
    return found


def test_query_equals_exact_fractions_and_whitens(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want = plain(rows)
    got = {(r.vec_id, r.component): r for r in queries()["op13_polarisation_whitening"](spark, folder).collect()}
    assert got.keys() == want.keys()
    signs = {}
    for key, (n, deviation, white, explained) in want.items():
        row = got[key]
        assert (row.n, row.deviation) == (n, deviation)
        assert row.explained == pytest.approx(explained, rel=1e-9) and row.identity_error < 1e-9
        if abs(white) > 1e-3:
            signs.setdefault(key[1], set()).add(np.sign(white) == np.sign(row.whitened))
        assert abs(row.whitened) == pytest.approx(abs(white), rel=1e-6, abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows of a component


def test_copies_nulls_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = [(k, rng.normal(size=4).tolist(), "x") for k in range(40)]
    copies = [(100 + k, base[0][1], "y") for k in range(30)] + [(7, base[7][1], "again")]
    odd = [
        (200, None, ""), (201, [], ""), (202, [1.0, None, 2.0, 3.0], ""), (203, [float("nan"), 0.0, 0.0, 0.0], ""),
        (204, [float("inf"), 0.0, 0.0, 0.0], ""), (205, [1.0, 2.0], ""), (206, [1e300, 0.0, 0.0, 0.0], ""),
        (None, base[1][1], "no id"),
    ]
    df = spark.createDataFrame(base + copies + odd, "vec_id long, embedding array<double>, x string")
    found = whiten(df).collect()
    want = plain([(i, v) for i, v, _ in base])
    assert {r.n for r in found} == {40} and len(found) == 4 * (40 + 31 + 1)
    for r in found:
        source = 1 if r.vec_id is None else r.vec_id if r.vec_id < 40 else 0
        _, deviation, white, _ = want[source, r.component]
        assert r.deviation == deviation and abs(r.whitened) == pytest.approx(abs(white), abs=1e-6)
    assert max(r.identity_error for r in found) < 1e-9


def test_empty_and_constant_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    rows = whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, None, None, None)] * 4
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert {r.whitened is None for r in line if r.component == 1} == {False}
    assert {r.whitened for r in line if r.component == 2} == {None}


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 33, 1 << 58])
def test_sums_are_exact_at_any_size(most):
    rng = np.random.default_rng(most % 97)
    x = rng.integers(-most, most, size=(50, 3))
    rows = [[int(v) for v in r] for r in x]
    assert column_sums(x) == [sum(c) for c in zip(*rows)]
    assert square_sums(x) == [sum(v * v for v in c) for c in zip(*rows)]
    sums = column_sums(x)
    m = centred(x, 50, sums)
    plain_m = [[50 * v - s for v, s in zip(r, sums)] for r in rows]
    assert [[int(v) for v in r] for r in m] == plain_m
    i, j = pair_names(3)
    want = [sum((r[a] + r[b] if a != b else r[a]) ** 2 for r in plain_m) for a, b in zip(i, j)]
    assert pair_square_sums(m) == want
    assert row_squares(m) == [sum(v * v for v in r) for r in plain_m]
