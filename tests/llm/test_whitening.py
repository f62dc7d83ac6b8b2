"""Whitening against plain numpy."""

import math
import random

import numpy as np
import pytest

from termloom.llm import whitening as wh


@pytest.mark.parametrize("reach", [1, 100, 2**30, 2**50])
def test_scatter_is_exact(reach):
    rng = random.Random(reach)
    for n, d in ((1, 1), (63, 3), (130, 5)):
        x = np.array([[rng.randrange(-reach, reach + 1) for _ in range(d)] for _ in range(n)], np.int64)
        sums, cross = wh.scatter(x)
        o = x.astype(object)
        assert sums.tolist() == o.sum(axis=0).tolist() and (cross == o.T @ o).all()


def expected(rows):
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array(((fit * n - s) / n).tolist(), float)
    v = centred.T @ centred / n
    return good, n, s, v


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(12)
    data = (rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) + rng.normal(size=20) * 9).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1])]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [1.0]), (2005, [])]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    got = wh.components(d).collect()
    good, n, s, v = expected(rows)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    assert sorted({(r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got}) == sorted({(i if i is not None else -1, int(((n * np.array(x, object) - s) ** 2).sum())) for i, x in good})
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k in range(1, 17):
        assert all(abs(r.explained / (values[k - 1] / np.trace(v)) - 1) < 1e-9 for r in got if r.component == k)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(1, 17):
        q = np.linalg.eigh(v)[1][:, ::-1][:, k - 1]
        own = np.array([by[i, k] for i, _ in good])
        plain = np.array([(np.array(x, object) - 1_000_000).astype(float) for _, x in good]) - np.array([(float(t) - 1e6 * n) / n for t in s])
        other = plain @ q / math.sqrt(values[k - 1])
        assert np.allclose(own, other, atol=1e-7) or np.allclose(own, -other, atol=1e-7)


def test_few_dimensions_and_ranks(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [3.0, 2.0, 2.0]), (3, [3.0, 2.0, 2.0])], "vec_id int, embedding array<double>")
    got = sorted(wh.components(d).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.n) for r in got] == [(i, k, 2) for i in (1, 2, 3) for k in (1, 2, 3)]
    assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None, None] * 3
    assert [r.explained for r in got[:3]] == [1.0, 0.0, 0.0] and {r.deviation for r in got} == {128**2}
    one = wh.components(d.limit(1)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, 0.0, 0, 0.0)] * 3


def test_deviation_beyond_a_long_is_null(spark):
    d = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 5.0]), (3, [1e300, -1e300])], "vec_id int, embedding array<double>")
    got = wh.components(d).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-6


def test_empty_tables_and_own_names(spark):
    full = wh.components(spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<double>"))
    for rows in ([], [(1, None)], [(1, [])]):
        none = wh.components(spark.createDataFrame(rows, "vec_id int, embedding array<double>"))
        assert none.count() == 0 and none.dtypes == full.dtypes
    d = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "id int, embedding array<double>, whitened string")
    rows, _ = wh.whiten(d)
    assert rows.columns == ["id", "embedding", "deviation", "whitened"] and rows.count() == 2
