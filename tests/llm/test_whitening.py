from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import whitening as wh
from tidemark.llm.whitening import whiten


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e8, 1e8), st.floats(-1e8, 1e8)), min_size=1, max_size=9))
def test_sums_keep_what_rounding_takes(pairs):
    a, b = (np.array(x)[:, None] for x in zip(*pairs))
    high, low = wh.total(*wh.products(np.concatenate([a, b], 1), np.zeros((len(a), 2)), np.array([0]), np.array([1])))
    exact = sum((Fraction(x) * Fraction(y) for x, y in pairs), Fraction(0))
    size = sum(abs(Fraction(x) * Fraction(y)) for x, y in pairs)
    assert abs(Fraction(high[0]) + Fraction(low[0]) - exact) <= size * Fraction(1, 2**95) + Fraction(1, 10**290)


def exact(rows):
    """n, sums and covariance of different whole vectors, in fractions."""
    rows = sorted({tuple(r) for r in rows})
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    cov = [[sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in rows) / n for j in range(len(sums))] for i in range(len(sums))]
    return n, sums, cov


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def test_against_fractions(spark):
    """Entries far from zero, of very different spread; some vectors stand there several times."""
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * [1000, 1, 1, 0.05, 30]).astype(np.float32)
    c[50:90] = c[3]
    df = vectors(spark, c.tolist()).repartition(7)
    x = np.floor(64 * c.astype(float)).astype(np.int64) + 10**9
    n, sums, cov = exact(x.tolist())
    whole = df.select(wh.whole(F.col("embedding"), 64, 10**9).alias("x")).distinct()
    assert wh.sums_of(whole, 5) == (n, sums)
    high, low = wh.covariance(whole, 5, n, lambda v: wh.centred(v, sums, n))
    for i in range(5):
        for j in range(5):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - cov[i][j]) < Fraction(1, 2**90) * (cov[i][i] + cov[j][j])
    values, axes = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    out = whiten(df, offset=10**9).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 300 * 5 and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9
    want = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums)] for r in x.tolist()]) @ axes / np.sqrt(values)
    got = out.whitened.to_numpy().reshape(300, 5)
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-7
    assert np.abs(out.explained.to_numpy()[:5] / (values / values.sum()) - 1).max() < 1e-9
    assert out.deviation.to_numpy()[::5].tolist() == [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]


def test_deviations_beyond_a_long_are_null():
    x = np.array([[2**40, 5], [3, 5]])
    assert wh.deviations(x, [2**40 + 3, 10], 2) == [None if (2**40 - 3) ** 2 >= 2**63 else 0, None]
    assert wh.deviations(np.array([[3, 5], [4, 4]]), [7, 9], 2) == [2, 2]


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 1.0], 7), (2, [0.5, 1.0], 7), (2, [0.5, 1.0], 7), (None, [0.25, -1.0], None), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1),
        (8, [1e30, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [3.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    out = whiten(df, extra=["n"]).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted((i, k) for i in (1, 2, 2, 0, 10) for k in (1, 2))
    assert {r.n for r in out} == {3} and all(r.whitened is not None for r in out)
    same = {r.component: r.whitened for r in out if r.vec_id == 1}
    assert all(r.whitened == same[r.component] for r in out if r.vec_id == 2)
    # one dimension never changes; then no dimension does
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and all(r.explained == (r.component == 1) and r.identity_error < 1e-12 for r in flat)
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error, r.n) for r in one] == [(None, 0.0, 0, 0.0, 1)] * 4
    empty = whiten(df.where("vec_id = 3"))
    assert empty.collect() == [] and empty.columns == whiten(df).columns and empty.dtypes == whiten(df).dtypes


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_same_for_any_partitions(spark, parts):
    df = spark.range(200).selectExpr("id as vec_id", "array(sin(id), cos(3 * id), sin(7 * id) * 0.1) as embedding")
    base = {(r.vec_id, r.component): r.whitened for r in whiten(df).collect()}
    for r in whiten(df.repartition(parts)).collect():
        assert abs(abs(r.whitened) - abs(base[r.vec_id, r.component])) < 1e-12
