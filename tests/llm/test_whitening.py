"""Whitening against exact fractions and a plain numpy version."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import whitening

ROW = "vec_id long, embedding array<double>, key string"


def plainly(rows, components=32):
    """{vec_id: (deviation, z)}, explained and eigenvalues of all usable rows, by exact sums and one covariance."""
    good = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for _, x in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    z = centred @ vectors[:, order] / np.sqrt(values[order])
    return n, {k: (sum((n * x[j] - sums[j]) ** 2 for j in range(d)), z[i]) for i, (k, x) in enumerate(good)}, values[order] / values.sum()


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check(got, rows, components=32):
    n, want, explained = plainly(rows, components)
    assert got.keys() == want.keys()
    k = len(explained)
    signs = None
    z = np.array([[got[i][c]["whitened"] for c in range(1, k + 1)] for i in want])
    expected = np.array([want[i][1] for i in want])
    signs = np.sign((z * expected).sum(axis=0))
    assert np.allclose(z * signs, expected, atol=1e-7)
    assert np.abs(np.cov(z.T, bias=True) - np.eye(k)).max() < 1e-9
    for i, own in got.items():
        assert sorted(own) == list(range(1, k + 1))
        for c, r in own.items():
            assert r["n"] == n and r["deviation"] == want[i][0] and r["identity_error"] < 1e-9
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("dimensions, shift", [(3, 0.0), (40, 5e8), (1, -3.0)])
def test_random_vectors(spark, partitions, dimensions, shift):
    rng = np.random.default_rng(dimensions)
    mixed = rng.normal(size=(dimensions, dimensions)) * 3
    rows = [(i, (rng.normal(size=dimensions) @ mixed + shift).tolist()) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW).repartition(partitions)
    check(by_key(whitening.whiten(df, whitening.fit(df))), rows)


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0], [1.0, 2.0], [0.0] * 5]
    df = spark.createDataFrame([(*r, "x") for r in good] + [(100 + i, v, "x") for i, v in enumerate(bad)], ROW)
    check(by_key(whitening.whiten(df, whitening.fit(df))), good)


def test_repeated_rows_and_null_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(None, rng.normal(size=3).tolist()) for _ in range(5)] + [(1, [1.0, 2.0, 3.5])] * 4
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    got = whitening.whiten(df, whitening.fit(df))
    assert got.count() == 27 and got.filter("vec_id is null").count() == 15
    assert got.filter("vec_id = 1").select("component", "whitened").distinct().count() == 3


def test_components_without_variance(spark):
    """Equal and dependent dimensions, one vector, equal vectors: null where nothing can be scaled."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), 2.0 * a, 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)).tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    got = whitening.whiten(df, whitening.fit(df))
    found = {r["component"]: r for r in got.groupBy("component").agg(F.count("whitened").alias("k"), F.max("explained").alias("e"), F.max("identity_error").alias("i")).collect()}
    assert [found[c]["k"] for c in (1, 2, 3, 4)] == [60, 60, 0, 0] and found[3]["e"] == found[4]["e"] == 0 and found[1]["i"] < 1e-9
    for same in ([(1, [1.0, 2.0], "x")], [(i, [1.0, 2.0], "x") for i in range(9)]):
        df = spark.createDataFrame(same, ROW)
        got = whitening.whiten(df, whitening.fit(df)).collect()
        assert len(got) == 2 * len(same) and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROW)
    for df in (none, spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [None], "x")], ROW)):
        got = whitening.whiten(df, whitening.fit(df))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_stay_exact(spark):
    """Whole numbers beyond what a double holds; null where a long can't hold them."""
    rows = [(0, [0.0]), (1, [3e6 + 1 / 64]), (2, [0.0]), (3, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert got == {k: v[0] for k, v in plainly(rows)[1].items()} and got[1] > 2**53
    rows = [(0, [0.0]), (1, [1e15]), (2, [0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    assert {r["deviation"] for r in whitening.whiten(df, whitening.fit(df)).collect()} == {None}
    centre = whitening.Centre.of(3, [2**62 + 1])
    assert centre.deviations(np.array([[2**61]], np.int64)) == [None]


def test_other_scales_and_new_vectors(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist(), "x") for i in range(80)], ROW)
    fitted = whitening.fit(df.filter("vec_id < 40"), components=2, scale=1024, offset=0)
    got = whitening.whiten(df, fitted)
    assert got.count() == 160 and fitted.centre.n == 40
    inside = got.filter("vec_id < 40").groupBy("component").agg(F.var_pop("whitened").alias("v")).collect()
    assert all(abs(r["v"] - 1) < 1e-9 for r in inside)


def test_query(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(by_key(queries()["op12_whitening"](spark, sf)), rows)
