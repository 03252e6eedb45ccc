"""Batches of operators with wide results stay small, however many trials a task has."""

import numpy as np

from kymo.operators.base import BatchOperator, Trials


class Lengths(BatchOperator):
    """How many trials a call sees, and much beside it."""

    inputs, output = ("x",), "y"

    def infer(self, a):
        return (20_000,)

    def batch(self, a):
        return np.full((len(a), 20_000), float(len(a)))


def test_wide_results_come_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        df = spark.range(1200, numPartitions=1).selectExpr("id as trial_id", "array(double(id)) as x")
        out = Lengths().apply(Trials(df, {"x": (1,)})).df.selectExpr("y[0] as n", "size(y) as size").collect()
        assert {r["size"] for r in out} == {20_000} and max(r["n"] for r in out) <= 100
    finally:
        spark.conf.set(key, before)


class Flat(BatchOperator):
    """Gives its results flat."""

    inputs, output = ("x",), "y"

    def infer(self, a):
        return (2, 3)

    def batch(self, a):
        return np.repeat(a, 6, axis=1).reshape(len(a), 6)


def test_flat_results_of_many_trials(spark):
    df = spark.range(1200, numPartitions=1).selectExpr("id as trial_id", "array(double(id)) as x")
    out = Flat().apply(Trials(df, {"x": (1,)})).df.collect()
    assert all(r["y"] == [float(r["trial_id"])] * 6 for r in out) and len(out) == 1200
