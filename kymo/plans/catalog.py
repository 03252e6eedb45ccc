"""Queries of the trial engine by name over the synthetic tables, with DuckDB SQL for those that SQL expresses.

``embeddings`` stands for a set of trials (4 channels of 16 samples), ``events`` for recordings with markers (a user is a
recording), ``lineitem`` for scalar columns. Results have one row an element; doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.operators import classify, elementwise, features, reduce, riemann, shape, signal
from kymo.operators.base import Operator, Trials
from kymo.plans import sql as q
from kymo.plans.pipeline import Plan
from kymo.session import shared_path
from kymo.sources import streams
from kymo.streaming import operators as streaming

CHANNELS, SAMPLES = 4, 16
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_trials(spark: SparkSession, sf_dir: str) -> Trials:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return Trials(df, {"x": (CHANNELS, SAMPLES)})


def rounded(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


def elements(trials: Trials, column: str, *more: str) -> DataFrame:
    """One row an element: trial_id, pos (row-major place), v."""
    if trials.shape(column) == ():
        return trials.df.select("trial_id", *more, rounded(F.col(column)).alias("v"))
    return spread(trials.df, column, "trial_id", *more).select("trial_id", *more, "pos", rounded(F.col("v")).alias("v"))


def spread(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row an element: pos and v. An inner explode would make Catalyst evaluate the array twice, first to drop empty ones."""
    return df.select(*keep, F.posexplode_outer(column).alias("pos", "v")).filter("pos is not null")


#: Elements of the trials in SQL: trial_id, label, ch, s, v.
LONG = f"""t as (select vec_id as trial_id, label, i // {SAMPLES} as ch, i % {SAMPLES} as s, embedding[i + 1]::double as v
  from embeddings cross join range({CHANNELS * SAMPLES}) as r(i))"""


def _filtered(ctes: str) -> str:
    """SQL for a filter's output from CTEs that end in f; the clause comes behind ``LONG``."""
    return f""", {ctes} select trial_id, (ch * {SAMPLES} + s)::int as pos, round(v, 6) + 0.0 as v from f"""


def _sections(design: signal.FilterDesign) -> list[q.Section]:
    return [(c[:3], c[3:]) for c in design.coefficients] if design.kind == "sos" else [design.coefficients]


def _out(value: str) -> str:
    return f"round({value}, 6) + 0.0 as v"


# ---- flagship ----


@query(f"""with {LONG}, e as (select trial_id, label, ch, s, v, w from t cross join range(3) as r(w) where s >= 4 * w and s < 4 * w + 8),
  c as (select a.trial_id, a.label, a.w, a.ch as r, b.ch as c, (covar_samp(a.v, b.v) + case when a.ch = b.ch then 0.01 else 0 end) / 1.01 as v
    from e a join e b on a.trial_id = b.trial_id and a.w = b.w and a.s = b.s group by a.trial_id, a.label, a.w, a.ch, b.ch)
  select label, r::int as r, c::int as c, round(avg(v), 6) + 0.0 as v from c group by label, r, c""")
def flagship_label_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean covariance of overlapping epochs by label."""
    plan = Plan([
        reduce.Covariance("by_epoch", "cov", 0.01),
        shape.Transpose("epochs", "by_epoch", (1, 0, 2)),
        shape.Epoch("x", "epochs", 8, 4),
    ])
    done = plan.transform(embedding_trials(spark, sf_dir), ["cov"])
    size = CHANNELS * CHANNELS
    at = spread(done.df, "cov", "label").groupBy("label", F.expr(f"cast(pos % {size} div {CHANNELS} as int)").alias("r"), F.expr(f"cast(pos % {CHANNELS} as int)").alias("c"))
    return at.agg(rounded(F.avg("v")).alias("v"))


# ---- element-wise: scalars of lineitem ----


def _line(spark: SparkSession, sf_dir: str) -> Trials:
    df = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_discount") - F.lit(0.05), F.col("l_tax") - F.lit(0.02)
    df = df.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trial_id"), a.alias("a"), b.alias("b"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    return Trials(df, {"a": (), "b": (), "p": (), "q": ()}, label=None)


_LINE = """l as (select l_orderkey || '-' || l_linenumber as trial_id, l_discount - 0.05::double as a, l_tax - 0.02::double as b, l_extendedprice as p, l_quantity as q from lineitem)"""


def _scalar(name: str, make: Callable[[], Operator], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return elements(make().apply(_line(spark, sf_dir)), "y")

    query(f"with {_LINE} select trial_id, {_out(sql)} from l", name)(run)


_scalar("absolute", lambda: elementwise.Absolute("a", "y"), "abs(a)")
_scalar("log", lambda: elementwise.Log("p", "y"), "ln(p)")
_scalar("addition", lambda: elementwise.Add("p", "q", "y"), "p + q")
_scalar("subtraction", lambda: elementwise.Subtract("p", "q", "y"), "p - q")
_scalar("multiplication", lambda: elementwise.Multiply("a", "b", "y"), "a * b")
_scalar("division", lambda: elementwise.Divide("q", "p", "y"), "q / p")
_scalar("logical_not", lambda: elementwise.Not("a", "y"), "(not a <> 0)::int::double")
_scalar("logical_and", lambda: elementwise.And("a", "b", "y"), "(a <> 0 and b <> 0)::int::double")
_scalar("logical_or", lambda: elementwise.Or("a", "b", "y"), "(a <> 0 or b <> 0)::int::double")
_scalar("logical_xor", lambda: elementwise.Xor("a", "b", "y"), "((a <> 0) <> (b <> 0))::int::double")
_scalar("greater", lambda: elementwise.Greater("a", "b", "y"), "(a > b)::int::double")
_scalar("less", lambda: elementwise.Less("a", "b", "y"), "(a < b)::int::double")
_scalar("equal", lambda: elementwise.Equal("a", "b", "y"), "(a = b)::int::double")
_scalar("threshold", lambda: elementwise.Threshold("p", 30000.0, "y"), "(p > 30000)::int::double")
_scalar("cdf_chi2", lambda: elementwise.Cdf("q", "y", "chi2", df=6), "1 - exp(-q / 2) * (1 + q / 2 + (q / 2) * (q / 2) / 2)")


# the Taylor series of the integral, whose terms fall below 1e-18 here
@query(f"""with {_LINE} select trial_id, round(0.5 + list_sum(list_transform(range(40), lambda k: pow(-1, k) * pow((q - 25) / 10, 2 * k + 1) / (pow(2, k) * gamma(k + 1) * (2 * k + 1)))) / sqrt(2 * pi()), 6) + 0.0 as v from l""")
def cdf_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal distribution function of quantities."""
    return elements(elementwise.Cdf("q", "y", "norm", loc=25.0, scale=10.0).apply(_line(spark, sf_dir)), "y")


@query(f"with {LONG}, m as (select trial_id, s, sum(v) as w from t group by all) select t.trial_id, (ch * {SAMPLES} + t.s)::int as pos, round(v * m.w, 6) + 0.0 as v from t join m on t.trial_id = m.trial_id and t.s = m.s")
def broadcast_multiplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials times their sums over channels: shapes (4, 16) and (16,)."""
    plan = Plan([reduce.Sum("x", "w", axis=0), elementwise.Multiply("x", "w", "y")])
    return elements(plan.transform(embedding_trials(spark, sf_dir)), "y")


# ---- operators on trials ----


def _trial(name: str, make: Callable[[], list], sql: str | None, output: str = "y") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return elements(Plan(make()).transform(embedding_trials(spark, sf_dir), [output]), output)

    query(f"with recursive {LONG} {sql}" if sql else None, name)(run)


_REDUCTIONS = {
    "max": (reduce.Max, "max(v)"), "min": (reduce.Min, "min(v)"), "mean": (reduce.Mean, "avg(v)"), "std": (reduce.Std, "stddev_pop(v)"),
    "var": (reduce.Var, "var_pop(v)"), "kurtosis": (reduce.Kurtosis, "kurtosis_pop(v)"), "reduced_sum": (reduce.Sum, "sum(v)"),
    "skewness": (reduce.Skewness, "(sum(v * v * v) / count(*) - 3 * avg(v) * sum(v * v) / count(*) + 2 * avg(v) * avg(v) * avg(v)) / pow(var_pop(v), 1.5)"),
}
for _name, (_class, _sql) in _REDUCTIONS.items():
    _trial(f"{_name}_axis0", lambda c=_class: [c("x", "y", axis=0)], f"select trial_id, s::int as pos, {_out(_sql)} from t group by trial_id, s")
    _trial(f"{_name}_axis1", lambda c=_class: [c("x", "y", axis=1)], f"select trial_id, ch::int as pos, {_out(_sql)} from t group by trial_id, ch")
    _whole = "0 as pos, " if _name == "reduced_sum" else ""
    _trial(f"{_name}_all", lambda c=_class: [c("x", "y")], f"select trial_id, {_whole}{_out(_sql)} from t group by trial_id")

_trial("var_ddof1", lambda: [reduce.Var("x", "y", axis=1, ddof=1)], f"select trial_id, ch::int as pos, {_out('var_samp(v)')} from t group by trial_id, ch")
_trial("std_ddof1", lambda: [reduce.Std("x", "y", axis=1, ddof=1)], f"select trial_id, ch::int as pos, {_out('stddev_samp(v)')} from t group by trial_id, ch")
_trial("covariance", lambda: [reduce.Covariance("x", "y", 0.05)], f"""select a.trial_id, (a.ch * {CHANNELS} + b.ch)::int as pos,
  round((covar_samp(a.v, b.v) + case when a.ch = b.ch then 0.05 else 0 end) / 1.05, 6) + 0.0 as v from t a join t b on a.trial_id = b.trial_id and a.s = b.s group by a.trial_id, a.ch, b.ch""")
_trial("slope", lambda: [reduce.Slope("x", "y", fs=50.0)], f"select trial_id, ch::int as pos, {_out(f'regr_slope(v, s) * {SAMPLES - 1} * 50.0 / {SAMPLES}')} from t group by trial_id, ch")
_trial("epoch", lambda: [shape.Epoch("x", "y", 6, 3)], "select trial_id, (ch * 24 + w * 6 + s - 3 * w)::int as pos, round(v, 6) + 0.0 as v from t cross join range(4) as r(w) where s >= 3 * w and s < 3 * w + 6")
_trial("baseline_correction", lambda: [shape.BaselineCorrection("x", "y", (0, 5))], f"select trial_id, (ch * {SAMPLES} + s)::int as pos, {_out('v - avg(case when s < 5 then v end) over (partition by trial_id, ch)')} from t")
_trial("extract", lambda: [shape.Extract("x", ([3, 1], slice(2, 12, 2)), "y")], """select trial_id, (case ch when 3 then 0 else 5 end + (s - 2) // 2)::int as pos, round(v, 6) + 0.0 as v
  from t where ch in (1, 3) and s in (2, 4, 6, 8, 10)""")
_trial("transpose", lambda: [shape.Transpose("x", "y")], f"select trial_id, (s * {CHANNELS} + ch)::int as pos, round(v, 6) + 0.0 as v from t")
_trial("reshape", lambda: [shape.Reshape("x", "r", (8, -1)), shape.Transpose("r", "y")], f"select trial_id, ((ch * {SAMPLES} + s) % 8 * 8 + (ch * {SAMPLES} + s) // 8)::int as pos, round(v, 6) + 0.0 as v from t")
_trial("concatenation", lambda: [elementwise.Absolute("x", "a"), shape.Concatenation("x", "a", "y", axis=1)],
       f"select trial_id, (ch * {2 * SAMPLES} + s + {SAMPLES} * k)::int as pos, round(case k when 0 then v else abs(v) end, 6) + 0.0 as v from t cross join range(2) as r(k)")
_trial("stack", lambda: [elementwise.Absolute("x", "a"), elementwise.Not("x", "b"), shape.Stack(["x", "a", "b"], "y")],
       f"select trial_id, (k * {CHANNELS * SAMPLES} + ch * {SAMPLES} + s)::int as pos, round(case k when 0 then v when 1 then abs(v) else (v = 0)::int end, 6) + 0.0 as v from t cross join range(3) as r(k)")
_trial("tensor_stack", lambda: [elementwise.Absolute("x", "a"), shape.TensorStack("x", "a", "y", axis=2)],
       f"select trial_id, ((ch * {SAMPLES} + s) * 2 + k)::int as pos, round(case k when 0 then v else abs(v) end, 6) + 0.0 as v from t cross join range(2) as r(k)")
_PADDED = f"from (select distinct trial_id from t) i cross join range({CHANNELS}) as c(ch) cross join range({SAMPLES + 5}) as r(p)"
_trial("pad_constant", lambda: [shape.Pad("x", "y", ((0, 0), (2, 3)), constant_values=1.5)],
       f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(coalesce(t.v, 1.5), 6) + 0.0 as v {_PADDED} left join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = p - 2")
_trial("pad_edge", lambda: [shape.Pad("x", "y", ((0, 0), (2, 3)), "edge")],
       f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(t.v, 6) + 0.0 as v {_PADDED} join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = least(greatest(p - 2, 0), {SAMPLES - 1})")
_trial("pad_reflect", lambda: [shape.Pad("x", "y", ((0, 0), (2, 3)), "reflect")],
       f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(t.v, 6) + 0.0 as v {_PADDED} join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = {SAMPLES - 1} - abs({SAMPLES - 1} - abs(p - 2))")
_trial("pad_mean", lambda: [shape.Pad("x", "y", ((0, 0), (2, 3)), "mean")],
       f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(coalesce(t.v, m.v), 6) + 0.0 as v {_PADDED} join (select trial_id, ch, avg(v) as v from t group by all) m on m.trial_id = i.trial_id and m.ch = c.ch left join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = p - 2")

_TAPS = signal.FilterDesign.fir(100.0, None, 20.0, length=5, high_width=10.0)
_trial("filter_fir", lambda: [signal.Filter("x", _TAPS, "y")], f"""select t.trial_id, (t.ch * {SAMPLES} + t.s)::int as pos, round(sum(b.v * h.c), 6) + 0.0 as v
  from t join t b on b.trial_id = t.trial_id and b.ch = t.ch and b.s <= t.s join (values {', '.join(f'({k}, {float(c)!r}::double)' for k, c in enumerate(_TAPS.coefficients))}) as h(k, c) on t.s - b.s = h.k group by all""")
_FIRST = signal.FilterDesign.butter(1, 10.0, fs=100.0)
_B, _A = (tuple(float(v) for v in c) for c in _FIRST.coefficients)
_trial("filter_iir", lambda: [signal.Filter("x", _FIRST, "y")], f""", l as (select trial_id, ch, s, {_B[0]!r}::double * v + {_B[1]!r}::double * coalesce(lag(v) over (partition by trial_id, ch order by s), 0) as u from t)
  select a.trial_id, (a.ch * {SAMPLES} + a.s)::int as pos, round(sum(b.u * pow({-_A[1]!r}::double, a.s - b.s)), 6) + 0.0 as v from l a join l b on a.trial_id = b.trial_id and a.ch = b.ch and b.s <= a.s group by all""")
_DESIGNS = {
    "filter_sos": signal.FilterDesign.butter(4, (8, 35), "bandpass", "sos", 250.0),
    "filter_cheby1": signal.FilterDesign.cheby1(3, 1.0, 20.0, "lowpass", "sos", 100.0),
    "filter_cheby2": signal.FilterDesign.cheby2(3, 30.0, 20.0, "highpass", "sos", 100.0),
    "filter_ellip": signal.FilterDesign.ellip(3, 1.0, 40.0, (10, 30), "bandstop", "sos", 100.0),
    "filter_bessel": signal.FilterDesign.bessel(3, 20.0, "lowpass", "ba", 100.0),
}
for _name, _design in _DESIGNS.items():
    _trial(_name, lambda d=_design: [signal.Filter("x", d, "y")], _filtered(q.filtered("t", "f", _sections(_design))))
_TWICE, _TWICE_SOS = signal.FilterDesign.butter(2, 20.0, fs=100.0), signal.FilterDesign.butter(2, 20.0, "lowpass", "sos", 100.0)
_trial("filtfilt", lambda: [signal.FiltFilt("x", _TWICE, "y")], _filtered(q.there_and_back("t", "f", _sections(_TWICE), SAMPLES, 9)))
_trial("filtfilt_sos", lambda: [signal.FiltFilt("x", _TWICE_SOS, "y")], _filtered(q.there_and_back("t", "f", _sections(_TWICE_SOS), SAMPLES, 9)))
# Doubling keeps every frequency below Nyquist; SQL writes the interpolation out as a sum over sines.
_trial("resample", lambda: [signal.Resample("x", 2, "y")], f""", f as (select trial_id, ch, k, sum(v * cos(2 * pi() * k * s / {SAMPLES})) as re, -sum(v * sin(2 * pi() * k * s / {SAMPLES})) as im
    from t cross join range({SAMPLES // 2 + 1}) as r(k) group by all)
  select trial_id, (ch * {2 * SAMPLES} + u)::int as pos, round(sum(case when k = 0 or k = {SAMPLES // 2} then 1 else 2 end * (re * cos(2 * pi() * k * u / {2 * SAMPLES}) - im * sin(2 * pi() * k * u / {2 * SAMPLES}))) / {SAMPLES}, 6) + 0.0 as v
  from f cross join range({2 * SAMPLES}) as q(u) group by trial_id, ch, u""")


# ---- fitted on all trials and run on them ----


def _fitted(name: str, make: Callable[[], list], sql: str | None, output: str = "y") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        trials = embedding_trials(spark, sf_dir)
        return elements(Plan(make()).fit(trials, [output]).transform(trials), output)

    query(f"with recursive {LONG}{sql}" if sql else None, name)(run)


_STATS = """, f as (select ch, s, min(v) as lo, max(v) as hi, avg(v) as m, stddev_pop(v) as d from t group by ch, s)"""
_fitted("zscore", lambda: [features.ZScore("x", "y")], f""" select trial_id, (ch * {SAMPLES} + s)::int as pos, round((v - avg(v) over ()) / stddev_samp(v) over (), 6) + 0.0 as v from t""")
for _method, _value in (("min-max", "(v - lo) / (hi - lo)"), ("mean-norm", "(v - m) / (hi - lo)"), ("zscore-norm", "(v - m) / d")):
    _fitted("normalize_" + _method.replace("-", "_"), lambda m=_method: [features.FeatureNormalization("x", "y", m)],
            f"{_STATS} select trial_id, (t.ch * {SAMPLES} + t.s)::int as pos, round({_value}, 6) + 0.0 as v from t join f on t.ch = f.ch and t.s = f.s")
_fitted("feature_selection", lambda: [features.FeatureSelection("x", "y", 5)], f""", g as (select ch * {SAMPLES} + s as i, label, count(*) as n, sum(v) as s1, sum(v * v) as s2 from t where label is not null group by all),
  f as (select i, ((sum(s1 * s1 / n) - sum(s1) * sum(s1) / sum(n)) / (count(*) - 1)) / ((sum(s2) - sum(s1 * s1 / n)) / (sum(n) - count(*))) as f from g group by i),
  k as (select i, row_number() over (order by i) - 1 as pos from (select i from f order by f desc, i limit 5))
  select trial_id, pos::int as pos, round(v, 6) + 0.0 as v from t join k on k.i = t.ch * {SAMPLES} + t.s""")
_fitted("csp", lambda: [_two_classes(), features.Csp("_classes", "y", 2)], None)
_fitted("xdawn_covariance", lambda: [features.XDawnCovariance("x", "y", 2, n_classes=10)], None)
_COV = lambda: reduce.Covariance("x", "cov", 0.01)
_fitted("riemann_mdm", lambda: [_COV(), riemann.RiemannMdm("cov", "y")], None)
_fitted("riemann_potato", lambda: [_COV(), riemann.RiemannPotato("cov", "y", 2.0)], None)
_fitted("tangent_space", lambda: [_COV(), riemann.TangentSpace("cov", "y", 0.01)], None)
_fitted("adaptive_rebias", lambda: [_COV(), riemann.AdaptiveRebiasFit("cov", "y", "trial_id", by=("label",))], None)
_fitted("classifier_lda", lambda: [shape.Reshape("x", "f", (-1,)), classify.Classifier("f", "y", classify.lda("lsqr"))], None)
_fitted("classifier_lda_shrinkage", lambda: [shape.Reshape("x", "f", (-1,)), classify.Classifier("f", "y", classify.lda("lsqr", "auto"))], None)
_fitted("classifier_svm", lambda: [shape.Reshape("x", "f", (-1,)), classify.Classifier("f", "y", classify.svm())], None)
_fitted("classifier_logistic", lambda: [reduce.Mean("x", "f", axis=1), classify.Classifier("f", "y", classify.logistic_regression())], None)
_CENTROIDS = """, m as (select trial_id, any_value(label) as label, ch, avg(v) as v from t group by trial_id, ch),
  c as (select label, ch, avg(v) as v from m where label is not null group by label, ch),
  d as (select m.trial_id, any_value(m.label) as label, c.label as guess, sum(pow(m.v - c.v, 2)) as d from m join c on m.ch = c.ch group by m.trial_id, c.label),
  p as (select trial_id, any_value(label) as label, arg_min(guess, d)::double as y from d group by trial_id)"""
_fitted("classifier_custom", lambda: [reduce.Mean("x", "f", axis=1), classify.Classifier("f", "y", NearestCentroid())], f"{_CENTROIDS} select trial_id, round(y, 6) + 0.0 as v from p")
_fitted("pattern_state", lambda: [_COV(), classify.PatternState("cov", "y", k_selection="fixed", n_clusters=3)], None)
_fitted("multi_potato", lambda: [_COV(), classify.MultiPotatoFit("cov", "y", 2)], None)
# two matrices of two channels: A # B = sqrt(ab) (A / a + B / b) / sqrt(det(A / a + B / b)) with a = sqrt(det A), b = sqrt(det B)
_SETS = f""", c as (select a.trial_id, a.ch // 2 as k, a.ch % 2 as i, b.ch % 2 as j, (covar_samp(a.v, b.v) + case when a.ch = b.ch then 0.05 else 0 end) / 1.05 as v
    from t a join t b on a.trial_id = b.trial_id and a.ch // 2 = b.ch // 2 and a.s = b.s group by a.trial_id, a.ch, b.ch),
  m as (select trial_id, k, max(case when i = 0 and j = 0 then v end) as a, max(case when i = 0 and j = 1 then v end) as b, max(case when i = 1 and j = 1 then v end) as c from c group by trial_id, k),
  p as (select u.trial_id, u.a as a0, u.b as b0, u.c as c0, w.a as a1, w.b as b1, w.c as c1, sqrt(u.a * u.c - u.b * u.b) as d0, sqrt(w.a * w.c - w.b * w.b) as d1
    from m u join m w on u.trial_id = w.trial_id and u.k = 0 and w.k = 1)"""
_trial("riemann_mean", lambda: [shape.Reshape("x", "sets", (2, 2, SAMPLES)), reduce.Covariance("sets", "covs", 0.05), riemann.RiemannMean("covs", "y")],
       f"""{_SETS}, g as (select trial_id, d0, d1, a0 / d0 + a1 / d1 as a, b0 / d0 + b1 / d1 as b, c0 / d0 + c1 / d1 as c from p),
  n as (select trial_id, [a, b, b, c] as e, sqrt(d0 * d1 / (a * c - b * b)) as f from g)
  select trial_id, r.i::int as pos, round(e[r.i + 1] * f, 6) + 0.0 as v from n cross join range(4) as r(i)""")
_trial("riemann_distance", lambda: [shape.Reshape("x", "sets", (2, 2, SAMPLES)), reduce.Covariance("sets", "covs", 0.05), shape.Extract("covs", ([1], None, None), "one"), riemann.RiemannDistance("covs", "one", "y")],
       f"""{_SETS} select trial_id, r.i::int as pos, round(case r.i when 0 then sqrt({q.squared_distance(("a1", "b1", "c1"), ("a0", "b0", "c0"))}) else 0 end, 6) + 0.0 as v from p cross join range(2) as r(i)""")


class NearestCentroid:
    """A learner of a user's own: the class whose mean is nearest."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> NearestCentroid:
        self.classes = np.unique(y)
        self.means = np.stack([x[y == c].mean(axis=0) for c in self.classes])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[((x[:, None] - self.means) ** 2).sum(-1).argmin(1)]


class _TwoClasses(Operator):
    """Labels 0 and 1 for the lower and upper half of labels; tensors stay."""

    inputs, output = ("x",), "_classes"

    def infer(self, a):
        return a

    def apply(self, trials: Trials) -> Trials:
        return Trials(trials.df.withColumn("label", (F.col("label") >= 5).cast("int")).withColumn("_classes", F.col("x")), {**trials.shapes, "_classes": trials.shape("x")}, trials.id, trials.label)


def _two_classes() -> Operator:
    return _TwoClasses()


@query("""with r as (select vec_id as trial_id, label, (row_number() over (partition by label order by vec_id) - 1) % 5 as f from embeddings)
  select trial_id, label, f::int as fold from r""")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified folds."""
    return classify.stratified_folds(embedding_trials(spark, sf_dir).df, "label", "trial_id", 5).select("trial_id", "label", "fold")


@query()
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of minimum distance to mean in each of three folds."""
    cv = classify.CrossValidation(lambda: Plan([reduce.Covariance("x", "cov", 0.01), riemann.RiemannMdm("cov", "y")]), "y", folds=3)
    cv.run(embedding_trials(spark, sf_dir))
    return spark.createDataFrame([(i, s) for i, s in enumerate(cv.scores)], "fold int, accuracy double")


# ---- recordings and markers: events ----


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.array("value").alias("values"), "event_id", "event_type", "props")


@query("""with n as (select *, row_number() over (partition by user_id order by ts) as n from events)
  select m.event_id, (s.n - m.n)::int as pos, round(s.value, 6) + 0.0 as v from n m join n s on s.user_id = m.user_id and s.n >= m.n and s.n < m.n + 5
  where m.event_type = 'purchase' and exists (select 1 from n e where e.user_id = m.user_id and e.n = m.n + 4)""")
def marker_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five samples from each purchase on."""
    sig = _signal(spark, sf_dir)
    cut = streams.epochs(sig.select("recording", "ts", "values"), sig.filter("event_type = 'purchase'").select("recording", "ts", "event_id"), 5, keep=("event_id",))
    return spread(cut, "data", "event_id").select("event_id", "pos", rounded(F.col("v")).alias("v"))


def _json_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    target = F.when(F.col("event_type") == "signup", F.concat(F.lit('{"target": '), k % 5, F.lit("}")))
    flash = F.when(F.col("event_type") == "click", F.concat(F.lit('{"flash": ['), k % 5, F.lit(", "), (k + 1) % 5, F.lit("]}")))
    return _signal(spark, sf_dir).select("recording", "ts", "event_id", F.coalesce(target, flash).alias("marker")).filter("marker is not null")


@query("""with m as (select event_id, user_id, ts, event_type, (props->>'$.k')::int as k from events where event_type in ('signup', 'click')),
  l as (select *, last_value(case when event_type = 'signup' then k % 5 end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row) as target from m)
  select event_id, case when target in (k % 5, (k + 1) % 5) then 'target' else 'non-target' end as label from l where event_type = 'click' and target is not null""")
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which flashes hold the last target."""
    return streams.target_labels(_json_markers(spark, sf_dir)).select("event_id", "label")


@query("""select event_id, event_type from (select *, row_number() over (partition by event_type order by ts, event_id) as n from events) where n = 7""")
def poll_nth_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventh event of each type."""
    return streams.nth_of_class(_signal(spark, sf_dir), 7, "event_type", ("ts", "event_id")).select("event_id", "event_type")


@query("""select event_id, case event_type when 'view' then 0 else 1 end as label from events where event_type in ('view', 'error') and regexp_matches(event_type, '^(?:vi|er)')""")
def task_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of two tasks that match a pattern from their start."""
    marked = streams.task_markers(_signal(spark, sf_dir).withColumnRenamed("event_type", "marker"), ["view", "error"])
    return streams.matching_markers(marked, "vi|er").select("event_id", "label")


@query("""with n as (select *, row_number() over (partition by user_id order by ts) - 1 as n from events), w as (select user_id, (n // 8) as w, n % 8 as p, value, count(*) over (partition by user_id, n // 8) as size from n)
  select user_id as recording, w::bigint as "window", p::int as pos, round(value, 6) + 0.0 as v from w where size = 8""")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight successive samples."""
    cut = streams.count_windows(_signal(spark, sf_dir).select("recording", "ts", "values"), 8)
    return spread(cut, "data", "recording", "window").select("recording", "window", "pos", rounded(F.col("v")).alias("v"))


def _event_trials(spark: SparkSession, sf_dir: str) -> Trials:
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("trial_id"), "user_id", "ts", F.array("value", F.col("value") * 2).alias("x"), (F.col("event_type") == "click").cast("double").alias("flag"))
    return Trials(df, {"x": (2,), "flag": ()}, label=None)


_AVERAGE = "select event_id as trial_id, k::int as pos, round(avg(value * (k + 1)) over (partition by user_id, k order by ts rows 4 preceding), 6) + 0.0 as v from events cross join range(2) as r(k)"


@query(_AVERAGE)
def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last five trials of each recording."""
    return elements(shape.RunningAverage("x", "y", 5, "ts", ("user_id",)).apply(_event_trials(spark, sf_dir)), "y")


@query("""with r as (select event_id, user_id, ts, value, row_number() over (partition by user_id order by ts) as n from events)
  select a.event_id as trial_id, count(*) as held, round(sum(b.value), 6) + 0.0 as total, round(arg_min(b.value, b.n), 6) + 0.0 as oldest from r a join r b on a.user_id = b.user_id and b.n <= a.n and b.n > a.n - 4 group by a.event_id""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of four holds at each trial."""
    held = shape.Enqueue("x", "y", 4, "ts", ("user_id",)).apply(_event_trials(spark, sf_dir)).df
    return _held(held)


@query("""with r as (select event_id, user_id, ts, value, event_type = 'click' as flag, count(*) filter (event_type = 'click') over (partition by user_id order by ts rows unbounded preceding) as n from events)
  select a.event_id as trial_id, count(b.value) as held, round(coalesce(sum(b.value), 0), 6) + 0.0 as total, round(arg_min(b.value, b.n), 6) + 0.0 as oldest from r a left join r b on a.user_id = b.user_id and b.flag and b.n <= a.n and b.n > a.n - 4 group by a.event_id""")
def gated_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of four holds into which only clicks are pushed."""
    return _held(shape.Enqueue("x", "y", 4, "ts", ("user_id",), "flag").apply(_event_trials(spark, sf_dir)).df)


def _held(df: DataFrame) -> DataFrame:
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0)))
    return df.select("trial_id", F.size("y").cast("long").alias("held"), rounded(total).alias("total"), rounded(F.get(F.get("y", F.lit(0)), F.lit(0))).alias("oldest"))


# ---- streams: the same results from Structured Streaming ----


def streamed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """All rows that a streaming query over a table gives when it has read what is there."""
    out = shared_path(spark, tag)
    file = f"{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{file}")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    # a stream reads folders; a table that is one file is picked from the folder around it
    stream = reader.parquet(f"{sf_dir}/{file}") if folder else reader.option("pathGlobFilter", file).parquet(sf_dir)
    started = streaming.to_sink(build(stream), lambda df, n: df.write.mode("append").parquet(f"{out}/rows"), f"{out}/state", once=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(_AVERAGE)
def stream_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``running_average``, with state in the state store."""

    def build(events: DataFrame) -> DataFrame:
        trials = events.select(F.col("event_id").alias("trial_id"), "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.array("value", F.col("value") * 2).alias("x"))
        return streaming.running_average(trials, "x", 5, "user_id", "at", "y").select("trial_id", F.posexplode("y").alias("pos", "v"))

    return streamed(spark, sf_dir, "events", build, "stream-average").select("trial_id", "pos", rounded(F.col("v")).alias("v"))


@query("""with n as (select *, row_number() over (partition by user_id order by ts) as n from events)
  select m.user_id::varchar as recording, m.event_id, (s.n - m.n)::int as pos, round(s.value, 6) + 0.0 as v from n m join n s on s.user_id = m.user_id and s.n >= m.n and s.n < m.n + 3
  where m.event_type = 'error' and exists (select 1 from n e where e.user_id = m.user_id and e.n = m.n + 2)""")
def stream_marker_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples from each error on, from a stream of samples and markers."""

    def build(events: DataFrame) -> DataFrame:
        at, recording = F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("user_id").cast("string").alias("recording")
        samples = events.select(recording, at, F.array("value").alias("values"), F.lit(None).cast("string").alias("marker"))
        markers = events.select(recording, at, F.lit(None).cast("array<double>").alias("values"), F.concat_ws(":", "event_type", "event_id").alias("marker"))
        return streaming.marker_windows(samples.unionByName(markers), 3, "error", keep_seconds=1e9)

    done = streamed(spark, sf_dir, "events", build, "stream-windows")
    return done.select("recording", F.split("marker", ":")[1].cast("long").alias("event_id"), F.posexplode("data").alias("pos", "v")).select("recording", "event_id", "pos", rounded(F.col("v")).alias("v"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from kymo.plans import catalog_more  # noqa: E402, F401  registers its queries
