"""More queries of the catalog: geometry and classifiers where SQL has closed forms, files, sinks, and operators' options.

``x`` taken as 2 channels of 32 samples has covariances of 2 x 2, whose functions SQL writes out (see ``kymo.plans.sql``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kymo.operators import classify, elementwise, features, reduce, riemann, shape
from kymo.operators.base import BatchOperator, Shape, Trials
from kymo.plans import sql as q
from kymo.plans.catalog import CHANNELS, LONG, SAMPLES, NearestCentroid, _CENTROIDS, _fitted, _json_markers, _out, _PADDED, _signal, _STATS, _trial, _two_classes, elements, embedding_trials, query, rounded, spread, streamed, table
from kymo.plans.pipeline import FittedPlan, Plan
from kymo.session import shared_path, stored
from kymo.sources import streams, xdf, xdf_source
from kymo.streaming import live
from kymo.streaming import operators as streaming

# ---- padding, moments and other options ----

_AT = f"least(greatest(p - 2, 0), {SAMPLES - 1})"
for _mode, _place in (("symmetric", f"case when p < 2 then 1 - p when p < {SAMPLES + 2} then p - 2 else {2 * SAMPLES + 1} - p end"), ("wrap", f"(p - 2 + {SAMPLES}) % {SAMPLES}")):
    _trial(f"pad_{_mode}", lambda m=_mode: [shape.Pad("x", "y", ((0, 0), (2, 3)), m)],
           f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(t.v, 6) + 0.0 as v {_PADDED} join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = {_place}")
for _mode, _value in (("maximum", "max(v)"), ("minimum", "min(v)"), ("median", "median(v)")):
    _trial(f"pad_{_mode}", lambda m=_mode: [shape.Pad("x", "y", ((0, 0), (2, 3)), m)],
           f"select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(coalesce(t.v, m.v), 6) + 0.0 as v {_PADDED} join (select trial_id, ch, {_value} as v from t group by all) m on m.trial_id = i.trial_id and m.ch = c.ch left join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = p - 2")
_trial("pad_linear_ramp", lambda: [shape.Pad("x", "y", ((0, 0), (2, 3)), "linear_ramp", end_values=2.0)],
       f"""select i.trial_id, (c.ch * {SAMPLES + 5} + p)::int as pos, round(t.v + (2.0 - t.v) * case when p < 2 then (2 - p) / 2.0 when p < {SAMPLES + 2} then 0 else (p - {SAMPLES + 1}) / 3.0 end, 6) + 0.0 as v
  {_PADDED} join t on t.trial_id = i.trial_id and t.ch = c.ch and t.s = {_AT}""")
_trial("kurtosis_unbiased", lambda: [reduce.Kurtosis("x", "y", axis=1, bias=False)], f"select trial_id, ch::int as pos, {_out('kurtosis(v)')} from t group by trial_id, ch")
_trial("kurtosis_pearson", lambda: [reduce.Kurtosis("x", "y", axis=1, fisher=False)], f"select trial_id, ch::int as pos, {_out('kurtosis_pop(v) + 3')} from t group by trial_id, ch")
_trial("skewness_unbiased", lambda: [reduce.Skewness("x", "y", axis=1, bias=False)], f"select trial_id, ch::int as pos, {_out('skewness(v)')} from t group by trial_id, ch")
_trial("kurtosis_omit_nan", lambda: [elementwise.Log("x", "l"), reduce.Kurtosis("l", "y", nan_policy="omit")], f"select trial_id, {_out('kurtosis_pop(ln(v))')} from t where v > 0 group by trial_id")
_trial("skewness_omit_nan", lambda: [elementwise.Log("x", "l"), reduce.Skewness("l", "y", bias=False, nan_policy="omit")], f"select trial_id, {_out('skewness(ln(v))')} from t where v > 0 group by trial_id")
_trial("extract_reduced", lambda: [shape.Extract("x", (2, None), "y", reduce_dims=True)], "select trial_id, s::int as pos, round(v, 6) + 0.0 as v from t where ch = 2")
_trial("mean_keepdims", lambda: [reduce.Mean("x", "m", axis=1, keepdims=True), elementwise.Subtract("x", "m", "y")],
       f"select trial_id, (ch * {SAMPLES} + s)::int as pos, {_out('v - avg(v) over (partition by trial_id, ch)')} from t")
_trial("moves_in_a_row", lambda: [shape.Epoch("x", "e", 8, 4), shape.Transpose("e", "a", (1, 2, 0)), shape.Reshape("a", "r", (6, -1)), shape.Transpose("r", "b"), reduce.Std("b", "y", axis=0)],
       f"""select trial_id, (w * 2 + (s - 4 * w) // 4)::int as pos, {_out('stddev_pop(v)')} from t cross join range(3) as r(w) where s >= 4 * w and s < 4 * w + 8 group by trial_id, w, (s - 4 * w) // 4""")

# ---- two channels: geometry and classifiers in closed form ----

_TWO = lambda: shape.Reshape("x", "two", (2, 2 * SAMPLES))
_PAIR = lambda: [_TWO(), reduce.Covariance("two", "cov", 0.01)]
_COVS = f""", h as (select trial_id, label, ch // 2 as i, ch % 2 * {SAMPLES} + s as s, v from t),
  cov as (select a.trial_id, any_value(a.label) as label, (var_samp(a.v) + 0.01) / 1.01 as a, covar_samp(a.v, b.v) / 1.01 as b, (var_samp(b.v) + 0.01) / 1.01 as c
    from h a join h b on a.trial_id = b.trial_id and a.s = b.s and a.i = 0 and b.i = 1 group by a.trial_id)"""
_X, _M = ("x.a", "x.b", "x.c"), ("m.a", "m.b", "m.c")
_fitted("riemann_mdm_2x2", lambda: [*_PAIR(), riemann.RiemannMdm("cov", "y")], f"""{_COVS}, s as (select label as g, a, b, c from cov where label is not null), {q.karcher("s", "m")},
  d as (select x.trial_id, m.g, {q.squared_distance(_M, _X)} as d from cov x cross join m)
  select trial_id, round(arg_min(g, d)::double, 6) + 0.0 as v from d group by trial_id""")
_REGULAR = "select 0 as g, 0.99 * a + 0.01 as a, 0.99 * b as b, 0.99 * c + 0.01 as c"


def _tangent(reference: str) -> str:
    """SQL of tangent vectors of s at the one matrix of a CTE."""
    return f"""w as (select {q.named(q.function_of(('a', 'b', 'c'), q.INVERSE_ROOT), 'wa wb wc')} from {reference}),
  z as (select trial_id, {q.named(q.about(('wa', 'wb', 'wc'), ('a', 'b', 'c')), 'xa xb xc')} from s cross join w),
  l as (select trial_id, {q.named(q.function_of(('xa', 'xb', 'xc'), q.LOG), 'la lb lc')} from z)
  select trial_id, r.i::int as pos, round([la, sqrt(2) * lb, lc][r.i + 1], 6) + 0.0 as v from l cross join range(3) as r(i)"""


_fitted("tangent_space_2x2", lambda: [*_PAIR(), riemann.TangentSpace("cov", "y", 0.01)], f"{_COVS}, s as ({_REGULAR}, trial_id from cov), {q.karcher('s', 'm')}, {_tangent('m')}")
_fitted("tangent_space_euclid", lambda: [*_PAIR(), riemann.TangentSpace("cov", "y", metric="euclid")], f"{_COVS}, s as (select 0 as g, a, b, c, trial_id from cov), m as (select avg(a) as a, avg(b) as b, avg(c) as c from s), {_tangent('m')}")
_fitted("tangent_space_logeuclid", lambda: [*_PAIR(), riemann.TangentSpace("cov", "y", metric="logeuclid")], f"""{_COVS}, s as (select 0 as g, a, b, c, trial_id from cov),
  e as (select {q.named(q.function_of(('a', 'b', 'c'), q.LOG), 'a b c')} from s), f as (select avg(a) as a, avg(b) as b, avg(c) as c from e),
  m as (select {q.named(q.function_of(('a', 'b', 'c'), q.EXP), 'a b c')} from f), {_tangent('m')}""")
_fitted("riemann_potato_2x2", lambda: [*_PAIR(), riemann.RiemannPotato("cov", "y", 1.5, max_iter=1)], f"""{_COVS}, s as ({_REGULAR}, trial_id from cov), {q.karcher("s", "m")},
  d as (select x.trial_id, ln({q.squared_distance(_M, _X)}) / 2 as d from s x cross join m)
  select trial_id, case when (d - avg(d) over ()) / stddev_pop(d) over () < 1.5 then 1.0 else 0.0 end::double as v from d""")
_NEXT = q.about(("ra", "rb", "rc"), q.function_of(("xa", "xb", "xc"), "pow({}, 0.1)"))
_fitted("adaptive_rebias_2x2", lambda: [*_PAIR(), riemann.AdaptiveRebiasFit("cov", "y", "trial_id", by=("label",))], f"""{_COVS}, s as (select 0 as g, a, b, c from cov), {q.karcher("s", "m")},
  o as (select *, row_number() over (partition by label order by trial_id) as n from cov),
  b as (
    select l.label, 0::bigint as n, -1::bigint as trial_id, m.a, m.b, m.c, 0.0::double as xa, 0.0::double as xb, 0.0::double as xc from (select distinct label from cov) l cross join m
    union all
    select label, n, trial_id, {q.named(_NEXT, 'a b c')}, xa, xb, xc from (
      select label, n, trial_id, ra, rb, rc, {q.named(q.about(('wa', 'wb', 'wc'), ('pa', 'pb', 'pc')), 'xa xb xc')} from (
        select b.label, o.n, o.trial_id, o.a as pa, o.b as pb, o.c as pc, {q.named(q.function_of(('b.a', 'b.b', 'b.c'), q.ROOT), 'ra rb rc')}, {q.named(q.function_of(('b.a', 'b.b', 'b.c'), q.INVERSE_ROOT), 'wa wb wc')}
        from b join o on o.label is not distinct from b.label and o.n = b.n + 1)))
  select trial_id, r.i::int as pos, round([xa, xb, xb, xc][r.i + 1], 6) + 0.0 as v from b cross join range(4) as r(i) where n > 0""")

# Filters w with (C0 - l (C0 + C1)) w = 0 and w' (C0 + C1) w = 1, by how far l is from 1/2.
_fitted("csp_two_channels", lambda: [_two_classes(), shape.Reshape("_classes", "two", (2, 2 * SAMPLES)), features.Csp("two", "y", 2)], f""", h as (select trial_id, (label >= 5)::int as k, ch // 2 as i, ch % 2 * {SAMPLES} + s as s, v from t),
  p as (select a.trial_id, a.k, a.s, a.v as u, b.v as v from h a join h b on a.trial_id = b.trial_id and a.s = b.s and a.i = 0 and b.i = 1),
  c as (select k, var_samp(u) as a, covar_samp(u, v) as b, var_samp(v) as c from p where k is not null group by k),
  e as (select z.a as a, z.b as b, z.c as c, z.a + o.a as p, z.b + o.b as q, z.c + o.c as r from c z join c o on z.k = 0 and o.k = 1),
  d as (select *, p * r - q * q as aa, -(a * r + c * p - 2 * b * q) as bb, a * c - b * b as cc from e),
  l as (select *, (-bb + sign * sqrt(bb * bb - 4 * aa * cc)) / (2 * aa) as l from d cross join (values (1), (-1)) as g(sign)),
  w as (select *, -(b - l * q) as w0, a - l * p as w1 from l),
  n as (select l, case when abs(w0) >= abs(w1) then sign(w0) else sign(w1) end / sqrt(w0 * w0 * p + 2 * w0 * w1 * q + w1 * w1 * r) as f, w0, w1 from w),
  f as (select *, row_number() over (order by abs(l - 0.5) desc, l) - 1 as row from n)
  select x.trial_id, (f.row * {2 * SAMPLES} + x.s)::int as pos, round(f.f * (f.w0 * x.u + f.w1 * x.v), 6) + 0.0 as v from p x cross join f""")

_MEANS = f""", m as (select trial_id, any_value(label) as label, avg(case when ch < 2 then v end) as u, avg(case when ch >= 2 then v end) as w from t group by trial_id),
  k as (select label, count(*) as n, avg(u) as u, avg(w) as w, var_pop(u) as a, covar_pop(u, w) as b, var_pop(w) as c from m where label is not null group by label)"""
_DISCRIMINANT = """p as (select sum(n * a) / sum(n) as a, sum(n * b) / sum(n) as b, sum(n * c) / sum(n) as c, sum(n) as n from {}),
  f as (select k.label, (p.c * k.u - p.b * k.w) / (p.a * p.c - p.b * p.b) as f, (p.a * k.w - p.b * k.u) / (p.a * p.c - p.b * p.b) as g, k.u, k.w, ln(k.n / p.n) as prior from k cross join p),
  s as (select m.trial_id, f.label, m.u * f.f + m.w * f.g - (f.u * f.f + f.w * f.g) / 2 + f.prior as s from m cross join f)
  select trial_id, round(arg_max(label, s)::double, 6) + 0.0 as v from s group by trial_id"""
_plane = lambda learner: [_TWO(), reduce.Mean("two", "f", axis=1), classify.Classifier("f", "y", learner)]
_fitted("classifier_lda_plane", lambda: _plane(classify.lda("lsqr")), f"{_MEANS}, {_DISCRIMINANT.format('k')}")
_fitted("classifier_lda_shrinkage_plane", lambda: _plane(classify.lda("lsqr", "auto")), f"""{_MEANS},
  z as (select m.label, (m.u - k.u) / sqrt(k.a) as u, (m.w - k.w) / sqrt(k.c) as w from m join k on m.label = k.label),
  i as (select label, avg(u * w) as r, avg(pow(u * u + w * w, 2)) as four, count(*) as n from z group by label),
  d as (select label, least(greatest((four - (2 + 2 * r * r)) / (n * 2), 0), r * r) / (r * r) as d from i),
  shrunk as (select k.label, k.n, k.a, (1 - d.d) * k.b as b, k.c from k join d on k.label = d.label), {_DISCRIMINANT.format('shrunk')}""")


def _logistic_sql(weight: str, c: float) -> str:
    """SQL of binary logistic regression on one feature by Newton's steps: with both classes' weights penalised, v^2 / (4 C)."""
    return f""", m as (select trial_id, (any_value(label) >= 5)::int as y, avg(v) as x from t group by trial_id),
  k as (select *, {weight} as w from m where y is not null),
  r as (
    select 0 as n, 0.0::double as v, 0.0::double as b
    union all
    select n + 1, v - (hb * gv - hc * gb) / (hv * hb - hc * hc), b - (hv * gb - hc * gv) / (hv * hb - hc * hc) from (
      select n, v, b, sum(w * (p - y) * x) + v / {2 * c} as gv, sum(w * (p - y)) as gb, sum(w * p * (1 - p) * x * x) + 1 / {2 * c} as hv, sum(w * p * (1 - p)) as hb, sum(w * p * (1 - p) * x) as hc
      from (select r.n, r.v, r.b, k.x, k.y, k.w, 1 / (1 + exp(-(r.v * k.x + r.b))) as p from r cross join k where r.n < 25) group by n, v, b))
  select m.trial_id, i.i::int as pos, round(case i.i when 1 then 1 / (1 + exp(-(v * x + b))) else 1 / (1 + exp(v * x + b)) end, 6) + 0.0 as v from m cross join r cross join range(2) as i(i) where r.n = 25"""


_LINE = lambda **options: [_two_classes(), reduce.Mean("_classes", "f", keepdims=True), classify.Classifier("f", "p", classify.logistic_regression(**options), "y")]
for _name, _options, _weight in (("classifier_logistic_line", {"C": 0.5}, "1.0"), ("classifier_logistic_balanced", {"C": 0.5, "class_weight": "balanced"}, "count(*) over () / (2.0 * count(*) over (partition by y))")):
    def _run(spark: SparkSession, sf_dir: str, options: dict = _options) -> DataFrame:
        trials = embedding_trials(spark, sf_dir)
        return elements(Plan(_LINE(**options)).fit(trials, ["p"]).transform(trials), "y")

    query(f"with recursive {LONG}{_logistic_sql(_weight, 0.5)}", _name)(_run)


def _sparse_sql(c: float, ratio: float) -> str:
    """As ``_logistic_sql``, with (ratio |v| + (1 - ratio) v^2 / 4) / C: each step minimises the quadratic model with |v|, which is a move toward zero."""
    full = _logistic_sql("1.0", c)
    step = full[full.index("    select n + 1") : full.index("      select n, v, b, sum(")]
    sparse = f"""    select n + 1, v2, b - (gb + hc * (v2 - v)) / hb from (select *, sign(v1) * greatest(abs(v1) - {ratio / c} / h1, 0) as v2 from (
      select *, hv - hc * hc / hb as h1, v - (gv - hc * gb / hb) / (hv - hc * hc / hb) as v1 from (
"""
    smooth = (1 - ratio) / (2 * c)
    out = full.replace(step, sparse).replace(f"v / {2 * c} as gv", f"v * {smooth} as gv").replace(f"1 / {2 * c} as hv", f"{smooth} as hv")
    return out.replace("where r.n < 25) group by n, v, b))", "where r.n < 25) group by n, v, b))))")


for _name, _options, _ratio in (("classifier_logistic_l1_line", {"C": 20.0, "penalty": "l1"}, 1.0), ("classifier_logistic_elasticnet_line", {"C": 5.0, "penalty": "elasticnet", "l1_ratio": 0.4}, 0.4)):
    def _run(spark: SparkSession, sf_dir: str, options: dict = _options) -> DataFrame:
        trials = embedding_trials(spark, sf_dir)
        return elements(Plan(_LINE(**options)).fit(trials, ["p"]).transform(trials), "y")

    query(f"with recursive {LONG}{_sparse_sql(_options['C'], _ratio)}", _name)(_run)


@query(None)
def classifier_svm_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of support vector machines of all pairs of classes."""
    trials = embedding_trials(spark, sf_dir)
    stages = [shape.Reshape("x", "f", (-1,)), classify.Classifier("f", "p", classify.svm(probability=True), "y")]
    return elements(Plan(stages).fit(trials, ["p"]).transform(trials), "y")


# ---- metrics and model selection ----


@query(f"""with {LONG}{_CENTROIDS}, n as (select label::double as y, y as p, count(*) as n from p group by all),
  k as (select distinct y from n where y is not null),
  h as (select k.y, sum(case when n.y = k.y and n.p = k.y then n.n else 0 end) as hit, sum(case when n.p = k.y then n.n else 0 end) as said, sum(case when n.y = k.y then n.n else 0 end) as really from k cross join n group by k.y),
  e as (select case when said > 0 then hit / said else 0 end as pr, case when really > 0 then hit / really else 0 end as re from h)
  select statistic, round(v, 6) + 0.0 as v from (select 'accuracy' as statistic, sum(case when y = p then n else 0 end) / sum(n) as v from n where y is not null
    union all select 'precision', avg(pr) from e union all select 'recall', avg(re) from e union all select 'f1', avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end) from e)""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the nearest centroid's predictions, averaged over classes."""
    trials = embedding_trials(spark, sf_dir)
    df = Plan([reduce.Mean("x", "f", axis=1), classify.Classifier("f", "y", NearestCentroid())]).fit(trials, ["y"]).transform(trials).df.select("label", "y")
    found = [(s, classify.metric(df, "label", "y", s, average="macro")) for s in ("accuracy", "precision", "recall", "f1")]
    return spark.createDataFrame(found, "statistic string, v double").select("statistic", rounded(F.col("v")).alias("v"))


@query(f"""with recursive {LONG}{_logistic_sql("1.0", 0.5).split("  select m.trial_id")[0]}
  select round(avg(-ln(case y when 1 then 1 / (1 + exp(-(v * x + b))) else 1 / (1 + exp(v * x + b)) end)), 6) + 0.0 as v from m cross join r where r.n = 25 and y is not null""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean negative logarithm of the probability of the label."""
    trials = embedding_trials(spark, sf_dir)
    done = Plan(_LINE(C=0.5)).fit(trials, ["p"]).transform(trials)
    return spark.createDataFrame([(classify.metric(done.df.filter("label is not null"), "label", "p", "cross_entropy", "y"),)], "v double").select(rounded(F.col("v")).alias("v"))


@query(f"""with {LONG}, m as (select trial_id, any_value(label) as label, ch, avg(v) as v from t group by trial_id, ch),
  o as (select vec_id as trial_id, (row_number() over (partition by label order by vec_id) - 1) % 4 as fold from embeddings),
  c as (select k.fold, m.label, m.ch, avg(m.v) as v from m join o on m.trial_id = o.trial_id cross join range(4) as k(fold) where o.fold <> k.fold and m.label is not null group by all),
  d as (select m.trial_id, o.fold, any_value(m.label) as label, c.label as guess, sum(pow(m.v - c.v, 2)) as d from m join o on m.trial_id = o.trial_id join c on c.fold = o.fold and c.ch = m.ch group by m.trial_id, o.fold, c.label),
  p as (select trial_id, fold, any_value(label) as label, arg_min(guess, d) as y from d group by trial_id, fold)
  select fold::int as fold, round(avg((label = y)::int), 6) + 0.0 as accuracy from p where label is not null group by fold""")
def cross_validate_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest centroid in each of four folds."""
    cv = classify.CrossValidation(lambda: Plan([reduce.Mean("x", "f", axis=1), classify.Classifier("f", "y", NearestCentroid())]), "y", folds=4)
    cv.run(embedding_trials(spark, sf_dir))
    return spark.createDataFrame([(i, s) for i, s in enumerate(cv.scores)], "fold int, accuracy double").select("fold", rounded(F.col("accuracy")).alias("accuracy"))


# ---- sessions, files, sinks and streams ----


@query(f"with {LONG}{_STATS} select trial_id, (t.ch * {SAMPLES} + t.s)::int as pos, round((v - m) / d, 6) + 0.0 as v from t join f on t.ch = f.ch and t.s = f.s")
def saved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted plan that was written and read again."""
    trials, path = embedding_trials(spark, sf_dir), shared_path(spark, "plan")
    Plan([features.FeatureNormalization("x", "y")]).fit(trials, ["y"]).save(spark, path)
    return elements(FittedPlan.load(spark, path).transform(trials), "y")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a recording of samples and markers, written to XDF files and read from them, once for all uses of them."""
    path = shared_path(spark, "recordings")
    rows = _signal(spark, sf_dir)
    samples = rows.select("recording", "ts", "values", F.lit(None).cast("string").alias("marker"))
    said = rows.select("recording", "ts", F.lit(None).cast("array<double>").alias("values"), F.concat_ws(":", "event_type", "event_id").alias("marker"))
    xdf_source.register(spark)
    samples.unionByName(said).repartition("recording").sortWithinPartitions("recording", "ts").write.format("xdf").mode("append").save(path)
    return stored(xdf.read_xdf(spark, path).select("recording", "stream", "type", "ts", "values", "marker"), "samples")


@query("""with n as (select *, row_number() over (partition by user_id order by ts) as n from events)
  select m.event_id, (s.n - m.n)::int as pos, round(s.value, 6) + 0.0 as v from n m join n s on s.user_id = m.user_id and s.n >= m.n and s.n < m.n + 4
  where m.event_type = 'click' and exists (select 1 from n e where e.user_id = m.user_id and e.n = m.n + 3)""")
def xdf_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples from each click on, from XDF files of recordings."""
    signal, markers = xdf.signal_and_markers(_recordings(spark, sf_dir))
    cut = streams.epochs(signal, streams.matching_markers(markers, "click"), 4, keep=("marker",))
    return spread(cut, "data", "marker").select(F.split("marker", ":")[1].cast("long").alias("event_id"), "pos", rounded(F.col("v")).alias("v"))


@query("""with n as (select *, row_number() over (partition by user_id order by ts) - 1 as n from events),
  w as (select n.user_id, w.w, n.n - 3 * w.w as p, n.value, count(*) over (partition by n.user_id, w.w) as size from n cross join range((select max(n) // 3 + 1 from n)) as w(w) where n.n >= 3 * w.w and n.n < 3 * w.w + 6)
  select user_id::varchar as recording, w::bigint as "window", p::int as pos, round(value, 6) + 0.0 as v from w where size = 6""")
def xdf_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six samples every three, from XDF files of recordings."""
    signal, _ = xdf.signal_and_markers(_recordings(spark, sf_dir))
    cut = streams.count_windows(signal, 6, 3)
    return spread(cut, "data", "recording", "window").select("recording", "window", "pos", rounded(F.col("v")).alias("v"))


@query("""with f as (select user_id, min(epoch_us(ts::timestamp)) as first from events where event_type = 'signup' group by user_id),
  n as (select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.ts) as n, f.first from events e join f on f.user_id = e.user_id)
  select event_id, (row_number() over (order by first, user_id::varchar, n))::bigint as place from n""")
def xdf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each sample when recordings, read from XDF files, follow each other in the order of their first signups."""
    signal, markers = xdf.signal_and_markers(_recordings(spark, sf_dir))
    marked = markers.select("recording", "ts", F.split("marker", ":")[1].cast("long").alias("event_id"))
    ordered = streams.one_after_the_other(signal.join(marked, ["recording", "ts"]), streams.matching_markers(markers, "signup"))
    # places without one task for all rows: samples before each recording, and the place within it
    sizes = ordered.groupBy("recording", "first_marker").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("first_marker", "recording")) - F.col("count")).select("recording", "before")
    return ordered.join(before, "recording").select("event_id", (F.col("before") + F.row_number().over(Window.partitionBy("recording").orderBy("ts"))).cast("long").alias("place"))


# ---- one recording over all tasks ----


def _one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the samples of one recording, a second apart in the order of their ids; clicks are flagged."""
    return table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("recording"), F.col("event_id").cast("double").alias("ts"), F.array("value").alias("values"), (F.col("event_type") == "click").cast("double").alias("flag"))


def _one_buffer(spark: SparkSession, sf_dir: str) -> Trials:
    return Trials(_one_recording(spark, sf_dir).select(F.col("event_id").alias("trial_id"), "flag", F.col("values").alias("x")), {"x": (1,), "flag": ()}, label=None)


@query("select event_id as trial_id, 0 as pos, round(avg(value) over (order by event_id rows 99 preceding), 6) + 0.0 as v from events")
def long_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last hundred samples of one long recording."""
    return elements(shape.RunningAverage("x", "y", 100, "trial_id").apply(_one_buffer(spark, sf_dir)), "y")


@query("""with r as (select event_id, value, event_type = 'click' as flag, count(*) filter (event_type = 'click') over (order by event_id rows unbounded preceding) as n from events)
  select a.event_id as trial_id, count(b.value) as held, round(coalesce(sum(b.value), 0), 6) + 0.0 as total from r a left join r b on b.flag and b.n <= a.n and b.n > a.n - 20 group by a.event_id""")
def long_gated_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of twenty holds into which only clicks of one long recording are pushed."""
    held = shape.Enqueue("x", "y", 20, "trial_id", flag="flag").apply(_one_buffer(spark, sf_dir)).df
    return held.select("trial_id", F.size("y").cast("long").alias("held"), rounded(F.aggregate("y", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0)))).alias("total"))


@query("""with n as (select value, row_number() over (order by event_id) - 1 as n, count(*) over () as size from events),
  w as (select n.*, unnest(range(greatest(0, (n - 63 + 31) // 32), n // 32 + 1)) as w from n)
  select w::bigint as "window", (n - 32 * w)::int as pos, round(value, 6) + 0.0 as v from w where 32 * w + 64 <= size""")
def long_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 samples every 32 of one long recording."""
    cut = streams.count_windows(_one_recording(spark, sf_dir).select("recording", "ts", "values"), 64, 32, split=True)
    return spread(cut, "data", "window").select("window", "pos", rounded(F.col("v")).alias("v"))


@query("""with n as (select *, row_number() over (order by event_id) as n from events)
  select m.event_id, (s.n - m.n - 1)::int as pos, round(s.value, 6) + 0.0 as v from n m join n s on s.n > m.n and s.n <= m.n + 30
  where m.event_type = 'purchase' and exists (select 1 from n e where e.n = m.n + 30)""")
def long_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty samples from half a second behind each purchase of one long recording."""
    sig = _one_recording(spark, sf_dir)
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", F.lit("all").alias("recording"), F.col("event_id").cast("double").alias("ts"))
    cut = streams.epochs(sig.select("recording", "ts", "values"), bought, 30, 0.5, keep=("event_id",), split=True)
    return spread(cut, "data", "event_id").select("event_id", "pos", rounded(F.col("v")).alias("v"))


_LABELLED = """with m as (select event_id, user_id, ts, case event_type when 'signup' then '{"target": ' || ((props->>'$.k')::int % 5) || '}'
    when 'click' then '{"flash": [' || ((props->>'$.k')::int % 5) || ', ' || (((props->>'$.k')::int + 1) % 5) || ']}' end as marker, epoch(ts::timestamp) as tm from events)"""


@query(f"""{_LABELLED}, c as (select avg(tm) as tm from m where marker is not null), k as (select m.* from m cross join c where marker like '{{"target%' and m.tm <= c.tm)
  select user_id as recording, arg_max(marker, tm) as marker from k group by user_id""")
def last_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's last target up to the mean time."""
    markers = _json_markers(spark, sf_dir)
    at = markers.agg(F.avg("ts")).first()[0]
    return streams.last_marker(markers, at, '[{]"target').select("recording", "marker")


@query(f"""{_LABELLED}, c as (select avg(tm) as tm from m where marker is not null), k as (select m.* from m cross join c where marker is not null and m.tm > c.tm)
  select user_id as recording, arg_min(marker, tm) as marker from k group by user_id""")
def peeked_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's next marker after the mean time."""
    markers = _json_markers(spark, sf_dir)
    return streams.peek_marker(markers, markers.agg(F.avg("ts")).first()[0]).select("recording", "marker")


@query("""with n as (select *, row_number() over (partition by user_id order by ts desc) as back from events)
  select user_id::varchar as recording, (5 - back)::int as pos, round(value, 6) + 0.0 as v from n where back <= 5 and (select count(*) from events e where e.user_id = n.user_id) >= 5""")
def stream_latest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five samples of each recording's backlog, from a stream without markers."""

    def build(events: DataFrame) -> DataFrame:
        at = F.col("ts").cast("timestamp").cast("double").alias("ts")
        samples = events.select(F.col("user_id").cast("string").alias("recording"), at, F.array("value").alias("values"))
        return streaming.marker_windows(live.events(samples), 5)

    done = streamed(spark, sf_dir, "events", build, "stream-latest")
    return spread(done, "data", "recording").select("recording", "pos", rounded(F.col("v")).alias("v"))


@query("""with r as (select event_id, user_id, value, event_type = 'click' as flag, row_number() over (partition by user_id order by ts) as n, count(*) filter (event_type = 'click') over (partition by user_id order by ts rows unbounded preceding) as k from events)
  select a.event_id as trial_id, count(b.value) as held, round(coalesce(sum(b.value), 0), 6) + 0.0 as total from r a left join r b on a.user_id = b.user_id and b.flag and b.k <= a.k and b.k > a.k - 3 group by a.event_id""")
def stream_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of three holds into which only clicks are pushed, with state in the state store; a sink writes it to a folder."""

    def build(events: DataFrame) -> DataFrame:
        trials = events.select(F.col("event_id").alias("trial_id"), "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.array("value").alias("x"), (F.col("event_type") == "click").alias("flag"))
        return streaming.ring_buffer(trials, "x", 3, "user_id", "at", "y", "flag").select("trial_id", "y")

    held = streamed(spark, sf_dir, "events", build, "stream-buffer")
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0)))
    return held.select("trial_id", F.size("y").cast("long").alias("held"), rounded(total).alias("total"))


# ---- literals, parameters and operators of a user's own ----


@query(f"with {LONG} select trial_id, (ch * {SAMPLES} + s)::int as pos, round(v * 2.5 - 0.25, 6) + 0.0 as v from t")
def scalar_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials times one scalar, less another."""
    trials = embedding_trials(spark, sf_dir).with_column("a", F.lit(2.5), ()).with_column("b", F.lit(0.25), ())
    return elements(Plan([elementwise.Multiply("x", "a", "y"), elementwise.Subtract("y", "b", "z")]).transform(trials), "z")


@query(f"with {LONG} select trial_id, (ch * {SAMPLES} + s)::int as pos, round(v * (ch + 1) + s / 10.0, 6) + 0.0 as v from t")
def tensor_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials times a column of channels, plus a row of samples."""
    trials = embedding_trials(spark, sf_dir)
    trials = trials.with_column("w", F.lit([float(c + 1) for c in range(CHANNELS)]), (CHANNELS, 1)).with_column("o", F.lit([s / 10 for s in range(SAMPLES)]), (SAMPLES,))
    return elements(Plan([elementwise.Multiply("x", "w", "y"), elementwise.Add("y", "o", "z")]).transform(trials), "z")


@query(f"with {LONG} select trial_id, (ch * {SAMPLES} + s)::int as pos, (v > 0.05)::int::double as v from t")
def updated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan whose threshold was changed."""
    return elements(Plan([elementwise.Threshold("x", 1.0, "y")]).updated("y", threshold=0.05).transform(embedding_trials(spark, sf_dir)), "y")


class RunningTotal(BatchOperator):
    """An operator of a user's own: sums up to each sample."""

    def __init__(self, a: str, output: str):
        self.inputs, self.output = (a,), output

    def infer(self, a: Shape) -> Shape:
        return a

    def batch(self, a: np.ndarray) -> np.ndarray:
        return a.cumsum(axis=-1)


_trial("own_operator", lambda: [elementwise.Absolute("x", "a"), RunningTotal("a", "y")], f"select trial_id, (ch * {SAMPLES} + s)::int as pos, {_out('sum(abs(v)) over (partition by trial_id, ch order by s)')} from t")


@query("""with n as (select *, row_number() over (partition by user_id order by ts) as n from events)
  select m.event_id, case m.event_type when 'view' then 0 else 1 end as label, round(avg(s.value), 6) + 0.0 as v from n m join n s on s.user_id = m.user_id and s.n >= m.n and s.n < m.n + 3
  where m.event_type in ('view', 'error') group by m.event_id, m.event_type having count(*) = 3""")
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials of two tasks with numbers for labels, and their means."""
    sig = _signal(spark, sf_dir)
    marked = streams.task_markers(sig.withColumnRenamed("event_type", "marker"), ["view", "error"])
    trials = streams.as_trials(streams.epochs(sig.select("recording", "ts", "values"), marked.select("recording", "ts", "label", "event_id"), 3, keep=("label", "event_id")), 1, 3)
    done = Plan([reduce.Mean("data", "y")]).transform(trials).df
    return done.select("event_id", "label", rounded(F.col("y")).alias("v"))


@query("""with r as (select event_id, user_id, value, row_number() over (partition by user_id order by ts) as n from events)
  select a.event_id as trial_id, round(avg(b.value), 6) + 0.0 as v from r a join r b on a.user_id = b.user_id and b.n <= a.n and b.n > a.n - 4 group by a.event_id""")
def sink_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed averages as a sink leaves them in a folder of files."""
    out = shared_path(spark, "sink")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    stream = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    trials = stream.select(F.col("event_id").alias("trial_id"), "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.array("value").alias("x"))
    done = streaming.running_average(trials, "x", 4, "user_id", "at", "y").select("trial_id", "y")
    live.to_folder(done, f"{out}/rows", f"{out}/state", "parquet", once=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("trial_id", rounded(F.get("y", F.lit(0))).alias("v"))
