"""Registered queries of model selection and feature studies, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions import metrics, quantiles, resample, stats
from loadlens.operators import splits, windows
from loadlens.operators.features import FEATURES
from loadlens.operators.splits import fold_rows, usable
from loadlens.plans import base, evaluate, gates, policy, sensitivity, serving, temporal, trees, variants
from loadlens.plans.base import featured, folds, meter, predictions, register, repaired, table, theta_of
from loadlens.plans.queries import _ACT, _outcome
from loadlens.sources.io import materialize

S, D = SparkSession, str

#: Two outer windows of three days, each with two inner ones of two days; the first week only fills the lags.
NESTED = temporal.nested_windows("2024-01-08", ["2024-01-24", "2024-01-28"], outer_days=3, inner_days=2, cal_days=2, most=2, least_core=3)
ORDER = ["lag24", "lag168", "mean", "forest", "regime2", "regime3"]
_QS = ", ".join(repr(0.5 + (0.999 - 0.5) * i / 119) for i in range(120))
_ROLE = "CASE WHEN ts < core_end THEN 'core' WHEN ts >= cal_start AND ts < cal_end THEN 'calibration' WHEN ts >= eval_start AND ts < eval_end THEN 'evaluation' END"
_NESTED_SQL = (
    "WITH win(o, i, core_end, cal_start, cal_end, eval_start, eval_end) AS (VALUES "
    + ", ".join(f"({w.outer}, {w.inner}, " + ", ".join(f"TIMESTAMP '{dict(w.bounds)[k]}'" for k in ("core_end", "cal_start", "cal_end", "eval_start", "eval_end")) + ")" for w in NESTED)
    + f"""), r0 AS (SELECT o, i, {_ROLE} AS role, f.* FROM @feat f, win WHERE NOT is_warmup AND NOT is_outage AND NOT is_erp_missing AND {_ROLE} IS NOT NULL),
tt AS (SELECT o, i, quantile_cont(y_peak, 0.95) AS t, count(*) AS n_core FROM r0 WHERE role = 'core' GROUP BY 1, 2 HAVING count(*) >= {temporal.LEAST_CORE}),
p AS (SELECT r0.o, r0.i, role, t, n_core, site_id, ts, y_avg, (y_peak >= t)::INT AS c, m.model, m.a, m.p FROM r0 JOIN tt ON r0.o = tt.o AND r0.i = tt.i,
  LATERAL (SELECT unnest([{{'model': 'lag24', 'a': y_avg_lag24, 'p': y_peak_lag24}}, {{'model': 'lag168', 'a': y_avg_lag168, 'p': y_peak_lag168}}, {{'model': 'mean', 'a': (y_avg_lag24 + y_avg_lag168) / 2, 'p': (y_peak_lag24 + y_peak_lag168) / 2}}]) AS m) x WHERE role <> 'core'),
q AS (SELECT o, i, model, quantile_cont(p, [{_QS}]) AS v, sum(c) AS pos, count(*) - sum(c) AS neg, any_value(t) AS t FROM p WHERE role = 'calibration' GROUP BY 1, 2, 3),
cand AS (SELECT DISTINCT o, i, model, pos, round_even(x, 2) AS tau FROM (SELECT *, unnest(v) AS x FROM q)),
f AS (SELECT cand.o, cand.i, cand.model, tau, coalesce(2.0::DOUBLE * sum(CASE WHEN round(p.p, 9) >= tau THEN c ELSE 0 END) / nullif(sum((round(p.p, 9) >= tau)::INT) + cand.pos, 0), 0) AS f1
  FROM cand JOIN p ON p.o = cand.o AND p.i = cand.i AND p.model = cand.model AND role = 'calibration' GROUP BY cand.o, cand.i, cand.model, tau, cand.pos),
bt AS (SELECT o, i, model, arg_min(tau, (-round(f1, 12), tau)) AS tau FROM f GROUP BY 1, 2, 3),
tau AS (SELECT q.o, q.i, q.model, pos < {temporal.LEAST_POSITIVE} OR neg < {temporal.LEAST_NEGATIVE} AS fallback, CASE WHEN pos < {temporal.LEAST_POSITIVE} OR neg < {temporal.LEAST_NEGATIVE} THEN t ELSE bt.tau END AS tau, pos + neg AS n_cal FROM q JOIN bt USING (o, i, model)),
m AS (SELECT p.o, p.i, p.model, any_value(t) AS t, any_value(tau) AS tau, any_value(fallback) AS fallback, any_value(n_core) AS n_core, any_value(n_cal) AS n_cal, count(*) AS n, avg(abs(y_avg - a)) AS mae, avg(CASE WHEN c = 1 THEN abs(y_avg - a) END) AS peak_mae,
  count(*) FILTER (c = 1 AND p >= tau) AS tp, count(*) FILTER (c = 0 AND p >= tau) AS fp, count(*) FILTER (c = 1 AND p < tau) AS fn, count(*) FILTER (c = 0 AND p < tau) AS tn
  FROM p JOIN tau USING (o, i, model) WHERE role = 'evaluation' GROUP BY 1, 2, 3),
s AS (SELECT o, model, sum(mae * n) / sum(n) AS mae, sum(coalesce(peak_mae, 0) * (tp + fn)) / nullif(sum(tp + fn), 0) AS peak_mae, sum(tp) / nullif(sum(tp + fn), 0) AS recall, coalesce(stddev_samp(mae), 0) AS fold_std, count(*) AS k FROM m WHERE i > 0 GROUP BY 1, 2),
z AS (SELECT *, round({temporal.FEASIBLE} + """
    + " + ".join(f"{w} * CASE WHEN {c} IS NULL THEN 0 WHEN max({c}) OVER g = min({c}) OVER g THEN 1 ELSE {f'max({c}) OVER g - {c}' if less else f'{c} - min({c}) OVER g'} END / CASE WHEN {c} IS NULL OR max({c}) OVER g = min({c}) OVER g THEN 1 ELSE max({c}) OVER g - min({c}) OVER g END" for c, (w, less) in temporal.WEIGHTS.items())
    + """, 9) AS score FROM s WINDOW g AS (PARTITION BY o)),
ch AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, list_position(['lag24', 'lag168', 'mean'], model)) = 1 AS sel FROM z)
SELECT I(m.o) AS outer_window, m.model, sel AS selected, R(score) AS score, I(k) AS inner_folds, R(ch.mae) AS inner_mae, R(recall) AS inner_recall, R(fold_std) AS inner_fold_std, R(t) AS theta, R(tau) AS tau, fallback, I(n_core) AS n_core, I(n_cal) AS n_calibration, I(n) AS n, R(m.mae) AS mae, R(m.peak_mae) AS peak_mae, I(tp) AS tp, I(fp) AS fp, I(fn) AS fn, I(tn) AS tn
FROM m JOIN ch ON m.o = ch.o AND m.model = ch.model WHERE m.i = 0"""
)


def _naive() -> dict:
    a, p = [F.col(f"y_avg_lag{n}") for n in (24, 168)], [F.col(f"y_peak_lag{n}") for n in (24, 168)]
    return {"lag24": (a[0], p[0]), "lag168": (a[1], p[1]), "mean": ((a[0] + a[1]) / 2, (p[0] + p[1]) / 2)}


def _nested_rows(spark: S, sf: D) -> DataFrame:
    return materialize(temporal.in_windows(featured(spark, sf), NESTED), "nested-rows")


@register(_NESTED_SQL)
def nested_selection(spark: S, sf: D) -> DataFrame:
    """The choice among naive candidates for each outer window, by its inner windows, and what each gives on the outer one."""
    made = temporal.naive_candidates(_nested_rows(spark, sf), _naive())
    return temporal.nested_selection(made, ORDER).withColumnRenamed("outer", "outer_window")


@register()
def nested_selection_trees(spark: S, sf: D) -> DataFrame:
    """The same with forests and regime models besides, all fitted in one go; the counts of past peaks follow each window's own threshold."""
    rows = _nested_rows(spark, sf)
    own = materialize(temporal.recounted(rows, repaired(spark, sf)), "nested-recounted")
    made = temporal.naive_candidates(rows, _naive()).unionByName(temporal.tree_candidates(own, base.EDGES, trees=4, depth=4, share=0.5))
    return temporal.nested_selection(made, ORDER).withColumnRenamed("outer", "outer_window")


def _normal() -> Column:
    """Working weekdays."""
    return (F.col("is_shutdown") == 0) & (F.col("is_sat") == 0) & (F.col("is_sun") == 0)


@register()
def variant_study(spark: S, sf: D) -> DataFrame:
    """Errors, changes, limits and flags of 59 feature subsets and five runs with noise, over all folds."""
    feat, th = materialize(featured(spark, sf), "features"), theta_of(repaired(spark, sf))
    rows = materialize(variants.out_of_fold(feat, folds(spark), trees=4, depth=4, share=0.5), "variant-predictions")
    n = rows.select("day").distinct().count()
    return variants.judged(variants.summarized(rows, th, _normal()), variants.limits(rows, resample.day_draws(spark, n, 500, 42)))


@register()
def feature_attributions(spark: S, sf: D) -> DataFrame:
    """Shapley values of a forest of the mean power, trained before the test period and explained on all usable hours of it, as importance and direction.

    max_gap is the largest difference of a row's values from its prediction.
    """
    # Written first: what the bins are made of is then read and not worked out in each of their expressions.
    feat = materialize(featured(spark, sf), "features").filter(usable())
    test = F.col("day") >= base.TEST_START
    edges = trees.edges_of(feat.filter(~test), list(FEATURES))
    rows = feat.select(F.lit(0).alias("spec"), F.struct("site_id", "ts").alias("id"), F.when(~test, F.col("y_avg")).alias("y"), trees.binned(list(FEATURES), edges).alias("bins"))
    rows = materialize(rows, "explained-rows")
    every = spark.createDataFrame([(0, "all", list(range(len(FEATURES))))], "spec int, variant string, features array<int>")
    values, nodes = trees.grown(rows, every, trees=4, depth=4, share=0.5)
    rest = rows.filter("y is null")
    phi = materialize(trees.attributions(rest, nodes, 4), "attributions")
    gap = phi.groupBy("spec", "variant", "id").agg(F.sum("phi").alias("p")).join(values, ["spec", "variant", "id"]).agg(F.max(F.abs(F.col("p") - F.col("value"))).alias("max_gap"))
    return trees.importance(phi, rest, list(FEATURES)).drop("spec", "variant").crossJoin(F.broadcast(gap))  # one row


_NULLS = 5
_VARIANT_SQL = """WITH nr AS (SELECT * FROM @pred), e AS (
SELECT CASE model WHEN 'mean' THEN 'all' ELSE model END AS variant, fold, y_avg, y_cls, pred_avg, pred_peak, is_shutdown + is_sat + is_sun = 0 AS normal, theta FROM nr, th
UNION ALL SELECT 'null:' || k, fold, y_avg, y_cls, pred_avg + ((hour * 7 + site_id * 13 + k * 29) % 11 - 5) / 7.0::DOUBLE, pred_peak, is_shutdown + is_sat + is_sun = 0, theta FROM nr, th, range(5) g(k) WHERE model = 'mean'),
f AS (SELECT variant, fold, count(*) AS n, sum(abs(y_avg - pred_avg)) AS s, sum(CASE WHEN y_cls = 1 THEN abs(y_avg - pred_avg) END) AS ps, sum(y_cls) AS p, count(*) FILTER (y_cls = 1 AND pred_peak >= theta) AS tp, sum(CASE WHEN normal THEN abs(y_avg - pred_avg) END) AS ns, count(*) FILTER (normal) AS nn FROM e GROUP BY 1, 2),
v AS (SELECT variant, sum(n) AS n, sum(s) / sum(n) AS mae, sum(ps) / nullif(sum(p), 0) AS peak_mae, sum(tp) / nullif(sum(p), 0) AS recall, coalesce(stddev_samp(s / n), 0) AS fold_std, sum(ns) / nullif(sum(nn), 0) AS mae_normal_days FROM f GROUP BY 1),
d AS (SELECT v.*, v.mae - b.mae AS d_mae, v.peak_mae - b.peak_mae AS d_peak_mae, v.recall - b.recall AS d_recall, v.fold_std - b.fold_std AS d_fold_std, v.mae_normal_days - b.mae_normal_days AS d_mae_normal_days FROM v, v b WHERE b.variant = 'all'),
w AS (SELECT max(abs(d_mae)) AS noise_mae, max(abs(d_peak_mae)) AS noise_peak_mae FROM d WHERE variant LIKE 'null:%'),
h AS (SELECT f.variant, count(*) FILTER (f.s / f.n < b.s / b.n) AS improved_folds, bool_and(f.s / f.n - b.s / b.n <= noise_mae) AS folds_hold FROM f JOIN f b ON b.variant = 'all' AND b.fold = f.fold, w GROUP BY 1),
j AS (SELECT d.*, noise_mae, noise_peak_mae, improved_folds, folds_hold, d_mae_normal_days <= noise_mae AS normal_days_hold, d_recall >= -0.01 AND d_peak_mae <= noise_peak_mae AS peaks_hold, abs(d_mae) > noise_mae AS beyond_noise FROM d JOIN h USING (variant), w)
SELECT variant, I(n) AS n, R(mae) AS mae, R(peak_mae) AS peak_mae, R(recall) AS recall, R(fold_std) AS fold_std, R(mae_normal_days) AS mae_normal_days, R(d_mae) AS d_mae, R(d_peak_mae) AS d_peak_mae, R(d_recall) AS d_recall, R(d_fold_std) AS d_fold_std, R(d_mae_normal_days) AS d_mae_normal_days, R(noise_mae) AS noise_mae, R(noise_peak_mae) AS noise_peak_mae,
I(improved_folds) AS improved_folds, folds_hold, normal_days_hold, peaks_hold, beyond_noise, coalesce(folds_hold, FALSE) AND coalesce(normal_days_hold, FALSE) AND coalesce(peaks_hold, FALSE) AND variant <> 'all' AS accepted FROM j"""


@register(_VARIANT_SQL)
def variant_flags(spark: S, sf: D) -> DataFrame:
    """The study's judgement over naive predictions: two lags against their mean, whose noisy copies give the width of noise."""
    rows = predictions(spark, sf).select("model", "fold", "site_id", "ts", "y_avg", "y_cls", "pred_avg", "pred_peak", "hour", "is_shutdown", "is_sat", "is_sun")
    named = rows.withColumn("variant", F.when(F.col("model") == "mean", variants.BASE).otherwise(F.col("model")))
    noisy = rows.filter("model = 'mean'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_NULLS - 1))))
    moved = noisy.withColumn("pred_avg", F.col("pred_avg") + (F.pmod(F.col("hour") * 7 + F.col("site_id") * 13 + F.col("k") * 29, F.lit(11)) - 5) / 7.0)
    both = named.unionByName(moved.withColumn("variant", F.concat(F.lit("null:"), F.col("k").cast("string"))).drop("k"))
    return variants.judged(variants.summarized(materialize(both, "variant-predictions"), theta_of(repaired(spark, sf)), _normal()))


# --- quantiles and serving --------------------------------------------------------------------------------------------

#: Kept coefficients of the three quantiles, thresholds, knots and half widths of a bundle; its holidays hold until the 27th.
QUANTILES = {"q10": {None: 4.0, "y_avg_lag24": 0.35, "y_avg_lag168": 0.25}, "q50": {None: 10.0, "y_avg_lag24": 0.5, "y_avg_lag168": 0.35, "hour_sin": -2.0}, "q90": {None: 30.0, "y_avg_lag24": 0.6, "y_avg_lag168": 0.5}}
COVER = serving.HolidayCover("2024-01-01", "2024-01-27")
KNOTS = ((0.2, 0.0), (0.5, 0.3), (0.9, 0.8))
_LEVELS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
_LINES = {n: " + ".join([repr(c[None]), *(f"{v!r} * {k}" for k, v in c.items() if k)]) for n, c in QUANTILES.items()}
_QSQL = f"l0 AS (SELECT *, list_sort([({_LINES['q10']})::DOUBLE, ({_LINES['q50']})::DOUBLE, ({_LINES['q90']})::DOUBLE]) AS qs FROM @feat), l AS (SELECT *, qs[1] AS q10, qs[2] AS q50, qs[3] AS q90 FROM l0)"


def _with_quantiles(df: DataFrame) -> DataFrame:
    return df.withColumns(quantiles.ordered({n: quantiles.linear(c) for n, c in QUANTILES.items()}))


@register(f"WITH {_QSQL}, v AS (SELECT fold, y_avg AS y, q10, q50, q90 FROM l JOIN @folds ON day BETWEEN val_start AND val_end WHERE NOT is_warmup AND NOT is_outage AND NOT is_erp_missing) SELECT I(fold) AS fold, count(*) AS n, " + ", ".join(f"R(avg(CASE WHEN y >= {c} THEN {q} * (y - {c}) ELSE {1 - q!r} * ({c} - y) END)) AS pinball_{c}, R(avg((y <= {c})::INT)) AS under_{c}" for c, q in _LEVELS.items()) + ", R(avg((y BETWEEN q10 AND q90)::INT)) AS coverage, R(avg(q90 - q10)) AS width FROM (SELECT * FROM v) GROUP BY fold")
def quantile_coverage(spark: S, sf: D) -> DataFrame:
    """Loss and coverage of kept quantile coefficients on each fold's validation days; crossed quantiles are put in order."""
    rows = fold_rows(featured(spark, sf), folds(spark)).filter(usable()).filter("role = 'val'")
    return quantiles.interval_table(_with_quantiles(rows), "y_avg", _LEVELS, ["fold"])


@register()
def quantile_fits(spark: S, sf: D) -> DataFrame:
    """Coefficients of three quantiles of the mean power by fold, fitted on its training days, with their loss on its validation days."""
    rows = materialize(fold_rows(featured(spark, sf), folds(spark)).filter(usable()), "fold-rows")
    names = ["y_avg_lag24", "y_avg_lag168", "roll24_avg_mean", "prod", "hour_sin", "hour_cos", "is_shutdown"]
    fits = quantiles.fit(rows.filter("role = 'train'"), names, "y_avg", tuple(_LEVELS.values()), "fold")
    kept = quantiles.table(rows, fits, names)
    value = lambda q: sum((F.when(F.col("fold") == k, quantiles.linear(dict(zip([None, *names], map(float, beta), strict=True)))).otherwise(0.0) for (k, l), beta in fits.items() if l == q), F.lit(0.0))
    scored = quantiles.interval_table(rows.filter("role = 'val'").withColumns(quantiles.ordered({n: value(q) for n, q in _LEVELS.items()})), "y_avg", _LEVELS, ["fold"])
    return kept.join(scored.select(F.col("fold").cast("string").alias("key"), "n", "pinball_q10", "pinball_q50", "pinball_q90", "coverage"), "key", "left")


def _bundle(theta: float) -> serving.Served:
    return serving.Served(theta, 0.9 * theta, 0.5, KNOTS, {"operating": 25.0, "shutdown": 10.0}, base.HOLIDAYS, COVER, base.EDGES, base.FLOOR)


def _predict(theta: float):
    """Naive means of two lags in place of models."""

    def add(df: DataFrame) -> DataFrame:
        avg, peak = (F.col("y_avg_lag24") + F.col("y_avg_lag168")) / 2, (F.col("y_peak_lag24") + F.col("y_peak_lag168")) / 2
        regime = F.when(avg <= base.EDGES[0], 0).when(avg <= base.EDGES[1], 1).otherwise(2)
        return _with_quantiles(df.withColumns({"y_avg_pred": avg, "y_peak_pred": peak, "prob": F.least(F.lit(1.0), peak / (2 * theta)), "regime": regime}))

    return add


_SERVED_DAYS = f"day >= (SELECT min(day) + 8 FROM meter) AND day BETWEEN DATE '{COVER.start}' AND DATE '{COVER.end}'"
_KNOT_SQL = "CASE WHEN prob <= 0.2 THEN 0.0 WHEN prob <= 0.5 THEN 0.3 * (prob - 0.2) / 0.3 WHEN prob <= 0.9 THEN 0.3 + 0.5 * (prob - 0.5) / 0.4 ELSE 0.8 END"


@register(f"WITH {_QSQL}, p AS (SELECT l.*, (y_avg_lag24 + y_avg_lag168) / 2 AS a, (y_peak_lag24 + y_peak_lag168) / 2 AS k, least(1.0::DOUBLE, (y_peak_lag24 + y_peak_lag168) / 2 / (2 * theta)) AS prob, theta FROM l, th WHERE {_SERVED_DAYS}) SELECT site_id, ts, R(a) AS y_avg_pred, R(k) AS y_peak_pred, I(CASE WHEN a <= {base.EDGES[0]} THEN 0 WHEN a <= {base.EDGES[1]} THEN 1 ELSE 2 END) AS regime, I(k >= 0.9::DOUBLE * theta) AS peak_label, R(prob) AS peak_prob, R({_KNOT_SQL}) AS peak_prob_cal, I(prob >= 0.5) AS peak_label_cls, R(q10) AS q10, R(q50) AS q50, R(q90) AS q90, R(greatest(a - CASE WHEN is_shutdown = 1 THEN 10 ELSE 25 END, 0)) AS pi_lo, R(a + CASE WHEN is_shutdown = 1 THEN 10 ELSE 25 END) AS pi_hi FROM p")
def served_days(spark: S, sf: D) -> DataFrame:
    """What serving gives for each day whose holidays are known, from its own history and plan: 24 hours of thirteen columns."""
    hours = materialize(meter(spark, sf), "meter")
    days = hours.groupBy("day").count().select("day")
    days = days.crossJoin(days.agg(F.min("day").alias("first"))).filter(F.col("day") >= F.date_add("first", 8)).select("day")  # one row of the first day
    th = theta_of(repaired(spark, sf))
    return serving.predict_days(hours, days, _bundle(th), _predict(th), 23)


@register(f"SELECT DISTINCT day, 'CALENDAR_NOT_COVERED' AS code FROM @meter WHERE day NOT BETWEEN DATE '{COVER.start}' AND DATE '{COVER.end}'")
def refused_days(spark: S, sf: D) -> DataFrame:
    """Days that serving refuses, as the bundle's holidays don't cover them."""
    return serving.refused_days(meter(spark, sf), COVER)


# --- gates ------------------------------------------------------------------------------------------------------------


def _gate_sql(gate: str, source: str, named: dict[str, str], warn: tuple[str, ...] = ()) -> str:
    head, _, body = source.rpartition("|")
    return (head + " " if head else "") + " UNION ALL ".join(f"SELECT '{gate}' AS gate, '{n}' AS check, '{'warn' if n in warn else 'hard'}' AS severity, count(*) AS n, count(*) FILTER ({w}) AS n_wrong, count(*) FILTER ({w}) = 0 AS passed FROM {body}" for n, w in named.items())


@register(_gate_sql("repair", "@rep", {"targets_known": "(y_avg IS NULL OR y_peak IS NULL) AND NOT is_outage", "hour_of_timestamp": "hour <> hour(ts)", "day_of_timestamp": "day <> ts::DATE", "peak_not_under_mean": "y_peak < floor(y_avg - 0.5)", "no_negative_power": "least(p15, p30, p45, p60) < 0", "weather_known": "wind IS NULL OR rain IS NULL"}, ("weather_known",)))
def gate_repair(spark: S, sf: D) -> DataFrame:
    return gates.through(repaired(spark, sf), "repair", gates.repair_checks())[1]


@register(_gate_sql("features", "@feat", {"complete_at_origin": "hour(ts) - 23 > 0", "no_power_of_the_hour": "FALSE", "no_repeated_columns": "FALSE", "usable_rows_are_whole": "NOT is_warmup AND (" + " OR ".join(f"{c} IS NULL" for c in FEATURES) + ")"}))
def gate_features(spark: S, sf: D) -> DataFrame:
    return gates.through(featured(spark, sf), "features", gates.feature_checks())[1]


@register(_gate_sql("folds", "WITH fr AS (SELECT day, y_cls, val_start, val_end, CASE WHEN day <= train_end THEN 'train' ELSE 'val' END AS role FROM @feat JOIN @folds ON day <= train_end OR day BETWEEN val_start AND val_end)|fr", {"trained_on_the_past": "role = 'train' AND day >= val_start", "a_day_between": "role = 'train' AND day + 1 >= val_start", "validated_within": "role = 'val' AND NOT day BETWEEN val_start AND val_end", "class_known": "y_cls IS NULL"}))
def gate_folds(spark: S, sf: D) -> DataFrame:
    listed = folds(spark)
    rows = fold_rows(featured(spark, sf), listed).join(F.broadcast(listed.drop("train_end")), "fold")
    return gates.through(rows, "folds", gates.fold_checks())[1]


@register(_gate_sql("results", "WITH m0 AS (SELECT model, count(*) AS n, avg(abs(y_avg - pred_avg)) AS mae, sum((y_cls = 1 AND pred_cls = 1)::INT) AS tp, sum((y_cls = 0 AND pred_cls = 1)::INT) AS fp, sum((y_cls = 1 AND pred_cls = 0)::INT) AS fn, sum((y_cls = 0 AND pred_cls = 0)::INT) AS tn FROM @pred GROUP BY 1), mm AS (SELECT m0.*, b.mae AS base_mae, b.mae - m0.mae AS ci_low FROM m0, m0 b WHERE b.model = 'lag168')|mm", {"better_than_lag168": "model = 'mean' AND NOT mae < base_mae", "counts_add_up": "tp + fp + fn + tn <> n", "significant": "model = 'mean' AND NOT ci_low > 0", "fewer_alarms_than_calendar": "model = 'mean' AND fp >= 82"}, ("significant", "fewer_alarms_than_calendar")))
def gate_results(spark: S, sf: D) -> DataFrame:
    """The last chapter's gate over naive models; the gain itself stands for its lower limit."""
    rows = predictions(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_avg") - F.col("pred_avg"))).alias("mae"), *metrics.confusion())
    base_ = rows.filter("model = 'lag168'").select(F.col("mae").alias("base_mae"))  # one row
    made = rows.crossJoin(F.broadcast(base_)).withColumn("ci_low", F.col("base_mae") - F.col("mae"))
    return gates.through(made, "results", gates.result_checks("lag168", "mean", 82))[1]


# --- order, names, contrasts, conditions, costs -----------------------------------------------------------------------


@register("WITH s AS (SELECT user_id % 4 AS site_id, ts, ts <= lag(ts) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS falls FROM events), g AS (SELECT site_id, count(*) AS n, count(*) FILTER (ts IS NULL) AS n_null, count(ts) - count(DISTINCT ts) AS n_repeated, count(*) FILTER (falls) AS n_falling FROM s GROUP BY 1) SELECT *, n_null = 0 AND n_repeated = 0 AND n_falling = 0 AS strict FROM g")
def event_time_order(spark: S, sf: D) -> DataFrame:
    """By site, whether event times are unique and rising in the order of the events' ids."""
    return stats.time_order(table(spark, sf, "events").withColumn("site_id", F.col("user_id") % 4), "ts", "event_id", ["site_id"])


@register("SELECT p_partkey, substr(regexp_replace(regexp_replace(p_brand || ' / ' || p_name, '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug, printf('%05d-%s', p_size, lower(p_type)) AS code, starts_with(p_name, 'red') AS is_red, contains(p_name, 'ring') AS has_ring, replace(p_name, ' ', '') AS joined FROM part")
def part_names(spark: S, sf: D) -> DataFrame:
    """Names made of texts: slugs, formatted codes, beginnings, parts and replacements."""
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", stats.slug(F.concat("p_brand", F.lit(" / "), name)).alias("slug"), F.format_string("%05d-%s", "p_size", F.lower("p_type")).alias("code"), F.startswith(name, F.lit("red")).alias("is_red"), F.contains(name, F.lit("ring")).alias("has_ring"), F.replace(name, F.lit(" "), F.lit("")).alias("joined"))


@register("WITH f AS (SELECT * FROM @feat WHERE NOT is_warmup), q AS (SELECT quantile_cont(prod, 0.75) AS p, quantile_cont(temp, 0.75) AS t, quantile_cont(roll168_peak_max, 0.5) AS k FROM f), m AS (SELECT y_peak AS v, prod > p AS h, is_startup_08 = 1 OR is_restart_13 = 1 AS s, is_daytime = 1 AS d, roll168_peak_max > k AS z, temp > t AS hot FROM f, q), "
          "u AS (SELECT 'production_startup' AS name, v, h AND s AS a, h AND NOT s AS b, h AND s AS c FROM m UNION ALL SELECT 'production_daytime', v, h AND d, h AND NOT d, h FROM m UNION ALL SELECT 'production_past_peak', v, h AND z, h AND NOT z, h AND z FROM m UNION ALL SELECT 'temperature', v, hot, NOT hot, hot FROM m) "
          "SELECT name, count(*) FILTER (c) AS n, R(avg(v) FILTER (a)) AS inside, R(avg(v) FILTER (b)) AS outside, R(avg(v) FILTER (a) - avg(v) FILTER (b)) AS difference FROM u GROUP BY 1")
def interaction_contrasts(spark: S, sf: D) -> DataFrame:
    return evaluate.interactions(materialize(featured(spark, sf).filter("not is_warmup"), "features"))


@register("WITH pp AS (SELECT site_id, day, day = min(day) OVER (PARTITION BY site_id, ph) AS first_ FROM @prof), e AS (SELECT model, fold, abs(y_avg - pred_avg) AS e, first_ FROM @pred p JOIN pp USING (site_id, day)), m AS (SELECT model, fold, avg(e) AS d1, avg(e) FILTER (first_) AS d2 FROM e GROUP BY 1, 2), r AS (SELECT *, rank() OVER (ORDER BY round(d1, 9)) + (count(*) OVER (PARTITION BY round(d1, 9)) - 1) / 2.0 AS r1, rank() OVER (ORDER BY round(d2, 9)) + (count(*) OVER (PARTITION BY round(d2, 9)) - 1) / 2.0 AS r2 FROM m WHERE d2 IS NOT NULL) SELECT count(*) AS n, R(corr(r1, r2)) AS rho, corr(r1, r2) > 0.7 AS preserved FROM r")
def rank_preservation(spark: S, sf: D) -> DataFrame:
    """Whether the order of models' errors by fold stays the same on days without repeated profiles; the condition is a key, so both come from one pass."""
    first = splits.dedup_days(splits.profile_hash(meter(spark, sf), "ts")).withColumn("first", F.lit(True))
    rows = predictions(spark, sf).select("model", "fold", "site_id", "day", F.abs(F.col("y_avg") - F.col("pred_avg")).alias("e")).join(first, ["site_id", "day"], "left")
    m = rows.groupBy("model", "fold").agg(F.round(F.avg("e"), 9).alias("d1"), F.round(F.avg(F.when(F.col("first"), F.col("e"))), 9).alias("d2")).filter("d2 is not null")
    ranked = windows.with_average_rank(windows.with_average_rank(materialize(m, "conditions"), "d1", "r1"), "d2", "r2")
    return ranked.agg(F.count("*").alias("n"), stats.correlation("r1", "r2").alias("rho")).withColumn("preserved", F.col("rho") > 0.7)


@register(f"WITH {_ACT}, o AS (SELECT a.*, eligible AND a.hour IN (8, 13) AND alert AS l1, NOT r.is_outage AND a.y_peak >= 0 AS valid, theta FROM a JOIN @rep r USING (site_id, ts), th), m AS (SELECT site_id, max(CASE WHEN valid THEN y_peak END) AS op, max(CASE WHEN valid THEN y_peak * (1 - 0.2::DOUBLE * 2 / 3 * l1::INT) END) AS ap, sum(l1::INT) AS acts, sum((l1 AND valid AND y_peak < theta)::INT) AS wrong, sum(CASE WHEN valid THEN 1 / (24.0::DOUBLE * day(last_day(day))) ELSE 0 END) AS months FROM o GROUP BY 1), "
          "g AS (SELECT a AS alpha, f, 0.0 AS c, 0.0 AS u FROM (VALUES (0.1), (0.2), (0.3)) x(a), (VALUES (0.7), (1.0), (1.3)) y(f) UNION SELECT 0.2, 1.0, c, u FROM (VALUES (0.0), (1000.0), (5000.0)) x(c), (VALUES (0.0), (0.01), (0.1)) y(u)) "
          "SELECT site_id, 'alert_L1' AS policy, R(alpha) AS alpha, R(f) AS rate_factor, R(c) AS action_cost, R(u) AS unit_cost, R((op - ap) * 8320.0::DOUBLE * f * months) AS gross, R(acts * c) AS execution_cost, R(wrong * c) AS false_action_cost, R((op - ap) * 8320.0::DOUBLE * f * months - acts * c) AS net FROM m, g")
def policy_costs(spark: S, sf: D) -> DataFrame:
    """What a policy saves and costs for each site at each point of the grid of rates and costs."""
    m = policy.policy_metrics(_outcome(spark, sf), theta_of(repaired(spark, sf)))
    out = policy.costs(materialize(m, "policy-metrics"), policy.cost_grid(spark))
    return out.select("site_id", "policy", "alpha", "rate_factor", "action_cost", "unit_cost", "gross", "execution_cost", "false_action_cost", "net")


@register()
def spearman_test(spark: S, sf: D) -> DataFrame:
    """By site, the rank correlation of production and mean power with its two-sided p."""
    df = repaired(spark, sf).select("site_id", "prod", "y_avg")
    ranked = windows.with_average_rank(windows.with_average_rank(df, "prod", "a", "site_id"), "y_avg", "b", "site_id")
    g = ranked.groupBy("site_id").agg(F.count("*").alias("n"), stats.correlation("a", "b").alias("rho"))
    return g.withColumn("p", stats.correlation_p(F.col("rho"), F.col("n")))


# --- a bundle under scenarios -----------------------------------------------------------------------------------------

_SCENARIOS = ", ".join(f"('{n}', {p}::DOUBLE, {h}::DOUBLE, {t}::DOUBLE, {k})" for n, p, h, t, k in [
    ("C0", 1, 1, 0, 0), *((f"P{round(f * 100)}", f, 1, 0, 0) for f in (0.8, 0.9, 1.1, 1.2)), *((f"H{round(f * 100)}", 1, f, 0, 0) for f in (0.9, 1.1)), *((f"T{d:+d}", 1, 1, d, 0) for d in (-2, -1, 1, 2)),
    *((f"P{round(f * 100)}T{d:+d}", f, 1, d, 0) for f in (0.8, 1.2) for d in (-2, 2)), *((f"S{d:+d}", 1, 1, 0, d) for d in (-1, 1)),
])
_LAST_DAYS = f"day BETWEEN DATE '2024-01-22' AND DATE '{COVER.end}'"


def _predict_plan(theta: float):
    """Means of two lags, with what production and heat of the plan add."""

    def add(df: DataFrame) -> DataFrame:
        more = 0.02 * F.col("prod") + 0.5 * F.col("cdd")
        avg, peak = (F.col("y_avg_lag24") + F.col("y_avg_lag168")) / 2 + more, (F.col("y_peak_lag24") + F.col("y_peak_lag168")) / 2 + more
        return _with_quantiles(df.withColumns({"y_avg_pred": avg, "y_peak_pred": peak, "prob": F.least(F.lit(1.0), peak / (2 * theta)), "regime": F.lit(1)}))

    return add


@register(f"WITH sc(scenario, p, h, t, k) AS (VALUES {_SCENARIOS}), f AS (SELECT * FROM @feat WHERE {_LAST_DAYS}), r AS (SELECT sc.*, f.* FROM sc, f), mv AS (SELECT scenario, site_id, day, greatest(0, least(23, hour + k)) AS hour, sum(prod * p) AS prod FROM r GROUP BY ALL), "
          "v AS (SELECT r.scenario, r.site_id, r.ts, 0.02 * coalesce(mv.prod, 0) + 0.5 * greatest(temp + t - 24, 0) AS more, y_avg_lag24, y_avg_lag168, y_peak_lag24, y_peak_lag168 FROM r LEFT JOIN mv ON mv.scenario = r.scenario AND mv.site_id = r.site_id AND mv.day = r.day AND mv.hour = r.hour), "
          "w AS (SELECT scenario, site_id, ts, (y_avg_lag24 + y_avg_lag168) / 2 + more AS a, ((y_peak_lag24 + y_peak_lag168) / 2 + more >= 0.9::DOUBLE * theta)::INT AS l FROM v, th) "
          "SELECT w.scenario, w.site_id, count(*) AS n, R(avg(w.a - b.a)) AS mean_change, R(max(w.a - b.a)) AS largest_rise, count(*) FILTER (abs(w.a - b.a) > 1e-9) AS hours_changed, count(*) FILTER (w.l = 1 AND b.l = 0) AS alarms_gained, count(*) FILTER (w.l = 0 AND b.l = 1) AS alarms_lost FROM w JOIN w b ON b.scenario = 'C0' AND b.site_id = w.site_id AND b.ts = w.ts GROUP BY 1, 2")
def scenario_effects(spark: S, sf: D) -> DataFrame:
    """What 17 perturbed plans change in the predictions of the last covered days, after the base one is found to be what serving itself gives."""
    hours = materialize(meter(spark, sf), "meter")
    days = hours.filter(_LAST_DAYS).groupBy("day").count().select("day")
    th = theta_of(repaired(spark, sf))
    stored = serving.predict_days(hours, days, _bundle(th), _predict_plan(th), 27)
    made = sensitivity.scenario_predictions(hours, days, policy.scenarios(spark), _bundle(th), _predict_plan(th), 27)
    return sensitivity.effects(sensitivity.audited(made, stored))
