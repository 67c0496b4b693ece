"""Nested temporal selection: candidates are chosen by inner windows of each outer window's core and scored on its evaluation days.

A window is a core to fit on, a calibration tail that only sets the alarm threshold, and evaluation days, with gaps between
them. Windows are keys: all candidates of all outer and inner windows are fitted, calibrated and scored in the same jobs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import metrics
from loadlens.operators.features import FEATURES
from loadlens.operators.splits import inner_partitions, partition_bounds, role_of_day, usable
from loadlens.plans import trees
from loadlens.sources.io import materialize

# The weights of the selection's score; the second says whether less is better.
WEIGHTS = {"mae": (0.30, True), "peak_mae": (0.15, True), "recall": (0.25, False), "fold_std": (0.20, True)}
FEASIBLE = 0.10
#: Calibration needs so many rows of either class; with fewer, the threshold is theta.
LEAST_POSITIVE, LEAST_NEGATIVE = 5, 20
#: Rows that a core has at least, and rows of a regime that get a regressor of their own.
LEAST_CORE, LEAST_REGIME = 48, 20
_COUNTS = {"roll24_peak_cnt": 1, "roll168_peak_cnt": 7}
_KEYS = ["outer", "inner"]


@dataclass(frozen=True)
class Nested:
    """A window by its number in its outer window; inner 0 is the outer window itself."""

    outer: int
    inner: int
    bounds: tuple[tuple[str, str], ...]


def nested_windows(first_day: str, outer_starts: list[str], outer_days: int = 14, inner_days: int = 14, cal_days: int = 14, most: int = 3, least_core: int = 14) -> list[Nested]:
    """Each outer window and its inner ones, oldest first. Inner windows end in the outer core; a day parts core, tail and evaluation."""
    out = []
    for k, start in enumerate(outer_starts, 1):
        outer = _bounds(start, cal_days, outer_days)
        inner = [_bounds(b["eval_start"][:10], cal_days, inner_days) for b in inner_partitions(first_day, outer["core_end"], most, inner_days, cal_days, 1, 0)]
        held = [b for b in inner if (dt.date.fromisoformat(b["core_end"][:10]) - dt.date.fromisoformat(first_day)).days >= least_core]
        if any(b["eval_end"] > outer["core_end"] for b in held):
            raise ValueError("an inner window reaches beyond its outer core")
        out += [Nested(k, i, tuple(b.items())) for i, b in enumerate([outer, *held])]
    return out


def _bounds(start: str, cal_days: int, eval_days: int) -> dict[str, str]:
    """A gap of a day between the tail and the evaluation too."""
    b = partition_bounds(str(dt.date.fromisoformat(start) - dt.timedelta(days=1)), 1, cal_days, 0)
    return b | {"eval_start": f"{start} 00:00:00", "eval_end": f"{dt.date.fromisoformat(start) + dt.timedelta(days=eval_days)} 00:00:00"}


def in_windows(df: DataFrame, windows: list[Nested]) -> DataFrame:
    """outer, inner, role, theta, y_cls and the columns of usable rows, once for each window that has the row; windows of under LEAST_CORE core rows fall out.

    theta is the 95 % quantile of the core's peaks.
    """
    each = F.array(*(F.struct(F.lit(w.outer).alias("outer"), F.lit(w.inner).alias("inner"), role_of_day(**dict(w.bounds)).alias("role")) for w in windows))
    rows = df.filter(usable()).withColumn("__w", F.explode(F.filter(each, lambda w: w["role"].isNotNull()))).select("__w.*", *(c for c in df.columns if c != "y_cls"))
    core = rows.filter("role = 'core'").groupBy(*_KEYS).agg(F.percentile("y_peak", F.lit(0.95)).alias("theta"), F.count("*").alias("n_core")).filter(F.col("n_core") >= LEAST_CORE)
    # A row a window.
    return rows.join(F.broadcast(core), _KEYS).withColumn("y_cls", (F.col("y_peak") >= F.col("theta")).cast("int"))


def recounted(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """rows with the counts of past peaks by their own window's theta; hours are all hours of the series.

    Days of 24 hours only give counts, as the rolling windows of hours do.
    """
    days = hours.select("site_id", "day", "y_peak").join(F.broadcast(rows.select(*_KEYS, "theta").distinct()), how="cross")
    by_day = days.groupBy(*_KEYS, "site_id", "day").agg(F.count_if(F.col("y_peak") >= F.col("theta")).cast("double").alias("peaks"), F.count("*").alias("hours"))
    over = lambda n: Window.partitionBy(*_KEYS, "site_id").orderBy("day").rowsBetween(1 - n, 0)
    counts = by_day.select(*_KEYS, "site_id", F.date_add("day", 1).alias("day"), *(F.when(F.sum("hours").over(over(n)) == 24 * n, F.sum("peaks").over(over(n))).alias(c) for c, n in _COUNTS.items()))
    return rows.drop(*_COUNTS).join(counts, [*_KEYS, "site_id", "day"], "left")


def naive_candidates(rows: DataFrame, named: dict[str, tuple[Column, Column]]) -> DataFrame:
    """model, pred_avg, pred_peak besides the columns of tail and evaluation rows, a row for each candidate."""
    made = F.array(*(F.struct(F.lit(n).alias("model"), a.alias("pred_avg"), p.alias("pred_peak")) for n, (a, p) in named.items()))
    columns = (*_KEYS, "role", "theta", "n_core", "site_id", "ts", "y_avg", "y_peak", "y_cls")
    return rows.filter("role <> 'core'").select(*columns, F.explode(made).alias("m")).select(*columns, "m.*")


def tree_candidates(rows: DataFrame, edges: tuple[float, float], features: tuple[str, ...] = FEATURES, bins: int = 16, **forest) -> DataFrame:
    """The same for `forest`, and `regime2` and `regime3`: regressors of the regimes by the daily edges, chosen by the likeliest regime.

    All are forests of the keyed kind, fitted on core rows only, in one go: a spec for each window, target and part of the rows.
    """
    y, low, high = F.col("y_avg"), *edges
    regime = {2: (y >= high).cast("int"), 3: F.when(y <= low, 0).when(y <= high, 1).otherwise(2)}
    parts: list[tuple[str, Column | None, Column]] = [(f"{t}:all", None, F.col(t)) for t in ("y_avg", "y_peak")]
    for k, r in regime.items():
        for j in range(k):
            parts += [(f"gate{k}:{j}", None, (r == j).cast("double")), *((f"{t}:{k}:{j}", r == j, F.col(t)) for t in ("y_avg", "y_peak"))]
    # The bins' edges come from the earliest core, so that no later row shapes them.
    first = rows.filter("role = 'core'").agg(F.min_by(F.struct("outer", "inner"), F.struct("n_core", "outer", "inner")).alias("w")).select("w.*")
    edges_ = trees.edges_of(rows.filter("role = 'core'").join(F.broadcast(first), _KEYS, "left_semi"), list(features), bins)
    held = F.col("role") == "core"
    of = lambda k, keep, t: F.when(~held | (F.lit(True) if keep is None else keep), F.struct(F.lit(k).alias("part"), F.when(held, t).alias("y")))
    each = rows.withColumn("bins", trees.binned(list(features), edges_)).select(*_KEYS, "bins", F.struct("site_id", "ts").alias("id"), F.explode(F.array_compact(F.array(*(of(k, keep, t.cast("double")) for k, (_, keep, t) in enumerate(parts))))).alias("p"))
    spec = (F.col("outer") * 1000 + F.col("inner")) * 100 + F.col("p.part")
    given = materialize(each.select(spec.alias("spec"), "id", "p.y", "bins"), "tree-rows")
    known = given.filter("y is not null").groupBy("spec").agg(F.count("*").alias("n"))
    everything = F.array(*map(F.lit, range(len(features)))).alias("features")
    made = trees.forests(given, known.select("spec", F.lit("all").alias("variant"), everything), **forest)
    part, window = F.col("spec") % 100, F.floor(F.col("spec") / 100)
    # A regime of few rows has no say: its hours get the whole's value.
    enough = made.join(known.select("spec", "n"), "spec").filter((part < 2) | F.get(F.array(*(F.lit(n.startswith("gate")) for n, *_ in parts)), part) | (F.col("n") >= LEAST_REGIME))
    wide = enough.groupBy(F.floor(window / 1000).cast("int").alias("outer"), (window % 1000).cast("int").alias("inner"), "id").agg(*(F.max(F.when(part == k, F.col("value"))).alias(n) for k, (n, *_) in enumerate(parts)))
    wide = wide.select(*_KEYS, "id.*", *(F.col(n).alias(n.replace(":", "_")) for n, *_ in parts))

    def routed(k: int, target: str) -> Column:
        likely = F.array_max(F.array(*(F.struct(F.coalesce(f"gate{k}_{j}", F.lit(0.0)).alias("p"), F.lit(-j).alias("j")) for j in range(k))))
        value = F.get(F.array(*(F.col(f"{target}_{k}_{j}") for j in range(k))), -likely["j"])
        return F.coalesce(value, f"{target}_all")

    named = {"forest": (F.col("y_avg_all"), F.col("y_peak_all"))} | {f"regime{k}": (routed(k, "y_avg"), routed(k, "y_peak")) for k in regime}
    rest = rows.filter("role <> 'core'").select(*_KEYS, "role", "theta", "n_core", "site_id", "ts", "y_avg", "y_peak", "y_cls")
    joined = rest.join(wide.drop("y_avg", "y_peak"), [*_KEYS, "site_id", "ts"])
    return naive_candidates(joined, named)


def tail_thresholds(predictions: DataFrame) -> DataFrame:
    """outer, inner, model, tau, fallback: the threshold of the best f1 on the tail's predicted peaks; theta where a class is too small."""
    keys = [*_KEYS, "model"]
    tail = predictions.filter("role = 'calibration'")
    size = tail.groupBy(*keys).agg(F.first("theta").alias("theta"), F.count_if(F.col("y_cls") == 1).alias("p"), F.count_if(F.col("y_cls") == 0).alias("n"))
    few = (F.col("p") < LEAST_POSITIVE) | (F.col("n") < LEAST_NEGATIVE)
    tuned = metrics.tune_threshold(tail, "y_cls", "pred_peak", keys, 0.0).select(*keys, F.col("tau").alias("best"))
    return size.join(tuned, keys).select(*keys, F.when(few, F.col("theta")).otherwise(F.col("best")).alias("tau"), few.alias("fallback"), (F.col("p") + F.col("n")).alias("n_calibration"))


def window_metrics(predictions: DataFrame) -> DataFrame:
    """By outer, inner and model: the evaluation's errors and confusion at the tail's threshold."""
    keys = [*_KEYS, "model"]
    rows = predictions.filter("role = 'evaluation'").join(tail_thresholds(predictions), keys)
    err, hit, alarm = F.abs(F.col("y_avg") - F.col("pred_avg")), F.col("y_cls") == 1, F.col("pred_peak") >= F.col("tau")
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*keys, "theta", "tau", "fallback", "n_core", "n_calibration").agg(F.count("*").alias("n"), F.avg(err).alias("mae"), F.avg(F.when(hit, err)).alias("peak_mae"), n(hit & alarm, "tp"), n(~hit & alarm, "fp"), n(hit & ~alarm, "fn"), n(~hit & ~alarm, "tn"))


def scored(inner: DataFrame, order: list[str]) -> DataFrame:
    """outer, model, mae, peak_mae, recall, fold_std, inner_folds, score, selected from the metrics of inner windows.

    Errors are weighted by hours, recall is pooled. Each is ranked from 0 to 1 within the outer window; an undefined one
    counts 0, and all count 1 where all are equal. Exact ties go to the candidate that `order` names first.
    """
    pos = F.col("tp") + F.col("fn")
    pooled = inner.groupBy("outer", "model").agg(
        (F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"), F.try_divide(F.sum(F.coalesce("peak_mae", F.lit(0.0)) * pos), F.sum(pos)).alias("peak_mae"),
        F.try_divide(F.sum("tp").cast("double"), F.sum(pos)).alias("recall"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("fold_std"), F.count("*").alias("inner_folds"),
    )
    of_outer, total = Window.partitionBy("outer"), F.lit(FEASIBLE)  # a row a candidate
    for c, (w, less) in WEIGHTS.items():
        low, high = F.min(c).over(of_outer), F.max(c).over(of_outer)
        rank = F.when(F.col(c).isNull(), 0.0).when(high == low, 1.0).otherwise((high - F.col(c) if less else F.col(c) - low) / (high - low))
        total = total + w * rank
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    best = F.row_number().over(of_outer.orderBy(F.desc("score"), place)) == 1
    return pooled.withColumn("score", F.round(total, 9)).withColumn("selected", best)


def select_on_core(predictions: DataFrame, order: list[str]) -> DataFrame:
    """scored() of the inner windows alone. Their rows lie in the outer cores, so nothing of tails and evaluation days is seen."""
    return scored(window_metrics(predictions.filter("inner > 0")), order)


def nested_selection(predictions: DataFrame, order: list[str]) -> DataFrame:
    """By outer window and candidate: the score from its inner windows, the choice, and the outer window's own metrics.

    An outer window without inner ones chooses the first candidate, with a null score.
    """
    held = materialize(predictions, "nested-predictions")
    outer = window_metrics(held.filter("inner = 0")).drop("inner")
    chosen = select_on_core(held, order).select("outer", "model", "score", "inner_folds", "selected", F.col("mae").alias("inner_mae"), F.col("recall").alias("inner_recall"), F.col("fold_std").alias("inner_fold_std"))
    out = outer.join(chosen, ["outer", "model"], "left")
    return out.withColumns({"inner_folds": F.coalesce("inner_folds", F.lit(0)), "selected": F.coalesce("selected", F.col("model") == order[0])})


def classifier_metrics(rows: DataFrame) -> DataFrame:
    """By outer window: confusion, rates, average precision and Brier score of an evaluation's probabilities (prob) at one half."""
    at = metrics.rates(rows.withColumn("pred_cls", (F.col("prob") >= 0.5).cast("int")).groupBy("outer").agg(F.count("*").alias("n"), *metrics.confusion(), F.avg(F.pow(F.col("y_cls") - F.col("prob"), F.lit(2))).alias("brier")), None)
    return at.join(metrics.average_precision(rows, "y_cls", "prob", ["outer"]), "outer", "left").select("outer", "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "average_precision", "brier")
