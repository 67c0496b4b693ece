"""Metrics as aggregates: each function gives the columns of one `agg`, so any number of them share a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.windows import running_sums, same_keys


def _mean(x: Column, keep: Column | None = None) -> Column:
    return F.avg(x if keep is None else F.when(keep, x))


def regression(y: str = "y_avg", p: str = "pred_avg", y_peak: str = "y_peak", p_peak: str = "pred_peak", theta: float = 187.0) -> list[Column]:
    """mae, rmse, smape, peak_mae and the counts behind them. Peak rows are those whose actual peak reaches theta; rates without rows are null."""
    y, p, yp, pp = (F.col(c) for c in (y, p, y_peak, p_peak))
    err, peak, high = F.abs(y - p), yp >= theta, y >= theta
    size = F.abs(y) + F.abs(p)
    return [
        F.count(err).alias("n"), _mean(err).alias("mae"), F.sqrt(F.avg(F.pow(y - p, F.lit(2)))).alias("rmse"), (100 * _mean(2 * err / F.nullif(size, F.lit(0.0)))).alias("smape"),
        _mean(err, peak).alias("peak_mae"), _mean(F.abs(yp - pp), peak).alias("peak15_mae"), F.sum(peak.cast("long")).alias("peak_n"), _mean(err, high).alias("high_load_mae"), F.sum(high.cast("long")).alias("high_load_n"),
    ]


def confusion(y: str = "y_cls", p: str = "pred_cls") -> list[Column]:
    yes, said = F.col(y) == 1, F.col(p) == 1
    n = lambda c, a: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(a)
    return [n(yes & said, "tp"), n(~yes & said, "fp"), n(yes & ~said, "fn"), n(~yes & ~said, "tn")]


def rates(df: DataFrame, zero_division: float | None = 0.0) -> DataFrame:
    """Adds precision, recall, f1, false_positive_rate, base_rate and lift to confusion counts; undefined ones are zero_division, or null."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    of = lambda a, b: F.try_divide(a, b) if zero_division is None else F.coalesce(F.try_divide(a, b), F.lit(zero_division))
    out = df.withColumns({"precision": of(tp, tp + fp), "recall": of(tp, tp + fn), "f1": of(2 * tp, 2 * tp + fp + fn), "false_positive_rate": of(fp, fp + tn), "base_rate": of(tp + fn, tp + fp + fn + tn)})
    return out.withColumn("lift", of(F.col("precision"), F.col("base_rate")))


def pr_curve(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    """keys, score, tp, fp, precision, recall at each distinct score, high scores first.

    Rows are reduced to a row for each score before the running sums, which go by ranges of scores.
    """
    at = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running_sums(at, "score", {"tp": "pos", "seen": "n"}, *keys, down=True)
    whole = df.groupBy(*keys).agg(F.sum((F.col(y) == 1).cast("long")).alias("all_pos")).select(*(F.col(k).alias(f"__k_{k}") for k in keys), "all_pos")
    run = run.join(whole, same_keys(keys)) if keys else run.crossJoin(F.broadcast(whole))
    return run.select(*keys, "score", "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"))


def average_precision(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    """keys, average_precision: recall steps times precision over distinct scores; null where a class is missing."""
    # A score's step of recall is its own positives over all of them, so no row needs the one before it.
    own = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos")).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("score").alias("__k_score"), "pos")
    curve = pr_curve(df, y, score, keys).join(own, same_keys([*keys, "score"]))
    parts = curve.withColumn("__s", F.try_divide(F.col("pos") * F.col("recall"), F.col("tp")) * F.col("precision"))
    return parts.groupBy(*keys).agg(F.when((F.max("tp") > 0) & (F.max("fp") > 0), F.sum("__s")).alias("average_precision"))


def tune_threshold(df: DataFrame, y: str, score: str, keys: list[str], fallback: float, points: int = 120, low: float = 0.5, high: float = 0.999) -> DataFrame:
    """keys, tau, f1: among rounded quantiles of the score, the least one of the best f1; the fallback where nothing is positive.

    Candidates meet the distinct scores of their group, already counted, and not its rows.
    """
    at = df.groupBy(*keys, F.round(score, 9).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    qs = [low + (high - low) * i / (points - 1) for i in range(points)]
    cand = df.groupBy(*keys).agg(F.percentile(score, F.array(*map(F.lit, qs))).alias("q"), F.sum((F.col(y) == 1).cast("long")).alias("all_pos"))
    cand = cand.select(*keys, "all_pos", F.explode(F.array_distinct(F.transform("q", lambda x: F.bround(x, 2)))).alias("tau"))
    met = cand.join(at, keys) if keys else cand.crossJoin(at)
    said = F.col("s") >= F.col("tau")
    f1 = met.groupBy(*keys, "tau", "all_pos").agg(F.sum(F.when(said, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("n")).otherwise(0)).alias("flagged"))
    f1 = f1.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("flagged") + F.col("all_pos")), F.lit(0.0)))
    best = f1.groupBy(*keys).agg(F.max_by("tau", F.struct(F.round("f1", 12), -F.col("tau"))).alias("tau"), F.max("f1").alias("f1"), F.max("all_pos").alias("all_pos"))
    return best.select(*keys, F.when(F.col("all_pos") > 0, F.col("tau")).otherwise(F.lit(fallback)).alias("tau"), F.when(F.col("all_pos") > 0, F.col("f1")).otherwise(F.lit(0.0)).alias("f1"))


def reliability(df: DataFrame, y: str, p: str, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, bin, n, mean_p, rate: bins are right-closed, the first one closed at 0 too."""
    edges = [i * (1.0 / bins) for i in range(1, bins)] + [1.0]
    b = F.lit(bins)
    for i in reversed(range(bins)):
        b = F.when(F.col(p) <= edges[i], i + 1).otherwise(b)
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, y: str, p: str, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, ece, brier."""
    r = reliability(df, y, p, keys, bins)
    ece = r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    brier = df.groupBy(*keys).agg(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))).alias("brier"))
    return ece.join(brier, keys) if keys else ece.crossJoin(brier)


def conformal(df: DataFrame, residual: str, keys: list[str], alpha: float) -> DataFrame:
    """keys, n, halfwidth: the ceil((n + 1)(1 - alpha))-th smallest absolute residual, null if there are fewer rows than that.

    Whole ranks come from counts of distinct residuals, summed up by ranges of them.
    """
    at = df.groupBy(*keys, F.abs(F.col(residual)).alias("r")).agg(F.count("*").alias("c"))
    whole = df.groupBy(*keys).agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"__k_{k}") for k in keys), "n")
    run = running_sums(at, "r", {"upto": "c"}, *keys)
    run = run.join(whole, same_keys(keys)) if keys else run.crossJoin(F.broadcast(whole))
    k = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= k, F.col("r"))).alias("halfwidth"))


def interval_score(df: DataFrame, lo: str, hi: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, coverage, width of intervals whose lower end is floored at 0."""
    low = F.greatest(F.col(lo), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(y).between(low, F.col(hi)).cast("double")).alias("coverage"), F.avg(F.col(hi) - low).alias("width"))


def scorecard(df: DataFrame, weights: dict[str, tuple[float, bool]], keep: dict[str, float] | None = None) -> DataFrame:
    """Adds score: weighted min-max ranks of columns (weight, lower is better), a range of 0 counting 1, plus columns taken as they are.

    One row for each model.
    """
    total = F.lit(0.0)
    ends = df.agg(*(f(c).alias(f"__{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))))
    rows = df.crossJoin(F.broadcast(ends))
    for c, (w, lower) in weights.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        z = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        total = total + w * F.coalesce((1 - z) if lower else z, F.lit(1.0))
    for c, w in (keep or {}).items():
        total = total + w * F.col(c)
    return rows.select(*df.columns, F.round(total, 4).alias("score"))
