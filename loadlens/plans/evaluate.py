"""Result tables over long predictions: a row for each model and time, with y_avg, y_peak, y_cls, pred_avg, pred_peak, pred_cls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import metrics
from loadlens.operators.splits import conditions


def regression_table(df: DataFrame, theta: float, keys: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    return df.groupBy(*keys).agg(*metrics.regression(theta=theta))


def peak_table(df: DataFrame, keys: list[str] = ["model"], zero_division: float | None = 0.0) -> DataFrame:  # noqa: B006
    return metrics.rates(df.groupBy(*keys).agg(*metrics.confusion()), zero_division)


def cells(df: DataFrame, keys: list[str], theta: float, sparse_hours: int = 20, sparse_days: int = 5) -> DataFrame:
    """Hours, days, confusion, rates (null if undefined), errors and peak rate of each cell; sparse ones are marked."""
    err = F.abs(F.col("y_avg") - F.col("pred_avg"))
    peak = F.col("y_cls") == 1
    g = df.groupBy(*keys).agg(F.count("*").alias("n_hours"), F.count_distinct("day").alias("n_days"), *metrics.confusion(), F.avg(err).alias("mae"), F.avg(F.when(peak, err)).alias("peak_mae"), F.avg(F.col("y_cls").cast("double")).alias("peak_rate"), F.avg("y_peak").alias("mean_peak"))
    return metrics.rates(g, None).withColumn("sparse_cell", (F.col("n_hours") < sparse_hours) | (F.col("n_days") < sparse_days))


def condition_cells(df: DataFrame, high: float, theta: float) -> DataFrame:
    return cells(conditions(df, high), ["condition"], theta)


def production_bands(df: DataFrame, q50: float, q75: float, theta: float) -> DataFrame:
    band = F.when(F.col("prod") == 0, "zero").when(F.col("prod") <= q50, "positive_to_q50").when(F.col("prod") <= q75, "q50_to_q75").otherwise("above_q75")
    return cells(df.withColumn("production_band", band).withColumn("hour", F.hour("ts")), ["production_band", "hour"], theta)


def temperature_bands(df: DataFrame, low: float, high: float, theta: float) -> DataFrame:
    band = F.when(F.col("temp") <= low, "low").when(F.col("temp") <= high, "middle").otherwise("high")
    return cells(df.withColumn("temperature_band", band).withColumn("hour", F.hour("ts")), ["hour", "is_shutdown", "temperature_band"], theta)


def split_by(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """name, mae_in, mae_out, n_in, n_out, days_in: mean absolute error where each condition holds and where it doesn't."""
    e = F.abs(F.col("y_avg") - F.col("pred_avg"))
    rows = df.select("day", e.alias("e"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("is_in")) for n, c in named.items()))).alias("x")).select("day", "e", "x.*")
    inside = F.col("is_in")
    return rows.groupBy("name").agg(F.avg(F.when(inside, F.col("e"))).alias("mae_in"), F.avg(F.when(~inside, F.col("e"))).alias("mae_out"), F.sum(inside.cast("long")).alias("n_in"), F.sum((~inside).cast("long")).alias("n_out"), F.count_distinct(F.when(inside, F.col("day"))).alias("days_in"))


def lift_table(df: DataFrame, subset: Column, named: dict[str, Column]) -> DataFrame:
    """name, share_in, share_all, lift of conditions in a subset against all rows."""
    rows = df.select(subset.alias("s"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in named.items()))).alias("x")).select("s", "x.*")
    g = rows.groupBy("name").agg(F.avg(F.when(F.col("s"), F.col("v"))).alias("share_in"), F.avg("v").alias("share_all"))
    return g.withColumn("lift", F.try_divide("share_in", "share_all"))


def contrasts(df: DataFrame, a: Column, b: Column, value: str = "y_avg") -> DataFrame:
    """Means of the four combinations of two conditions, and the interaction contrast."""
    m = lambda x, y: F.avg(F.when((a == F.lit(x)) & (b == F.lit(y)), F.col(value)))
    g = df.agg(m(True, True).alias("both"), m(True, False).alias("only_a"), m(False, True).alias("only_b"), m(False, False).alias("neither"))
    return g.withColumn("interaction", F.col("both") - F.col("only_a") - F.col("only_b") + F.col("neither"))


def interactions(df: DataFrame, value: str = "y_peak") -> DataFrame:
    """name, n, inside, outside, difference of four contrasts: means of a value where a condition holds and where it doesn't.

    In hours of production over its 75 % quantile: hours of starting up, daytime, a past week's peak over its median; in all hours:
    temperature over its 75 % quantile. n counts the rows in which both hold; for daytime and temperature those of the condition they start from.
    """
    q = df.agg(F.percentile("prod", F.lit(0.75)).alias("prod75"), F.percentile("temp", F.lit(0.75)).alias("temp75"), F.percentile("roll168_peak_max", F.lit(0.5)).alias("peak50"))  # one row
    rows = df.crossJoin(F.broadcast(q))
    high, hot = F.col("prod") > F.col("prod75"), F.col("temp") > F.col("temp75")
    start = (F.col("is_startup_08") == 1) | (F.col("is_restart_13") == 1)
    day, past = F.col("is_daytime") == 1, F.col("roll168_peak_max") > F.col("peak50")
    named = {"production_startup": (high, start, high & start), "production_daytime": (high, day, high), "production_past_peak": (high, past, high & past), "temperature": (F.lit(True), hot, hot)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (within & c).alias("a"), (within & ~c).alias("b"), counted.alias("c")) for k, (within, c, counted) in named.items()))).alias("x")
    g = rows.select(F.col(value).alias("v"), each).groupBy("x.name").agg(F.count_if("x.c").alias("n"), F.avg(F.when(F.col("x.a"), F.col("v"))).alias("inside"), F.avg(F.when(F.col("x.b"), F.col("v"))).alias("outside"))
    return g.withColumn("difference", F.col("inside") - F.col("outside"))


def worst_days(df: DataFrame, k: int = 3) -> DataFrame:
    """The hour of the largest error of each day, for the k worst days."""
    e = df.withColumn("abs_err", F.abs(F.col("y_avg") - F.col("pred_avg")))
    top = e.withColumn("__r", F.row_number().over(Window.partitionBy("site_id", "day").orderBy(F.desc("abs_err"), "ts"))).filter("__r = 1").drop("__r")
    return top.orderBy(F.desc("abs_err"), "site_id", "ts").limit(k)


def blend(df: DataFrame, a: str, b: str, y: str, steps: int = 20) -> DataFrame:
    """w, mae for weights 0 to 1 on a; the weights are a literal array on each row and are summed before any shuffle."""
    w = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps)))
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(y).alias("y"), w.alias("w"))
    return rows.groupBy("w").agg(F.avg(F.abs(F.col("y") - (F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")))).alias("mae"))


def best_blend(df: DataFrame, a: str, b: str, y: str, least_gain: float = 1e-9) -> DataFrame:
    """One row: the least weight of the best error, the better single error, and whether the blend gains enough to be taken."""
    g = blend(df, a, b, y)
    alone = F.least(F.max(F.when(F.col("w") == 0, F.col("mae"))), F.max(F.when(F.col("w") == 1, F.col("mae"))))
    one = g.agg(F.min_by("w", F.struct(F.round("mae", 12), "w")).alias("w"), F.min("mae").alias("mae"), alone.alias("single"))
    return one.withColumn("accepted", F.col("single") - F.col("mae") > least_gain)


def pooled_score(folds: DataFrame) -> DataFrame:
    """model, mae, peak_mae, recall, fold_std from rows of model, fold, n, mae, peak_mae, tp, fn: errors weighted by hours, recall pooled."""
    pos = F.col("tp") + F.col("fn")
    return folds.groupBy("model").agg(F.try_divide(F.sum(F.col("mae") * F.col("n")), F.sum("n")).alias("mae"), F.try_divide(F.sum(F.coalesce("peak_mae", F.lit(0.0)) * pos), F.sum(pos)).alias("peak_mae"), F.try_divide(F.sum("tp").cast("double"), F.sum(pos)).alias("recall"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("fold_std"))


def check_arithmetic(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_pos, n_neg, counts_add_up, mae: whether confusion counts, positives and negatives of each result fit its rows."""
    pos = F.sum((F.col("y_cls") == 1).cast("long"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), pos.alias("n_pos"), F.sum((F.col("y_cls") != 1).cast("long")).alias("n_neg"), *metrics.confusion(), F.avg(F.abs(F.col("y_avg") - F.col("pred_avg"))).alias("mae"))
    fits = (F.col("tp") + F.col("fn") == F.col("n_pos")) & (F.col("fp") + F.col("tn") == F.col("n_neg")) & (F.col("n_pos") + F.col("n_neg") == F.col("n"))
    return g.select(*keys, "n", "n_pos", "n_neg", fits.alias("counts_add_up"), "mae")


def pick_first(scores: DataFrame, order: list[str]) -> DataFrame:
    """The model of the best score; exact ties go to the one registered first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return scores.withColumn("__p", place).orderBy(F.desc("score"), "__p").limit(1).drop("__p")


def judge_variants(df: DataFrame, noise: float) -> DataFrame:
    """Flags of variants (d_mae, d_peak_mae, d_recall, d_fold_std): better, beyond noise, no worse on peaks, stable, accepted."""
    out = df.withColumns({"better": F.col("d_mae") < 0, "beyond_noise": F.abs("d_mae") > noise, "peaks_no_worse": (F.col("d_peak_mae") <= 0) & (F.col("d_recall") >= 0), "stable": F.col("d_fold_std") <= 0})
    return out.withColumn("accepted", F.col("better") & F.col("beyond_noise") & F.col("peaks_no_worse") & F.col("stable"))


def earlier_thresholds(df: DataFrame, folds: DataFrame, q: float = 0.95) -> DataFrame:
    """fold, tau: the quantile of predicted peaks of folds that ended before this one began."""
    starts = folds.select("fold", "val_start")
    past = starts.join(df.select("day", "pred_peak"), F.col("day") < F.col("val_start"))
    return past.groupBy("fold").agg(F.percentile("pred_peak", F.lit(q)).alias("tau"), F.count("*").alias("n"))
