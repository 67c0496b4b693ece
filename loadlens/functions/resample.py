"""Bootstrap over days. Draws are made once, by numpy from a seed, as a small table of (replicate, day's place, times); days are
reduced to sums first, so a replicate is a join of two small tables and never of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def day_draws(spark: SparkSession, n_days: int, n_boot: int, seed: int) -> DataFrame:
    """rep, place, times: for each replicate, n_days days drawn with replacement."""
    drawn = np.random.default_rng(seed).integers(0, n_days, size=(n_boot, n_days))
    return _table(spark, drawn)


def block_draws(spark: SparkSession, days: list, block: int, n_boot: int, seed: int) -> DataFrame:
    """Moving blocks of consecutive days without wrap-around, cut to the number of days; fails where the calendar has a gap."""
    starts = block_starts(days, block)
    rng = np.random.default_rng(seed)
    n, need = len(days), -(-len(days) // block)
    chosen = starts[rng.integers(0, len(starts), size=(n_boot, need))]
    drawn = (chosen[:, :, None] + np.arange(block)).reshape(n_boot, -1)[:, :n]
    return _table(spark, drawn)


def block_starts(days: list, block: int) -> np.ndarray:
    """Places at which `block` calendar days follow one another."""
    d = np.array(days, dtype="datetime64[D]")
    ok = [i for i in range(len(d) - block + 1) if (np.diff(d[i : i + block]) == np.timedelta64(1, "D")).all()]
    if not ok:
        raise ValueError("no stretch of consecutive days is that long")
    return np.array(ok)


def _table(spark: SparkSession, drawn: np.ndarray) -> DataFrame:
    import pandas as pd

    flat = pd.DataFrame({"rep": np.repeat(np.arange(len(drawn)), drawn.shape[1]), "place": drawn.ravel()})
    counts = flat.value_counts().rename("times").reset_index()
    return spark.createDataFrame(counts.astype("int64"), "rep long, place long, times long")


def _daily(df: DataFrame, sums: dict[str, Column], day: str) -> DataFrame:
    days = df.groupBy(day).agg(*(v.alias(k) for k, v in sums.items()))
    return days.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1)


def replicates(df: DataFrame, sums: dict[str, Column], draws: DataFrame, day: str = "day") -> DataFrame:
    """rep and, for each named sum over a day's rows, its total over the days drawn."""
    met = draws.join(_daily(df, sums, day), "place")
    return met.groupBy("rep").agg(*(F.sum(F.col(k) * F.col("times")).alias(k) for k in sums))


def paired_mae(df: DataFrame, draws: DataFrame, y: str = "y", a: str = "pred_a", b: str = "pred_b", day: str = "day") -> DataFrame:
    """One row: diff (error of a minus that of b), 95 and 90 % limits, two-tailed p, and verdict flags."""
    err = lambda p: F.abs(F.col(y) - F.col(p))
    sums = {"s": F.sum(err(a) - err(b)), "n": F.count("*")}
    reps = replicates(df, sums, draws, day).select((F.col("s") / F.col("n")).alias("d"))
    q = F.percentile("d", F.array(*map(F.lit, (0.025, 0.05, 0.95, 0.975))))
    tails = reps.agg(q.alias("q"), F.avg((F.col("d") >= 0).cast("double")).alias("over"), F.avg((F.col("d") <= 0).cast("double")).alias("under"))
    diff = df.agg((F.sum(err(a) - err(b)) / F.count("*")).alias("diff"))
    lo, lo90, hi90, hi = (F.col("q")[i] for i in range(4))
    return diff.crossJoin(tails).select(
        "diff", lo.alias("ci_low"), hi.alias("ci_high"), lo90.alias("ci90_low"), hi90.alias("ci90_high"), F.least(F.lit(1.0), 2 * F.least("over", "under")).alias("p"),
        ((lo > 0) | (hi < 0)).alias("significant_95"), ((lo90 > 0) | (hi90 < 0)).alias("significant_90"), (F.col("diff") > 0).alias("b_better"),
    )


def mean_limits(df: DataFrame, value: Column, keep: Column, draws_of, day: str = "day") -> DataFrame:
    """n, mean, low, high of a value's mean over the rows that `keep` holds for: 95 % limits from draws of the days that have such rows.

    draws_of makes the draws for a number of days; fewer than two days give null limits.
    """
    rows = df.filter(keep & value.isNotNull())
    n = rows.select(day).distinct().count()
    plain = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    if n < 2:
        return plain.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    reps = replicates(rows, {"s": F.sum(value), "c": F.count("*")}, draws_of(n), day).select((F.col("s") / F.col("c")).alias("m"))
    q = reps.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return plain.crossJoin(q).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def seed_draws(spark: SparkSession, days: list, block: int, n_boot: int, seeds: range | list[int]) -> DataFrame:
    """seed, rep, place, times: the draws of block_draws() for each seed; the seed is one more key of one table."""
    parts = [block_draws(spark, days, block, n_boot, s).withColumn("seed", F.lit(s)) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_sensitivity(df: DataFrame, draws: DataFrame, y: str = "y", a: str = "pred_a", b: str = "pred_b", day: str = "day") -> DataFrame:
    """seed, ci_low, ci_high, p, includes_zero of the difference of two mean absolute errors, for each seed's draws."""
    err = lambda p: F.abs(F.col(y) - F.col(p))
    met = draws.join(_daily(df, {"s": F.sum(err(a) - err(b)), "n": F.count("*")}, day), "place")
    reps = met.groupBy("seed", "rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    out = reps.groupBy("seed").agg(q.alias("q"), F.avg((F.col("d") >= 0).cast("double")).alias("over"), F.avg((F.col("d") <= 0).cast("double")).alias("under"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return out.select("seed", lo.alias("ci_low"), hi.alias("ci_high"), F.least(F.lit(1.0), 2 * F.least("over", "under")).alias("p"), ((lo <= 0) & (hi >= 0)).alias("includes_zero"))


#: Rates of the cluster bootstrap, out of daily tp, fn, fp, tn, error sum and rows.
RATES = {
    "miss_rate": ("fn", "tp + fn"), "false_positive_rate": ("fp", "fp + tn"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "mae": ("esum", "n"),
}


def cluster_rates(df: DataFrame, keep: Column, draws: DataFrame, y: str = "y_cls", p: str = "pred_cls", err: Column | None = None, day: str = "day") -> DataFrame:
    """rate, low, high, n_valid: limits of the rates of the rows that `keep` holds for, over draws of all days, also those without such rows."""
    yes, said = F.col(y) == 1, F.col(p) == 1
    n = lambda c: F.sum((keep & c).cast("long"))
    sums = {"tp": n(yes & said), "fn": n(yes & ~said), "fp": n(~yes & said), "tn": n(~yes & ~said), "esum": F.sum(F.when(keep, err if err is not None else F.lit(0.0)).otherwise(0.0)), "n": n(F.lit(True))}
    reps = replicates(df, sums, draws, day)
    long = reps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.expr(f"try_divide(cast({a} as double), {b})").alias("v")) for k, (a, b) in RATES.items()))).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("rate").agg(q.alias("q"), F.count("v").alias("n_valid")).select("rate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_valid")
