"""Operating calendar: one row for each site and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators.windows import runs, series, with_run

REGIME_EDGES = (30.0, 70.0)


def daily_regime(x, edges: tuple[float, float] = REGIME_EDGES):
    """0 base, 1 middle, 2 running; right-closed, as daily means are cut. Null stays null."""
    return F.when(x <= edges[0], 0).when(x <= edges[1], 1).when(x.isNotNull(), 2)


def hourly_regime(x, edges: tuple[float, float] = REGIME_EDGES):
    """0, 1, 2; left-closed, as hourly targets are cut. Null stays null."""
    return F.when(x < edges[0], 0).when(x < edges[1], 1).when(x.isNotNull(), 2)


def operating_calendar(df: DataFrame, edges: tuple[float, float] = REGIME_EDGES) -> DataFrame:
    """site_id, day, prod_sum, power_mean, the day's flags, dow (0 Monday), is_shutdown, regime, shutdown_nth, is_back.

    A day is shut when it produces nothing and its records aren't missing; power plays no part.
    """
    cal = df.groupBy("site_id", "day").agg(F.sum("prod").alias("prod_sum"), F.avg("y_avg").alias("power_mean"), F.bool_or("is_erp_missing").alias("is_erp_missing"), F.bool_or("is_aug_inconsistent").alias("is_aug_inconsistent"))
    cal = cal.withColumns({"dow": F.weekday("day"), "is_shutdown": (F.col("prod_sum") == 0) & ~F.col("is_erp_missing"), "regime": daily_regime(F.col("power_mean"), edges)})
    cal = with_run(cal, "is_shutdown", "shutdown_nth", "day", "site_id")
    before = F.lag("is_shutdown").over(series("day", "site_id"))
    # The first day of a series counts as a switch and its day before as open.
    return cal.withColumns({"is_back": ~F.col("is_shutdown") & F.coalesce(before, F.lit(False)), "prev_day_shutdown": F.coalesce(before, F.lit(False)), "is_state_switch": F.coalesce(before != F.col("is_shutdown"), F.lit(True))})


def long_shutdowns(cal: DataFrame, least: int = 3) -> DataFrame:
    """site_id, start, end, n of runs of `least` shut days or more."""
    return runs(cal, "is_shutdown", "day", "site_id", least=least)


def holiday_audit(cal: DataFrame, holidays: DataFrame, over: float = 0.8) -> DataFrame:
    """For each site and listed day: power against the median of open weekdays, and a verdict from power and production together."""
    median = cal.filter((F.col("dow") < 5) & ~F.col("is_shutdown")).groupBy("site_id").agg(F.percentile("power_mean", F.lit(0.5)).alias("weekday_median"))
    rows = cal.join(F.broadcast(holidays.select(F.col("day"))), "day", "left_semi").join(median, "site_id", "left").withColumn("ratio", F.try_divide("power_mean", "weekday_median"))
    verdict = F.when((F.col("prod_sum") == 0) & (F.col("ratio") > over), "holiday_power_overwritten").when(F.col("prod_sum") == 0, "holiday").otherwise("open")
    return rows.select("site_id", "day", "dow", "power_mean", "ratio", "prod_sum", "is_aug_inconsistent", verdict.alias("verdict"))
