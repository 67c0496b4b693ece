"""From raw rows to a repaired hourly series; repairs use past values only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.windows import ffill, series
from loadlens.schemas import POWER

#: Mean power of a day from which a day without production counts as running; labour factor of a day without records.
POWER_FLOOR, LABOR_LOST = 70.0, 1.5


def restore_hours(df: DataFrame, keys: tuple[str, ...] = ("site_id", "day")) -> DataFrame:
    """Hours 0 to 23 by physical row order (row_seq) on days with any hour out of range; hour_broken marks those days.

    Such a day of another number of rows than 24 can't be restored and fails.
    """
    day = Window.partitionBy(*keys)
    bad = F.max((~F.col("hour").between(0, 23) | F.col("hour").isNull()).cast("int")).over(day) == 1
    place = F.row_number().over(day.orderBy("row_seq")) - 1
    rows = F.count("*").over(day)
    return df.withColumn("hour_broken", bad).withColumn("hour", F.when(~F.col("hour_broken"), F.col("hour")).when(rows == 24, place).otherwise(F.raise_error(F.concat(F.lit("HOURS_NOT_RESTORABLE: rows of the day: "), rows.cast("string"))).cast("int")))


def flag(df: DataFrame, power_floor: float = POWER_FLOOR) -> DataFrame:
    """Adds is_outage, is_erp_missing, is_aug_inconsistent; the day's mean power is that before any repair, zeros included."""
    day = Window.partitionBy("site_id", "day")
    idle = (F.sum("prod").over(day) == 0) & (F.avg("avg").over(day) >= power_floor)
    lost = F.min("labor").over(day) == LABOR_LOST
    return df.withColumns({"is_outage": F.col("avg") == 0, "is_erp_missing": idle & lost, "is_aug_inconsistent": idle & ~lost})


def repair(df: DataFrame, power_floor: float = POWER_FLOOR) -> DataFrame:
    """Flags, then: readings of outages, wind and headcount from the last valid past value, rain 0, and avg rebuilt for all rows.

    Null readings are skipped in the rebuilt mean; a series that opens with an outage has nulls there.
    """
    w = series()
    df = flag(df, power_floor)
    df = df.withColumns({c: ffill(F.when(~F.col("is_outage"), F.col(c)), w) for c in POWER} | {c: ffill(F.col(c), w) for c in ("wind", "headcount")})
    known = F.filter(F.array(*POWER), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return df.withColumns({"avg": F.floor(mean + 0.5).cast("double"), "rain": F.coalesce("rain", F.lit(0.0))})


def targets(df: DataFrame, theta: float | None = None) -> DataFrame:
    """Adds y_avg, y_peak (the largest of the four readings) and, with a threshold, y_cls."""
    df = df.withColumns({"y_avg": F.col("avg"), "y_peak": F.greatest(*POWER)})
    return df if theta is None else df.withColumn("y_cls", (F.col("y_peak") >= theta).cast("int"))


def repair_log(df: DataFrame) -> DataFrame:
    """item, n: what repair() changes in a flagged raw table."""
    counts = df.agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("outage", F.col("is_outage")), ("erp_missing", F.col("is_erp_missing")), ("aug_inconsistent", F.col("is_aug_inconsistent")), ("rain_null", F.col("rain").isNull()), ("wind_null", F.col("wind").isNull()), ("headcount_null", F.col("headcount").isNull()))))
    return counts.unpivot([], counts.columns, "item", "n")
