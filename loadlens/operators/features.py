"""Day-ahead features: everything about day D + 1 is known at 24:00 of day D."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.windows import lags, rolling, series
from loadlens.schemas import all_true

# Lags and windows in hours, and the contract's features by group, in its order.
LAGS = (24, 48, 168)
WINDOWS = (24, 168)
GROUPS = {
    "past_power": tuple(f"{c}_lag{n}" for c in ("y_avg", "y_peak") for n in LAGS),
    "rolling": ("roll24_avg_mean", "roll24_avg_max", "roll24_avg_std", "roll24_peak_max", "roll24_peak_cnt", "roll168_avg_mean", "roll168_avg_max", "roll168_avg_std", "roll168_peak_max", "roll168_peak_cnt"),
    "time": ("hour", "dow", "month", "is_sat", "is_sun", "is_holiday", "hour_sin", "hour_cos", "dow_sin", "dow_cos"),
    "process": ("is_daytime", "is_startup_08", "is_restart_13", "is_shutdown", "shutdown_nth", "is_first_day_back", "prev_day_shutdown", "is_state_switch"),
    "production": ("prod", "headcount", "prod_chg_ratio", "prod_cum_day"),
    "weather": ("temp", "humid", "wind", "rain", "cdd", "hdd"),
}
FEATURES = tuple(c for g in GROUPS.values() for c in g)


def calendar_features(df: DataFrame, cal: DataFrame, holidays: DataFrame) -> DataFrame:
    """Time of day, week and year, and the day's state from the calendar. The calendar has a row a day, so it is joined as it is."""
    hour, dow, pi2 = F.hour("ts"), F.weekday("ts"), 2 * F.pi()
    flags = {c: F.col(s).cast("int") for c, s in (("is_shutdown", "is_shutdown"), ("is_first_day_back", "is_back"), ("prev_day_shutdown", "prev_day_shutdown"), ("is_state_switch", "is_state_switch"))}
    days = cal.select("site_id", "day", "shutdown_nth", *(v.alias(k) for k, v in flags.items()))
    off = holidays.select("day").distinct().withColumn("is_holiday", F.lit(1))
    return (
        df.join(days, ["site_id", "day"], "left").join(F.broadcast(off), "day", "left")
        .withColumns({
            "hour": hour, "dow": dow, "month": F.month("ts"), "is_sat": (dow == 5).cast("int"), "is_sun": (dow == 6).cast("int"), "is_holiday": F.coalesce("is_holiday", F.lit(0)),
            "hour_sin": F.sin(pi2 * hour / 24), "hour_cos": F.cos(pi2 * hour / 24), "dow_sin": F.sin(pi2 * dow / 7), "dow_cos": F.cos(pi2 * dow / 7),
            "is_daytime": hour.between(9, 17).cast("int"), "is_startup_08": (hour == 8).cast("int"), "is_restart_13": (hour == 13).cast("int"),
        })
    )


def origin_stats(df: DataFrame, theta: float) -> DataFrame:
    """site_id, origin_day and the statistics of the last 24 and 168 hours as of its 24:00; null until a window is full."""
    w, cols = series(), {}
    peak = F.when(F.col("y_peak").isNotNull(), (F.col("y_peak") >= theta).cast("double")).otherwise(0.0)
    for n in WINDOWS:
        cols |= {f"roll{n}_avg_mean": rolling(F.avg, F.col("y_avg"), n, w), f"roll{n}_avg_max": rolling(F.max, F.col("y_avg"), n, w), f"roll{n}_avg_std": rolling(F.stddev_samp, F.col("y_avg"), n, w), f"roll{n}_peak_max": rolling(F.max, F.col("y_peak"), n, w), f"roll{n}_peak_cnt": rolling(F.sum, peak, n, w)}
    return df.select("site_id", F.col("day").alias("origin_day"), F.hour("ts").alias("__h"), *(v.alias(k) for k, v in cols.items())).filter("__h = 23").drop("__h")


def with_origin(df: DataFrame, origin: DataFrame) -> DataFrame:
    """The statistics of the day before, the same for all hours of a day."""
    shifted = origin.withColumn("day", F.date_add("origin_day", 1)).drop("origin_day")
    return df.join(shifted, ["site_id", "day"], "left")


def production_weather(df: DataFrame) -> DataFrame:
    """Plan and weather terms; a change against nothing, or against zero, is 0."""
    before = F.lag("prod", 24).over(series())
    today = Window.partitionBy("site_id", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return df.withColumns({
        "prod_chg_ratio": F.coalesce(F.try_divide(F.col("prod") - before, F.nullif(before, F.lit(0.0))), F.lit(0.0)),
        "prod_cum_day": F.sum("prod").over(today), "cdd": floor0(F.col("temp") - 24), "hdd": floor0(18 - F.col("temp")),
    })


def build_features(df: DataFrame, cal: DataFrame, theta: float, holidays: DataFrame) -> DataFrame:
    """All features and is_warmup (any of them null); nothing runs until an action asks, and unused ones are pruned."""
    out = lags(calendar_features(df, cal, holidays), ("y_avg", "y_peak"), LAGS, series())
    out = with_origin(production_weather(out), origin_stats(df, theta))
    return out.withColumn("is_warmup", ~all_true([F.col(c).isNotNull() for c in FEATURES]))


def completion_check(lag_hours: tuple[int, ...] = LAGS):
    """(hour, lag) pairs whose value isn't complete at the origin: of hour h, lag k ends at h - k + 1, which must not be over 0."""
    return [(h, k) for h in range(24) for k in lag_hours if h - k + 1 > 0]


def future_blind(df: DataFrame, cal: DataFrame, theta: float, holidays: DataFrame, day: str, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows of a day whose features change when power from that day on is unknown; empty if nothing leaks."""
    cut = F.lit(day).cast("date")
    power = ("p15", "p30", "p45", "p60", "avg", "y_avg", "y_peak")
    blind = df.withColumns({c: F.when(F.col("day") < cut, F.col(c)) for c in power})
    rows = [build_features(x, cal, theta, holidays).filter(F.col("day") == cut).select("site_id", "ts", *(F.round(F.col(c).cast("double"), 9).alias(c) for c in columns)) for x in (df, blind)]
    return rows[0].exceptAll(rows[1]).unionByName(rows[1].exceptAll(rows[0]))
