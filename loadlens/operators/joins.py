"""Joins with the checks and the search rules that plain joins lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails, when it runs, if a key repeats on either side."""
    def unique(df: DataFrame, side: str) -> DataFrame:
        n = df.groupBy(*on).agg(F.count("*").alias("__n"))
        again = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{side} key repeats: "), F.concat_ws("/", *(F.col(c).cast("string") for c in on))))).otherwise(F.lit(True))
        return df.join(n.select(*on, again.alias("__ok")), on).filter("__ok").drop("__ok")

    return unique(left, "left").join(unique(right, "right"), on, how)


def status_matched_lag(df: DataFrame, cal: DataFrame, value: str, lag_hours: int, step_days: int, most_steps: int) -> DataFrame:
    """site_id, ts, matched, walked: the value at the same hour of the nearest earlier day whose shutdown status is the row's own.

    Days are tried lag_hours back and then step_days apart; walked counts the steps, -1 where none matched. The steps are
    few, and each is an equal-key join of days, so the cost is rows times steps and no row meets a whole series.
    """
    status = cal.select("site_id", F.col("day").alias("ref"), F.col("is_shutdown").alias("ref_status"))
    steps = F.sequence(F.lit(0), F.lit(most_steps))
    tried = cal.select("site_id", "day", "is_shutdown", F.posexplode(steps).alias("step", "__s")).withColumn("ref", F.date_sub("day", F.lit(lag_hours // 24) + F.col("step") * step_days))
    near = tried.join(status, ["site_id", "ref"]).filter("is_shutdown = ref_status").groupBy("site_id", "day").agg(F.min("step").alias("walked"), F.min_by("ref", "step").alias("ref"))
    values = df.select("site_id", F.col("day").alias("ref"), F.hour("ts").alias("h"), F.col(value).alias("matched"))
    rows = df.select("site_id", "ts", "day", F.hour("ts").alias("h")).join(near, ["site_id", "day"], "left").join(values, ["site_id", "ref", "h"], "left")
    return rows.select("site_id", "ts", "matched", F.coalesce("walked", F.lit(-1)).alias("walked"))


def paired(df: DataFrame, a: str, b: str, keys: list[str], model: str = "model") -> DataFrame:
    """keys, y, pred_a, pred_b for two models' rows of one long table; fails if their truths differ or a side lacks a row."""
    side = lambda name, s: df.filter(F.col(model) == name).select(*keys, F.col("y").alias(f"y_{s}"), F.col("pred").alias(f"pred_{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    same = F.col("y_a").eqNullSafe(F.col("y_b"))
    return both.withColumn("y", F.when(same, F.col("y_a")).otherwise(F.raise_error(F.lit("the models' rows differ")))).select(*keys, "y", "pred_a", "pred_b")


def inconsistent(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys and columns in which two tables disagree, nulls being equal to nulls; empty if they agree."""
    r = right.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    both = left.select(*keys, *columns).join(r, keys)
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns)))
    return both.select(*keys, F.explode(wrong).alias("column"))


def day_to_hours(df: DataFrame, daily: DataFrame) -> DataFrame:
    return df.join(daily, ["site_id", "day"], "left")


def grid(frames: list[DataFrame]) -> DataFrame:
    """All combinations of a few small literal tables."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out
