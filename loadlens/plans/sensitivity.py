"""A bundle under perturbed plans: predictions of every scenario and day in one job, and an audit that the base scenario changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.errors import PredictionError
from loadlens.operators import features, opcal
from loadlens.plans import policy, serving
from loadlens.sources import io

BASE = "C0"
_PLAN = ("site_id", "ts", "day", "prod", "headcount", "temp", "wind", "humid", "rain")


def scenario_features(df: DataFrame, days: DataFrame, grid: DataFrame, served: serving.Served, history_days: int = 62) -> DataFrame:
    """scenario, target and the features of each target day's hours (days: a table with `day`), a row for each scenario of the grid.

    Plans are perturbed, histories are as they were: what a scenario changes on one day is no other day's past. Scenario, site and
    day name a series, so all run in one job. Days that the holidays don't cover give no row.
    """
    targets = days.select(F.col("day").alias("target")).distinct().filter(served.cover.covers(F.col("target")))
    named = df.withColumn("target", F.explode(F.sequence(F.col("day"), F.date_add("day", history_days)))).join(targets, "target", "left_semi")
    hours = named.filter("day = target").select(*_PLAN, F.hour("ts").alias("hour"))
    moved = policy.perturb(hours.select("site_id", "day", "hour", "prod", "headcount", "temp"), grid)
    rest = hours.select("site_id", "day", "hour", "ts", "wind", "humid", "rain")
    key = lambda target: F.struct("site_id", F.col(target).alias("target"), "scenario")
    plan = moved.join(rest, ["site_id", "day", "hour"]).withColumn("site_id", key("day")).select(*_PLAN)
    # The grid has a few rows.
    past = named.filter("day < target").crossJoin(F.broadcast(grid.select("scenario"))).withColumn("site_id", key("target")).drop("target", "scenario")
    both = serving.join_history_plan(past, plan, served.power_floor)
    made = features.build_features(both, opcal.operating_calendar(both, served.edges), served.theta, io.holidays(df.sparkSession, days=list(served.holidays)))
    made = made.withColumns({"scenario": F.col("site_id.scenario"), "target": F.col("site_id.target")}).filter("day = target")
    return made.withColumn("site_id", F.col("site_id.site_id"))


def scenario_predictions(df: DataFrame, days: DataFrame, grid: DataFrame, served: serving.Served, predict: Callable[[DataFrame], DataFrame], history_days: int = 62) -> DataFrame:
    """scenario and serving.OUTPUT for every scenario, day and site. predict may add any model's values: it is the bundle's own stage."""
    rows = predict(serving._without_gaps(scenario_features(df, days, grid, served, history_days)))
    # One name for scenario and site through the output's assembly.
    named = rows.withColumn("site_id", F.struct("scenario", "site_id"))
    out = serving.assemble(named, served.tau, served.tau_cls, list(served.knots), served.halfwidth)
    return out.select("site_id.scenario", "site_id.site_id", *serving.OUTPUT[1:])


def audit(predictions: DataFrame, stored: DataFrame, atol: float = 1e-8) -> DataFrame:
    """site_id, ts, reason of each row of the base scenario that isn't what was stored: missing on one side, repeated, or off by more than atol; empty if all agree."""
    from loadlens.plans.compare import compare

    own = predictions.filter(F.col("scenario") == BASE).drop("scenario")
    numeric = [c for c in serving.OUTPUT if c not in ("site_id", "ts")]
    return compare(stored.select(*serving.OUTPUT), own.select(*serving.OUTPUT), ["site_id", "ts"], dict.fromkeys(numeric, "numeric"), atol=atol, rtol=0.0)


def audited(predictions: DataFrame, stored: DataFrame, atol: float = 1e-8) -> DataFrame:
    """The predictions, written and read again; PredictionError if the base scenario isn't what was stored."""
    held = io.materialize(predictions, "scenario-predictions")
    if bad := audit(held, stored, atol).limit(3).collect():
        raise PredictionError("NOT_INVARIANT", ", ".join(f"{r['key']} {r['column']}: {r['reason']}" for r in bad))
    return held


def effects(predictions: DataFrame) -> DataFrame:
    """scenario, site_id, n, mean_change, largest_rise, hours_changed, alarms_gained, alarms_lost against the base scenario."""
    base = predictions.filter(F.col("scenario") == BASE).select("site_id", "ts", F.col("y_avg_pred").alias("b"), F.col("peak_label").alias("bl"))
    both = predictions.join(base, ["site_id", "ts"]).withColumn("d", F.col("y_avg_pred") - F.col("b"))
    gained, lost = (F.col("peak_label") == 1) & (F.col("bl") == 0), (F.col("peak_label") == 0) & (F.col("bl") == 1)
    return both.groupBy("scenario", "site_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean_change"), F.max("d").alias("largest_rise"), F.count_if(F.abs("d") > 1e-9).alias("hours_changed"), F.count_if(gained).alias("alarms_gained"), F.count_if(lost).alias("alarms_lost"))
