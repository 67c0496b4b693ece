"""Day-ahead serving: features of one target day from history and plan, replay over many days, and model bundles.

Training and serving share one feature path. Repairs see the history only; plan rows come with unknown power.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.errors import BundleError, InputError, PredictionError
from loadlens.functions.stats import interpolate
from loadlens.operators import features, opcal, repair
from loadlens.operators.splits import finite
from loadlens.operators.windows import ffill, series
from loadlens.sources import io

OUTPUT = ("site_id", "ts", "y_avg_pred", "y_peak_pred", "regime", "peak_label", "peak_prob", "peak_prob_cal", "peak_label_cls", "q10", "q50", "q90", "pi_lo", "pi_hi")
POWER_COLUMNS = (*schemas.POWER, "avg", "y_avg", "y_peak")


def check_grid(history: DataFrame, target: str, min_days: int, max_days: int | None = None) -> DataFrame:
    """site_id, code of sites whose history isn't whole hours from 00:00 to 23:00 of the day before the target; empty if all are."""
    end = F.lit(f"{target} 00:00:00").cast("timestamp_ntz") - F.expr("interval 1 hour")
    g = history.groupBy("site_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = F.timestamp_diff("HOUR", "a", "b") + 1
    code = F.when(F.col("n") != F.col("d"), "duplicate_hours").when(F.col("b") != end, "wrong_end").when(F.hour("a") != 0, "partial_first_day").when(hours != F.col("n"), "missing_hours").when(F.col("n") < 24 * min_days, "too_short")
    if max_days is not None:
        code = code.when(F.col("n") > 24 * max_days, "too_long")
    return g.select("site_id", code.alias("code")).filter("code is not null")


def check_plan(plan: DataFrame, target: str) -> list[str]:
    """What is wrong with a plan's columns and days; the rows' values are schemas.violations()'s business."""
    wrong = [f"forbidden_column:{c}" for c in schemas.FORBIDDEN_IN_PLAN if c in plan.columns]
    wrong += [f"missing_column:{c}" for c in ("prod", "headcount", "temp", "wind", "humid", "rain") if c not in plan.columns]
    bad = plan.groupBy("site_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d"), F.min("day").alias("a"), F.max("day").alias("b")).filter(f"n <> 24 or d <> 24 or a <> date '{target}' or b <> date '{target}'")
    return wrong + (["not_one_day"] if bad.limit(1).count() else [])


def join_history_plan(history: DataFrame, plan: DataFrame, power_floor: float = repair.POWER_FLOOR) -> DataFrame:
    """The repaired history followed by the plan's rows, whose power is null and whose flags are false."""
    past = repair.targets(repair.repair(history, power_floor))
    ahead = plan.withColumns({c: F.lit(None).cast("double") for c in POWER_COLUMNS} | {c: F.lit(False) for c in ("is_outage", "is_erp_missing", "is_aug_inconsistent")} | {"rain": F.coalesce("rain", F.lit(0.0)), "hour": F.hour("ts"), "labor": F.when(F.hour("ts").between(9, 17), 1.0).otherwise(1.5)})
    both = past.unionByName(ahead.select(*past.columns))
    w = series()
    return both.withColumns({c: F.when(F.col("y_avg").isNull() | F.col(c).isNotNull(), ffill(F.col(c), w)) for c in ("wind", "headcount")})


def day_ahead_features(history: DataFrame, plan: DataFrame, target: str, theta: float, holidays: DataFrame, edges=opcal.REGIME_EDGES, power_floor: float = repair.POWER_FLOOR, min_days: int = 8, max_days: int | None = 62, strict: bool = True) -> DataFrame:
    """The features of the target day's hours. Strict: fails for a history or plan that breaks the contract, and when a feature of the day is null."""
    if strict:
        if wrong := check_plan(plan, target):
            raise InputError("PLAN_INVALID", ", ".join(wrong))
        if bad := check_grid(history, target, min_days, max_days).limit(5).collect():
            raise InputError("HISTORY_INVALID", ", ".join(f"{r['site_id']}: {r['code']}" for r in bad))
    df = join_history_plan(history, plan, power_floor)
    out = features.build_features(df, opcal.operating_calendar(df, edges), theta, holidays).filter(F.col("day") == F.lit(target).cast("date"))
    return _without_gaps(out) if strict else out


def replay(df: DataFrame, days: DataFrame, history_days: int, theta: float, holidays: DataFrame, edges=opcal.REGIME_EDGES, power_floor: float = repair.POWER_FLOOR) -> DataFrame:
    """Features of many target days (a table with `day`, a row each), each from its own window of history: windows become a key, so all days run in one job."""
    targets = days.select(F.col("day").alias("target")).distinct()
    # A day of history belongs to at most history_days targets: each row names them, and those that are wanted stay.
    named = df.withColumn("target", F.explode(F.sequence(F.col("day"), F.date_add("day", history_days))))
    rows = named.join(targets, "target", "left_semi")
    # A window of a site is a series of its own, named by both.
    keyed = rows.withColumn("site_id", F.struct("site_id", "target"))
    plan_columns = ("site_id", "ts", "day", "prod", "headcount", "temp", "wind", "humid", "rain")
    history, plan = keyed.filter("day < target").drop("target"), keyed.filter("day = target").select(*plan_columns)
    both = join_history_plan(history, plan, power_floor)
    feat = features.build_features(both, opcal.operating_calendar(both, edges), theta, holidays)
    return feat.withColumn("target", F.col("site_id.target")).filter("day = target").withColumn("site_id", F.col("site_id.site_id"))


@dataclass(frozen=True)
class HolidayCover:
    """Days for which the listed holidays are all there are: those from start to end, and whole years."""

    start: str
    end: str
    years: tuple[int, ...] = ()

    def covers(self, day: Column) -> Column:
        span = day.between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))
        return span | F.year(day).isin(*self.years) if self.years else span


@dataclass(frozen=True)
class Served:
    """What a bundle says besides its models: thresholds, calibration knots, half widths by the day's state, holidays and where they hold."""

    theta: float
    tau: float
    tau_cls: float
    knots: tuple[tuple[float, float], ...]
    halfwidth: dict[str, float]
    holidays: tuple[str, ...]
    cover: HolidayCover
    edges: tuple[float, float] = opcal.REGIME_EDGES
    power_floor: float = repair.POWER_FLOOR

    def as_settings(self) -> dict:
        """For a bundle's settings; from_settings() gives the same again."""
        return asdict(self)

    @classmethod
    def from_settings(cls, x: dict) -> Served:
        cover = HolidayCover(x["cover"]["start"], x["cover"]["end"], tuple(x["cover"]["years"]))
        return cls(**{**x, "cover": cover, "knots": tuple(map(tuple, x["knots"])), "holidays": tuple(x["holidays"]), "edges": tuple(x["edges"])})


def refused_days(days: DataFrame, cover: HolidayCover) -> DataFrame:
    """day, code: target days for which the holidays aren't known."""
    return days.select("day").distinct().filter(~cover.covers(F.col("day"))).select("day", F.lit("CALENDAR_NOT_COVERED").alias("code"))


def predict_days(df: DataFrame, days: DataFrame, served: Served, predict: Callable[[DataFrame], DataFrame], history_days: int = 62) -> DataFrame:
    """OUTPUT of all hours of the days (a table with `day`), each from what its own window of history and its plan say, in one job.

    predict adds y_avg_pred, y_peak_pred, prob, regime, q10, q50 and q90 to rows of features. Days that the holidays don't cover
    are refused: they give no row here and are listed by refused_days(). A null feature of a day that isn't fails the job.
    """
    listed = io.holidays(df.sparkSession, days=list(served.holidays))
    known = days.select("day").distinct().filter(served.cover.covers(F.col("day")))
    rows = replay(df, known, history_days, served.theta, listed, served.edges, served.power_floor)
    return assemble(predict(_without_gaps(rows)), served.tau, served.tau_cls, list(served.knots), served.halfwidth)


def predict_day(history: DataFrame, plan: DataFrame, target: str, served: Served, predict: Callable[[DataFrame], DataFrame], min_days: int = 8, max_days: int | None = 62) -> DataFrame:
    """OUTPUT of the 24 hours of one day for each site. InputError if the holidays don't cover it, or history or plan break the contract."""
    spark = history.sparkSession
    if refused_days(spark.createDataFrame([(target,)], "d string").select(F.to_date("d").alias("day")), served.cover).limit(1).count():
        raise InputError("CALENDAR_NOT_COVERED", f"no list of holidays covers {target}")
    listed = io.holidays(spark, days=list(served.holidays))
    rows = day_ahead_features(history, plan, target, served.theta, listed, served.edges, served.power_floor, min_days, max_days)
    return assemble(predict(rows), served.tau, served.tau_cls, list(served.knots), served.halfwidth)


def _without_gaps(rows: DataFrame) -> DataFrame:
    """The rows; one with a null feature fails when it is read."""
    return rows.withColumn("is_warmup", F.when(F.col("is_warmup"), F.raise_error(F.lit("FEATURE_INVALID: a feature of the target day is null"))).otherwise(False)).filter(~F.col("is_warmup"))


def assemble(df: DataFrame, tau: float, tau_cls: float, knots: list[tuple[float, float]], halfwidth: dict[str, float]) -> DataFrame:
    """The columns OUTPUT from y_avg_pred, y_peak_pred, prob, regime, q10, q50, q90 and is_shutdown; null, NaN and infinite predictions fail.

    Labels, the calibrated probability, and an interval that is floored at 0 and as wide as the day's state says.
    """
    q = F.when(F.col("is_shutdown") == 1, halfwidth["shutdown"]).otherwise(halfwidth["operating"])
    ok = finite(["y_avg_pred", "y_peak_pred", "prob", "regime", "q10", "q50", "q90"])
    avg = F.when(ok, F.col("y_avg_pred")).otherwise(F.raise_error(F.lit("PREDICTION_NONFINITE")).cast("double"))
    return df.select("site_id", "ts", avg.alias("y_avg_pred"), "y_peak_pred", F.col("regime").cast("int").alias("regime"), (F.col("y_peak_pred") >= tau).cast("int").alias("peak_label"), F.col("prob").alias("peak_prob"), interpolate(F.col("prob"), knots).alias("peak_prob_cal"), (F.col("prob") >= tau_cls).cast("int").alias("peak_label_cls"), "q10", "q50", "q90", F.greatest(F.col("y_avg_pred") - q, F.lit(0.0)).alias("pi_lo"), (F.col("y_avg_pred") + q).alias("pi_hi"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a folder: those of its files' bytes, each worked out where the file is read, folded in the order of their paths within it.

    A changed, added, removed or renamed file changes it; files that Spark hides (names that begin with _ or .) are no part of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    own = "/".join(path.rstrip("/").rsplit("/", 2)[1:])
    # A row a file; a model has some dozens.
    listed = files.select(F.regexp_extract("path", rf"^.*/{re.escape(own)}/(.*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256")).collect()
    return hashlib.sha256(io.dumps(sorted([r["name"], r["sha256"]] for r in listed)).encode()).hexdigest()


def write_bundle(spark: SparkSession, path: str, models: dict, settings: dict, golden: DataFrame, predictions: DataFrame) -> dict:
    """Spark ML models, settings, and a golden case with what the models say of it; all under one digest."""
    for name, m in models.items():
        PipelineModel([m]).write().overwrite().save(f"{path}/models/{name}")
    io.write_snapshot({"golden": golden, "predictions": predictions}, f"{path}/case")
    core = {"models": {name: folder_digest(spark, f"{path}/models/{name}") for name in sorted(models)}, "settings": io.json_safe(settings), "case": io.read_json(spark, f"{path}/case/manifest.json")["sha256"]}
    core["sha256"] = hashlib.sha256(io.dumps(core).encode()).hexdigest()
    io.write_json(spark, f"{path}/manifest.json", core)
    return core


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, dict, DataFrame, DataFrame]:
    """models, settings, golden case, its predictions; BundleError if anything isn't what was written."""
    try:
        core = io.read_json(spark, f"{path}/manifest.json")
        want = core.pop("sha256")
        if hashlib.sha256(io.dumps(core).encode()).hexdigest() != want:
            raise BundleError("MANIFEST_CHANGED", path)
        case = io.read_snapshot(spark, f"{path}/case")
        if io.read_json(spark, f"{path}/case/manifest.json")["sha256"] != core["case"]:
            raise BundleError("CASE_CHANGED", path)
        for name, digest in core["models"].items():
            if folder_digest(spark, f"{path}/models/{name}") != digest:
                raise BundleError("MODEL_CHANGED", f"{path}/models/{name}")
        return {n: PipelineModel.load(f"{path}/models/{n}").stages[0] for n in core["models"]}, core["settings"], case["golden"], case["predictions"]
    except BundleError:
        raise
    except Exception as e:
        raise BundleError("BUNDLE_INVALID", str(e)[:200]) from e


def self_test(predicted: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-9) -> None:
    """Fails if the reloaded models say anything else of the golden case."""
    from loadlens.plans.compare import compare

    diff = compare(expected.select(*keys, *columns), predicted.select(*keys, *columns), keys, dict.fromkeys(columns, "numeric"), atol=0.0, rtol=rtol)
    if bad := diff.limit(3).collect():
        raise PredictionError("SELF_TEST", str([(r["key"], r["column"], r["reason"]) for r in bad]))
