"""Gates: checks of a chapter's table that are counted while the table is written, so that they cost no scan of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loadlens.errors import LoadlensError
from loadlens.operators.features import FEATURES, LAGS, completion_check
from loadlens.schemas import POWER
from loadlens.sources.io import materialize


@dataclass(frozen=True)
class Check:
    """A row breaks it where `wrong` is true; null is no breach. A hard one stops the chapter, others only warn."""

    name: str
    wrong: Column
    hard: bool = True


class GateError(LoadlensError):
    """Hard checks of a gate didn't pass; facts has how many rows broke each."""


def through(df: DataFrame, gate: str, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """The table as written, and gate, check, severity, n, n_wrong, passed of each check; both from one pass over df.

    The counts are observed in the stage that writes, whose tasks count once each, however often one is tried. An empty table passes.
    """
    seen = Observation(gate)
    counts = [F.coalesce(F.count_if(F.coalesce(c.wrong, F.lit(False))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(checks)]
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *counts), gate)
    got = seen.get
    rows = [(gate, c.name, "hard" if c.hard else "warn", got["n"], got[f"c{i}"], got[f"c{i}"] == 0) for i, c in enumerate(checks)]
    return out, df.sparkSession.createDataFrame(rows, "gate string, check string, severity string, n long, n_wrong long, passed boolean")


def passed(df: DataFrame, gate: str, checks: list[Check]) -> DataFrame:
    """The table as written; GateError with the names of the hard checks that it breaks, if there are any."""
    out, table = through(df, gate, checks)
    if bad := table.filter("severity = 'hard' and not passed").collect():  # a row a check
        raise GateError("GATE_FAILED", f"{gate}: {', '.join(r['check'] for r in bad)}", **{r["check"]: r["n_wrong"] for r in bad})
    return out


def repair_checks() -> list[Check]:
    """Of repaired hours: the first chapter."""
    known = F.col("y_avg").isNotNull() & F.col("y_peak").isNotNull()
    return [
        Check("targets_known", ~known & ~F.col("is_outage")), Check("hour_of_timestamp", F.col("hour") != F.hour("ts")), Check("day_of_timestamp", F.col("day") != F.to_date("ts")),
        Check("peak_not_under_mean", F.col("y_peak") < F.floor(F.col("y_avg") - 0.5)), Check("no_negative_power", F.least(*POWER) < 0), Check("weather_known", F.col("wind").isNull() | F.col("rain").isNull(), False),
    ]


def feature_checks(columns: tuple[str, ...] = FEATURES, blind: str | None = None) -> list[Check]:
    """Of features: the second chapter, against leaks. `blind` names a column that is true where an hour's features change with the future."""
    static = {
        "complete_at_origin": bool(completion_check(LAGS)), "no_power_of_the_hour": bool({*POWER, "avg", "y_avg", "y_peak"} & set(columns)),
        "no_repeated_columns": len(set(columns)) != len(columns),
    }
    whole = F.lit(False)
    for c in columns:
        whole = whole | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    made = [Check(n, F.lit(wrong)) for n, wrong in static.items()] + [Check("usable_rows_are_whole", ~F.col("is_warmup") & whole)]
    return made + ([Check("future_blind", F.col(blind))] if blind else [])


def fold_checks() -> list[Check]:
    """Of rows with fold and role, and the folds' own days: the fourth chapter, against training on what comes later."""
    train = F.col("role") == "train"
    return [
        Check("trained_on_the_past", train & (F.col("day") >= F.col("val_start"))), Check("a_day_between", train & (F.date_add("day", 1) >= F.col("val_start"))),
        Check("validated_within", (F.col("role") == "val") & ~F.col("day").between(F.col("val_start"), F.col("val_end"))), Check("class_known", F.col("y_cls").isNull()),
    ]


def result_checks(baseline: str, model: str, calendar_fp: int) -> list[Check]:
    """Of one row a model with mae, base_mae, ci_low and fp: the sixth chapter. The last two only warn."""
    final = F.col("model") == model
    return [
        Check("better_than_" + baseline, final & ~(F.col("mae") < F.col("base_mae"))), Check("counts_add_up", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") != F.col("n")),
        Check("significant", final & ~(F.col("ci_low") > 0), False), Check("fewer_alarms_than_calendar", final & (F.col("fp") >= calendar_fp), False),
    ]
