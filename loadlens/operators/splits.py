"""Rows for training and evaluation: predicates, folds, deduplicated days, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.schemas import all_true

MASKS = ("is_warmup", "is_outage", "is_erp_missing")


def usable() -> Column:
    """Rows to train on: no warm-up, outage or missing records."""
    return ~F.col("is_warmup") & ~F.col("is_outage") & ~F.col("is_erp_missing")


def evaluable() -> Column:
    """Rows to evaluate on out of fold; warm-up rows count."""
    return ~F.col("is_outage") & ~F.col("is_erp_missing")


def finite(columns: list[str]) -> Column:
    return all_true([F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns])


def valid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(finite(columns) & usable())


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """fold and role for every row and fold: train up to train_end, validation within val_start to val_end; a gap has no role.

    folds has a row for each fold, of which there are a few, so the range join broadcasts it.
    """
    f = F.broadcast(folds)
    role = F.when(F.col("day") <= F.col("train_end"), "train").when(F.col("day").between(F.col("val_start"), F.col("val_end")), "val")
    on = (df["day"] <= f["train_end"]) | df["day"].between(f["val_start"], f["val_end"])
    return df.join(f, on).withColumn("role", role).drop("train_end", "val_start", "val_end")


def role_of_day(core_end: str, cal_start: str, cal_end: str, eval_start: str, eval_end: str) -> Column:
    """core, calibration, evaluation or null for ts in half-open intervals with gaps between them."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    ts = F.col("ts")
    return F.when(ts < t(core_end), "core").when((ts >= t(cal_start)) & (ts < t(cal_end)), "calibration").when((ts >= t(eval_start)) & (ts < t(eval_end)), "evaluation")


def partition_bounds(eval_start: str, core_gap_days: int = 1, cal_days: int = 15, eval_days: int = 14) -> dict[str, str]:
    """The bounds around an evaluation start: a calibration tail of cal_days before it and a day's gap before either."""
    import datetime as dt

    start = dt.date.fromisoformat(eval_start)
    day = lambda n: f"{start + dt.timedelta(days=n)} 00:00:00"
    return {"core_end": day(-cal_days - core_gap_days), "cal_start": day(-cal_days), "cal_end": day(0 - 0), "eval_start": day(0), "eval_end": day(eval_days)}


def inner_partitions(first_day: str, core_end: str, most: int, days: int, cal_days: int, gap_days: int = 1, least_core: int = 30) -> list[dict[str, str]]:
    """Bounds of up to `most` evaluation windows of `days` days that end one after another at the core's end, oldest first.

    Each has its own gap and calibration tail; windows whose own core is shorter than least_core days are left out.
    """
    import datetime as dt

    end, first = dt.date.fromisoformat(core_end[:10]), dt.date.fromisoformat(first_day)
    starts = [end - dt.timedelta(days=(k + 1) * days) for k in reversed(range(most))]
    made = [partition_bounds(str(s), gap_days, cal_days, days) for s in starts]
    return [b for b in made if (dt.date.fromisoformat(b["core_end"][:10]) - first).days >= least_core]


def profile_novelty(df: DataFrame, bounds: dict[str, str]) -> DataFrame:
    """site_id, day, seen_in_core of evaluation days of 24 whole hours, and the core's days, distinct profiles and repeated days of the site.

    Looks at targets, so it belongs after the scoring.
    """
    whole = F.count(F.when(F.col("y_avg").isNotNull() & F.col("y_peak").isNotNull(), 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "y_avg", "y_peak"))), lambda x: F.concat_ws(",", x["y_avg"].cast("string"), x["y_peak"].cast("string")))
    days = df.groupBy("site_id", "day").agg(F.count("*").alias("n"), whole.alias("w"), F.md5(F.concat_ws(";", listed)).alias("h"), F.min("ts").alias("ts")).filter("n = 24 and w = 24")
    role = days.withColumn("role", role_of_day(**bounds))
    core = role.filter("role = 'core'")
    sizes = core.groupBy("site_id").agg(F.count("*").alias("core_days"), F.count_distinct("h").alias("core_profiles"))
    seen = core.select("site_id", "h").distinct().withColumn("__seen", F.lit(True))
    out = role.filter("role = 'evaluation'").join(seen, ["site_id", "h"], "left").join(sizes, "site_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("site_id", "day", F.coalesce("__seen", F.lit(False)).alias("seen_in_core"), n("core_days").alias("core_days"), n("core_profiles").alias("core_profiles"), (n("core_days") - n("core_profiles")).alias("core_repeats"))


def profile_hash(df: DataFrame, order: str = "row_seq") -> DataFrame:
    """site_id, day, profile_hash of the day's readings in physical order; a day is at most a few dozen rows."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "p15", "p30", "p45", "p60"))), lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("p15", "p30", "p45", "p60"))))
    return df.groupBy("site_id", "day").agg(F.md5(F.concat_ws(";", listed)).alias("profile_hash"))


def duplicate_profiles(profiles: DataFrame) -> DataFrame:
    """profile_hash, n_days, first_day, last_day of profiles that more than one day has."""
    return profiles.groupBy("profile_hash").agg(F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).filter("n_days > 1")


def dedup_days(profiles: DataFrame) -> DataFrame:
    """The earliest day of each profile of a site."""
    return profiles.groupBy("site_id", "profile_hash").agg(F.min("day").alias("day")).select("site_id", "day")


def condition(df: DataFrame, name: str, profiles: DataFrame) -> DataFrame:
    """D1: all rows; D2: those of deduplicated days."""
    if name == "D1":
        return df
    if name == "D2":
        return df.join(dedup_days(profiles), ["site_id", "day"], "left_semi")
    raise ValueError(f"unknown condition {name}")


def contamination(profiles: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, n_val_days, n_seen: validation days whose profile some training day has."""
    rows = fold_rows(profiles, folds)
    train = rows.filter("role = 'train'").select("fold", "profile_hash").distinct().withColumn("seen", F.lit(1))
    val = rows.filter("role = 'val'")
    return val.join(train, ["fold", "profile_hash"], "left").groupBy("fold").agg(F.count("*").alias("n_val_days"), F.coalesce(F.sum("seen"), F.lit(0)).alias("n_seen"))


def split_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, exclusions, masks, positives and an order-free digest for each split."""
    digest = F.sum(F.xxhash64("site_id", "ts", "y_peak").cast("decimal(38,0)")).cast("string")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(usable().cast("long")).alias("n_usable"), *(F.sum(F.col(c).cast("long")).alias(f"n_{c[3:]}") for c in MASKS), F.sum(F.coalesce("y_cls", F.lit(0)).cast("long")).alias("n_pos"), digest.alias("digest"))


def frame_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and a digest that doesn't depend on row order or partitions."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def conditions(df: DataFrame, high: float) -> DataFrame:
    """A row for each row and condition that holds; the twelve conditions overlap."""
    h = F.hour("ts")
    named = {
        "all": F.lit(True), "production_zero": F.col("prod") == 0, "production_positive": F.col("prod") > 0, "production_high": F.col("prod") > high, "hour_08": h == 8, "hour_13": h == 13, "hour_17_18": h.isin(17, 18),
        "daytime_09_17": h.between(9, 17), "nighttime": ~h.between(9, 17), "shutdown": F.col("is_shutdown") == 1, "operating": F.col("is_shutdown") == 0, "first_day_after_shutdown": F.col("is_first_day_back") == 1,
    }
    return df.withColumn("condition", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))))


def evenly_spaced(days: DataFrame, n: int, order: str = "day") -> DataFrame:
    """n rows at equal steps from the first to the last, as whole positions of a linear space."""
    w = Window.partitionBy("site_id").orderBy(order)
    rows = days.withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy("site_id"))})
    if n == 1:
        return rows.filter("__r = 0").drop("__r", "__n")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (n - 1)))
    return rows.filter(F.array_contains(at, F.col("__r").cast("long"))).drop("__r", "__n")


def seeded_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows by the order of a hash of their key: the same ones at any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
