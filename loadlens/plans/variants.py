"""Studies of feature subsets: leaving out each feature, groups of them or the plan's information, against runs with noise added.

All variants of a fold and target are one spec of plans.trees with as many variants, so they share each histogram as long as
they split alike, and no row is read again for a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.features import FEATURES, GROUPS
from loadlens.operators.splits import evaluable, fold_rows, usable
from loadlens.plans import trees
from loadlens.sources.io import materialize

BASE = "all"
#: Runs with a column of noise besides all features; the largest change among them is the width of noise.
NULL_RUNS = 5
#: What recall may lose.
RECALL_SLACK = 0.01
# The calendar that follows from the day's production plan; with the production group, all that the plan tells.
PLAN = (*GROUPS["production"], "is_shutdown", "shutdown_nth", "is_first_day_back", "is_state_switch")
_ERRORS = ("mae", "peak_mae", "recall", "fold_std", "mae_normal_days")


def subsets(features: tuple[str, ...] = FEATURES, nulls: int = NULL_RUNS) -> dict[str, list[int]]:
    """By variant, the places of its features; null run i has the noise in place len(features) + i."""
    every = range(len(features))
    without = lambda gone: [i for i in every if features[i] not in gone]
    out = {BASE: list(every)} | {f"null:{i}": [*every, len(features) + i] for i in range(nulls)}
    out |= {f"feature:{c}": without({c}) for c in features}
    out |= {f"group:{g}": without(set(cs)) for g, cs in GROUPS.items() if without(set(cs)) != list(every)}
    out |= {f"lag:{n}": without({f"y_avg_lag{n}", f"y_peak_lag{n}"}) for n in (24, 48, 168)}
    return out | {"plan": without(set(PLAN))}


def out_of_fold(feat: DataFrame, folds: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = 16, nulls: int = NULL_RUNS, seed: int = 42, **forest) -> DataFrame:
    """variant, fold, site_id, ts, y_avg, y_peak, y_cls, pred_avg, pred_peak of all variants on the folds' validation rows."""
    rows = fold_rows(feat, folds)
    train = F.col("role") == "train"
    rows = rows.filter(F.when(train, usable()).otherwise(evaluable()))
    first = rows.filter(train).join(F.broadcast(folds.select(F.min("fold").alias("fold"))), "fold", "left_semi")
    noise = [(1 + F.pmod(F.xxhash64(F.lit(seed + 1 + i), "site_id", "ts"), F.lit(bins))).cast("byte") for i in range(nulls)]
    all_bins = F.concat(trees.binned(list(features), trees.edges_of(first, list(features), bins)), F.array(*noise)) if nulls else trees.binned(list(features), trees.edges_of(first, list(features), bins))
    targets = F.explode(F.array(*(F.struct(F.lit(k).alias("target"), F.when(train, F.col(t).cast("double")).alias("y")) for k, t in enumerate(("y_avg", "y_peak"))))).alias("t")
    given = rows.select("fold", "role", F.struct("site_id", "ts").alias("id"), all_bins.alias("bins"), targets).filter((F.col("role") == "val") | F.col("t.y").isNotNull())
    given = materialize(given.select((F.col("fold") * 2 + F.col("t.target")).alias("spec"), "id", "t.y", "bins"), "variant-rows")
    listed = feat.sparkSession.createDataFrame(list(subsets(features, nulls).items()), "variant string, features array<int>")
    made = trees.forests(given, given.select("spec").distinct().crossJoin(F.broadcast(listed)), seed=seed, **forest)
    of = lambda k: F.max(F.when(F.col("spec") % 2 == k, F.col("value")))
    wide = made.groupBy("variant", F.floor(F.col("spec") / 2).cast("int").alias("fold"), "id").agg(of(0).alias("pred_avg"), of(1).alias("pred_peak"))
    truth = rows.filter("role = 'val'").select("fold", "site_id", "ts", "day", "y_avg", "y_peak", "y_cls", "is_shutdown", "is_sat", "is_sun")
    return wide.select("variant", "fold", "id.*", "pred_avg", "pred_peak").join(truth, ["fold", "site_id", "ts"])


def summarized(rows: DataFrame, tau: float, normal: Column) -> DataFrame:
    """variant, n, mae, peak_mae, recall, fold_std, mae_normal_days and mae by fold (a map); normal says which rows are of normal days."""
    err, hit = F.abs(F.col("y_avg") - F.col("pred_avg")), F.col("y_cls") == 1
    by_fold = rows.groupBy("variant", "fold").agg(
        F.count("*").alias("n"), F.sum(err).alias("s"), F.sum(F.when(hit, err)).alias("ps"), F.count_if(hit).alias("p"), F.count_if(hit & (F.col("pred_peak") >= tau)).alias("tp"),
        F.sum(F.when(normal, err)).alias("ns"), F.count_if(normal).alias("nn"),
    )
    mae = F.col("s") / F.col("n")
    return by_fold.groupBy("variant").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mae"), F.try_divide(F.sum("ps"), F.sum("p")).alias("peak_mae"), F.try_divide(F.sum("tp"), F.sum("p")).alias("recall"),
        F.coalesce(F.stddev_samp(mae), F.lit(0.0)).alias("fold_std"), F.try_divide(F.sum("ns"), F.sum("nn")).alias("mae_normal_days"), F.map_from_entries(F.collect_list(F.struct("fold", mae.alias("mae")))).alias("folds"),
    )


def limits(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """variant, ci_low, ci_high: 95 % limits of the error of a variant minus that of all features, over draws (rep, place, times) of days.

    Days are reduced to a sum a variant first; a replicate joins tables of days.
    """
    err = F.abs(F.col("y_avg") - F.col("pred_avg"))
    days = rows.groupBy("variant", "day").agg(F.sum(err).alias("s"), F.count("*").alias("n"))
    base = days.filter(F.col("variant") == BASE).select("day", F.col("s").alias("b"), (F.row_number().over(Window.orderBy("day")) - 1).alias("place"))  # a row a day
    both = days.filter(F.col("variant") != BASE).join(base, "day")
    reps = both.join(draws, "place").groupBy("variant", "rep").agg((F.sum((F.col("s") - F.col("b")) * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("d"))
    return reps.groupBy("variant").agg(F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"))


def judged(table: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """summarized() with changes against all features, the noise's width and flags; `accepted` needs all of them.

    clear: the limits lie below 0 (only with limits); folds_hold, normal_days_hold: no fold and no normal days get worse by more than
    the noise; peaks_hold: recall loses at most RECALL_SLACK and the peaks' error no more than its noise; improved_folds counts the
    folds of a smaller error.
    """
    base = table.filter(F.col("variant") == BASE).select(*(F.col(c).alias(f"b_{c}") for c in (*_ERRORS, "folds")))  # one row
    out = table.crossJoin(F.broadcast(base)).withColumns({f"d_{c}": F.col(c) - F.col(f"b_{c}") for c in _ERRORS})
    noise = out.filter(F.startswith("variant", F.lit("null:"))).agg(F.max(F.abs("d_mae")).alias("noise_mae"), F.max(F.abs("d_peak_mae")).alias("noise_peak_mae"))
    out = out.crossJoin(F.broadcast(noise))
    worse = F.transform(F.map_entries("folds"), lambda e: e["value"] - F.element_at("b_folds", e["key"]))
    out = out.withColumns({
        "improved_folds": F.size(F.filter(worse, lambda d: d < 0)), "folds_hold": F.forall(worse, lambda d: d <= F.col("noise_mae")), "normal_days_hold": F.col("d_mae_normal_days") <= F.col("noise_mae"),
        "peaks_hold": (F.col("d_recall") >= -RECALL_SLACK) & (F.col("d_peak_mae") <= F.col("noise_peak_mae")), "beyond_noise": F.abs("d_mae") > F.col("noise_mae"),
    })
    flags = ["folds_hold", "normal_days_hold", "peaks_hold"]
    if limits is not None:
        out, flags = out.join(limits, "variant", "left").withColumn("clear", F.col("ci_high") < 0), ["clear", *flags]
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    return out.withColumn("accepted", ok & (F.col("variant") != BASE)).drop("folds", "b_folds", *(f"b_{c}" for c in _ERRORS))
