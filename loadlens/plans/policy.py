"""Tariffs, load-shifting levers and alarm policies.

Levers that move production are joins of donors with receivers. Two rules carry state from hour to hour (a cap that
overflows into the next hour, and receivers whose room is used up); they fold one site's day, 24 rows, at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.operators.windows import series
from loadlens.sources.io import materialize

# Assumed charge a kW and month, labour cost of 1,000 units and hour, night factor; hours of the levers.
RATE, LABOR_COST, NIGHT_FACTOR = 8320.0, 25_000.0, 1.5
RECEIVERS, NIGHT, SATURDAY = (10, 11, 15, 16), (21, 22, 23, 0, 1, 2), tuple(range(8, 18))


def monthly_billing(df: DataFrame, value: str = "y_peak") -> DataFrame:
    """site_id, month, peak, billing: the largest peak of a month and of it with the two before."""
    months = df.groupBy("site_id", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.max(value).alias("peak"))
    return months.withColumn("billing", F.max("peak").over(series("month").rowsBetween(-2, 0)))


def basic_charge(df: DataFrame, value: str = "y_peak", rate: float = RATE) -> DataFrame:
    """site_id, billing_peak, annual_charge."""
    return monthly_billing(df, value).groupBy("site_id").agg(F.max("billing").alias("billing_peak")).withColumn("annual_charge", F.col("billing_peak") * rate * 12)


def observed_months(df: DataFrame) -> DataFrame:
    """site_id, months: each day observed counts one over the days of its month."""
    days = df.select("site_id", "day").distinct()
    return days.groupBy("site_id").agg(F.sum(1 / F.day(F.last_day("day"))).alias("months"))


def spread_start(df: DataFrame, alpha: float = 0.2, hours: tuple[int, ...] = (8, 13), value: str = "y_peak") -> DataFrame:
    """Adds peak_new: at the hours named the part alpha of the peak falls by two thirds; never below 0."""
    cut = F.when(F.hour("ts").isin(*hours), F.col(value) * (1 - alpha * 2 / 3)).otherwise(F.col(value))
    return df.withColumn("peak_new", F.when(cut.isNotNull(), F.greatest(cut, F.lit(0.0))))


def _sources(df: DataFrame, theta: float, top: int) -> DataFrame:
    """The hour of the largest peak (the first, if tied) of each day with production there, of days at theta or among the top peaks."""
    day = Window.partitionBy("site_id", "day")
    first = F.row_number().over(day.orderBy(F.desc_nulls_last("y_peak"), "ts"))
    firsts = df.filter(F.col("y_peak").isNotNull()).withColumn("__r", first).filter("__r = 1").drop("__r")
    if top:
        w = Window.partitionBy("site_id").orderBy(F.desc("y_peak"), "ts")
        # Of a site's top rows only days matter; rows are cut to each day's best `top` before they are ranked together.
        best = df.filter(F.col("y_peak").isNotNull()).withColumn("__d", F.row_number().over(day.orderBy(F.desc("y_peak"), "ts"))).filter(F.col("__d") <= top)
        days = best.withColumn("__t", F.row_number().over(w)).filter(F.col("__t") <= top).select("site_id", "day").distinct().withColumn("__top", F.lit(True))
        firsts = firsts.join(days, ["site_id", "day"], "left").filter((F.col("y_peak") >= theta) | F.coalesce("__top", F.lit(False))).drop("__top")
    else:
        firsts = firsts.filter(F.col("y_peak") >= theta)
    return firsts.filter("prod > 0")


def _move(df: DataFrame, moves: DataFrame, beta: float) -> DataFrame:
    """moves: site_id, src, dst, units. Adds prod_new and peak_new, at least 0."""
    delta = moves.select("site_id", F.col("src").alias("ts"), (-F.col("units")).alias("d")).unionByName(moves.select("site_id", F.col("dst").alias("ts"), F.col("units").alias("d"))).groupBy("site_id", "ts").agg(F.sum("d").alias("__d"))
    out = df.join(delta, ["site_id", "ts"], "left").withColumn("__d", F.coalesce("__d", F.lit(0.0)))
    peak = F.col("y_peak") + beta * F.col("__d")
    return out.withColumns({"prod_new": F.col("prod") + F.col("__d"), "peak_new": F.when(peak.isNotNull(), F.greatest(peak, F.lit(0.0)))}).drop("__d")


def _moves(sources: DataFrame, receivers: DataFrame, on: list[str], share: float, others_only: bool = False) -> DataFrame:
    met = sources.select("site_id", *[c for c in on if c != "site_id"], F.col("ts").alias("src"), (F.col("prod") * share).alias("all_units")).join(receivers, on)
    met = met.filter("src <> dst") if others_only else met
    n = F.count("*").over(Window.partitionBy("site_id", "src"))
    return met.select("site_id", "src", "dst", (F.col("all_units") / n).alias("units"))


def shift_same_day(df: DataFrame, theta: float, beta: float, share: float = 0.2, hours: tuple[int, ...] = RECEIVERS, top: int = 20) -> DataFrame:
    """A share of the production at a day's peak hour goes in equal parts to the receiving hours of that day."""
    receivers = df.filter(F.hour("ts").isin(*hours)).select("site_id", "day", F.col("ts").alias("dst"))
    return _move(df, _moves(_sources(df, theta, top), receivers, ["site_id", "day"], share, others_only=True), beta)


def shift_off_hours(df: DataFrame, theta: float, beta: float, target: str = "night", share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """To the night hours of the same day, or to Saturday of the same week; and site_id, extra_labor by the night factor (Saturday: none)."""
    sources = _sources(df, theta, 0)
    if target == "night":
        receivers, on, factor = df.filter(F.hour("ts").isin(*NIGHT)).select("site_id", "day", F.col("ts").alias("dst")), ["site_id", "day"], NIGHT_FACTOR
    else:
        week = F.date_sub("day", F.weekday("day")).alias("week")
        sources = sources.withColumn("week", week)
        receivers, on, factor = df.filter((F.weekday("day") == 5) & F.hour("ts").isin(*SATURDAY)).select("site_id", week, F.col("ts").alias("dst")), ["site_id", "week"], 1.0
    moves = _moves(sources, receivers, on, share)
    labor = moves.groupBy("site_id").agg((F.sum("units") * LABOR_COST / 1000 * (factor - 1)).alias("extra_labor"))
    return _move(df, moves, beta), labor


def cap_and_carry(df: DataFrame, theta: float, beta: float, q: float = 0.9) -> DataFrame:
    """Hours at theta or more produce at most the q quantile of positive production; the rest goes to the next hour, and what is left at a day's end stays in its last hour.

    A fold over each day's hours in order; a day is one array of a few dozen entries.
    """
    cap = df.filter("prod > 0").groupBy("site_id").agg(F.percentile("prod", F.lit(q)).alias("cap"))
    days = df.groupBy("site_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "prod", "y_peak"))).alias("h"), F.max("y_peak").alias("top")).join(cap, "site_id", "left")

    def step(acc: Column, x: Column) -> Column:
        want = x["prod"] + acc["carry"]
        over = (F.coalesce(x["y_peak"], F.lit(-1.0)) >= theta) & (want > F.col("cap"))
        made = F.when(over, F.col("cap")).otherwise(want)
        return F.struct((want - made).alias("carry"), F.concat(acc["out"], F.array(F.struct(x["ts"].alias("ts"), made.alias("made")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<ts:timestamp_ntz,made:double>>").alias("out"))
    folded = days.filter(F.col("top") >= theta).select("site_id", F.aggregate("h", start, step).alias("f"))
    last = F.size("f.out")
    made = folded.select("site_id", "f.carry", last.alias("n"), F.posexplode("f.out").alias("i", "x")).select("site_id", "x.ts", (F.col("x.made") + F.when(F.col("i") == F.col("n") - 1, F.col("carry")).otherwise(0.0)).alias("made"))
    out = df.join(made, ["site_id", "ts"], "left").withColumn("prod_new", F.coalesce("made", "prod"))
    peak = F.col("y_peak") + beta * (F.col("prod_new") - F.col("prod"))
    return out.withColumn("peak_new", F.when(peak.isNotNull(), F.greatest(peak, F.lit(0.0)))).drop("made")


def evaluate_lever(df: DataFrame, rate: float = RATE) -> DataFrame:
    """For each site: fall of the billing peak, saving over the observed months, hours above the old maximum, and whether days and weeks conserve production."""
    before, after = (monthly_billing(df, c).groupBy("site_id").agg(F.max("billing").alias(n)) for c, n in (("y_peak", "peak_before"), ("peak_new", "peak_after")))
    top = Window.partitionBy("site_id")
    over = df.withColumn("__top", F.max("y_peak").over(top)).groupBy("site_id").agg(F.sum((F.col("peak_new") > F.col("__top")).cast("long")).alias("hours_over"))
    prod_new = F.col("prod_new") if "prod_new" in df.columns else F.col("prod")
    kept = lambda keys, n: df.groupBy("site_id", *keys).agg(F.abs(F.sum(prod_new - F.col("prod"))).alias("d")).groupBy("site_id").agg((F.max("d") <= 1e-6).alias(n))
    out = before.join(after, "site_id").join(observed_months(df), "site_id").join(over, "site_id").join(kept(["day"], "day_conserved"), "site_id").join(kept([F.date_sub("day", F.weekday("day"))], "week_conserved"), "site_id")
    return out.withColumns({"delta_peak": F.col("peak_before") - F.col("peak_after"), "saving": (F.col("peak_before") - F.col("peak_after")) * rate * F.col("months")})


#: Hours of the start-up lever in each of its variants.
SPREADS = {"L1a": (8, 13), "L1b": (8, 11, 13), "L1c": (8, 9, 11, 13)}


def _lever(at: DataFrame, lever: str, theta: float, beta: float, alpha: float) -> tuple[DataFrame, DataFrame | None]:
    """site_id, ts, prod_new, peak_new of one lever on site_id, ts, day, prod, y_peak; and the extra labour, if it costs any."""
    if lever in SPREADS:
        return spread_start(at, alpha, SPREADS[lever]).withColumn("prod_new", F.col("prod")), None
    if lever == "L2":
        return shift_same_day(at, theta, beta), None
    if lever == "L3":
        return cap_and_carry(at, theta, beta), None
    if lever == "L4":
        return shift_off_hours(at, theta, beta)
    raise ValueError(f"unknown lever {lever}")


def lever_chains(df: DataFrame, theta: float, beta: float, chains: dict[str, tuple[tuple[str, ...], float]]) -> DataFrame:
    """name, site_id, delta_peak, saving, extra_labor, day_conserved of each chain of levers, applied one after another; (levers, alpha) by name.

    Chains that begin alike share those steps, and each step is written once. The chain becomes part of the series' key,
    so one job judges them all.
    """
    base = df.select("site_id", "ts", "day", "prod", "y_peak")
    steps: dict[tuple, tuple[DataFrame, DataFrame | None]] = {}
    rows = labor = None
    for name, (chain, alpha) in chains.items():
        at, cost = base, None
        for i, lever in enumerate(chain):
            key = (chain[: i + 1], alpha)
            if key not in steps:
                made, cost = _lever(at, lever, theta, beta, alpha)
                steps[key] = (materialize(base.select("site_id", "ts", "day").join(made.select("site_id", "ts", F.col("prod_new").alias("prod"), F.col("peak_new").alias("y_peak")), ["site_id", "ts"]), "lever"), cost)
            at, cost = steps[key]
        # A chain's hours of a site are a series of their own, named by both.
        named = F.struct(F.lit(name).alias("name"), "site_id").alias("site_id")
        part = base.join(at.select("site_id", "ts", F.col("prod").alias("prod_new"), F.col("y_peak").alias("peak_new")), ["site_id", "ts"]).select(named, "ts", "day", "prod", "y_peak", "prod_new", "peak_new")
        rows = part if rows is None else rows.unionByName(part)
        if cost is not None:
            cost = cost.select(named, "extra_labor")
            labor = cost if labor is None else labor.unionByName(cost)
    out = evaluate_lever(materialize(rows, "chains"))
    out = out.join(labor, "site_id", "left") if labor is not None else out.withColumn("extra_labor", F.lit(0.0))
    return out.select("site_id.name", "site_id.site_id", "delta_peak", "saving", F.coalesce("extra_labor", F.lit(0.0)).alias("extra_labor"), "day_conserved")


# The scenarios, and the combinations whose order the sensitivity table looks at.
SCENARIOS = {"S0": (), "S1a": ("L1a",), "S1b": ("L1b",), "S1c": ("L1c",), "S2": ("L1c", "L2"), "S3": ("L1c", "L3"), "S4": ("L1c", "L2", "L4")}
COMBINATIONS = {"L1c": ("L1c",), "L1c+L2": ("L1c", "L2"), "L1c+L2+L4": ("L1c", "L2", "L4")}


def scenario_table(df: DataFrame, theta: float, beta: float, alpha: float = 0.2) -> DataFrame:
    """scenario, site_id, delta_peak, saving, extra_labor, net, day_conserved for S0 to S4."""
    out = lever_chains(df, theta, beta, {name: (chain, alpha) for name, chain in SCENARIOS.items()})
    return out.withColumnRenamed("name", "scenario").withColumn("net", F.col("saving") - F.col("extra_labor"))


def sensitivity(df: DataFrame, theta: float, beta: float, alphas=(0.1, 0.2, 0.3), factors=(0.7, 1.0, 1.3)) -> DataFrame:
    """site_id, alpha, rate_factor, combination, net, best, stable: nine cells of charge and spread part.

    best marks the combination of the largest net saving of its cell (the shortest, if tied); stable is whether one
    combination is best in all cells of the site. Only alpha changes what levers do, so a chain runs once for each alpha.
    """
    out = lever_chains(df, theta, beta, {f"{name}/{alpha!r}": (chain, alpha) for alpha in map(float, alphas) for name, chain in COMBINATIONS.items()})
    key = F.split("name", "/")
    rows = out.select("site_id", key[1].cast("double").alias("alpha"), key[0].alias("combination"), "saving", "extra_labor", F.explode(F.array(*(F.lit(float(f)) for f in factors))).alias("rate_factor"))
    rows = rows.withColumn("net", F.col("saving") * F.col("rate_factor") - F.col("extra_labor"))
    cell = Window.partitionBy("site_id", "alpha", "rate_factor").orderBy(F.desc(F.round("net", 6)), F.length("combination"))
    rows = rows.withColumn("best", F.row_number().over(cell) == 1)
    first = F.collect_set(F.when(F.col("best"), F.col("combination"))).over(Window.partitionBy("site_id"))
    return rows.select("site_id", "alpha", "rate_factor", "combination", "net", "best", (F.size(first) == 1).alias("stable"))


def response(df: DataFrame) -> DataFrame:
    """site_id, n, beta (at least 0), beta_raw, r2, status: peak on production with an intercept for each hour, over usable rows with production.

    status is `estimated`, or `unidentified_zero_fallback` where production doesn't vary within hours. A site without
    usable rows has no row.
    """
    from loadlens.functions.stats import within_slope

    rows = df.filter((F.col("prod") > 0) & F.col("y_peak").isNotNull() & ~F.col("is_outage") & ~F.col("is_erp_missing"))
    slope = within_slope(rows.withColumn("__h", F.hour("ts")), "prod", "y_peak", "__h", ["site_id"])
    return slope.select("site_id", "n", F.greatest("beta", F.lit(0.0)).alias("beta"), F.col("beta").alias("beta_raw"), "r2", F.when(F.col("identified"), "estimated").otherwise("unidentified_zero_fallback").alias("status"))


# The columns that a policy may see.
ACTION_COLUMNS = ("site_id", "ts", "origin", "pred_peak", "tau", "planned_production", "plan_known", "is_operating")


def strict_flag(c: str) -> Column:
    """true/false/1/0 in any case; anything else, null too, is an error."""
    s = F.lower(F.col(c).cast("string"))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no flag: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def select_actions(df: DataFrame, policy: str, capacity: float, start_hours=(8, 13), receiving=RECEIVERS, share: float = 0.2) -> DataFrame:
    """Actions of none, fixed_L1, alert_L1 or alert_L2 from forecasts and plans alone; any other column is refused.

    A day with an unknown or invalid plan has no actions at all. `transfers` of an hour lists where its production goes.
    """
    if set(df.columns) != set(ACTION_COLUMNS):
        raise ValueError("actions are chosen from the columns of the contract only")
    if policy not in ("none", "fixed_L1", "alert_L1", "alert_L2") or not 0 <= capacity < float("inf"):
        raise ValueError("unknown policy or capacity")
    num = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    finite = num("pred_peak") & num("tau") & num("planned_production")
    df = df.withColumns({"plan_known": strict_flag("plan_known"), "is_operating": strict_flag("is_operating"), "day": F.to_date("ts")})
    valid = finite & (F.col("planned_production") >= 0) & F.col("plan_known") & F.coalesce(F.col("origin") <= F.col("ts"), F.lit(False))
    df = df.withColumns({"valid_plan_day": F.bool_and(valid).over(Window.partitionBy("site_id", "day")), "alert": F.coalesce(finite & (F.col("pred_peak") >= F.col("tau")), F.lit(False)), "policy": F.lit(policy)})
    ok = F.col("valid_plan_day") & F.col("is_operating") & (F.col("ts") > F.col("origin"))
    df = df.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    l1 = F.col("eligible") & F.hour("ts").isin(*start_hours) if policy in ("fixed_L1", "alert_L1") else F.lit(False)
    df = df.withColumn("l1_action", l1 & F.col("alert") if policy == "alert_L1" else l1)
    zero = {c: F.lit(0.0) for c in ("shift_requested", "shift_out", "shift_in", "unallocated_units")}
    df = df.withColumns(zero).withColumn("transfers", F.array().cast("array<struct<to:int,units:double>>"))
    if policy == "alert_L2":
        df = _allocate(df, capacity, receiving, share)
    return df.withColumns({"production_after": F.col("planned_production") + F.col("shift_in") - F.col("shift_out"), "l2_action": F.col("shift_out") > 0})


def _allocate(df: DataFrame, capacity: float, receiving: tuple[int, ...], share: float) -> DataFrame:
    """Donors in time order fill later receivers of their day in time order, as far as these have room: one site's day at a time."""

    def day(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", ignore_index=True)
        plan, ok, alert, hours = rows["planned_production"].to_numpy(), rows["eligible"].to_numpy(bool), rows["alert"].to_numpy(bool), rows["ts"].dt.hour.to_numpy()
        asked, out, into = (rows[c].to_numpy(copy=True) for c in ("shift_requested", "shift_out", "shift_in"))
        takers = [i for i in range(len(rows)) if ok[i] and not alert[i] and hours[i] in receiving]
        moves: list[list[dict]] = [[] for _ in range(len(rows))]
        for i in range(len(rows)):
            if not (ok[i] and alert[i] and plan[i] > 0):
                continue
            asked[i] = left = plan[i] * share
            for j in takers:
                if j > i and left > 1e-10 and (units := min(left, capacity - plan[j] - into[j])) > 0:
                    out[i], into[j], left = out[i] + units, into[j] + units, left - units
                    moves[i].append({"to": int(hours[j]), "units": float(units)})
        return rows.assign(shift_requested=asked, shift_out=out, shift_in=into, unallocated_units=asked - out, transfers=moves)

    return df.groupBy("site_id", "day").applyInPandas(day, df.schema)


def transfers(actions: DataFrame) -> DataFrame:
    """policy, site_id, origin, source, recipient, units: a row for each move of production, from one hour to a later one of its day."""
    rows = actions.select("policy", "site_id", "day", "origin", F.col("ts").alias("source"), F.explode("transfers").alias("t"))
    return rows.select("policy", "site_id", "origin", "source", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours="t.to")).alias("recipient"), "t.units")


def audit(actions: DataFrame, capacity: float) -> DataFrame:
    """site_id, day and whether production is conserved, receivers keep within capacity and come after donor and origin, production stays at 0 or more, and days without a plan have no action."""
    later = F.forall("transfers", lambda t: (t["to"] > F.hour("ts")) & (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=t["to"]) > F.col("origin")))
    g = actions.groupBy("site_id", "day").agg((F.abs(F.sum(F.col("shift_in") - F.col("shift_out"))) <= 1e-8).alias("conserved"), F.bool_and((F.col("shift_in") <= 0) | (F.col("production_after") <= capacity + 1e-8)).alias("capacity_ok"), F.bool_and(~(F.col("l1_action") | F.col("l2_action")) | F.col("valid_plan_day")).alias("no_invalid_action"), F.bool_and(later).alias("future_ok"), F.bool_and(~F.col("valid_plan_day") | (F.col("production_after") >= -1e-8)).alias("nonnegative"), F.sum("unallocated_units").alias("unallocated_units"))
    return g.withColumn("passed", F.col("conserved") & F.col("capacity_ok") & F.col("no_invalid_action") & F.col("future_ok") & F.col("nonnegative"))


def outcomes(actions: DataFrame, truth: DataFrame, theta: float, beta: float, alpha: float) -> DataFrame:
    """actions with the observed peak and the assumed one; truth (site_id, ts, y_peak, usable) is joined only now."""
    rows = actions.join(truth.select("site_id", "ts", "y_peak", "usable"), ["site_id", "ts"], "left")
    valid = F.coalesce(F.col("usable") & (F.col("y_peak") >= 0), F.lit(False))
    raw = F.col("y_peak") * (1 - alpha * 2 / 3 * F.col("l1_action").cast("int")) + beta * (F.col("shift_in") - F.col("shift_out"))
    rows = rows.withColumns({"valid": valid, "observed": F.when(valid, F.col("y_peak")), "assumed": F.when(valid, F.greatest(raw, F.lit(0.0))), "floored": valid & (raw < 0)})
    return rows.withColumns({"event": F.col("valid") & (F.col("observed") >= theta), "normal": F.col("valid") & (F.col("observed") < theta)})


def policy_metrics(rows: DataFrame, theta: float) -> DataFrame:
    """site_id, policy and counts of hours, events, alarms and actions; what concerns hours without a valid target is kept apart."""
    n = lambda c: F.sum(c.cast("long"))
    acted = F.col("l1_action") | F.col("l2_action")
    days = F.count_distinct("day")
    return rows.groupBy("site_id", "policy").agg(
        F.count("*").alias("n_hours"), days.alias("n_days"), n(F.col("valid")).alias("n_eval"), F.max("observed").alias("observed_peak"), F.max("assumed").alias("assumed_peak"),
        n(F.col("event") & F.col("alert")).alias("tp"), n(F.col("event") & ~F.col("alert")).alias("fn"), n(F.col("normal") & F.col("alert")).alias("fp"), n(F.col("normal") & ~F.col("alert")).alias("tn"),
        (n(F.col("l1_action")) + n(F.col("l2_action"))).alias("action_events"), F.sum("shift_out").alias("shifted_units"),
        (n(F.col("l1_action") & F.col("normal")) + n(F.col("l2_action") & F.col("normal"))).alias("false_action_events"), F.sum(F.when(F.col("normal"), F.col("shift_out")).otherwise(0.0)).alias("false_shifted_units"),
        n(F.col("event") & ~acted).alias("peaks_without_action"), n(F.col("normal") & (F.col("assumed") >= theta)).alias("new_peak_hours"), n(F.col("floored")).alias("floored_hours"),
        F.sum(F.when(F.col("valid"), 1 / (24.0 * F.day(F.last_day("day")))).otherwise(0.0)).alias("valid_months"),
    )


def cost_grid(spark: SparkSession, alphas=(0.1, 0.2, 0.3), factors=(0.7, 1.0, 1.3), action=(0.0, 1000.0, 5000.0), unit=(0.0, 0.01, 0.1), alpha: float = 0.2, rate: float = RATE) -> DataFrame:
    """alpha, rate_factor, action_cost, unit_cost: two grids of assumptions, their common points once."""
    points = {(float(a), float(f), 0.0, 0.0) for a in alphas for f in factors} | {(float(alpha), 1.0, float(c), float(u)) for c in action for u in unit}
    grid = spark.createDataFrame(sorted(points), "alpha double, rate_factor double, action_cost double, unit_cost double")
    return grid.coalesce(1).withColumn("rate", F.lit(rate) * F.col("rate_factor"))


def costs(metrics: DataFrame, grid: DataFrame) -> DataFrame:
    """metrics for each grid point with gross, execution, false-action and net cost; the grid has a few rows."""
    rows = metrics.crossJoin(F.broadcast(grid))
    gross = (F.col("observed_peak") - F.col("assumed_peak")) * F.col("rate") * F.col("valid_months")
    run = F.col("action_events") * F.col("action_cost") + F.col("shifted_units") * F.col("unit_cost")
    return rows.withColumns({"gross": gross, "execution_cost": run, "false_action_cost": F.col("false_action_events") * F.col("action_cost") + F.col("false_shifted_units") * F.col("unit_cost"), "net": gross - run})


def scenarios(spark: SparkSession) -> DataFrame:
    """id, production, headcount, temperature, shift: the registered perturbations of a plan."""
    rows = [("C0", 1.0, 1.0, 0.0, 0)] + [(f"P{round(f * 100)}", f, 1.0, 0.0, 0) for f in (0.8, 0.9, 1.1, 1.2)] + [(f"H{round(f * 100)}", 1.0, f, 0.0, 0) for f in (0.9, 1.1)] + [(f"T{d:+d}", 1.0, 1.0, float(d), 0) for d in (-2, -1, 1, 2)]
    rows += [(f"P{round(f * 100)}T{d:+d}", f, 1.0, float(d), 0) for f in (0.8, 1.2) for d in (-2, 2)] + [(f"S{d:+d}", 1.0, 1.0, 0.0, d) for d in (-1, 1)]
    return spark.createDataFrame(rows, "scenario string, production double, headcount_factor double, temperature double, shift int")


def perturb(plan: DataFrame, grid: DataFrame) -> DataFrame:
    """plan rows (site_id, day, hour, prod, headcount, temp) for each scenario; shifted production stays within its day, at its edge hours."""
    rows = plan.crossJoin(F.broadcast(grid))
    moved = rows.withColumn("hour", F.greatest(F.lit(0), F.least(F.lit(23), F.col("hour") + F.col("shift")))).groupBy("scenario", "site_id", "day", "hour").agg(F.sum(F.col("prod") * F.col("production")).alias("prod"))
    rest = rows.select("scenario", "site_id", "day", "hour", (F.col("headcount") * F.col("headcount_factor")).alias("headcount"), (F.col("temp") + F.col("temperature")).alias("temp"))
    return rest.join(moved, ["scenario", "site_id", "day", "hour"], "left").withColumn("prod", F.coalesce("prod", F.lit(0.0)))
