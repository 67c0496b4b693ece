"""Hand-made cases and invariants of the time-series operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.errors import BundleError, InputError, PredictionError
from loadlens.functions import metrics, resample, stats
from loadlens.operators import features, joins, opcal, repair, splits, windows
from loadlens.plans import base, compare, evaluate, models, policy, serving
from loadlens.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plant(spark):
    """40 days of two sites: weekday load follows production, weekends are shut."""
    rng, rows = np.random.default_rng(1), []
    for site in (1, 2):
        for d in range(32):
            day = dt.date(2024, 3, 1) + dt.timedelta(days=d)
            for h in range(24):
                made = 0.0 if day.weekday() >= 5 or not 7 <= h <= 19 else float(rng.integers(500, 1500))
                load = 20 + made * 0.1 + rng.normal(0, 3)
                p = [max(1.0, float(round(load + rng.normal(0, 4)))) for _ in range(4)]
                rows.append((site, dt.datetime.combine(day, dt.time(h)), day, h, *p, float(np.floor(np.mean(p) + 0.5)), made, 30.0 if made else 2.0, 1.0 if 9 <= h <= 17 else 1.5, float(15 + 10 * np.sin(h / 24)), 2.0, 50.0, 0.0))
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, day date, hour int, p15 double, p30 double, p45 double, p60 double, avg double, prod double, headcount double, labor double, temp double, wind double, humid double, rain double").repartition(4)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 9.0, 190.0, 180.0), (200.0, 180.0, 220.0, 215.0), (100.0, 120.0, 186.0, 200.0)], "y_avg double, pred_avg double, y_peak double, pred_peak double")
    r = df.agg(*metrics.regression(theta=187.0)).first()
    assert (r["peak_mae"], r["peak15_mae"], r["peak_n"], r["high_load_mae"], r["high_load_n"]) == (10.5, 7.5, 2, 20.0, 1)
    r = df.filter("y_avg < 0").agg(*metrics.regression(theta=187.0)).first()
    assert r["n"] == 0 and r["peak_mae"] is None


def test_repair_uses_the_past(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), dt.date(2024, 1, 1), p, w, n) for h, (p, w, n) in enumerate([(10.0, 2.0, 3.0), (0.0, None, None), (100.0, 40.0, 30.0), (110.0, 50.0, 40.0)])]
    rows += [(2, dt.datetime(2024, 1, 1, h), dt.date(2024, 1, 1), p, w, w) for h, (p, w) in enumerate([(0.0, None), (50.0, 1.0)])]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, day date, avg double, wind double, headcount double").withColumns({c: F.col("avg") for c in schemas.POWER} | {"prod": F.lit(1.0), "labor": F.lit(1.0), "rain": F.lit(None).cast("double")})
    out = {(r["site_id"], r["ts"].hour): r for r in repair.repair(df).collect()}
    r = out[1, 1]
    assert (r["avg"], r["wind"], r["headcount"], r["is_outage"], r["rain"]) == (10.0, 2.0, 3.0, True, 0.0)
    assert all(out[2, 0][c] is None for c in (*schemas.POWER, "avg", "wind", "headcount"))


def test_half_up_and_bankers(spark):
    r = spark.range(1).select(stats.half_up(F.lit(-2.5)).alias("a"), stats.half_up(F.lit(2.5)).alias("b"), F.bround(F.lit(2.5), 0).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (-2, 3, 2.0)


def test_erp_rule_needs_lost_labour(spark):
    rows = [(1, dt.datetime(2024, 1, d, h), dt.date(2024, 1, d), 100.0, 0.0, 1.5 if d == 1 or h < 9 else 1.0) for d in (1, 2) for h in range(24)]
    out = repair.flag(spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, day date, avg double, prod double, labor double")).groupBy("day").agg(F.bool_and("is_erp_missing").alias("e"), F.bool_and("is_aug_inconsistent").alias("a")).orderBy("day").collect()
    assert [(r["e"], r["a"]) for r in out] == [(True, False), (False, True)]


def test_calendar_opens_shut(spark):
    shut = [True, True, False, True, False, False]
    rows = [(1, dt.date(2024, 1, i + 1), 0.0 if s else 5.0, v) for i, (s, v) in enumerate(zip(shut, [30.0, 30.1, 70.0, 70.1, 10.0, None]))]
    cal = opcal.operating_calendar(spark.createDataFrame(rows, "site_id long, day date, prod double, y_avg double").withColumns({"is_erp_missing": F.lit(False), "is_aug_inconsistent": F.lit(False)})).orderBy("day").collect()
    assert [r["shutdown_nth"] for r in cal] == [1, 2, 0, 1, 0, 0]
    assert [r["is_back"] for r in cal] == [False, False, True, False, True, False]
    assert [r["is_state_switch"] for r in cal] == [True, False, True, True, True, False]
    assert [r["regime"] for r in cal] == [0, 1, 1, 2, 0, None]
    edge = spark.createDataFrame([(30.0,), (70.0,)], "x double").select(opcal.hourly_regime(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in edge] == [1, 2]


def test_quantile_bins_are_not_ntile(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(10)], "k int, v double").withColumn("q", windows.quantile_bins("v", 4, "v", "k"))
    assert [r["count"] for r in df.groupBy("q").count().orderBy("q").collect()] == [3, 2, 2, 3]


def test_exact_binomial_limits():
    low, high = stats.binomial_limits(28, 28)
    assert low == pytest.approx(0.8765638814997362, abs=1e-9) and high == 1.0
    assert stats.binomial_limits(0, 0) == (None, None)
    assert stats.binomial_limits(0, 10)[0] == 0.0


def test_billing_maximum(spark):
    peaks = [222, 198, 222, 199, 199, 222, 222, 218, 204]
    df = spark.createDataFrame([(1, dt.datetime(2021, m + 1, 3), float(p)) for m, p in enumerate(peaks)], "site_id long, ts timestamp_ntz, y_peak double")
    assert {r["billing"] for r in policy.monthly_billing(df).collect()} == {222.0}


DIFFS = [-0.4817135902, 0.7750258523, 0.6133601328, 0.7561640354, 1.6700002891, 0.7630337683, 1.4004789883, 0.5446106973, 0.8547671582, 1.3338035162, -1.5900181478, 0.0024602971, -0.2085217160, -0.4444289875]


def test_bootstrap_by_hand(spark):
    rows = [(dt.date(2021, 1, i + 1), 0.0, 5 + d, 5.0) for i, d in enumerate(DIFFS)]
    df = spark.createDataFrame(rows, "day date, y double, pred_a double, pred_b double")
    r = resample.paired_mae(df, resample.day_draws(spark, 14, 2000, 42)).first()
    assert r["p"] == pytest.approx(0.073) and r["ci_low"] <= 0 < r["ci90_low"] and not r["significant_95"] and r["significant_90"]
    hours = df.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    again = resample.paired_mae(hours, resample.day_draws(spark, 14, 2000, 42)).first()
    assert [again[c] for c in ("diff", "ci_low", "ci_high", "p")] == pytest.approx([r[c] for c in ("diff", "ci_low", "ci_high", "p")])
    same = resample.paired_mae(df.withColumn("pred_b", F.col("pred_a")), resample.day_draws(spark, 14, 200, 1)).first()
    assert (same["ci_low"], same["ci_high"], same["p"]) == (0.0, 0.0, 1.0)


def test_block_draws(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(14)]
    for block in (1, 2, 3):
        n = resample.block_draws(spark, days, block, 50, 42).groupBy("rep").agg(F.sum("times").alias("n"))
        assert {r["n"] for r in n.collect()} == {14}
    assert list(resample.block_starts(days, 3)) == list(range(12))
    with pytest.raises(ValueError):
        resample.block_starts([days[0], days[3]], 2)


def test_partition_bounds():
    b = splits.partition_bounds("2021-07-07")
    assert (b["core_end"], b["cal_start"], b["eval_end"]) == ("2021-06-21 00:00:00", "2021-06-22 00:00:00", "2021-07-21 00:00:00")


def test_completion():
    assert features.completion_check() == [] and features.completion_check((23,)) == [(23, 23)]


def test_features_do_not_look_ahead(spark, plant):
    df = repair.targets(repair.repair(plant))
    cal, hol = opcal.operating_calendar(df), io.holidays(spark, days=["2024-03-05"])
    assert features.future_blind(df, cal, 100.0, hol, "2024-03-20").count() == 0
    cheat = df.withColumn("prod", F.col("y_avg"))  # production that tells power does leak
    blind = cheat.withColumn("prod", F.when(F.col("day") < F.lit("2024-03-20").cast("date"), F.col("prod")).otherwise(0.0))
    a, b = (features.build_features(x, cal, 100.0, hol).filter("day = date '2024-03-20'").select("site_id", "ts", "prod_cum_day") for x in (cheat, blind))
    assert a.exceptAll(b).count() > 0


def test_serving_equals_training(spark, plant):
    hol = io.holidays(spark, days=["2024-03-05"])
    df = repair.targets(repair.repair(plant))
    train = features.build_features(df, opcal.operating_calendar(df), 100.0, hol)
    day = "2024-03-22"
    plan = plant.filter(f"day = date '{day}'").select("site_id", "ts", "day", "prod", "headcount", "temp", "wind", "humid", "rain")
    history = plant.filter(f"day < date '{day}'")
    # Whole history but the calendar's first day, which a shorter one would count as a switch.
    served = serving.day_ahead_features(history, plan, day, 100.0, hol)
    pick = lambda x: x.select("site_id", "ts", *(F.round(F.col(c).cast("double"), 8).alias(c) for c in features.FEATURES))
    want = pick(train.filter(f"day = date '{day}'"))
    assert pick(served).exceptAll(want).count() == 0 and served.count() == 48
    with pytest.raises(InputError):
        serving.day_ahead_features(history, plan.withColumn("avg", F.lit(1.0)), day, 100.0, hol)
    with pytest.raises(InputError):
        serving.day_ahead_features(history.filter("hour(ts) <> 5 or day <> date '2024-03-10'"), plan, day, 100.0, hol)
    bad = serving.check_grid(history.filter("site_id = 1 or day > date '2024-03-16'"), day, 8).collect()
    assert [(r["site_id"], r["code"]) for r in bad] == [(2, "too_short")]


def test_contract(spark):
    df = spark.createDataFrame([("20240230", "1", "x"), ("20240101", "24", "1"), ("20240101", "24", None)], "date string, hour string, prod string")
    got = {(r["code"], r["message"]) for r in schemas.violations(df, ("date", "hour", "prod", "temp"), ("date", "hour"), forbidden=("prod",)).collect()}
    assert got == {("missing_column", "temp"), ("forbidden_column", "prod"), ("no_such_day", "date"), ("hour", "hour"), ("not_a_number", "prod"), ("null", "prod"), ("duplicate_key", "2")}
    nan = schemas.clean(spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")).first()
    assert tuple(nan) == (None, None, 1.0)


def test_one_to_one_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert joins.one_to_one(a, b.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="right key repeats"):
        joins.one_to_one(a, b, ["k"]).collect()


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0, "x", 1), (2, None, "y", 2), (3, 3.0, "z", 3)], "k int, v double, s string, t int")
    roles = {"v": "numeric", "s": "exact", "t": "provenance"}
    assert compare.compare(a, a.orderBy(F.desc("k")).withColumn("t", F.lit(9)), ["k"], roles).count() == 0
    assert compare.compare(a, a.withColumn("v", F.col("v") + 1e-9), ["k"], roles).count() == 0
    b = spark.createDataFrame([(1, 1.1, "x", 1), (2, 5.0, "w", 2), (4, 3.0, "z", 3), (4, 3.0, "z", 3)], "k int, v double, s string, t int")
    got = {(r["key"], r["column"], r["reason"]) for r in compare.compare(a, b, ["k"], roles).collect()}
    assert got == {("1", "v", "numeric_differs"), ("2", "v", "numeric_differs"), ("2", "s", "exact_differs"), ("3", "", "only_reference"), ("4", "", "only_current"), ("4", "", "current_key_repeats")}
    with pytest.raises(ValueError):
        compare.compare(a, a, ["k"], {"v": "numeric"})
    t = compare.checks(spark, {"empty": a.limit(0), "full": a, "flag": True}, hard=("full",))
    with pytest.raises(AssertionError, match="full"):
        compare.require(t)
    assert compare.protocol_diff({"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": 3}, "d": 0}) == ["/b/c", "/d"]


def actions(spark, rows):
    schema = "site_id long, ts timestamp_ntz, origin timestamp_ntz, pred_peak double, tau double, planned_production double, plan_known string, is_operating string"
    t = lambda h: dt.datetime(2024, 1, 2, h)
    return spark.createDataFrame([(1, t(h), dt.datetime(2024, 1, 2), p, 100.0, q, k, "1") for h, p, q, k in rows], schema)


def test_greedy_shift(spark):
    df = actions(spark, [(8, 150.0, 1000.0, "true"), (9, 150.0, 1000.0, "true"), (10, 50.0, 900.0, "true"), (11, 150.0, 100.0, "true"), (15, 50.0, 950.0, "true"), (16, 50.0, 1000.0, "true")])
    out = {r["ts"].hour: r for r in policy.select_actions(df, "alert_L2", 1000.0).collect()}
    assert out[8]["shift_out"] == 150.0 and out[8]["unallocated_units"] == 50.0
    assert out[10]["shift_in"] == 100.0 and out[15]["shift_in"] == 50.0 and out[9]["shift_out"] == 0.0 and out[9]["unallocated_units"] == 200.0
    assert sum(r["production_after"] for r in out.values()) == 4950.0
    audit = policy.audit(policy.select_actions(df, "alert_L2", 1000.0), 1000.0).first()
    assert audit["passed"]
    none = policy.select_actions(actions(spark, [(8, 150.0, 10.0, "true"), (13, 150.0, 10.0, "0")]), "fixed_L1", 5.0)
    assert not none.filter("l1_action").count()
    with pytest.raises(ValueError):
        policy.select_actions(df.withColumn("y_peak", F.lit(1.0)), "none", 1.0)
    with pytest.raises(Exception, match="no flag"):
        policy.select_actions(actions(spark, [(8, 1.0, 1.0, "maybe")]), "none", 1.0).collect()


def test_levers_conserve_production(spark, plant):
    df = repair.targets(repair.repair(plant))
    for out, day in ((policy.shift_same_day(df, 120.0, 0.1), True), (policy.shift_off_hours(df, 120.0, 0.1)[0], True), (policy.cap_and_carry(df, 120.0, 0.1), True), (policy.shift_off_hours(df, 120.0, 0.1, "saturday")[0], False)):
        r = policy.evaluate_lever(out).collect()
        assert all(x["week_conserved"] and (x["day_conserved"] or not day) for x in r)
        assert out.filter("abs(prod_new - prod) > 1e-9").count() > 0 and out.filter("prod_new < -1e-9").count() == 0


def test_costs(spark):
    assert policy.cost_grid(spark).count() == 17
    assert policy.scenarios(spark).count() == 17
    m = spark.createDataFrame([(200.0, 190.0, 0.5, 3, 10.0, 1, 4.0)], "observed_peak double, assumed_peak double, valid_months double, action_events long, shifted_units double, false_action_events long, false_shifted_units double")
    r = policy.costs(m, policy.cost_grid(spark)).filter("action_cost = 1000 and unit_cost = 0.1").first()
    assert (r["gross"], r["execution_cost"], r["false_action_cost"], r["net"]) == (10 * 8320 * 0.5, 3001.0, 1000.4, 41600 - 3001.0)


def test_scorecard_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 3.0, 5.0)], "model string, mae double, flat double")
    got = {r["model"]: r["score"] for r in metrics.scorecard(df, {"mae": (0.6, True), "flat": (0.4, False)}).collect()}
    assert got == {"a": 1.0, "b": 0.7, "c": 0.4}
    first = evaluate.pick_first(spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 0.5)], "model string, score double"), ["z", "y", "x"]).first()
    assert first["model"] == "y"


def test_threshold_without_positives(spark):
    df = spark.createDataFrame([("m", 0, float(i)) for i in range(50)], "model string, y int, s double")
    assert metrics.tune_threshold(df, "y", "s", ["model"], 187.0).first()["tau"] == 187.0


def test_conformal_rank(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 10)], "k int, r double")
    assert metrics.conformal(df, "r", ["k"], 0.1).first()["halfwidth"] == 9.0
    assert metrics.conformal(df.filter("r < 9"), "r", ["k"], 0.1).first()["halfwidth"] is None


def test_models_rank_and_round_trip(spark, plant, tmp_path):
    df = repair.targets(repair.repair(plant), 120.0)
    feat = io.materialize(features.build_features(df, opcal.operating_calendar(df), 120.0, io.holidays(spark, days=[])).drop("y_cls").withColumn("y_cls", (F.col("y_peak") >= 120).cast("int")), "feat")
    fold = spark.createDataFrame([(1, dt.date(2024, 3, 22), dt.date(2024, 3, 24), dt.date(2024, 3, 31))], "fold int, train_end date, val_start date, val_end date")
    few = ["hour", "prod", "is_shutdown", "y_avg_lag24", "roll24_avg_mean"]
    fits = {"naive": models.seasonal_naive, "forest": models.forest(10, 6), "regime": models.regimes(models.forest(10, 6))}
    oof = models.cross_validate(feat, fold, fits, few, ("y_avg",))
    mae = {r["model"]: r["mae"] for r in oof.groupBy("model").agg(F.avg(F.abs(F.col("y_avg") - F.col("pred_avg"))).alias("mae")).collect()}
    assert mae["forest"] < mae["naive"] and mae["regime"] < mae["naive"]
    train, val = feat.filter("day <= date '2024-03-22' and not is_warmup"), feat.filter("day > date '2024-03-23'")
    prob = models.peak_classifier(train, few, trees=5)(val, "prob")
    assert prob.filter("prob < 0 or prob > 1 or prob is null").count() == 0
    knots = models.isotonic(prob)
    assert [k[1] for k in knots] == sorted(k[1] for k in knots)
    reg = models.forest(5, 4)(train, few, "y_avg")
    case = val.select("site_id", "ts", *few).filter("site_id = 1").limit(24)
    said = reg(case, "p").select("site_id", "ts", "p")
    path = f"file://{tmp_path}/bundle"
    serving.write_bundle(spark, path, {"avg": reg.model}, {"tau": 1.0}, case, said)
    loaded, settings, golden, expected = serving.read_bundle(spark, path)
    again = loaded["avg"].transform(models._vector(golden, few)).select("site_id", "ts", F.col("__p").alias("p"))
    serving.self_test(again, expected, ["site_id", "ts"], ["p"])
    with pytest.raises(PredictionError):
        serving.self_test(again.withColumn("p", F.col("p") + 1), expected, ["site_id", "ts"], ["p"])
    io.write_json(spark, f"{path}/manifest.json", {**io.read_json(spark, f"{path}/manifest.json"), "settings": {"tau": 2.0}})
    with pytest.raises(BundleError):
        serving.read_bundle(spark, path)
    out = serving.assemble(reg(val.filter("site_id = 1"), "y_avg_pred").withColumns({"y_peak_pred": F.lit(130.0), "prob": F.lit(0.5), "regime": F.lit(1), "q10": F.lit(1.0), "q50": F.lit(2.0), "q90": F.lit(3.0)}), 120.0, 0.5, [(0.0, 0.0), (1.0, 0.4)], {"operating": 1000.0, "shutdown": 5.0})
    r = out.first()
    assert tuple(out.columns) == serving.OUTPUT and r["peak_prob_cal"] == pytest.approx(0.2) and r["peak_label"] == 1 and out.filter("pi_lo < 0").count() == 0


def test_io(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    open(path, "w", encoding="utf-8-sig").write("d,v\n1,2.5\n2,\n")
    df = io.read_csv(spark, path, "date int, value double", {"value": "v2"})
    assert [tuple(r) for r in df.orderBy("date").collect()] == [(1, 2.5), (2, None)] and df.columns == ["date", "v2"]
    io.write_snapshot({"t": df}, f"file://{tmp_path}/snap")
    assert io.read_snapshot(spark, f"file://{tmp_path}/snap")["t"].count() == 2
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/snap/t")
    with pytest.raises(ValueError, match="isn't what was written"):
        io.read_snapshot(spark, f"file://{tmp_path}/snap")
    assert io.dumps({"b": float("nan"), "a": np.float64(1.5)}) == '{"a": 1.5, "b": null}'
    with pytest.raises(ValueError, match="unknown"):
        io.rows_to_frame(spark, [{"x": 1}], "a int")
    assert io.rows_to_frame(spark, [{"A": 1}], "a int, b string", {"A": "a"}).first().asDict() == {"a": 1, "b": None}


def test_streaming(spark, tmp_path):
    from loadlens.streaming import dayahead

    events = base.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = dayahead.start(dayahead.daily_origin(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = dayahead.daily_origin(events)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() > 0
    closed = got.groupBy().agg(F.sum("n").alias("n"), F.max("origin_day").alias("d")).first()
    assert closed["n"] == want.filter(F.col("origin_day") <= F.lit(closed["d"])).agg(F.sum("n").alias("n")).first()["n"]
    assert dayahead.sliding(events).count() > 0 and dayahead.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_plan_prunes_columns(spark):
    from loadlens.sources import meter

    plan = meter.hourly_sums(base.table(spark, SF, "events")).select("site_id", "ts", "n_buy")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1][:200] and "value:double" not in plan.split("ReadSchema")[1][:200]


@pytest.mark.parametrize("name", ["day_ahead_features", "regression_metrics", "tuned_threshold", "conformal_halfwidth", "lever_same_day", "policy_outcomes", "replayed_features", "repaired_series"])
def test_events_are_read_once(spark, name, monkeypatch):
    from loadlens.plans import queries  # noqa: F401
    from loadlens.sources import meter

    reads, plain = [], meter.hourly_sums
    monkeypatch.setattr(meter, "hourly_sums", lambda *a: reads.append(1) or plain(*a))
    plan = base.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(reads) == 1 and "event_type" not in plan and "user_id" not in plan


def test_intermediates_go(spark, tmp_path):
    with io.intermediates(spark) as paths:
        df = io.materialize(spark.range(5), "gone")
        kept = io.materialize(spark.range(5), "kept", lasting=True)
        assert df.count() == 5 and len(paths) == 1
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(paths[0] if paths else df.inputFiles()[0]).count()


def test_meter_range_follows_the_events(spark):
    from loadlens.sources import meter

    rows = [("2024-03-01 05:10:00", 1, "purchase", 2.0, "{}"), ("2025-01-02 00:20:00", 5, "view", 3.0, "{}")]
    events = spark.createDataFrame(rows, "t string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = meter.hourly_meter(events).agg(F.min("ts").cast("string"), F.max("ts").cast("string"), F.sum("p15"), F.sum("p30")).first()
    assert tuple(got) == ("2024-03-01 00:00:00", "2025-01-02 23:00:00", 2.0, 3.0)
    assert meter.hourly_meter(events.filter("1 = 0")).count() == 0
    assert meter.hourly_meter(events, start="2024-03-01 00:00:00", end="2024-03-01 23:00:00").count() == 24


def test_exit_codes():
    from loadlens.errors import LoadlensError

    assert [e("X").exit_code for e in (PredictionError, InputError, BundleError, LoadlensError)] == [1, 2, 3, 1]
    assert InputError("PLAN_INVALID", "no hour").as_row() == {"kind": "input", "reason": "PLAN_INVALID", "text": "no hour"}


def test_restore_fails_on_short_days(spark):
    rows = [(1, "d", h, h) for h in range(23)] + [(1, "d", 99, 23)]
    df = spark.createDataFrame(rows, "site_id int, day string, hour int, row_seq int")
    assert [r["hour"] for r in repair.restore_hours(df).orderBy("row_seq").collect()] == list(range(24))
    with pytest.raises(Exception, match="HOURS_NOT_RESTORABLE"):
        repair.restore_hours(df.filter("row_seq > 0")).collect()


def test_interpolate_many_knots(spark):
    r = np.random.default_rng(3)
    x = np.sort(r.uniform(0, 1, 3000))
    y = np.cumsum(r.uniform(0, 1, 3000))
    at = r.uniform(-0.1, 1.1, 200)
    df = spark.createDataFrame([(float(v),) for v in at], "x double")
    got = np.array([v[0] for v in df.select(stats.interpolate(F.col("x"), list(zip(x.tolist(), y.tolist())))).collect()])
    assert np.allclose(got, np.interp(at, x, y))


def test_binomial_limits_against_the_tail():
    import math

    def tail(k, n, p):
        return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for k, n, p in ((1, 7, 0.3), (5, 9, 0.9), (30, 60, 0.4), (60, 60, 0.99), (2, 400, 0.01)):
        assert math.isclose(stats._tail(k, n, p), tail(k, n, p), rel_tol=1e-11)
    low, high = stats.binomial_limits(500_000, 1_000_000)
    assert 0.49901 < low < 0.49903 and 0.50097 < high < 0.50099


def test_within_slope_without_variation(spark):
    rows = [(1, h, 2.0, 10.0 + h % 3) for h in range(24)] + [(2, 0, 1.0, 5.0), (2, 0, 3.0, 9.0), (3, 0, 1.0, 4.0)]
    got = {r["site_id"]: (r["beta"], r["r2"], r["identified"]) for r in stats.within_slope(spark.createDataFrame(rows, "site_id int, h int, x double, y double"), "x", "y", "h", ["site_id"]).collect()}
    assert got[1] == (0.0, 1.0, False) and got[2] == (2.0, 1.0, True) and got[3] == (0.0, None, False)


def test_correlation_without_variation(spark):
    """A constant column has no correlation: NaN, as the SQL gives, and no division by zero."""
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "x double, c double, nil double")
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["x", "c", "nil"]).collect()}
    assert got["x", "x"] == pytest.approx(1.0) and np.isnan(got["x", "c"]) and np.isnan(got["c", "c"])
    assert all(v is None for k, v in got.items() if "nil" in k)
    assert np.isnan(stats.spearman(df, "x", "c").first()["rho"])
    paired = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (4.0, 4.0), (None, 90.0), (70.0, None)], "a double, b double")
    assert paired.agg(stats.correlation("a", "b")).first()[0] == pytest.approx(np.corrcoef([1, 2, 4], [3, 5, 4])[0, 1])


def test_inner_partitions_stay_in_the_core():
    got = splits.inner_partitions("2021-01-01", "2021-07-01 00:00:00", 3, 14, 15, 1, 60)
    assert [b["eval_start"][:10] for b in got] == ["2021-05-20", "2021-06-03", "2021-06-17"] and got[-1]["eval_end"] == "2021-07-01 00:00:00"
    assert got[0]["core_end"][:10] == "2021-05-04"
    assert splits.inner_partitions("2021-06-01", "2021-07-01", 3, 14, 15) == []


def test_seed_sensitivity_by_hand(spark):
    r = np.random.default_rng(1)
    rows = [(f"2024-01-{d + 1:02d}", float(r.normal(5)), float(r.normal(5)), float(r.normal(5))) for d in range(12) for _ in range(4)]
    df = spark.createDataFrame(rows, "d string, y double, pred_a double, pred_b double").withColumn("day", F.to_date("d"))
    days = [f"2024-01-{d + 1:02d}" for d in range(12)]
    got = {x["seed"]: (x["ci_low"], x["ci_high"], x["p"]) for x in resample.seed_sensitivity(df, resample.seed_draws(spark, days, 2, 200, [3, 4])).collect()}
    e = np.array([[abs(y - a) - abs(y - b) for d, y, a, b in rows if d == day] for day in days])
    for seed in (3, 4):
        g = np.random.default_rng(seed)
        starts = resample.block_starts(days, 2)
        drawn = (starts[g.integers(0, len(starts), size=(200, 6))][:, :, None] + np.arange(2)).reshape(200, -1)[:, :12]
        diff = e.sum(1)[drawn].sum(1) / 48
        assert np.allclose(got[seed][:2], np.quantile(diff, [0.025, 0.975])) and np.isclose(got[seed][2], min(1, 2 * min((diff >= 0).mean(), (diff <= 0).mean())))
    lim = resample.mean_limits(df, F.col("y"), F.col("y") > 0, lambda n: resample.day_draws(spark, n, 50, 7)).first()
    drawn = np.random.default_rng(7).integers(0, 12, size=(50, 12))
    s = np.array([sum(y for d, y, _, _ in rows if d == day and y > 0) for day in days])
    c = np.array([sum(1 for d, y, _, _ in rows if d == day and y > 0) for day in days])
    assert np.allclose((lim["low"], lim["high"]), np.quantile(s[drawn].sum(1) / c[drawn].sum(1), [0.025, 0.975]))


def test_small_helpers(spark, tmp_path):
    """What no registered query reaches."""
    from loadlens.plans import evaluate, models

    df = spark.createDataFrame([(1, f"2024-01-0{i + 1} 00:00:00", float(i * i), i) for i in range(6)], "site_id int, t string, v double, i int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [r["m"] for r in df.select("i", windows.earlier_only(df, "v", "ts", "site_id").alias("m")).orderBy("i").collect()] == [None, 0.0, 0.5, 1.0, 2.5, 4.0]
    one, other = (sorted(r["i"] for r in splits.seeded_sample(x, 3, 9, "site_id", "i").collect()) for x in (df, df.repartition(5)))
    assert one == other and len(one) == 3
    assert splits.frame_digest(df, ["i", "v"]).first() == splits.frame_digest(df.repartition(3), ["i", "v"]).first()
    z = np.array([r["z"] for r in models.standardize(df.filter("i < 4"), df, ["v"]).orderBy("i").collect()])[:, 0]
    base_ = np.array([0.0, 1.0, 4.0, 9.0])
    assert np.allclose(z, (np.arange(6) ** 2 - base_.mean()) / base_.std(ddof=1))
    judged = evaluate.judge_variants(spark.createDataFrame([("a", -1.0, -0.1, 0.0, 0.0), ("b", -0.1, 0.2, 0.0, 0.0)], "v string, d_mae double, d_peak_mae double, d_recall double, d_fold_std double"), 0.5)
    assert {r["v"]: r["accepted"] for r in judged.collect()} == {"a": True, "b": False}
    cal = spark.createDataFrame([(f, p / 10, int(p > 5)) for f in (1, 2) for p in range(10)], "fold int, prob double, y_cls int")
    got = {(r["fold"], r["prob"]): r["prob_cal"] for r in models.calibrate_forward(cal).collect()}
    assert all(got[1, p / 10] == p / 10 for p in range(10)) and got[2, 0.0] == 0.0 and got[2, 0.9] == 1.0
    io.write_csv(df.select("i", "v"), f"{tmp_path}/csv", one_file=True)
    assert io.read_csv(spark, f"{tmp_path}/csv", "i int, v double").agg(F.sum("v")).first()[0] == 55.0
    io.write_text(spark, f"file://{tmp_path}/note", "one")
    io.write_text(spark, f"file://{tmp_path}/note", "two")
    assert io.read_text(spark, f"file://{tmp_path}/note") == "two"


def test_search_and_importance(spark):
    """The feature that tells the label matters more than noise; settings differ, and the best so far never rises."""
    from loadlens.plans import models

    r = np.random.default_rng(2)
    rows = [(1, i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(r.uniform(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "site_id int, ts int, a double, b double, y double")
    predict = models.forest(5, 4)(df, ["a", "b"], "y")
    up = {x["feature"]: x["increase"] for x in models.permutation_importance(predict, df, ["a", "b"], "y", repeats=1).collect()}
    assert up["a"] > 10 * max(up["b"], 0.01)
    found = models.random_search(df.filter("ts < 150"), df.filter("ts >= 150"), ["a", "b"], "y", trials=2)
    assert len(found) == 2 and found[0]["best"] >= found[1]["best"] and found[0]["trees"] != found[1]["trees"]
