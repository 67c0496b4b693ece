"""Quantile regression, prediction of days from a bundle, digests of model folders, and gates."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.errors import BundleError, InputError
from loadlens.functions import quantiles
from loadlens.operators import features, opcal, repair
from loadlens.plans import gates, models, serving
from loadlens.sources import io


def loss(points, beta, q):
    return sum(max(q * r, (q - 1) * r) for *x, y in points for r in [y - beta[0] - sum(b * v for b, v in zip(beta[1:], x, strict=True))])


def best_loss(points, q):
    """A best fit goes through as many points as it has coefficients: all such fits are tried."""
    least = float("inf")
    for part in itertools.combinations(points, 3):
        a = np.array([[1.0, *x] for *x, _ in part])
        if abs(np.linalg.det(a)) > 1e-9:
            least = min(least, loss(points, np.linalg.solve(a, [p[-1] for p in part]), q))
    return least


@pytest.mark.parametrize("seed", [1, 2])
def test_quantile_fits_against_all_basic_ones(spark, seed):
    r = random.Random(seed)
    points = {k: [(x := r.uniform(0, 9), z := r.uniform(-2, 2), 3 + 2 * x - z * k + r.gauss(0, 1 + x / 3)) for _ in range(26)] for k in (1, 2)}
    rows = [(k, *p) for k, ps in points.items() for p in ps] + [(1, None, 0.0, 1e6), (2, float("nan"), 0.0, 1e6), (2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, z double, y double").repartition(3)
    fits = quantiles.fit(df, ["x", "z"], "y", key="k")
    assert set(fits) == {(k, q) for k in (1, 2) for q in (0.1, 0.5, 0.9)}
    for (k, q), beta in fits.items():
        assert loss(points[k], beta, q) <= 1.01 * best_loss(points[k], q)
    one = quantiles.fit(df.filter("k = 1"), ["x", "z"], "y", (0.5,))
    assert np.allclose(one[None, 0.5], fits[1, 0.5], atol=1e-3)
    assert quantiles.table(df, fits, ["x", "z"]).count() == 18
    assert quantiles.fit(df.filter("k = 3"), ["x", "z"], "y") == {}


def test_quantiles_do_not_cross(spark):
    df = spark.createDataFrame([(1.0, 9.0), (5.0, 2.0), (None, 1.0)], "a double, b double")
    out = df.select(*(c.alias(n) for n, c in quantiles.ordered({"lo": F.col("a"), "hi": F.col("b")}).items())).collect()
    assert [tuple(r) for r in out][:2] == [(1.0, 9.0), (2.0, 5.0)]
    t = quantiles.interval_table(df.dropna().select(F.lit(4.0).alias("y"), *(c.alias(n) for n, c in quantiles.ordered({"lo": F.col("a"), "hi": F.col("b")}).items())), "y", {"lo": 0.1, "hi": 0.9}, []).first()
    assert (t.n, t.coverage, t.width) == (2, 1.0, 5.5) and t.pinball_lo == pytest.approx((0.3 + 0.2) / 2)


@pytest.fixture(scope="module")
def plant(spark):
    """24 days of two sites, one with a bar in its name."""
    r, rows = random.Random(4), []
    for site in ("a|b", "c"):
        for d in range(24):
            for h in range(24):
                made = 0.0 if d % 7 >= 5 or not 7 <= h <= 19 else float(r.randint(500, 1500))
                p = [max(1.0, float(round(20 + made * 0.1 + r.gauss(0, 4)))) for _ in range(4)]
                rows.append((site, d, h, *p, float(np.floor(np.mean(p) + 0.5)), made, 30.0, 1.0 if 9 <= h <= 17 else 1.5, 15.0, 2.0, 50.0, 0.0))
    df = spark.createDataFrame(rows, "site_id string, d int, hour int, p15 double, p30 double, p45 double, p60 double, avg double, prod double, headcount double, labor double, temp double, wind double, humid double, rain double")
    day = F.date_add(F.lit("2024-03-01").cast("date"), F.col("d"))
    return df.select("site_id", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, d, hour)").alias("ts"), day.alias("day"), *df.columns[2:]).repartition(4)


COVER = serving.HolidayCover("2024-03-01", "2024-03-20", (2026,))
SERVED = serving.Served(100.0, 90.0, 0.5, ((0.2, 0.0), (0.9, 0.8)), {"operating": 25.0, "shutdown": 10.0}, ("2024-03-05",), COVER)


def predict(df):
    lag = F.col("y_avg_lag24")
    return df.withColumns({"y_avg_pred": lag, "y_peak_pred": F.col("y_peak_lag24"), "prob": F.lit(0.6), "regime": F.lit(1), "q10": lag - 5, "q50": lag, "q90": lag + 5})


def test_one_day_and_many_days_say_the_same(spark, plant):
    day = "2024-03-20"
    plan = plant.filter(f"day = date '{day}'").select("site_id", "ts", "day", "prod", "headcount", "temp", "wind", "humid", "rain")
    one = serving.predict_day(plant.filter(f"day < date '{day}'"), plan, day, SERVED, predict)
    days = spark.createDataFrame([(f"2024-03-{d}",) for d in (15, 20, 22)], "d string").select(F.to_date("d").alias("day"))
    many = serving.predict_days(plant, days, SERVED, predict)
    assert tuple(one.columns) == tuple(many.columns) == serving.OUTPUT and len(serving.OUTPUT) == 14  # the site and thirteen columns
    assert sorted(one.collect()) == sorted(many.filter(f"to_date(ts) = date '{day}'").collect()) and one.count() == 48
    assert {(r.site_id, str(r.day)) for r in many.select("site_id", F.to_date("ts").alias("day")).distinct().collect()} == {(s, f"2024-03-{d}") for s in ("a|b", "c") for d in (15, 20)}
    refused = serving.refused_days(days, COVER).collect()
    assert [(str(r.day), r.code) for r in refused] == [("2024-03-22", "CALENDAR_NOT_COVERED")]


@pytest.mark.parametrize("day, ok", [("2024-03-01", True), ("2024-03-20", True), ("2024-03-21", False), ("2023-03-05", False), ("2026-03-01", True), ("2025-12-31", False)])
def test_holiday_cover(spark, day, ok):
    assert spark.range(1).select(COVER.covers(F.lit(day).cast("date"))).first()[0] is ok


def test_uncovered_day_is_refused(plant):
    with pytest.raises(InputError) as e:
        serving.predict_day(plant, plant, "2024-03-22", SERVED, predict)
    assert e.value.reason == "CALENDAR_NOT_COVERED" and e.value.exit_code == 2


def test_settings_round_trip(spark, tmp_path):
    io.write_json(spark, f"file://{tmp_path}/s.json", SERVED.as_settings())
    assert serving.Served.from_settings(io.read_json(spark, f"file://{tmp_path}/s.json")) == SERVED


def test_predictions_that_are_no_numbers_fail(spark):
    row = [("s", 50.0, 60.0, 0.5, 1, 40.0, 50.0, 60.0, 0)]
    df = spark.createDataFrame(row, "site_id string, y_avg_pred double, y_peak_pred double, prob double, regime int, q10 double, q50 double, q90 double, is_shutdown int").withColumn("ts", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    assert serving.assemble(df, 60.0, 0.6, [(0.0, 0.0), (1.0, 0.4)], SERVED.halfwidth).first()[2:] == (50.0, 60.0, 1, 1, 0.5, 0.2, 0, 40.0, 50.0, 60.0, 25.0, 75.0)
    for bad in ({"q50": F.lit(float("nan"))}, {"y_avg_pred": F.lit(float("inf"))}, {"prob": F.lit(None).cast("double")}):
        with pytest.raises(Exception, match="PREDICTION_NONFINITE"):
            serving.assemble(df.withColumns(bad), 60.0, 0.6, [(0.0, 0.0), (1.0, 0.4)], SERVED.halfwidth).collect()


def test_a_changed_byte_of_a_model_is_noticed(spark, plant, tmp_path):
    train = plant.select("site_id", "ts", "hour", "prod", F.col("avg").alias("y_avg"))
    model = models.forest(2, 2)(train, ["hour", "prod"], "y_avg")
    path = f"file://{tmp_path}/bundle"
    core = serving.write_bundle(spark, path, {"avg": model.model}, SERVED.as_settings(), train.limit(3), train.limit(3))
    assert set(core["models"]) == {"avg"} and set(serving.read_bundle(spark, path)[0]) == {"avg"}
    part = next(p for p in Path(f"{tmp_path}/bundle/models/avg").rglob("part-*.parquet") if p.stat().st_size > 500)
    whole = part.read_bytes()
    for crc in part.parent.glob(f".{part.name}.crc"):
        crc.unlink()
    part.write_bytes(whole[:300] + bytes([whole[300] ^ 1]) + whole[301:])
    with pytest.raises(BundleError, match="MODEL_CHANGED"):
        serving.read_bundle(spark, path)
    part.write_bytes(whole)
    assert serving.read_bundle(spark, path)[1] == SERVED.as_settings() | {"cover": {"start": "2024-03-01", "end": "2024-03-20", "years": [2026]}, "knots": [[0.2, 0.0], [0.9, 0.8]], "holidays": ["2024-03-05"], "edges": [30.0, 70.0]}
    (part.parent / "part-99999-more.parquet").write_bytes(whole)
    with pytest.raises(BundleError, match="MODEL_CHANGED"):
        serving.read_bundle(spark, path)


def test_gate_counts_while_it_writes(spark, plant):
    """The checks add no scan: the written plan reads its source once, and the result is the written table."""
    df = repair.targets(repair.repair(plant))
    out, table = gates.through(df, "repair", gates.repair_checks())
    assert out.count() == 2 * 24 * 24 and {r.check: (r.n_wrong, r.passed) for r in table.collect()} == dict.fromkeys([c.name for c in gates.repair_checks()], (0, True))
    broken = df.withColumn("hour", F.when((F.col("hour") == 5) & (F.col("site_id") == "c"), 6).otherwise(F.col("hour"))).withColumn("wind", F.lit(None).cast("double"))
    table = {r.check: r for r in gates.through(broken, "repair", gates.repair_checks())[1].collect()}
    assert table["hour_of_timestamp"].n_wrong == 24 and not table["weather_known"].passed and table["weather_known"].severity == "warn"
    with pytest.raises(gates.GateError, match="repair: hour_of_timestamp$") as e:
        gates.passed(broken, "repair", gates.repair_checks())
    assert e.value.facts == {"hour_of_timestamp": 24}
    source = io.materialize(df, "gate-source")
    watched = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gate", "gate")
    gates.through(source, "repair", gates.repair_checks())
    watched = [j for j in tracker.getJobIdsForGroup("gate") if len(tracker.getJobInfo(j).stageIds)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(watched) == 1
    assert gates.passed(df.limit(0), "repair", gates.repair_checks()).count() == 0


def test_feature_gate_finds_leaks(spark, plant):
    df = repair.targets(repair.repair(plant))
    feat = features.build_features(df, opcal.operating_calendar(df), 100.0, io.holidays(spark, days=[]))
    state = lambda checks: {r.check: r.passed for r in gates.through(feat, "features", checks)[1].collect()}
    assert all(state(gates.feature_checks()).values())
    assert not state(gates.feature_checks((*features.FEATURES, "y_avg")))["no_power_of_the_hour"]
    assert not state(gates.feature_checks((*features.FEATURES, "prod")))["no_repeated_columns"]
    assert not gates.through(feat.withColumn("is_warmup", F.lit(False)), "features", gates.feature_checks())[1].filter("check = 'usable_rows_are_whole'").first().passed


def test_missing_features_are_told_from_zero(spark):
    rows = [(i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i % 5), 100.0 if i % 3 != 2 else 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    said = models.forest(5, 3)(df, ["x"], "y")(df, "p").collect()
    assert all(r.p > 90 for r in said if r.i % 3 != 2) and all(r.p < 20 for r in said if r.i % 3 == 2)
    with pytest.raises(Exception):  # noqa: B017
        models.standardize(df, df, ["x"]).collect()


def test_cluster_without_a_shared_folder_fails(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: conf.get(k, d))})

    made = lambda master, **more: io.shared_dir(Session(**{"spark.master": master, "spark.sql.warehouse.dir": "file:/w", **more}))
    assert made("local[8]") == made("local") == "file:/w/loadlens-intermediate"
    assert made("yarn", **{"spark.checkpoint.dir": "hdfs://x"}) == "hdfs://x"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,512]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            made(master)


def test_sites_named_with_a_bar_keep_their_names(spark, plant):
    from loadlens.plans import policy

    df = repair.targets(repair.repair(plant))
    out = policy.scenario_table(df, 100.0, 0.05).select("scenario", "site_id").distinct().collect()
    assert {tuple(r) for r in out} == {(s, site) for s in policy.SCENARIOS for site in ("a|b", "c")}


def test_scenarios_change_their_own_day_only(spark, plant):
    """The base scenario is what serving gives; a changed stored row stops the audit; a scenario's plan is no other day's past."""
    from loadlens.errors import PredictionError
    from loadlens.plans import policy, sensitivity

    def by_plan(df):
        return predict(df).withColumn("y_avg_pred", F.col("y_avg_lag24") + 0.1 * F.col("prod") + F.col("cdd"))

    days = spark.createDataFrame([("2024-03-14",), ("2024-03-15",), ("2024-03-22",)], "d string").select(F.to_date("d").alias("day"))
    stored = io.materialize(serving.predict_days(plant, days, SERVED, by_plan, 12), "stored")
    grid = policy.scenarios(spark).filter("scenario in ('C0', 'P80', 'T+2', 'S+1')")
    made = sensitivity.audited(sensitivity.scenario_predictions(plant, days, grid, SERVED, by_plan, 12), stored)
    assert made.groupBy("scenario").count().collect() and {r["count"] for r in made.groupBy("scenario").count().collect()} == {2 * 2 * 24}
    rows = {(r.scenario, r.site_id, r.ts): r.y_avg_pred for r in made.collect()}
    prod = {(r.site_id, r.ts): r["prod"] for r in plant.collect()}
    for (scenario, site, ts), v in rows.items():
        if scenario == "P80":
            assert v == pytest.approx(rows["C0", site, ts] - 0.02 * prod[site, ts])
        if scenario == "T+2":  # 15 degrees and two more cool nothing
            assert v == pytest.approx(rows["C0", site, ts])
    total = lambda s: sum(v for (name, *_), v in rows.items() if name == s)
    assert total("S+1") == pytest.approx(total("C0"))  # production moves within its day
    one = stored.withColumn("q50", F.when((F.hour("ts") == 7) & (F.col("site_id") == "c"), F.col("q50") + 1e-6).otherwise(F.col("q50")))
    with pytest.raises(PredictionError, match="NOT_INVARIANT.*q50"):
        sensitivity.audited(made, one)
    assert sensitivity.audit(made.filter("hour(ts) <> 3"), stored).count() == 2 * 2
    e = {(r.scenario, r.site_id): r for r in sensitivity.effects(made).collect()}
    assert e["C0", "c"].hours_changed == 0 and e["P80", "c"].mean_change < 0 and e["P80", "c"].n == 48
