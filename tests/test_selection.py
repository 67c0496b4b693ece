"""Keyed forests, nested selection and feature studies, against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loadlens.functions import metrics, stats
from loadlens.operators import windows
from loadlens.operators.features import FEATURES, GROUPS
from loadlens.plans import temporal, trees, variants

VARIANTS = (("all", [0, 1, 2]), ("no_a", [1, 2]), ("no_b", [0, 2]), ("no_c", [0, 1]))


@pytest.fixture(scope="module")
def small(spark):
    r, rows = random.Random(1), []
    for spec in (0, 1):
        for i in range(120):
            x = [r.random(), r.choice([None, 1.0, 2.0, 3.0]), r.random()]
            y = 10 * x[0] + (x[1] or 0) * 3 + r.random() if spec == 0 else 5 * x[2]
            rows.append((spec, i, None if i % 5 == 0 else round(y, 3), *x))
    df = spark.createDataFrame(rows, "spec int, id int, y double, a double, b double, c double")
    return df.select("spec", "id", "y", trees.binned(list("abc"), trees.edges_of(df, list("abc"), 8)).alias("bins")).repartition(3)


def grown(rows, weight, looked_at, allowed, depth, least):
    """A tree by plain search: predictions of the rows without y."""
    out = {}

    def go(train, rest, level):
        n, s = sum(weight[x.id] for x in train), sum(weight[x.id] * round(x.y * 1e6) for x in train)
        best = None
        for f in [f for f in allowed if looked_at[f]] if level < depth else ():
            for b in sorted({x.bins[f] for x in train}):
                left = [x for x in train if x.bins[f] <= b]
                ln, ls = sum(weight[x.id] for x in left), sum(weight[x.id] * round(x.y * 1e6) for x in left)
                if min(ln, n - ln) >= least:
                    gain = round((ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n) / 1e12, 6)
                    if gain > 0 and (best is None or (gain, -f, -b) > best):
                        best = gain, -f, -b
        if best is None:
            out.update({x.id: s / n / 1e6 for x in rest})
            return
        f, b = -best[1], -best[2]
        go([x for x in train if x.bins[f] <= b], [x for x in rest if x.bins[f] <= b], level + 1)
        go([x for x in train if x.bins[f] > b], [x for x in rest if x.bins[f] > b], level + 1)

    go([x for x in rows if x.y is not None and weight[x.id]], [x for x in rows if x.y is None], 0)
    return out


def test_forests_against_plain_trees(spark, small):
    listed = spark.createDataFrame([(s, n, f) for s in (0, 1) for n, f in VARIANTS], "spec int, variant string, features array<int>")
    got = {(r.spec, r.variant, r.id): r.value for r in trees.forests(small, listed, trees=3, depth=3, least=4, share=0.7).collect()}
    key = spark.range(2).select(F.col("id").cast("int").alias("spec"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree"))
    weight = {(r.spec, r.tree, r.id): r.w for r in key.crossJoin(small.select("id").distinct()).select("spec", "tree", "id", trees.drawn(42, F.col("spec"), F.col("tree"), F.col("id")).alias("w")).collect()}
    looks = {(r.spec, r.tree, r.f): r.s for r in key.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("f")).select("spec", "tree", "f", trees.in_share(42, 0.7, F.col("f"), F.col("spec"), F.col("tree")).alias("s")).collect()}
    rows = small.collect()
    assert len(got) == 2 * 4 * 24 and len({round(v, 6) for v in got.values()}) > 20
    for spec in (0, 1):
        own = [r for r in rows if r.spec == spec]
        for name, allowed in VARIANTS:
            made = [grown(own, {r.id: weight[spec, t, r.id] for r in own}, [looks[spec, t, f] for f in range(3)], allowed, 3, 4) for t in range(3)]
            for i in made[0]:
                assert got[spec, name, i] == pytest.approx(sum(m[i] for m in made) / 3, abs=1e-9)


def test_variants_that_split_alike_share_their_nodes(spark, small, monkeypatch):
    """Leaving out a feature that no tree uses adds no row to any level."""
    levels = []
    monkeypatch.setattr(trees, "materialize", lambda df, name: _kept(levels, df, name))
    one = small.filter("spec = 1")
    for names in (["all"], ["all", "no_a", "no_b"]):
        levels.clear()
        listed = spark.createDataFrame([(1, n, dict(VARIANTS)[n]) for n in names], "spec int, variant string, features array<int>")
        values = trees.forests(one, listed, trees=2, depth=2, least=4).collect()
        members = [n for name, n in levels if name == "tree-members"]
        if len(names) == 1:
            alone = members
    assert members == alone  # only c says anything of y
    by = {}
    for r in values:
        by.setdefault(r.id, set()).add(round(r.value, 9))
    assert all(len(v) == 1 for v in by.values())


def _kept(levels, df, name):
    from loadlens.sources.io import materialize

    out = materialize(df, name)
    levels.append((name, out.count()))
    return out


def test_nested_windows():
    made = temporal.nested_windows("2021-01-01", ["2021-07-07"])
    outer = dict(made[0].bounds)
    # A fortnight's tail and evaluation with a day between the parts.
    assert outer == {"core_end": "2021-06-21 00:00:00", "cal_start": "2021-06-22 00:00:00", "cal_end": "2021-07-06 00:00:00", "eval_start": "2021-07-07 00:00:00", "eval_end": "2021-07-21 00:00:00"}
    inner = [dict(w.bounds) for w in made[1:]]
    assert [b["eval_start"][:10] for b in inner] == ["2021-05-10", "2021-05-24", "2021-06-07"] and inner[-1]["eval_end"] == outer["core_end"]
    assert all(b["core_end"] < b["cal_start"] < b["cal_end"] < b["eval_start"] < b["eval_end"] <= outer["core_end"] for b in inner)
    assert len(temporal.nested_windows("2021-05-20", ["2021-07-07"])) == 1


def hours(spark, change_from=None):
    rows, r = [], random.Random(2)
    for d in range(40):
        for h in range(24):
            avg = 50.0 + 40 * (9 <= h <= 17) + r.randint(0, 20)
            rows.append((1, f"2024-01-01 {h:02d}:00:00", d, avg, avg + r.randint(0, 60)))
    df = spark.createDataFrame(rows, "site_id long, t string, d int, y_avg double, y_peak double")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    df = df.select("site_id", F.to_timestamp_ntz(F.concat(day.cast("string"), F.substring("t", 11, 9))).alias("ts"), day.alias("day"), "y_avg", "y_peak", *(F.lit(False).alias(c) for c in ("is_warmup", "is_outage", "is_erp_missing")))
    if change_from:
        df = df.withColumns({c: F.when(F.col("day") >= change_from, -999.0).otherwise(F.col(c)) for c in ("y_avg", "y_peak")})
    return df


def candidates(df, windows):
    guess = {"low": (F.lit(60.0), F.lit(80.0)), "hourly": (50.0 + 40 * F.hour("ts").between(9, 17).cast("int"), 80.0 + 40 * F.hour("ts").between(9, 17).cast("int")), "same": (F.lit(60.0), F.lit(80.0))}
    return temporal.naive_candidates(temporal.in_windows(df, windows), guess)


def test_selection_sees_the_core_only(spark):
    """Changing every target of the outer tail and evaluation leaves scores and choice as they are; ties go to the first registered."""
    windows = temporal.nested_windows("2024-01-01", ["2024-02-01"], 4, 4, 4, 2, 5)
    core_end = dict(windows[0].bounds)["core_end"][:10]
    order = ["same", "low", "hourly"]
    rows = [sorted(temporal.select_on_core(candidates(hours(spark, change), windows), order).collect()) for change in (None, core_end)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    by = {r.model: r for r in rows[0]}
    assert by["hourly"].selected and by["same"].score == by["low"].score < by["hourly"].score
    tied = temporal.select_on_core(candidates(hours(spark), windows).filter("model <> 'hourly'"), order).collect()
    assert {r.model: r.selected for r in tied} == {"same": True, "low": False} and len({r.score for r in tied}) == 1
    outer = [{r.model: r.mae for r in temporal.nested_selection(candidates(hours(spark, c), windows), order).collect()} for c in (None, core_end)]
    assert outer[0]["low"] != outer[1]["low"]


def test_scores_stay_defined_without_peaks(spark):
    rows = [(1, 1, m, 24, 10.0 + i, None, 0, 0) for i, m in enumerate("abc")]
    got = {r.model: r for r in temporal.scored(spark.createDataFrame(rows, "outer int, inner int, model string, n long, mae double, peak_mae double, tp long, fn long"), list("abc")).collect()}
    # Undefined ranks count nothing: 0.30 for the least error, 0.20 for equal deviations, 0.10 for being feasible.
    assert [round(got[m].score, 9) for m in "abc"] == [0.6, 0.45, 0.3] and got["a"].selected


def test_few_positives_fall_back_to_theta(spark):
    rows = [(1, 0, "m", "calibration", 100.0, 10, "x", None, 50.0, 60.0 + i, int(i < k), 50.0, 40.0 + i) for k in (4,) for i in range(40)]
    df = spark.createDataFrame(rows, "outer int, inner int, model string, role string, theta double, n_core long, site_id string, ts string, y_avg double, y_peak double, y_cls int, pred_avg double, pred_peak double")
    one = temporal.tail_thresholds(df).first()
    assert one.fallback and one.tau == 100.0 and one.n_calibration == 40


def test_counts_of_past_peaks_by_each_windows_threshold(spark):
    df = hours(spark)
    windows = temporal.nested_windows("2024-01-01", ["2024-02-01"], 4, 4, 4, 1, 5)
    rows = temporal.in_windows(df.withColumns({c: F.lit(-1.0) for c in temporal._COUNTS}), windows)
    got = temporal.recounted(rows, df).filter("inner = 1 and hour(ts) = 5").collect()
    past = {}
    for r in df.collect():
        past.setdefault(r.day, []).append(r.y_peak)
    assert len(got) > 10
    days = sorted(past)
    for r in got:
        k = days.index(r.day)
        count = lambda n: float(sum(p >= r.theta for d in days[k - n : k] for p in past[d])) if k >= n else None  # noqa: B023, E731
        assert (r.roll24_peak_cnt, r.roll168_peak_cnt) == (count(1), count(7))


def test_subsets():
    made = variants.subsets()
    assert len(made) == 1 + 5 + 44 + len(GROUPS) + 3 + 1
    names = lambda v: {FEATURES[i] for i in made[v] if i < len(FEATURES)}
    # Without the plan nothing of the day's production or the calendar that follows from it is left; the day before is known.
    assert not names("plan") & {"prod", "headcount", "prod_chg_ratio", "prod_cum_day", "is_shutdown", "shutdown_nth", "is_first_day_back", "is_state_switch"} and "prev_day_shutdown" in names("plan")
    assert made["null:3"] == [*range(44), 47] and len(names("lag:48")) == 42 and len(names("feature:hour")) == 43


def test_judged_variants(spark):
    fold = lambda a, b: {1: a, 2: b}
    rows = [("all", 48, 10.0, 20.0, 0.5, 1.0, 9.0, fold(10.0, 10.0)), ("null:0", 48, 10.2, 20.1, 0.5, 1.0, 9.1, fold(10.1, 10.3)), ("null:1", 48, 9.7, 20.5, 0.5, 1.0, 9.0, fold(9.5, 9.9)),
            ("good", 48, 9.0, 20.2, 0.5, 1.0, 8.0, fold(9.5, 8.5)), ("one_fold", 48, 9.0, 20.0, 0.5, 1.0, 8.0, fold(7.5, 10.5)), ("peaks", 48, 9.0, 20.0, 0.48, 1.0, 8.0, fold(9.0, 9.0)), ("small", 48, 9.9, 20.0, 0.5, 1.0, 9.0, fold(9.9, 9.9))]
    table = spark.createDataFrame(rows, "variant string, n long, mae double, peak_mae double, recall double, fold_std double, mae_normal_days double, folds map<int,double>")
    ci = spark.createDataFrame([(v, -1.0, -0.1 if v not in ("small", "null:0") else 0.1) for v, *_ in rows if v != "all"], "variant string, ci_low double, ci_high double")
    got = {r.variant: r for r in variants.judged(table, ci).collect()}
    assert got["good"].noise_mae == pytest.approx(0.3) and got["good"].noise_peak_mae == pytest.approx(0.5)
    assert {v for v, r in got.items() if r.accepted} == {"good", "null:1"}
    assert not got["one_fold"].folds_hold and got["one_fold"].improved_folds == 1 and not got["peaks"].peaks_hold and not got["small"].clear and not got["small"].beyond_noise


def expected(tree, node, bins, known):
    """A tree's value where only the known features are asked for, the others by the shares of training rows."""
    value, n, f, b = tree[node]
    if f is None:
        return value
    left, right = f"{node}/{f}:{b}:L", f"{node}/{f}:{b}:R"
    if f in known:
        return expected(tree, left if bins[f] <= b else right, bins, known)
    return (tree[left][1] * expected(tree, left, bins, known) + tree[right][1] * expected(tree, right, bins, known)) / n


def test_attributions_against_all_subsets(spark):
    """Six features, all subsets enumerated; the values of a row sum up to its prediction."""
    r, rows = random.Random(7), []
    for i in range(150):
        x = [r.randint(0, 5) for _ in range(6)]
        rows.append((0, i, None if i % 15 == 0 else float(x[0] * 3 + x[1] * x[2] + (x[3] > 2) * 5 - x[4]), x))
    df = spark.createDataFrame(rows, "spec int, id int, y double, bins array<int>")
    df = df.withColumn("bins", F.col("bins").cast("array<tinyint>"))
    listed = spark.createDataFrame([(0, "all", list(range(6))), (0, "some", [0, 3, 5])], "spec int, variant string, features array<int>")
    values, nodes = trees.grown(df, listed, trees=2, depth=4, least=3)
    rest = df.filter("y is null")
    phi = trees.attributions(rest, nodes, 2)
    got = {(p.variant, p.id, p.feature): p.phi for p in phi.collect()}
    said = {(v.variant, v.id): v.value for v in values.collect()}
    for key, value in said.items():
        assert sum(p for (v, i, _), p in got.items() if (v, i) == key) == pytest.approx(value, abs=1e-9)
    forest = {}
    for x in nodes.collect():
        forest.setdefault((x.variant, x.tree), {})[x.node] = (x.value, x.n, x.feature, x.bin)
    for variant in ("all", "some"):
        for row in rest.limit(4).collect():
            f = lambda known: sum(expected(forest[variant, t], f"0/{t}", row.bins, known) for t in range(2)) / 2  # noqa: B023, E731
            assert got[variant, row.id, None] == pytest.approx(f(()), abs=1e-9)
            for i in range(6):
                others = [j for j in range(6) if j != i]
                want = sum(math.factorial(k) * math.factorial(5 - k) / 720 * (f((*s, i)) - f(s)) for k in range(6) for s in itertools.combinations(others, k))
                assert got.get((variant, row.id, i), 0.0) == pytest.approx(want, abs=1e-9)
    by = {x.feature: x for x in trees.importance(phi.filter("variant = 'all'"), rest, list("abcdef")).collect()}
    assert by["a"].direction == 1 and by["e"].direction <= 0 and by["a"].mean_abs > by["e"].mean_abs


@pytest.mark.parametrize("down", [False, True])
def test_running_sums_by_ranges(spark, down, monkeypatch):
    """Keys of any size, null keys and values, ranges that hold nothing or one value; exact in either direction."""
    monkeypatch.setattr(windows, "RANGES", 5)
    r = random.Random(3)
    rows = {(k, v): (r.randint(1, 9), r.randint(0, 3)) for k in ("a", "b", None) for v in [None, *(round(r.gauss(0, 1), 3) for _ in range(60 if k == "a" else 2))]}
    df = spark.createDataFrame([(*kv, *x) for kv, x in rows.items()], "k string, v double, n long, p long").repartition(4)
    got = {(x.k, x.v): (x.upto, x.pos) for x in windows.running_sums(df, "v", {"upto": "n", "pos": "p"}, "k", down=down).collect()}
    rank = lambda v: (v is not None, v or 0.0) if not down else (v is None, -(v or 0.0))
    for (k, v), x in got.items():
        below = [y for (k2, v2), y in rows.items() if k2 == k and rank(v2) <= rank(v)]
        assert x == (sum(n for n, _ in below), sum(p for _, p in below))
    alone = windows.running_sums(df.filter("k = 'a' and v is not null"), "v", {"upto": "n"}, down=down).agg(F.max("upto")).first()[0]
    assert alone == sum(n for (k, v), (n, _) in rows.items() if k == "a" and v is not None)


def test_ordered_metrics_against_plain(spark):
    r = random.Random(8)
    rows = [(m, int(r.random() < 0.3), round(r.random(), 2 if m == "x" else 6)) for m in ("x", "y") for _ in range(400)]
    df = spark.createDataFrame(rows, "m string, y int, s double").repartition(4)
    for x in metrics.average_precision(df, "y", "s", ["m"]).collect():
        own = [(s, y) for m, y, s in rows if m == x.m]
        pos, ap, before = sum(y for _, y in own), 0.0, 0.0
        for t in sorted({s for s, _ in own}, reverse=True):
            said = [y for s, y in own if s >= t]
            ap, before = ap + (sum(said) / pos - before) * sum(said) / len(said), sum(said) / pos
        assert x.average_precision == pytest.approx(ap, abs=1e-12)
    for x in metrics.conformal(df, "s", ["m"], 0.1).collect():
        own = sorted(s for m, _, s in rows if m == x.m)
        assert (x.n, x.halfwidth) == (400, own[math.ceil(401 * 0.9) - 1])


def test_correlation_p_against_integrals(spark):
    def by_integral(rho, n):
        """Two tails of Student's t by Simpson's rule over the angle of its substitution."""
        free, t = n - 2, abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
        a, b, k = math.atan(t / math.sqrt(free)), math.pi / 2, 4000
        f = lambda u: math.cos(u) ** (free - 1)
        h = (b - a) / k
        s = f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, k))
        return 2 * s * h / 3 * math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(math.pi)

    cases = [(0.6319, 10), (0.05, 500), (-0.4, 27), (0.9, 4), (0.01, 1000), (0.97, 30), (0.5, 3), (0.3, 2000)]
    df = spark.createDataFrame(cases, "r double, n long").select("r", "n", stats.correlation_p(F.col("r"), F.col("n")).alias("p"))
    for x in df.collect():
        assert x.p == pytest.approx(by_integral(x.r, x.n), rel=1e-9, abs=1e-12)
    assert [x.p for x in spark.createDataFrame([(1.0, 9), (0.0, 9), (0.5, 2)], "r double, n long").select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()] == [0.0, 1.0, None]


def test_time_order_and_slugs(spark):
    rows = [("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("b", 1, 10), ("b", 2, 10), ("b", 3, 5), ("c", 1, None), ("c", 2, 3)]
    got = {x.k: tuple(x)[1:] for x in stats.time_order(spark.createDataFrame(rows, "k string, i int, t int"), "t", "i", ["k"]).collect()}
    assert got == {"a": (3, 0, 0, 0, True), "b": (3, 0, 1, 2, False), "c": (2, 1, 0, 0, False)}
    texts = spark.createDataFrame([("  Peak / load: 5 kW!",), ("__x__",), ("a" * 50,), ("",)], "t string").select(stats.slug(F.col("t")).alias("s")).collect()
    assert [x.s for x in texts] == ["Peak_load_5_kW", "x", "a" * 40, ""]
