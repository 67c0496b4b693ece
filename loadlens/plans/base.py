"""Tables that the registered queries share, in Spark and, independently, as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.functions import stats
from loadlens.operators import features, opcal, repair
from loadlens.sources.io import holidays, materialize
from loadlens.sources.meter import hourly_meter

#: Test period, folds (train_end, val_start, val_end), listed holidays, edges of daily power; the reference's own are the library's defaults.
TEST_START = "2024-01-24"
FOLDS = ((1, "2024-01-12", "2024-01-14", "2024-01-16"), (2, "2024-01-15", "2024-01-17", "2024-01-19"), (3, "2024-01-18", "2024-01-20", "2024-01-23"))
HOLIDAYS = ("2024-01-01", "2024-01-06", "2024-01-15", "2024-01-20")
EDGES, FLOOR = (60.0, 90.0), 70.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Of the query being built: its shared tables, each made once.
_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Within one registered query, the table is made once for each folder; nothing is kept from query to query."""

    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _shared.get()
        if held is None:
            return f(spark, sf_dir)
        if (f.__name__, sf_dir) not in held:
            held[f.__name__, sf_dir] = f(spark, sf_dir)
        return held[f.__name__, sf_dir]

    return get


def register(sql: str | None = None):
    """Registers a query under its function's name; its columns are brought to long, double of six digits, boolean, string, date or timestamp."""

    def add(f):
        @wraps(f)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            token = _shared.set({})
            try:
                return tidy(f(spark, sf_dir))
            finally:
                _shared.reset(token)

        QUERIES[f.__name__] = query
        if sql:
            ORACLE_SQL[f.__name__] = rewrite(sql)
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)
    to = {c: F.col(c).cast("long") for c, t in kind.items() if t in ("int", "smallint", "tinyint")}
    to |= {c: F.round(F.col(c).cast("double"), 6) + 0.0 for c, t in kind.items() if t in ("double", "float") or t.startswith("decimal")}
    return df.withColumns(to) if to else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@once
def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are taken in the order of the file's rows, as the SQL takes them."""
    events = table(spark, sf_dir, "events").withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    return hourly_meter(events, order=("__file", "__row"))


@once
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again: features, calendar and threshold all start from it."""
    return materialize(repair.targets(repair.repair(meter(spark, sf_dir), FLOOR)), "repaired")


def calendar(df: DataFrame) -> DataFrame:
    return opcal.operating_calendar(df, EDGES)


def theta_of(df: DataFrame) -> float:
    """One number, the peak threshold from before the test period; of one table it is worked out once in a query."""
    held = _shared.get()
    key = ("theta", id(df))
    if held is None or key not in held:
        found = round(stats.theta(df, 0.95, TEST_START).first()[0] or 0.0, 6)
        if held is None:
            return found
        held[key] = (found, df)  # the table too, so that no other gets its id
    return held[key][0]


def listed(spark: SparkSession) -> DataFrame:
    return holidays(spark, days=list(HOLIDAYS))


@once
def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repaired(spark, sf_dir)
    th = theta_of(df)
    return features.build_features(df, calendar(df), th, listed(spark)).withColumn("y_cls", (F.col("y_peak") >= th).cast("int"))


def folds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FOLDS), "fold int, a string, b string, c string").select("fold", F.to_date("a").alias("train_end"), F.to_date("b").alias("val_start"), F.to_date("c").alias("val_end"))


@once
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of three naive models on usable rows of the folds' validation days."""
    df = featured(spark, sf_dir)
    th = theta_of(repaired(spark, sf_dir))
    rows = df.join(F.broadcast(folds(spark)), df["day"].between(F.col("val_start"), F.col("val_end"))).filter("not is_warmup and not is_outage and not is_erp_missing")
    models = F.array(*(F.struct(F.lit(n).alias("model"), a.alias("pred_avg"), p.alias("pred_peak")) for n, a, p in (
        ("lag24", F.col("y_avg_lag24"), F.col("y_peak_lag24")), ("lag168", F.col("y_avg_lag168"), F.col("y_peak_lag168")),
        ("mean", (F.col("y_avg_lag24") + F.col("y_avg_lag168")) / 2, (F.col("y_peak_lag24") + F.col("y_peak_lag168")) / 2),
    )))
    long = rows.withColumn("__m", F.explode(models)).select("*", "__m.*").drop("__m", "train_end", "val_start", "val_end")
    return long.withColumns({"pred_cls": (F.col("pred_peak") >= th).cast("int"), "prob": F.round(F.least(F.lit(1.0), F.col("pred_peak") / (2 * th)), 6)})


# --- the same tables as SQL ------------------------------------------------------------------------------------------

_Q = "(coalesce(q0,0)+coalesce(q1,0)+coalesce(q2,0)+coalesce(q3,0))/4"
_FF = "last_value({} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PARTS = {
    "ev": "SELECT user_id % 4 AS site_id, date_trunc('hour', ts)::TIMESTAMP AS h, minute(ts) AS m, value, event_type, user_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events",
    "hr": "SELECT site_id, h AS ts, " + ", ".join(f"sum(CASE WHEN m >= {15 * i} AND m < {15 * i + 15} THEN value END) AS q{i}" for i in range(4)) + ", count(*) FILTER (event_type = 'purchase') AS n_buy, count(DISTINCT user_id) AS n_users, sum(k) AS k_sum, count(k) AS k_n, min(k) AS k_min, max(k) AS k_max, sum(CASE WHEN event_type = 'error' THEN 1 END) AS n_bad FROM ev GROUP BY ALL",
    "grid": "SELECT site_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT site_id FROM hr), (SELECT date_trunc('day', min(ts))::TIMESTAMP AS a, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 23 HOUR AS b FROM hr)",
    "meter": f"SELECT site_id, ts, ts::DATE AS day, hour(ts) AS hour, round(coalesce(q0,0),6) AS p15, round(coalesce(q1,0),6) AS p30, round(coalesce(q2,0),6) AS p45, round(coalesce(q3,0),6) AS p60, floor({_Q} + 0.5) AS avg, CASE WHEN isodow(ts) >= 6 THEN 0.0::DOUBLE ELSE coalesce(n_buy, 0)::DOUBLE END AS prod, n_users::DOUBLE AS headcount, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS labor, round(coalesce(k_sum / k_n, 0), 6) AS temp, k_min AS wind, coalesce(k_max, 0)::DOUBLE AS humid, n_bad::DOUBLE AS rain FROM grid LEFT JOIN hr USING (site_id, ts)",
    "flagged": f"SELECT *, avg = 0 AS is_outage, sum(prod) OVER d = 0 AND avg(avg) OVER d >= {FLOOR} AND min(labor) OVER d = 1.5 AS is_erp_missing, sum(prod) OVER d = 0 AND avg(avg) OVER d >= {FLOOR} AND min(labor) OVER d <> 1.5 AS is_aug_inconsistent FROM meter WINDOW d AS (PARTITION BY site_id, day)",
    "filled": "SELECT * REPLACE (" + ", ".join(f"{_FF.format(f'CASE WHEN NOT is_outage THEN {c} END')} AS {c}" for c in ("p15", "p30", "p45", "p60")) + f", {_FF.format('wind')} AS wind, {_FF.format('headcount')} AS headcount, coalesce(rain, 0.0) AS rain) FROM flagged",
    "rep": "SELECT * REPLACE (floor((p15 + p30 + p45 + p60) / 4 + 0.5) AS avg), floor((p15 + p30 + p45 + p60) / 4 + 0.5) AS y_avg, greatest(p15, p30, p45, p60) AS y_peak FROM filled",
    "th": f"SELECT round(quantile_cont(y_peak, 0.95), 6) AS theta FROM rep WHERE day < DATE '{TEST_START}'",
    "cal0": "SELECT site_id, day, sum(prod) AS prod_sum, avg(y_avg) AS power_mean, bool_or(is_erp_missing) AS is_erp_missing, bool_or(is_aug_inconsistent) AS is_aug_inconsistent, isodow(day) - 1 AS dow, sum(prod) = 0 AND NOT bool_or(is_erp_missing) AS is_shutdown FROM rep GROUP BY site_id, day",
    "cal1": "SELECT *, sum(CASE WHEN is_shutdown THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS g, lag(is_shutdown) OVER (PARTITION BY site_id ORDER BY day) AS before FROM cal0",
    "cal": f"SELECT * EXCLUDE (g, before), CASE WHEN power_mean <= {EDGES[0]} THEN 0 WHEN power_mean <= {EDGES[1]} THEN 1 WHEN power_mean IS NOT NULL THEN 2 END AS regime, CASE WHEN is_shutdown THEN sum(CASE WHEN is_shutdown THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, g ORDER BY day ROWS UNBOUNDED PRECEDING) ELSE 0 END AS shutdown_nth, NOT is_shutdown AND coalesce(before, FALSE) AS is_back, coalesce(before, FALSE) AS prev_day_shutdown, coalesce(before <> is_shutdown, TRUE) AS is_state_switch FROM cal1",
    "org": "SELECT site_id, day AS origin_day, " + ", ".join(
        f"CASE WHEN count({x}) OVER w{n} = {n} THEN {f}({x}) OVER w{n} END AS roll{n}_{a}"
        for n in (24, 168) for a, f, x in (("avg_mean", "avg", "y_avg"), ("avg_max", "max", "y_avg"), ("avg_std", "stddev_samp", "y_avg"), ("peak_max", "max", "y_peak"), ("peak_cnt", "sum", "pk"))
    ) + ", hour(ts) AS h FROM (SELECT rep.*, CASE WHEN y_peak >= theta THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pk FROM rep, th) WINDOW w24 AS (PARTITION BY site_id ORDER BY ts ROWS 23 PRECEDING), w168 AS (PARTITION BY site_id ORDER BY ts ROWS 167 PRECEDING)",
    "feat0": "SELECT r.* EXCLUDE (hour), hour(r.ts) AS hour, isodow(r.ts) - 1 AS dow, month(r.ts) AS month, (isodow(r.ts) = 6)::INT AS is_sat, (isodow(r.ts) = 7)::INT AS is_sun, (r.day IN (" + ", ".join(f"DATE '{d}'" for d in HOLIDAYS) + "))::INT AS is_holiday, sin(2*pi()*hour(r.ts)/24) AS hour_sin, cos(2*pi()*hour(r.ts)/24) AS hour_cos, sin(2*pi()*(isodow(r.ts)-1)/7) AS dow_sin, cos(2*pi()*(isodow(r.ts)-1)/7) AS dow_cos, (hour(r.ts) BETWEEN 9 AND 17)::INT AS is_daytime, (hour(r.ts) = 8)::INT AS is_startup_08, (hour(r.ts) = 13)::INT AS is_restart_13, c.is_shutdown::INT AS is_shutdown, c.shutdown_nth::INT AS shutdown_nth, c.is_back::INT AS is_first_day_back, c.prev_day_shutdown::INT AS prev_day_shutdown, c.is_state_switch::INT AS is_state_switch, (y_peak >= (SELECT theta FROM th))::INT AS y_cls, " + ", ".join(f"lag({c}, {n}) OVER s AS {c}_lag{n}" for c in ("y_avg", "y_peak") for n in (24, 48, 168)) + ", coalesce((prod - lag(prod, 24) OVER s) / nullif(lag(prod, 24) OVER s, 0), 0) AS prod_chg_ratio, sum(prod) OVER (PARTITION BY r.site_id, r.day ORDER BY r.ts ROWS UNBOUNDED PRECEDING) AS prod_cum_day, greatest(temp - 24, 0) AS cdd, greatest(18 - temp, 0) AS hdd FROM rep r JOIN cal c ON r.site_id = c.site_id AND r.day = c.day WINDOW s AS (PARTITION BY r.site_id ORDER BY r.ts)",
    "feat": "SELECT f.*, o.* EXCLUDE (site_id, origin_day, h), " + " OR ".join(f"{c} IS NULL" for c in features.FEATURES) + " AS is_warmup FROM feat0 f LEFT JOIN (SELECT * FROM org WHERE h = 23) o ON f.site_id = o.site_id AND f.day = o.origin_day + 1",
    "folds": "SELECT * FROM (VALUES " + ", ".join(f"({f}, DATE '{a}', DATE '{b}', DATE '{c}')" for f, a, b, c in FOLDS) + ") t(fold, train_end, val_start, val_end)",
    "pred": "SELECT f.*, fold, m.model, m.a AS pred_avg, m.p AS pred_peak, (m.p >= theta)::INT AS pred_cls, round(least(1.0::DOUBLE, m.p / (2 * theta)), 6) AS prob FROM feat f JOIN folds ON f.day BETWEEN val_start AND val_end, th, LATERAL (SELECT unnest([{'model': 'lag24', 'a': y_avg_lag24, 'p': y_peak_lag24}, {'model': 'lag168', 'a': y_avg_lag168, 'p': y_peak_lag168}, {'model': 'mean', 'a': (y_avg_lag24 + y_avg_lag168) / 2, 'p': (y_peak_lag24 + y_peak_lag168) / 2}]) AS m) x WHERE NOT is_warmup AND NOT is_outage AND NOT is_erp_missing",
    "prof": "SELECT site_id, day, string_agg(concat_ws('|', p15, p30, p45, p60), ';' ORDER BY ts) AS ph FROM meter GROUP BY site_id, day",
}
_NEEDS = {"hr": ["ev"], "grid": ["hr"], "meter": ["grid", "hr"], "flagged": ["meter"], "filled": ["flagged"], "rep": ["filled"], "th": ["rep"], "cal0": ["rep"], "cal1": ["cal0"], "cal": ["cal1"], "org": ["rep", "th"], "feat0": ["rep", "cal", "th"], "feat": ["feat0", "org"], "pred": ["feat", "folds", "th"], "prof": ["meter"]}


def rewrite(sql: str) -> str:
    """R(x) is x as a double of six digits, I(x) as a long; `@name` stands for a shared table, which is put before the query."""
    used: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in used:
            used.append(name)

    for name in re.findall(r"@(\w+)", sql):
        need(name)
    sql = re.sub(r"@(\w+)", r"\1", sql)
    for mark, before, after in (("R(", "(round(CAST((", ") AS DOUBLE), 6) + 0.0::DOUBLE)"), ("I(", "CAST((", ") AS BIGINT)")):
        while (m := re.search(rf"(?<![A-Za-z_]){re.escape(mark)}", sql)):
            depth, i = 1, m.end()
            while depth:
                depth += (sql[i] == "(") - (sql[i] == ")")
                i += 1
            sql = sql[: m.start()] + before + sql[m.end() : i - 1] + after + sql[i:]
    ctes = [f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in used]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {sql[5:]}" if ctes else sql
    return (f"WITH {', '.join(ctes)} " if ctes else "") + sql
