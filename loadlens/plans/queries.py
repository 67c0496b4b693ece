"""Registered queries of the time-series operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.functions import metrics, stats
from loadlens.operators import features, joins, opcal, repair, splits, windows
from loadlens.plans import base, compare, evaluate, policy
from loadlens.plans.base import calendar, featured, folds, listed, meter, predictions, register, repaired, table, theta_of
from loadlens.sources.io import materialize

S, D = SparkSession, str
_FEATURES = ", ".join(f"R({c})::DOUBLE AS {c}" for c in features.FEATURES)

# --- ingest, repair, calendar -----------------------------------------------------------------------------------------


@register("SELECT site_id, ts, day, I(hour) AS hour, R(p15) AS p15, R(p30) AS p30, R(p45) AS p45, R(p60) AS p60, R(avg) AS avg, R(prod) AS prod, R(headcount) AS headcount, R(labor) AS labor, R(temp) AS temp, R(wind) AS wind, R(humid) AS humid, R(rain) AS rain FROM @meter")
def hourly_meter(spark: S, sf: D) -> DataFrame:
    return meter(spark, sf)


@register("SELECT site_id, ts, is_outage, is_erp_missing, is_aug_inconsistent, R(p15) AS p15, R(p60) AS p60, R(wind) AS wind, R(headcount) AS headcount, R(rain) AS rain, R(y_avg) AS y_avg, R(y_peak) AS y_peak FROM @rep")
def repaired_series(spark: S, sf: D) -> DataFrame:
    return repaired(spark, sf).select("site_id", "ts", "is_outage", "is_erp_missing", "is_aug_inconsistent", "p15", "p60", "wind", "headcount", "rain", "y_avg", "y_peak")


@register("SELECT unnest(['outage', 'erp_missing', 'aug_inconsistent', 'rain_null', 'wind_null', 'headcount_null']) AS item, I(unnest([sum(is_outage::INT), sum(is_erp_missing::INT), sum(is_aug_inconsistent::INT), sum((rain IS NULL)::INT), sum((wind IS NULL)::INT), sum((headcount IS NULL)::INT)])) AS n FROM @flagged")
def repair_log(spark: S, sf: D) -> DataFrame:
    return repair.repair_log(repair.flag(meter(spark, sf), base.FLOOR))


@register("SELECT site_id, ts, I(row_number() OVER (PARTITION BY site_id, day ORDER BY ts) - 1) AS restored FROM @meter WHERE day IN (DATE '2024-01-05', DATE '2024-01-09')")
def restored_hours(spark: S, sf: D) -> DataFrame:
    """Two days whose hours were overwritten get them back from the physical order."""
    rows = meter(spark, sf).withColumn("row_seq", F.unix_timestamp(F.col("ts").cast("timestamp")))
    broken = rows.withColumn("hour", F.when(F.col("day").isin("2024-01-05", "2024-01-09"), F.col("hour") + 100).otherwise(F.col("hour")))
    return repair.restore_hours(broken).filter("hour_broken").select("site_id", "ts", F.col("hour").alias("restored"))


@register("SELECT site_id, day, R(prod_sum) AS prod_sum, R(power_mean) AS power_mean, is_erp_missing, is_aug_inconsistent, I(dow) AS dow, is_shutdown, I(regime) AS regime, I(shutdown_nth) AS shutdown_nth, is_back, prev_day_shutdown, is_state_switch FROM @cal")
def operating_calendar(spark: S, sf: D) -> DataFrame:
    return calendar(repaired(spark, sf))


@register("SELECT site_id, min(day) AS start, max(day) AS \"end\", count(*) AS n FROM @cal1 WHERE is_shutdown GROUP BY site_id, g HAVING count(*) >= 2")
def long_shutdowns(spark: S, sf: D) -> DataFrame:
    return opcal.long_shutdowns(calendar(repaired(spark, sf)), 2)


@register("WITH m AS (SELECT site_id, median(power_mean) AS wm FROM @cal WHERE dow < 5 AND NOT is_shutdown GROUP BY site_id) SELECT site_id, day, I(dow) AS dow, R(power_mean) AS power_mean, R(power_mean / wm) AS ratio, R(prod_sum) AS prod_sum, is_aug_inconsistent, CASE WHEN prod_sum = 0 AND power_mean / wm > 0.8 THEN 'holiday_power_overwritten' WHEN prod_sum = 0 THEN 'holiday' ELSE 'open' END AS verdict FROM cal LEFT JOIN m USING (site_id) WHERE day IN (DATE '2024-01-01', DATE '2024-01-06', DATE '2024-01-15', DATE '2024-01-20')")
def holiday_audit(spark: S, sf: D) -> DataFrame:
    return opcal.holiday_audit(calendar(repaired(spark, sf)), listed(spark))


# --- quality and profiles ---------------------------------------------------------------------------------------------


@register("SELECT 'p15' AS \"column\", R(min(p15)) AS lo, R(max(p15)) AS hi, count(DISTINCT p15) AS n_distinct, I(sum((p15 IS NULL)::INT)) AS n_null FROM @meter UNION ALL SELECT 'wind', R(min(wind)), R(max(wind)), count(DISTINCT wind), I(sum((wind IS NULL)::INT)) FROM meter UNION ALL SELECT 'headcount', R(min(headcount)), R(max(headcount)), count(DISTINCT headcount), I(sum((headcount IS NULL)::INT)) FROM meter")
def column_profile(spark: S, sf: D) -> DataFrame:
    return stats.column_profile(meter(spark, sf), ["p15", "wind", "headcount"])


@register("WITH i AS (SELECT sum((l_orderkey IS NULL)::INT + (l_linenumber IS NULL)::INT + (l_quantity IS NULL)::INT) AS null_cells, count(*) AS n FROM lineitem), k AS (SELECT sum(c - 1) AS s FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)), w AS (SELECT sum(c - 1) AS s FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_quantity)) SELECT 'rows' AS item, I(n) AS n FROM i UNION ALL SELECT 'surplus_keys', I(s) FROM k UNION ALL SELECT 'surplus_rows', I(s) FROM w UNION ALL SELECT 'null_cells', I(null_cells) FROM i")
def quality_report(spark: S, sf: D) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(0).alias("hour"), F.lit(0.0).alias("avg"), F.lit(0).alias("site_id"), F.to_date("l_shipdate").alias("day"))
    return stats.quality_report(rows.withColumn("day", F.lit("2024-01-01").cast("date")), ["l_orderkey", "l_linenumber"], ["avg"]).filter("item in ('rows', 'surplus_keys', 'surplus_rows', 'null_cells')")


@register("SELECT count(*) AS n_groups, I(sum(c)) AS n_days, I(sum(c - 1)) AS surplus FROM (SELECT ph, count(*) AS c FROM @prof GROUP BY ph HAVING count(*) > 1)")
def duplicate_profiles(spark: S, sf: D) -> DataFrame:
    p = splits.duplicate_profiles(splits.profile_hash(meter(spark, sf), "ts"))
    return p.agg(F.count("*").alias("n_groups"), F.sum("n_days").alias("n_days"), F.sum(F.col("n_days") - 1).alias("surplus"))


@register("SELECT I(count(*)) AS n_groups, I(sum(c)) AS n_rows, I(max(c)) AS largest FROM (SELECT md5(text), count(*) AS c FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_texts(spark: S, sf: D) -> DataFrame:
    g = table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).count().filter("count > 1")
    return g.agg(F.count("*").alias("n_groups"), F.sum("count").alias("n_rows"), F.max("count").alias("largest"))


@register("WITH e AS (SELECT site_id, day, arg_min(temp, ts) AS f, arg_max(temp, ts) AS l FROM @meter GROUP BY site_id, day), j AS (SELECT site_id, day, round(abs(f - lag(l) OVER (PARTITION BY site_id ORDER BY day)), 9) AS jump FROM e) SELECT site_id, R(median(jump)) AS median_jump, R(quantile_cont(jump, 0.9)) AS p90_jump, arg_min(day, (jump, day)) AS least_day, arg_min(day, (-jump, day)) AS greatest_day FROM j WHERE jump IS NOT NULL GROUP BY site_id")
def boundary_jump(spark: S, sf: D) -> DataFrame:
    return stats.boundary_jump(meter(spark, sf), "temp", "ts")


@register("SELECT R(quantile_cont(y_peak, 0.95)) AS q95, R(quantile_cont(y_peak, 0.99)) AS q99, R(max(y_peak)) AS top FROM @rep WHERE day < DATE '2024-01-24'")
def peak_threshold(spark: S, sf: D) -> DataFrame:
    rows = repaired(spark, sf).filter("day < date '2024-01-24'")
    return rows.agg(F.percentile("y_peak", F.lit(0.95)).alias("q95"), F.percentile("y_peak", F.lit(0.99)).alias("q99"), F.max("y_peak").alias("top"))


# --- exploration: aggregates and pivots ---------------------------------------------------------------------------------


@register("SELECT I(r.hour) AS hour, R(avg(CASE WHEN NOT is_shutdown THEN y_avg END)) AS open, R(avg(CASE WHEN is_shutdown THEN y_avg END)) AS shut FROM @rep r JOIN @cal c USING (site_id, day) GROUP BY 1")
def hourly_profile_pivot(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    rows = joins.day_to_hours(df, calendar(df).select("site_id", "day", F.when(F.col("is_shutdown"), "shut").otherwise("open").alias("kind")))
    return rows.groupBy("hour").pivot("kind", ["open", "shut"]).agg(F.avg("y_avg"))


@register("SELECT I(isodow(ts) - 1) AS dow, R(avg(y_avg)) AS mean_power FROM @rep GROUP BY 1")
def weekday_profile(spark: S, sf: D) -> DataFrame:
    return repaired(spark, sf).groupBy(F.weekday("ts").alias("dow")).agg(F.avg("y_avg").alias("mean_power"))


@register("SELECT I(hour) AS hour, I(sum((y_peak >= theta)::INT)) AS n_peak, count(*) AS n, R(round(100.0 * avg((y_peak >= theta)::INT), 1)) AS rate FROM @rep, @th GROUP BY 1")
def peak_rate_by_hour(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    peak = (F.col("y_peak") >= theta_of(df)).cast("int")
    return df.groupBy("hour").agg(F.sum(F.coalesce(peak, F.lit(0))).alias("n_peak"), F.count("*").alias("n"), F.round(100 * F.avg(peak), 1).alias("rate"))


@register("SELECT o_orderpriority AS priority, R(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)) AS f, R(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)) AS o, R(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END)) AS p FROM orders GROUP BY 1")
def order_pivot(spark: S, sf: D) -> DataFrame:
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return g.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@register("SELECT date_trunc('month', o_orderdate)::DATE AS month, R(max(o_totalprice)) AS top, R(avg(o_totalprice)) AS mean FROM orders GROUP BY 1")
def monthly_peak(spark: S, sf: D) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.max("o_totalprice").alias("top"), F.avg("o_totalprice").alias("mean"))


@register("SELECT site_id, ts, R(y_peak) AS y_peak FROM @rep, @th WHERE y_peak >= theta AND (hour >= 22 OR hour < 6)")
def night_peaks(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return df.filter((F.col("y_peak") >= theta_of(df)) & ((F.col("hour") >= 22) | (F.col("hour") < 6))).select("site_id", "ts", "y_peak")


@register("SELECT site_id, month(ts) AS month, " + ", ".join(f"R(sum(CASE WHEN day(day) = {d} THEN y_avg END)) AS d{d}" for d in range(1, 32)) + " FROM @rep GROUP BY 1, 2")
def month_day_pivot(spark: S, sf: D) -> DataFrame:
    rows = repaired(spark, sf).withColumn("d", F.concat(F.lit("d"), F.day("day").cast("string")))
    return rows.groupBy("site_id", F.month("ts").alias("month")).pivot("d", [f"d{d}" for d in range(1, 32)]).agg(F.sum("y_avg"))


@register("SELECT I(hour) AS hour, " + ", ".join(f"R(avg(CASE WHEN month(ts) = {m} THEN (y_peak >= theta)::INT END)) AS m{m}" for m in range(1, 13)) + " FROM @rep, @th GROUP BY 1")
def peak_rate_pivot(spark: S, sf: D) -> DataFrame:
    """Share of peak hours by hour of day and month."""
    df = repaired(spark, sf)
    rows = df.select("hour", F.concat(F.lit("m"), F.month("ts").cast("string")).alias("m"), (F.col("y_peak") >= theta_of(df)).cast("double").alias("peak"))
    return rows.groupBy("hour").pivot("m", [f"m{m}" for m in range(1, 13)]).agg(F.avg("peak"))


@register("SELECT site_id, date_trunc('week', day)::DATE AS week, R(sum(prod)) AS prod, R(avg(y_avg)) AS mean, R(max(y_peak)) AS top FROM @rep GROUP BY 1, 2")
def weekly_resample(spark: S, sf: D) -> DataFrame:
    return repaired(spark, sf).groupBy("site_id", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.sum("prod").alias("prod"), F.avg("y_avg").alias("mean"), F.max("y_peak").alias("top"))


_COR = ("y_avg", "y_peak", "prod", "headcount", "labor", "temp", "wind", "humid", "rain")


@register("SELECT a, b, R(r) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM @rep" for a in _COR for b in _COR) + ")")
def correlation_matrix(spark: S, sf: D) -> DataFrame:
    return stats.correlation_matrix(repaired(spark, sf), list(_COR))


@register("WITH d AS (SELECT site_id, day, sum(prod) AS p, avg(y_avg) AS m FROM @rep GROUP BY 1, 2), r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS b FROM d) SELECT R(corr(a, b)) AS rho FROM r")
def spearman(spark: S, sf: D) -> DataFrame:
    return stats.spearman(repaired(spark, sf).groupBy("site_id", "day").agg(F.sum("prod").alias("p"), F.avg("y_avg").alias("m")), "p", "m")


@register("SELECT I(CASE WHEN power_mean >= 0 AND power_mean < 50 THEN 0 WHEN power_mean >= 50 AND power_mean < 75 THEN 1 WHEN power_mean >= 75 AND power_mean < 100 THEN 2 WHEN power_mean >= 100 AND power_mean <= 1000 THEN 3 END) AS bin, count(*) AS n FROM @cal WHERE power_mean BETWEEN 0 AND 1000 GROUP BY 1")
def daily_histogram(spark: S, sf: D) -> DataFrame:
    return stats.histogram(calendar(repaired(spark, sf)), "power_mean", [0.0, 50.0, 75.0, 100.0, 1000.0])


@register("SELECT I(regime) AS regime, count(*) AS n, R(avg(prod_sum)) AS mean_prod, R(avg(power_mean)) AS mean_power FROM @cal GROUP BY 1")
def regime_means(spark: S, sf: D) -> DataFrame:
    return calendar(repaired(spark, sf)).groupBy("regime").agg(F.count("*").alias("n"), F.avg("prod_sum").alias("mean_prod"), F.avg("power_mean").alias("mean_power"))


@register("WITH r AS (SELECT hour, y_avg, row_number() OVER (PARTITION BY site_id ORDER BY prod, ts) AS r, count(*) OVER (PARTITION BY site_id) AS n FROM @rep), q AS (SELECT hour, y_avg, greatest(1, ceil((r - 1) * 4 / (n - 1)::DOUBLE)) - 1 AS q FROM r) SELECT I(q) AS quartile, I(hour) AS hour, R(avg(y_avg)) AS mean_power FROM q GROUP BY 1, 2")
def production_quartiles(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf).withColumn("quartile", windows.quantile_bins("prod", 4, "ts", "site_id"))
    return df.groupBy("quartile", "hour").agg(F.avg("y_avg").alias("mean_power"))


@register("WITH x AS (SELECT site_id, hour, prod, y_peak, avg(prod) OVER w AS mx, avg(y_peak) OVER w AS my FROM @rep WHERE prod > 0 AND y_peak IS NOT NULL AND NOT is_outage AND NOT is_erp_missing WINDOW w AS (PARTITION BY site_id, hour)), s AS (SELECT site_id, count(*) AS n, sum((prod - mx) * (y_peak - my)) AS wxy, sum((prod - mx) * (prod - mx)) AS wxx, greatest(1, sum(prod * prod)) AS axx FROM x GROUP BY 1), b AS (SELECT *, wxx > pow(2, -52) * axx AS ok, CASE WHEN wxx > pow(2, -52) * axx THEN wxy / wxx ELSE 0 END AS beta FROM s), r AS (SELECT x.site_id, sum(pow(y_peak - my - beta * (prod - mx), 2)) AS left_, sum(pow(y_peak - t.m, 2)) AS whole, greatest(1, sum(y_peak * y_peak)) AS ayy FROM x JOIN b USING (site_id) JOIN (SELECT site_id, avg(y_peak) AS m FROM x GROUP BY 1) t USING (site_id) GROUP BY 1) SELECT site_id, n, R(greatest(beta, 0)) AS beta, R(beta) AS beta_raw, R(CASE WHEN whole > pow(2, -52) * ayy THEN 1 - left_ / whole END) AS r2, CASE WHEN ok THEN 'estimated' ELSE 'unidentified_zero_fallback' END AS status FROM b JOIN r USING (site_id)")
def production_response(spark: S, sf: D) -> DataFrame:
    return policy.response(repaired(spark, sf))


@register("SELECT site_id, R(sum(1.0::DOUBLE / day(last_day(day)))) AS months FROM (SELECT DISTINCT site_id, day FROM @meter) GROUP BY 1")
def observed_months(spark: S, sf: D) -> DataFrame:
    return policy.observed_months(meter(spark, sf))


@register("SELECT I(hour) AS hour, count(*) AS n FROM @rep, @th WHERE y_peak >= theta GROUP BY 1 ORDER BY n DESC, hour LIMIT 5")
def top_hours(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return df.filter(F.col("y_peak") >= theta_of(df)).groupBy("hour").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(5)


@register("SELECT name, R(a) AS share_in, R(b) AS share_all, R(a / b) AS lift FROM (SELECT 'daytime' AS name, avg(CASE WHEN y_peak >= theta THEN (hour BETWEEN 9 AND 17)::INT END) AS a, avg((hour BETWEEN 9 AND 17)::INT) AS b FROM @rep, @th UNION ALL SELECT 'weekend', avg(CASE WHEN y_peak >= theta THEN (isodow(ts) >= 6)::INT END), avg((isodow(ts) >= 6)::INT) FROM rep, th UNION ALL SELECT 'producing', avg(CASE WHEN y_peak >= theta THEN (prod > 0)::INT END), avg((prod > 0)::INT) FROM rep, th)")
def condition_lift(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return evaluate.lift_table(df, F.col("y_peak") >= theta_of(df), {"daytime": F.col("hour").between(9, 17), "weekend": F.weekday("ts") >= 5, "producing": F.col("prod") > 0})


@register("SELECT R(avg(CASE WHEN a AND b THEN y_avg END)) AS both, R(avg(CASE WHEN a AND NOT b THEN y_avg END)) AS only_a, R(avg(CASE WHEN NOT a AND b THEN y_avg END)) AS only_b, R(avg(CASE WHEN NOT a AND NOT b THEN y_avg END)) AS neither, R(avg(CASE WHEN a AND b THEN y_avg END) - avg(CASE WHEN a AND NOT b THEN y_avg END) - avg(CASE WHEN NOT a AND b THEN y_avg END) + avg(CASE WHEN NOT a AND NOT b THEN y_avg END)) AS interaction FROM (SELECT y_avg, prod > 1 AS a, temp > 50 AS b FROM @rep)")
def interaction_contrast(spark: S, sf: D) -> DataFrame:
    return evaluate.contrasts(repaired(spark, sf), F.col("prod") > 1, F.col("temp") > 50)


# --- features and windows ---------------------------------------------------------------------------------------------


@register(f"SELECT site_id, ts, {_FEATURES}, is_warmup FROM @feat")
def day_ahead_features(spark: S, sf: D) -> DataFrame:
    return featured(spark, sf).select("site_id", "ts", *(F.col(c).cast("double").alias(c) for c in features.FEATURES), "is_warmup")


@register("SELECT site_id, origin_day, " + ", ".join(f"R({c}) AS {c}" for c in features.GROUPS["rolling"]) + " FROM @org WHERE h = 23")
def origin_statistics(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return features.origin_stats(df, theta_of(df))


@register("SELECT site_id, ts, R(lag(y_avg, 24) OVER w) AS y_avg_lag24, R(lag(y_avg, 168) OVER w) AS y_avg_lag168 FROM @rep WINDOW w AS (PARTITION BY site_id ORDER BY ts)")
def fixed_lags(spark: S, sf: D) -> DataFrame:
    return windows.lags(repaired(spark, sf), ("y_avg",), (24, 168), windows.series()).select("site_id", "ts", "y_avg_lag24", "y_avg_lag168")


@register("SELECT site_id, ts, R(list_sum(l)) AS lag_sum, R(l[1]) AS lag_1, R(l[168]) AS lag_168 FROM (SELECT site_id, ts, list_reverse(list(y_avg) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)) AS l FROM @rep WHERE y_avg IS NOT NULL) WHERE len(l) = 168")
def lag_matrix(spark: S, sf: D) -> DataFrame:
    df = windows.lag_matrix(repaired(spark, sf).filter("y_avg is not null"), "y_avg", 168, windows.series()).filter("y_avg_lags is not null")
    return df.select("site_id", "ts", F.aggregate("y_avg_lags", F.lit(0.0), lambda a, x: a + x).alias("lag_sum"), F.col("y_avg_lags")[0].alias("lag_1"), F.col("y_avg_lags")[167].alias("lag_168"))


@register("SELECT g.ts, g.site_id FROM @grid g LEFT JOIN @hr h USING (site_id, ts) WHERE h.ts IS NULL")
def empty_hours(spark: S, sf: D) -> DataFrame:
    return meter(spark, sf).filter("headcount is null").select("ts", "site_id")


@register("WITH p AS (SELECT site_id, ts FROM @rep, @th WHERE y_peak >= theta), b AS (SELECT *, sum(CASE WHEN prev = ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS prev FROM p)) SELECT site_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM b GROUP BY site_id, g")
def peak_blocks(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return windows.blocks(df.filter(F.col("y_peak") >= theta_of(df)), "ts", "site_id")


@register("WITH c AS (SELECT site_id, day, is_shutdown FROM @cal), n AS (SELECT t.site_id, t.day, min(s) AS walked FROM c t, range(6) r(s) JOIN c u ON TRUE WHERE u.site_id = t.site_id AND u.day = t.day - (1 + s)::INT AND u.is_shutdown = t.is_shutdown GROUP BY 1, 2) SELECT r.site_id, r.ts, R(v.y_avg) AS matched, I(coalesce(n.walked, -1)) AS walked FROM @rep r LEFT JOIN n ON n.site_id = r.site_id AND n.day = r.day LEFT JOIN rep v ON v.site_id = r.site_id AND v.day = r.day - (1 + n.walked)::INT AND v.hour = r.hour")
def status_matched_lag(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return joins.status_matched_lag(df, calendar(df), "y_avg", 24, 1, 5)


@register("SELECT site_id, ts, R(power_share) AS power_share, R(cum) AS cum, all_valid FROM (SELECT site_id, ts, y_avg / nullif(sum(y_avg) OVER d, 0) AS power_share, sum(prod) OVER (PARTITION BY site_id, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum, bool_and(NOT is_outage) OVER d AS all_valid FROM @rep WINDOW d AS (PARTITION BY site_id, day))")
def within_day_shares(spark: S, sf: D) -> DataFrame:
    day = Window.partitionBy("site_id", "day")
    return repaired(spark, sf).select("site_id", "ts", stats.safe_ratio(F.col("y_avg"), F.sum("y_avg").over(day)).alias("power_share"), F.sum("prod").over(day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.bool_and(~F.col("is_outage")).over(day).alias("all_valid"))


@register("SELECT site_id, day, ts FROM (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY y_peak DESC NULLS LAST, ts) AS r FROM @rep) WHERE r = 1")
def peak_hour_of_day(spark: S, sf: D) -> DataFrame:
    w = Window.partitionBy("site_id", "day").orderBy(F.desc_nulls_last("y_peak"), "ts")
    return repaired(spark, sf).withColumn("r", F.row_number().over(w)).filter("r = 1").select("site_id", "day", "ts")


@register("SELECT site_id, day, R(min(power_mean) OVER w) AS best_low, R(max(power_mean) OVER w) AS best_high FROM @cal WINDOW w AS (PARTITION BY site_id ORDER BY day ROWS UNBOUNDED PRECEDING)")
def running_best(spark: S, sf: D) -> DataFrame:
    w = windows.series("day").rowsBetween(Window.unboundedPreceding, 0)
    return calendar(repaired(spark, sf)).select("site_id", "day", F.min("power_mean").over(w).alias("best_low"), F.max("power_mean").over(w).alias("best_high"))


@register("SELECT c_custkey, I(floor(rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0)) AS rank_ FROM customer")
def average_rank(spark: S, sf: D) -> DataFrame:
    """Average ranks, cut to whole numbers."""
    df = windows.with_average_rank(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "rank_")
    return df.select("c_custkey", F.col("rank_").cast("int").alias("rank_"))


@register("SELECT site_id, I(count(*)) AS hours, " + ", ".join(f"I(sum((ts - INTERVAL {n - 1} HOUR > day::TIMESTAMP)::INT)) AS late_lag{n}" for n in features.LAGS) + " FROM @meter GROUP BY 1")
def observation_completion(spark: S, sf: D) -> DataFrame:
    """By site, hours whose value of a lag wasn't complete at the day's 0:00."""
    late = {h: [n for n in features.LAGS if (h, n) in features.completion_check()] for h in range(24)}
    flags = {n: F.hour("ts").isin([h for h in late if n in late[h]] or [-1]) for n in features.LAGS}
    return meter(spark, sf).groupBy("site_id").agg(F.count("*").alias("hours"), *(F.sum(c.cast("long")).alias(f"late_lag{n}") for n, c in flags.items()))


def _replayed(spark: S, sf: D, days: DataFrame, history_days: int) -> DataFrame:
    from loadlens.plans import serving

    return serving.replay(meter(spark, sf), days, history_days, theta_of(repaired(spark, sf)), listed(spark), base.EDGES, base.FLOOR)


@register("SELECT site_id, day, count(*) AS n_hours, 0::BIGINT AS n_changed FROM @meter WHERE day >= (SELECT min(day) + 8 FROM meter) GROUP BY 1, 2")
def future_blind(spark: S, sf: D) -> DataFrame:
    """Each day's features, built again from what was known at its start: repair, calendar and windows see the hours before it only.

    n_changed counts hours of which any feature differs; 62 days of history are more than any window or run reaches.
    """
    days = meter(spark, sf).select("day").distinct()
    days = days.crossJoin(days.agg(F.min("day").alias("first"))).filter(F.col("day") >= F.date_add("first", 8)).select("day")  # one row of the first day
    row = lambda df, n: df.select("site_id", "day", "ts", F.struct(*(F.round(F.col(c).cast("double"), 9).alias(c) for c in features.FEATURES)).alias(n))
    both = row(_replayed(spark, sf, days, 62), "then").join(row(featured(spark, sf), "now").drop("day"), ["site_id", "ts"], "left")
    return both.groupBy("site_id", "day").agg(F.count("*").alias("n_hours"), F.sum((~F.col("then").eqNullSafe(F.col("now"))).cast("long")).alias("n_changed"))


# --- splits -------------------------------------------------------------------------------------------------------------


@register("SELECT I(fold) AS fold, role, count(*) AS n, I(sum(CASE WHEN NOT is_warmup AND NOT is_outage AND NOT is_erp_missing THEN 1 ELSE 0 END)) AS n_usable, R(avg(is_shutdown)) AS shut_share, I(sum(coalesce(y_cls, 0))) AS n_pos, R(quantile_cont(y_peak, 0.95)) AS q95 FROM (SELECT f.*, fold, CASE WHEN day <= train_end THEN 'train' ELSE 'val' END AS role FROM @feat f JOIN @folds ON day <= train_end OR day BETWEEN val_start AND val_end) GROUP BY 1, 2")
def fold_summary(spark: S, sf: D) -> DataFrame:
    rows = splits.fold_rows(featured(spark, sf), folds(spark))
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum(splits.usable().cast("long")).alias("n_usable"), F.avg("is_shutdown").alias("shut_share"), F.sum(F.coalesce("y_cls", F.lit(0))).alias("n_pos"), F.percentile("y_peak", F.lit(0.95)).alias("q95"))


@register("WITH p AS (SELECT site_id, day, ph, min(day) OVER (PARTITION BY site_id, ph) AS first_ FROM @prof) SELECT I(fold) AS fold, count(*) AS d1, I(sum(CASE WHEN p.day = first_ THEN 1 ELSE 0 END)) AS d2 FROM @meter m JOIN p USING (site_id, day) JOIN @folds ON day BETWEEN val_start AND val_end GROUP BY 1")
def condition_sizes(spark: S, sf: D) -> DataFrame:
    df = meter(spark, sf)
    prof = splits.profile_hash(df, "ts")
    rows = splits.fold_rows(splits.condition(df, "D1", prof).withColumn("c", F.lit("d1")).unionByName(splits.condition(df, "D2", prof).withColumn("c", F.lit("d2"))), folds(spark)).filter("role = 'val'")
    return rows.groupBy("fold").pivot("c", ["d1", "d2"]).count()


@register("WITH p AS (SELECT site_id, day, ph FROM @prof), v AS (SELECT fold, site_id, ph FROM p JOIN @folds ON day BETWEEN val_start AND val_end), t AS (SELECT DISTINCT fold, ph FROM p JOIN folds ON day <= train_end) SELECT I(v.fold) AS fold, count(*) AS n_val_days, I(sum(CASE WHEN t.ph IS NOT NULL THEN 1 ELSE 0 END)) AS n_seen FROM v LEFT JOIN t ON v.fold = t.fold AND v.ph = t.ph GROUP BY 1")
def profile_contamination(spark: S, sf: D) -> DataFrame:
    return splits.contamination(splits.profile_hash(meter(spark, sf), "ts"), folds(spark))


@register("WITH d AS (SELECT md5(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS train FROM documents), t AS (SELECT DISTINCT h FROM d WHERE train) SELECT I(count(*)) AS n_val, I(sum((t.h IS NOT NULL)::INT)) AS n_seen FROM (SELECT h FROM d WHERE NOT train) v LEFT JOIN t ON v.h = t.h")
def text_contamination(spark: S, sf: D) -> DataFrame:
    """Unlabelled documents, and how many of them have a labelled one's text."""
    labelled = table(spark, sf, "labels").select("doc_id").distinct().withColumn("train", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")).join(labelled, "doc_id", "left")
    seen = d.filter("train").select("h").distinct().withColumn("seen", F.lit(1))
    return d.filter("train is null").join(seen, "h", "left").agg(F.count("*").alias("n_val"), F.sum(F.coalesce("seen", F.lit(0))).alias("n_seen"))


@register("SELECT role, count(*) AS n FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'core' WHEN ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-18' THEN 'calibration' WHEN ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25' THEN 'evaluation' END AS role FROM @meter) GROUP BY 1")
def interval_roles(spark: S, sf: D) -> DataFrame:
    role = splits.role_of_day(**splits.partition_bounds("2024-01-18", 1, 7, 7))
    return meter(spark, sf).groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@register("SELECT site_id, ts, R(y_avg_lag24) AS y_avg_lag24, R(prod) AS prod FROM @feat WHERE NOT is_warmup AND NOT is_outage AND NOT is_erp_missing")
def usable_rows(spark: S, sf: D) -> DataFrame:
    return splits.valid_rows(featured(spark, sf), ["y_avg_lag24", "prod"]).select("site_id", "ts", "y_avg_lag24", "prod")


@register("SELECT site_id, ts, (isodow(ts) <= 5 AND hour(ts) BETWEEN 8 AND 18) AS says_peak FROM @meter WHERE day >= DATE '2024-01-24'")
def calendar_rule(spark: S, sf: D) -> DataFrame:
    return meter(spark, sf).filter("day >= date '2024-01-24'").select("site_id", "ts", ((F.weekday("ts") < 5) & F.hour("ts").between(8, 18)).alias("says_peak"))


@register("SELECT code, \"key\", message FROM (SELECT 'null' AS code, concat_ws('/', site_id, ts) AS \"key\", 'headcount' AS message FROM @meter WHERE headcount IS NULL) UNION ALL SELECT 'missing_column', '', 'tariff'")
def contract_violations(spark: S, sf: D) -> DataFrame:
    df = meter(spark, sf).select("site_id", "ts", "prod", "headcount", "wind", F.date_format("ts", "yyyyMMdd").cast("int").alias("date"), "hour")
    v = schemas.violations(df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ("date", "hour", "prod", "headcount", "wind", "tariff"), ("site_id", "ts"), nullable=("wind",))
    return v


@register("SELECT site_id, day FROM (SELECT site_id, day, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS r, count(*) OVER (PARTITION BY site_id) AS n FROM @cal) WHERE r IN (SELECT floor(i * (n - 1) / 11.0) FROM range(12) t(i))")
def evenly_spaced_days(spark: S, sf: D) -> DataFrame:
    return splits.evenly_spaced(calendar(repaired(spark, sf)).select("site_id", "day"), 12)


# --- metrics ------------------------------------------------------------------------------------------------------------


@register("SELECT model, count(abs(y_avg - pred_avg)) AS n, R(avg(abs(y_avg - pred_avg))) AS mae, R(sqrt(avg(pow(y_avg - pred_avg, 2)))) AS rmse, R(100 * avg(2 * abs(y_avg - pred_avg) / nullif(abs(y_avg) + abs(pred_avg), 0))) AS smape, R(avg(CASE WHEN y_peak >= theta THEN abs(y_avg - pred_avg) END)) AS peak_mae, R(avg(CASE WHEN y_peak >= theta THEN abs(y_peak - pred_peak) END)) AS peak15_mae, I(sum((y_peak >= theta)::INT)) AS peak_n, R(avg(CASE WHEN y_avg >= theta THEN abs(y_avg - pred_avg) END)) AS high_load_mae, I(sum((y_avg >= theta)::INT)) AS high_load_n FROM @pred, @th GROUP BY 1")
def regression_metrics(spark: S, sf: D) -> DataFrame:
    return evaluate.regression_table(predictions(spark, sf), theta_of(repaired(spark, sf)))


_CONF = "I(sum((y_cls = 1 AND pred_cls = 1)::INT)) AS tp, I(sum((y_cls <> 1 AND pred_cls = 1)::INT)) AS fp, I(sum((y_cls = 1 AND pred_cls <> 1)::INT)) AS fn, I(sum((y_cls <> 1 AND pred_cls <> 1)::INT)) AS tn"
_RATES = "R(coalesce(tp / nullif(tp + fp, 0), {0})) AS precision, R(coalesce(tp / nullif(tp + fn, 0), {0})) AS recall, R(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), {0})) AS f1, R(coalesce(fp / nullif(fp + tn, 0), {0})) AS false_positive_rate, R(coalesce((tp + fn) / nullif(tp + fp + fn + tn, 0), {0})) AS base_rate, R(coalesce(coalesce(tp / nullif(tp + fp, 0), {0}) / nullif(coalesce((tp + fn) / nullif(tp + fp + fn + tn, 0), {0}), 0), {0})) AS lift"


@register(f"WITH c AS (SELECT model, {_CONF} FROM @pred GROUP BY 1) SELECT *, {_RATES.format('0')} FROM c")
def classification_metrics(spark: S, sf: D) -> DataFrame:
    return evaluate.peak_table(predictions(spark, sf))


@register(f"WITH c AS (SELECT fold, {_CONF} FROM @pred WHERE model = 'lag24' GROUP BY 1) SELECT I(fold) AS fold, * EXCLUDE (fold), {_RATES.format('NULL')} FROM c")
def fold_confusion(spark: S, sf: D) -> DataFrame:
    return evaluate.peak_table(predictions(spark, sf).filter("model = 'lag24'"), ["fold"], None)


@register("WITH a AS (SELECT lang, n_chars, sum(quality) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY lang) AS p FROM a WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, tp / p AS rec, coalesce(lag(tp) OVER (PARTITION BY lang ORDER BY n_chars DESC) / p, 0) AS rec0 FROM r) SELECT lang, R(CASE WHEN max(tp) > 0 AND max(seen - tp) > 0 THEN sum((rec - rec0) * tp / seen) END) AS average_precision FROM s GROUP BY 1")
def average_precision(spark: S, sf: D) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return metrics.average_precision(d, "quality", "n_chars", ["lang"])


@register("WITH a AS (SELECT prob, sum(y_cls) AS pos, count(*) AS n FROM @pred WHERE model = 'mean' GROUP BY 1) SELECT R(prob) AS score, I(sum(pos) OVER w) AS tp, I(sum(n) OVER w - sum(pos) OVER w) AS fp, R(sum(pos) OVER w / sum(n) OVER w) AS precision, R(sum(pos) OVER w / nullif(sum(pos) OVER (), 0)) AS recall FROM a WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)")
def precision_recall_curve(spark: S, sf: D) -> DataFrame:
    return metrics.pr_curve(predictions(spark, sf).filter("model = 'mean'"), "y_cls", "prob", ["model"]).drop("model")


@register("WITH q AS (SELECT model, [0.5 + 0.499 * i / 119 FOR i IN range(120)] AS qs, quantile_cont(pred_peak, [" + ", ".join(repr(0.5 + (0.999 - 0.5) * i / 119) for i in range(120)) + "]) AS v, sum(y_cls) AS p FROM @pred GROUP BY 1), c AS (SELECT DISTINCT model, p, round_even(x, 2) AS tau FROM (SELECT model, p, unnest(v) AS x FROM q)), f AS (SELECT c.model, tau, p, coalesce(2.0::DOUBLE * sum(CASE WHEN round(pred_peak, 9) >= tau THEN y_cls ELSE 0 END) / nullif(sum((round(pred_peak, 9) >= tau)::INT) + p, 0), 0) AS f1 FROM c JOIN pred d ON c.model = d.model GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f1, 12) DESC, tau) AS r FROM f) SELECT model, R(tau) AS tau, R(f1) AS f1 FROM b WHERE r = 1")
def tuned_threshold(spark: S, sf: D) -> DataFrame:
    return metrics.tune_threshold(materialize(predictions(spark, sf).select("model", "y_cls", "pred_peak"), "scores"), "y_cls", "pred_peak", ["model"], 0.0)


@register("WITH b AS (SELECT model, prob, y_cls, CASE " + " ".join(f"WHEN prob <= {(i + 1) * 0.1 if i < 9 else 1.0!r}::DOUBLE THEN {i + 1}" for i in range(10)) + " ELSE 10 END AS bin FROM @pred), g AS (SELECT model, bin, count(*) AS n, avg(prob) AS mp, avg(y_cls) AS r FROM b GROUP BY 1, 2), e AS (SELECT model, sum(n * abs(mp - r)) / sum(n) AS ece FROM g GROUP BY 1), s AS (SELECT model, avg(pow(y_cls - prob, 2)) AS brier FROM pred GROUP BY 1) SELECT model, R(ece) AS ece, R(brier) AS brier FROM e JOIN s USING (model)")
def calibration_error(spark: S, sf: D) -> DataFrame:
    return metrics.calibration_error(materialize(predictions(spark, sf).select("model", "y_cls", "prob"), "scores"), "y_cls", "prob", ["model"])


@register("SELECT I(CASE " + " ".join(f"WHEN prob <= {(i + 1) * 0.1 if i < 9 else 1.0!r}::DOUBLE THEN {i + 1}" for i in range(10)) + " ELSE 10 END) AS bin, count(*) AS n, R(avg(prob)) AS mean_p, R(avg(y_cls)) AS rate FROM @pred WHERE model = 'mean' GROUP BY 1")
def reliability_bins(spark: S, sf: D) -> DataFrame:
    return metrics.reliability(predictions(spark, sf).filter("model = 'mean'"), "y_cls", "prob", [])


@register("WITH r AS (SELECT model, is_shutdown, abs(y_avg - pred_avg) AS e FROM @pred), k AS (SELECT *, row_number() OVER (PARTITION BY model, is_shutdown ORDER BY e) AS i, count(*) OVER (PARTITION BY model, is_shutdown) AS n FROM r) SELECT model, I(is_shutdown) AS is_shutdown, max(n) AS n, R(min(CASE WHEN i >= ceil(round((n + 1) * 0.9, 9)) THEN e END)) AS halfwidth FROM k GROUP BY 1, 2")
def conformal_halfwidth(spark: S, sf: D) -> DataFrame:
    df = predictions(spark, sf).withColumn("e", F.col("y_avg") - F.col("pred_avg"))
    return metrics.conformal(df, "e", ["model", "is_shutdown"], 0.1)


@register("WITH k AS (SELECT model, is_shutdown, abs(y_avg - pred_avg) AS e, row_number() OVER (PARTITION BY model, is_shutdown ORDER BY abs(y_avg - pred_avg)) AS i, count(*) OVER (PARTITION BY model, is_shutdown) AS n FROM @pred WHERE fold < 3), q AS (SELECT model, is_shutdown, min(CASE WHEN i >= ceil(round((n + 1) * 0.8, 9)) THEN e END) AS w FROM k GROUP BY 1, 2) SELECT model, count(*) AS n, R(avg((y_avg BETWEEN greatest(pred_avg - w, 0) AND pred_avg + w)::INT)) AS coverage, R(avg(pred_avg + w - greatest(pred_avg - w, 0))) AS width FROM pred JOIN q USING (model, is_shutdown) WHERE fold = 3 AND w IS NOT NULL GROUP BY 1")
def interval_coverage(spark: S, sf: D) -> DataFrame:
    """Conformal intervals of the first two folds' residuals, by model and state of the day, on the third fold."""
    df = predictions(spark, sf)
    half = metrics.conformal(df.filter("fold < 3").withColumn("e", F.col("y_avg") - F.col("pred_avg")), "e", ["model", "is_shutdown"], 0.2).drop("n")
    rows = df.filter("fold = 3").join(half, ["model", "is_shutdown"]).filter("halfwidth is not null")
    return metrics.interval_score(rows.withColumns({"lo": F.col("pred_avg") - F.col("halfwidth"), "hi": F.col("pred_avg") + F.col("halfwidth")}), "lo", "hi", "y_avg", ["model"])


@register("WITH a AS (SELECT model, fold, avg(abs(y_avg - pred_avg)) AS m FROM @pred GROUP BY 1, 2), t AS (SELECT model, avg(abs(y_avg - pred_avg)) AS mae, avg((y_cls = pred_cls)::INT) AS acc FROM pred GROUP BY 1), s AS (SELECT model, mae, acc, sd FROM t JOIN (SELECT model, stddev_samp(m) AS sd FROM a GROUP BY 1) USING (model)), z AS (SELECT model, coalesce(1 - (mae - min(mae) OVER ()) / nullif(max(mae) OVER () - min(mae) OVER (), 0), 1) AS a, coalesce((acc - min(acc) OVER ()) / nullif(max(acc) OVER () - min(acc) OVER (), 0), 1) AS b, coalesce(1 - (sd - min(sd) OVER ()) / nullif(max(sd) OVER () - min(sd) OVER (), 0), 1) AS c FROM s) SELECT model, R(round(0.45 * a + 0.35 * b + 0.2 * c, 4)) AS score FROM z")
def model_scorecard(spark: S, sf: D) -> DataFrame:
    p = materialize(predictions(spark, sf).select("model", "fold", "y_avg", "pred_avg", "y_cls", "pred_cls"), "scores")
    err = F.abs(F.col("y_avg") - F.col("pred_avg"))
    sd = p.groupBy("model", "fold").agg(F.avg(err).alias("m")).groupBy("model").agg(F.stddev_samp("m").alias("sd"))
    rows = p.groupBy("model").agg(F.avg(err).alias("mae"), F.avg((F.col("y_cls") == F.col("pred_cls")).cast("double")).alias("acc")).join(sd, "model")
    return metrics.scorecard(rows, {"mae": (0.45, True), "acc": (0.35, False), "sd": (0.2, True)}).select("model", "score")


@register("WITH w AS (SELECT i / 20.0::DOUBLE AS w FROM range(21) t(i)), p AS (SELECT y_avg, y_avg_lag24 AS a, y_avg_lag168 AS b FROM @pred WHERE model = 'mean'), e AS (SELECT w, avg(abs(y_avg - (w * a + (1 - w) * b))) AS mae FROM w, p GROUP BY 1) SELECT R((SELECT w FROM e ORDER BY round(mae, 12), w LIMIT 1)) AS w, R(min(mae)) AS mae, R(least(max(mae) FILTER (w = 0), max(mae) FILTER (w = 1))) AS single, least(max(mae) FILTER (w = 0), max(mae) FILTER (w = 1)) - min(mae) > 1e-9 AS accepted FROM e")
def ensemble_blend(spark: S, sf: D) -> DataFrame:
    return evaluate.best_blend(predictions(spark, sf).filter("model = 'mean'"), "y_avg_lag24", "y_avg_lag168", "y_avg")


@register("WITH f AS (SELECT model, fold, count(*) AS n, avg(abs(y_avg - pred_avg)) AS mae, avg(CASE WHEN y_cls = 1 THEN abs(y_avg - pred_avg) END) AS pm, sum((y_cls = 1 AND pred_cls = 1)::INT) AS tp, sum((y_cls = 1 AND pred_cls = 0)::INT) AS fn FROM @pred GROUP BY 1, 2) SELECT model, R(sum(mae * n) / sum(n)) AS mae, R(sum(coalesce(pm, 0) * (tp + fn)) / nullif(sum(tp + fn), 0)) AS peak_mae, R(sum(tp) / nullif(sum(tp + fn), 0)) AS recall, R(coalesce(stddev_samp(mae), 0)) AS fold_std FROM f GROUP BY 1")
def pooled_fold_score(spark: S, sf: D) -> DataFrame:
    err = F.abs(F.col("y_avg") - F.col("pred_avg"))
    f = predictions(spark, sf).groupBy("model", "fold").agg(F.count("*").alias("n"), F.avg(err).alias("mae"), F.avg(F.when(F.col("y_cls") == 1, err)).alias("peak_mae"), *metrics.confusion())
    return evaluate.pooled_score(f)


_CONDS = {"all": "TRUE", "production_zero": "prod = 0", "production_positive": "prod > 0", "production_high": "prod > 2", "hour_08": "hour = 8", "hour_13": "hour = 13", "hour_17_18": "hour IN (17, 18)", "daytime_09_17": "hour BETWEEN 9 AND 17", "nighttime": "hour NOT BETWEEN 9 AND 17", "shutdown": "is_shutdown = 1", "operating": "is_shutdown = 0", "first_day_after_shutdown": "is_first_day_back = 1"}
_CELL = f"count(*) AS n_hours, count(DISTINCT day) AS n_days, {_CONF}, R(avg(abs(y_avg - pred_avg))) AS mae, R(avg(CASE WHEN y_cls = 1 THEN abs(y_avg - pred_avg) END)) AS peak_mae, R(avg(y_cls)) AS peak_rate, R(avg(y_peak)) AS mean_peak"


@register("WITH x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS condition, * FROM @pred WHERE model = 'lag24' AND {c}" for n, c in _CONDS.items()) + f"), g AS (SELECT condition, {_CELL} FROM x GROUP BY 1) SELECT *, {_RATES.format('NULL')}, n_hours < 20 OR n_days < 5 AS sparse_cell FROM g")
def condition_cells(spark: S, sf: D) -> DataFrame:
    return evaluate.condition_cells(predictions(spark, sf).filter("model = 'lag24'"), 2.0, 0.0)


@register(f"WITH x AS (SELECT *, CASE WHEN prod = 0 THEN 'zero' WHEN prod <= 1 THEN 'positive_to_q50' WHEN prod <= 2 THEN 'q50_to_q75' ELSE 'above_q75' END AS production_band FROM @pred WHERE model = 'lag24'), g AS (SELECT production_band, I(hour) AS hour, {_CELL} FROM x GROUP BY 1, 2) SELECT *, {_RATES.format('NULL')}, n_hours < 20 OR n_days < 5 AS sparse_cell FROM g")
def production_band_cells(spark: S, sf: D) -> DataFrame:
    return evaluate.production_bands(predictions(spark, sf).filter("model = 'lag24'"), 1.0, 2.0, 0.0)


@register(f"WITH x AS (SELECT *, CASE WHEN temp <= 40 THEN 'low' WHEN temp <= 60 THEN 'middle' ELSE 'high' END AS temperature_band FROM @pred WHERE model = 'lag24'), g AS (SELECT I(hour) AS hour, I(is_shutdown) AS is_shutdown, temperature_band, {_CELL} FROM x GROUP BY 1, 2, 3) SELECT *, {_RATES.format('NULL')}, n_hours < 20 OR n_days < 5 AS sparse_cell FROM g")
def temperature_band_cells(spark: S, sf: D) -> DataFrame:
    return evaluate.temperature_bands(predictions(spark, sf).filter("model = 'lag24'"), 40.0, 60.0, 0.0)


@register("WITH x AS (SELECT day, abs(y_avg - pred_avg) AS e, unnest([{'n': 'operating', 'c': is_shutdown = 0}, {'n': 'startup', 'c': hour IN (8, 13)}, {'n': 'daytime', 'c': is_daytime = 1}, {'n': 'after_holiday', 'c': prev_day_shutdown = 1}, {'n': 'production_change', 'c': abs(prod_chg_ratio) >= 0.5}]) AS u FROM @pred WHERE model = 'lag24') SELECT u.n AS name, R(avg(CASE WHEN u.c THEN e END)) AS mae_in, R(avg(CASE WHEN NOT u.c THEN e END)) AS mae_out, I(sum(u.c::INT)) AS n_in, I(sum((NOT u.c)::INT)) AS n_out, count(DISTINCT CASE WHEN u.c THEN day END) AS days_in FROM x GROUP BY 1")
def conditional_errors(spark: S, sf: D) -> DataFrame:
    named = {"operating": F.col("is_shutdown") == 0, "startup": F.col("hour").isin(8, 13), "daytime": F.col("is_daytime") == 1, "after_holiday": F.col("prev_day_shutdown") == 1, "production_change": F.abs("prod_chg_ratio") >= 0.5}
    return evaluate.split_by(predictions(spark, sf).filter("model = 'lag24'"), named)


@register("WITH e AS (SELECT site_id, day, ts, abs(y_avg - pred_avg) AS e FROM @pred WHERE model = 'lag24'), t AS (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY e DESC, ts) AS r FROM e) SELECT site_id, day, ts, R(e) AS abs_err FROM t WHERE r = 1 ORDER BY e DESC, site_id, ts LIMIT 3")
def failure_cases(spark: S, sf: D) -> DataFrame:
    return evaluate.worst_days(predictions(spark, sf).filter("model = 'lag24'")).select("site_id", "day", "ts", "abs_err")


@register("SELECT I(f.fold) AS fold, R(quantile_cont(pred_peak, 0.95)) AS tau, count(*) AS n FROM @folds f JOIN @pred p ON p.day < f.val_start WHERE model = 'lag168' GROUP BY 1")
def earlier_fold_threshold(spark: S, sf: D) -> DataFrame:
    return evaluate.earlier_thresholds(predictions(spark, sf).filter("model = 'lag168'"), folds(spark))


@register("SELECT a.site_id, a.ts, R(a.y_avg) AS y, R(a.pred_avg) AS pred_a, R(b.pred_avg) AS pred_b FROM @pred a JOIN pred b ON a.site_id = b.site_id AND a.ts = b.ts WHERE a.model = 'lag24' AND b.model = 'lag168'")
def paired_predictions(spark: S, sf: D) -> DataFrame:
    long = materialize(predictions(spark, sf).select("site_id", "ts", "model", F.col("y_avg").alias("y"), F.col("pred_avg").alias("pred")), "pairs")
    return joins.paired(long, "lag24", "lag168", ["site_id", "ts"])


@register("SELECT site_id, day, R(sum(abs(y_avg - pred_avg))) AS err, count(*) AS n FROM @pred WHERE model = 'mean' GROUP BY 1, 2")
def daily_errors(spark: S, sf: D) -> DataFrame:
    return predictions(spark, sf).filter("model = 'mean'").groupBy("site_id", "day").agg(F.sum(F.abs(F.col("y_avg") - F.col("pred_avg"))).alias("err"), F.count("*").alias("n"))


@register("SELECT site_id, day, R(avg(abs(y_avg - y_avg_lag168))) AS mae, R(avg(CASE WHEN y_cls = 1 THEN abs(y_avg - y_avg_lag168) END)) AS peak_mae, count(*) AS n FROM @feat WHERE day >= DATE '2024-01-24' AND NOT is_outage AND y_avg_lag168 IS NOT NULL GROUP BY 1, 2")
def seasonal_naive_by_day(spark: S, sf: D) -> DataFrame:
    """The flagship: scan, hourly grid, repair, calendar, windows, joins and metrics in one plan."""
    err = F.abs(F.col("y_avg") - F.col("y_avg_lag168"))
    rows = featured(spark, sf).filter("day >= date '2024-01-24' and not is_outage and y_avg_lag168 is not null")
    return rows.groupBy("site_id", "day").agg(F.avg(err).alias("mae"), F.avg(F.when(F.col("y_cls") == 1, err)).alias("peak_mae"), F.count("*").alias("n"))


# --- joins, sets, sorts ---------------------------------------------------------------------------------------------------


@register("SELECT o_orderkey, c_name, n_name, R(o_totalprice) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def order_customers(spark: S, sf: D) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_totalprice > 100000")
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@register("SELECT c_custkey, R(coalesce(s, 0)) AS spent FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def one_to_one_left(spark: S, sf: D) -> DataFrame:
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    return joins.one_to_one(table(spark, sf, "customer").select("c_custkey"), spent, ["c_custkey"]).select("c_custkey", F.coalesce("s", F.lit(0.0)).alias("spent"))


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customers_without_orders(spark: S, sf: D) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def returned_orders(spark: S, sf: D) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    return li.join(table(spark, sf, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@register("SELECT site_id, ts, \"column\" FROM (SELECT site_id, ts, 'headcount' AS \"column\", m.headcount IS DISTINCT FROM r.headcount AS d FROM @meter m JOIN @rep r USING (site_id, ts) UNION ALL SELECT site_id, ts, 'avg', m.avg IS DISTINCT FROM r.avg FROM meter m JOIN rep r USING (site_id, ts)) WHERE d")
def repaired_cells(spark: S, sf: D) -> DataFrame:
    return joins.inconsistent(meter(spark, sf), repaired(spark, sf), ["site_id", "ts"], ["headcount", "avg"])


@register("SELECT DISTINCT x FROM (SELECT n_name AS x FROM nation WHERE n_regionkey < 3 UNION SELECT n_name FROM nation WHERE n_regionkey > 1)")
def union_distinct(spark: S, sf: D) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.filter("n_regionkey < 3").select(F.col("n_name").alias("x")).union(n.filter("n_regionkey > 1").select("n_name")).distinct()


@register("SELECT I(c_nationkey) AS k FROM customer INTERSECT SELECT I(s_nationkey) FROM supplier")
def intersect_keys(spark: S, sf: D) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@register("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_keys(spark: S, sf: D) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@register("SELECT site_id, ts, R(y_peak) AS y_peak FROM @rep ORDER BY y_peak DESC NULLS LAST, ts, site_id LIMIT 20")
def largest_peaks(spark: S, sf: D) -> DataFrame:
    return repaired(spark, sf).select("site_id", "ts", "y_peak").orderBy(F.desc_nulls_last("y_peak"), "ts", "site_id").limit(20)


# --- scalar functions -----------------------------------------------------------------------------------------------------


@register("SELECT l_orderkey, I(l_linenumber) AS l_linenumber, R(floor(x + 0.5)) AS half_up, R(round_even(x, 0)) AS half_even, R(coalesce(l_tax / nullif(l_discount, 0), 0)) AS ratio, R(CASE WHEN l_quantity <= 0 THEN 0 WHEN l_quantity <= 10 THEN l_quantity / 10 WHEN l_quantity <= 50 THEN 1 + (l_quantity - 10) * 0.025 ELSE 2 END) AS bent FROM (SELECT *, l_quantity / 2 - 10 AS x FROM lineitem)")
def scalar_rounding(spark: S, sf: D) -> DataFrame:
    x = F.col("l_quantity") / 2 - 10
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", stats.half_up(x).cast("double").alias("half_up"), F.bround(x, 0).alias("half_even"), F.coalesce(stats.safe_ratio(F.col("l_tax"), F.col("l_discount")), F.lit(0.0)).alias("ratio"), stats.interpolate(F.col("l_quantity"), [(0.0, 0.0), (10.0, 1.0), (50.0, 2.0)]).alias("bent"))


@register("SELECT o_orderkey, I(isodow(o_orderdate) - 1) AS dow, I(strftime(o_orderdate, '%Y%m%d')) AS ymd, I(day(last_day(o_orderdate))) AS month_days, (o_orderdate::DATE + (5 - (isodow(o_orderdate) - 1))::INT)::DATE AS saturday, md5(o_orderpriority) AS digest, I(CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 ELSE 2 END) AS left_closed, I(CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 150000 THEN 1 ELSE 2 END) AS right_closed FROM orders")
def scalar_dates_bins(spark: S, sf: D) -> DataFrame:
    o, d = table(spark, sf, "orders"), F.to_date("o_orderdate")
    edges = (50000.0, 150000.0)
    return o.select("o_orderkey", F.weekday("o_orderdate").alias("dow"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("ymd"), F.day(F.last_day(d)).alias("month_days"), F.date_add(d, 5 - F.weekday(d)).alias("saturday"), F.md5("o_orderpriority").alias("digest"), opcal.hourly_regime(F.col("o_totalprice"), edges).alias("left_closed"), opcal.daily_regime(F.col("o_totalprice"), edges).alias("right_closed"))


# --- simulation, policy, comparison -----------------------------------------------------------------------------------------


@register("WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, max(o_totalprice) AS peak FROM orders GROUP BY 1, 2) SELECT p AS site_id, month, R(peak) AS peak, R(max(peak) OVER (PARTITION BY p ORDER BY month ROWS 2 PRECEDING)) AS billing FROM m")
def billing_peaks(spark: S, sf: D) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y_peak"))
    return policy.monthly_billing(o)


@register("SELECT site_id, R(max(y_peak)) AS billing_peak, R(max(y_peak) * 8320 * 12) AS annual_charge FROM @rep GROUP BY 1")
def annual_charge(spark: S, sf: D) -> DataFrame:
    return policy.basic_charge(repaired(spark, sf))


@register("SELECT site_id, ts, R(CASE WHEN hour IN (8, 13) AND y_peak IS NOT NULL THEN greatest(y_peak * (1 - 0.2::DOUBLE * 2 / 3), 0) ELSE CASE WHEN y_peak IS NOT NULL THEN greatest(y_peak, 0) END END) AS peak_new FROM @rep")
def lever_spread(spark: S, sf: D) -> DataFrame:
    return policy.spread_start(repaired(spark, sf)).select("site_id", "ts", "peak_new")


_SRC = "f AS (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY y_peak DESC, ts) AS r FROM @rep WHERE y_peak IS NOT NULL)"
_APPLY = "delta AS (SELECT site_id, ts, sum(d) AS d FROM (SELECT site_id, src AS ts, -units AS d FROM mv UNION ALL SELECT site_id, dst, units FROM mv) GROUP BY 1, 2) SELECT site_id, ts, R(prod + coalesce(d, 0)) AS prod_new, R(CASE WHEN y_peak IS NOT NULL THEN greatest(y_peak + 1.5::DOUBLE * coalesce(d, 0), 0) END) AS peak_new FROM rep LEFT JOIN delta USING (site_id, ts)"


@register(f"WITH {_SRC}, t AS (SELECT DISTINCT site_id, day FROM (SELECT site_id, day, row_number() OVER (PARTITION BY site_id ORDER BY y_peak DESC, ts) AS k FROM f) WHERE k <= 20), s AS (SELECT f.* FROM f, @th WHERE r = 1 AND prod > 0 AND (y_peak >= theta OR EXISTS (SELECT 1 FROM t WHERE t.site_id = f.site_id AND t.day = f.day))), mv AS (SELECT s.site_id, s.ts AS src, x.ts AS dst, s.prod * 0.2::DOUBLE / count(*) OVER (PARTITION BY s.site_id, s.ts) AS units FROM s JOIN rep x ON x.site_id = s.site_id AND x.day = s.day AND x.hour IN (10, 11, 15, 16) AND x.ts <> s.ts), {_APPLY}")
def lever_same_day(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.shift_same_day(df, theta_of(df), 1.5).select("site_id", "ts", "prod_new", "peak_new")


@register(f"WITH {_SRC}, s AS (SELECT f.* FROM f, @th WHERE r = 1 AND prod > 0 AND y_peak >= theta), mv AS (SELECT s.site_id, s.ts AS src, x.ts AS dst, s.prod * 0.15::DOUBLE / count(*) OVER (PARTITION BY s.site_id, s.ts) AS units FROM s JOIN rep x ON x.site_id = s.site_id AND x.day = s.day AND x.hour IN (21, 22, 23, 0, 1, 2)), {_APPLY}")
def lever_night(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.shift_off_hours(df, theta_of(df), 1.5)[0].select("site_id", "ts", "prod_new", "peak_new")


@register(f"WITH {_SRC}, s AS (SELECT f.* FROM f, @th WHERE r = 1 AND prod > 0 AND y_peak >= theta), mv AS (SELECT s.site_id, s.ts AS src, x.ts AS dst, s.prod * 0.15::DOUBLE / count(*) OVER (PARTITION BY s.site_id, s.ts) AS units FROM s JOIN rep x ON x.site_id = s.site_id AND date_trunc('week', x.day) = date_trunc('week', s.day) AND isodow(x.day) = 6 AND x.hour BETWEEN 8 AND 17), {_APPLY}")
def lever_saturday(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.shift_off_hours(df, theta_of(df), 1.5, "saturday")[0].select("site_id", "ts", "prod_new", "peak_new")


@register("WITH RECURSIVE cap AS (SELECT site_id, quantile_cont(prod, 0.9) AS c FROM @rep WHERE prod > 0 GROUP BY 1), d AS (SELECT r.*, c, theta, max(y_peak) OVER (PARTITION BY r.site_id, day) >= theta AS hot FROM rep r JOIN cap USING (site_id), @th), f AS (SELECT site_id, day, hour, hot AND y_peak >= theta AND prod > c AS over_, CASE WHEN hot AND y_peak >= theta AND prod > c THEN c ELSE prod END AS made, CASE WHEN hot AND y_peak >= theta AND prod > c THEN prod - c ELSE 0 END AS carry FROM d WHERE hour = 0 UNION ALL SELECT d.site_id, d.day, d.hour, TRUE, CASE WHEN d.hot AND d.y_peak >= theta AND d.prod + f.carry > c THEN c ELSE d.prod + f.carry END, CASE WHEN d.hot AND d.y_peak >= theta AND d.prod + f.carry > c THEN d.prod + f.carry - c ELSE 0 END FROM f JOIN d ON d.site_id = f.site_id AND d.day = f.day AND d.hour = f.hour + 1) SELECT site_id, day, I(hour) AS hour, R(made + CASE WHEN hour = 23 THEN carry ELSE 0 END) AS prod_new FROM f")
def lever_cap(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.cap_and_carry(df, theta_of(df), 1.5).select("site_id", "day", "hour", "prod_new")


@register("WITH n AS (SELECT site_id, max(y_peak) AS a, max(CASE WHEN hour IN (8, 13) THEN y_peak * (1 - 0.2::DOUBLE * 2 / 3) ELSE y_peak END) AS b FROM @rep GROUP BY 1), m AS (SELECT site_id, sum(1.0::DOUBLE / day(last_day(day))) AS months FROM (SELECT DISTINCT site_id, day FROM rep) GROUP BY 1) SELECT site_id, R(a) AS peak_before, R(b) AS peak_after, R(months) AS months, 0::BIGINT AS hours_over, TRUE AS day_conserved, TRUE AS week_conserved, R(a - b) AS delta_peak, R((a - b) * 8320 * months) AS saving FROM n JOIN m USING (site_id)")
def lever_evaluation(spark: S, sf: D) -> DataFrame:
    return policy.evaluate_lever(policy.spread_start(repaired(spark, sf)))


def _actions(spark: S, sf: D, name: str) -> DataFrame:
    df = featured(spark, sf)
    th = theta_of(repaired(spark, sf))
    rows = df.filter("day >= date '2024-01-24'").select("site_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("origin"), F.col("y_peak_lag24").alias("pred_peak"), F.lit(th * 0.8).alias("tau"), F.col("prod").alias("planned_production"), F.lit(True).alias("plan_known"), (F.col("is_shutdown") == 0).alias("is_operating"))
    return policy.select_actions(rows, name, 3.0)


_ACT = "a AS (SELECT site_id, ts, day, y_peak, coalesce(y_peak_lag24 >= theta * 0.8::DOUBLE, FALSE) AS alert, is_shutdown = 0 AND hour > 0 AND bool_and(y_peak_lag24 IS NOT NULL AND prod IS NOT NULL) OVER (PARTITION BY site_id, day) AS eligible, hour, prod FROM @feat, @th WHERE day >= DATE '2024-01-24')"


@register(f"WITH {_ACT} SELECT site_id, ts, alert, eligible AND hour IN (8, 13) AND alert AS l1_action, R(prod) AS production_after FROM a")
def policy_alert_spread(spark: S, sf: D) -> DataFrame:
    return _actions(spark, sf, "alert_L1").select("site_id", "ts", "alert", "l1_action", "production_after")


@register(f"WITH {_ACT} SELECT site_id, ts, eligible AND hour IN (8, 13) AS l1_action FROM a")
def policy_fixed_spread(spark: S, sf: D) -> DataFrame:
    return _actions(spark, sf, "fixed_L1").select("site_id", "ts", "l1_action")


#: The allocation as a recursion over pairs of donor and receiver of a day, in the order of both; `used` holds what each receiver got.
_SHIFT = (
    _ACT.replace("a AS (", "a AS MATERIALIZED (", 1)
    + ", dn AS (SELECT site_id, day, hour, prod * 0.2::DOUBLE AS asked FROM a WHERE eligible AND alert AND prod > 0)"
    + ", tk AS (SELECT site_id, day, hour, prod, row_number() OVER (PARTITION BY site_id, day ORDER BY hour) AS j FROM a WHERE eligible AND NOT alert AND hour IN (10, 11, 15, 16))"
    + ", pr AS MATERIALIZED (SELECT d.site_id, d.day, d.hour AS dh, t.hour AS th, t.j, asked, t.prod, row_number() OVER (PARTITION BY d.site_id, d.day ORDER BY d.hour, t.hour) AS k, row_number() OVER (PARTITION BY d.site_id, d.day, d.hour ORDER BY t.hour) = 1 AS new FROM dn d JOIN tk t ON t.site_id = d.site_id AND t.day = d.day AND t.hour > d.hour)"
    + ", w AS (SELECT site_id, day, 0::BIGINT AS k, 0::BIGINT AS dh, 0::BIGINT AS th, 0.0::DOUBLE AS units, 0.0::DOUBLE AS rest, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS used FROM (SELECT DISTINCT site_id, day FROM pr)"
    + " UNION ALL SELECT site_id, day, k, dh, th, m, r0 - m, [CASE WHEN i = j THEN used[i] + m ELSE used[i] END FOR i IN range(1, 5)] FROM (SELECT *, CASE WHEN r0 > 1e-10 THEN least(r0, greatest(0, 3.0::DOUBLE - prod - used[j])) ELSE 0.0 END AS m FROM (SELECT p.*, w.used, CASE WHEN p.new THEN p.asked ELSE w.rest END AS r0 FROM w JOIN pr p ON p.site_id = w.site_id AND p.day = w.day AND p.k = w.k + 1)))"
    + ", sh AS (SELECT a.*, coalesce(dn.asked, 0) AS asked, coalesce(o.u, 0) AS out_, coalesce(i.u, 0) AS in_ FROM a LEFT JOIN dn USING (site_id, day, hour) LEFT JOIN (SELECT site_id, day, dh AS hour, sum(units) AS u FROM w GROUP BY 1, 2, 3) o USING (site_id, day, hour) LEFT JOIN (SELECT site_id, day, th AS hour, sum(units) AS u FROM w GROUP BY 1, 2, 3) i USING (site_id, day, hour))"
)


@register(f"WITH RECURSIVE {_SHIFT} SELECT site_id, ts, R(asked) AS shift_requested, R(out_) AS shift_out, R(in_) AS shift_in, R(asked - out_) AS unallocated_units, R(prod + in_ - out_) AS production_after FROM sh")
def policy_alert_shift(spark: S, sf: D) -> DataFrame:
    """Donors fill later receivers in turn."""
    return _actions(spark, sf, "alert_L2").select("site_id", "ts", "shift_requested", "shift_out", "shift_in", "unallocated_units", "production_after")


@register(f"WITH RECURSIVE {_SHIFT} SELECT site_id, ts AS source, day::TIMESTAMP + th * INTERVAL 1 HOUR AS recipient, R(units) AS units FROM (SELECT site_id, day, dh, th, units FROM w WHERE units > 0) JOIN (SELECT site_id, day, hour AS dh, ts FROM a) USING (site_id, day, dh)")
def policy_transfers(spark: S, sf: D) -> DataFrame:
    return policy.transfers(_actions(spark, sf, "alert_L2")).select("site_id", "source", "recipient", "units")


@register(f"WITH RECURSIVE {_SHIFT}, g AS (SELECT site_id, day, abs(sum(in_ - out_)) <= 1e-8 AS conserved, bool_and(in_ <= 0 OR prod + in_ - out_ <= 3 + 1e-8) AS capacity_ok, bool_and(out_ <= 0 OR eligible) AS no_invalid_action, bool_and(NOT eligible OR prod + in_ - out_ >= -1e-8) AS nonnegative, sum(asked - out_) AS unallocated_units FROM sh GROUP BY 1, 2), t AS (SELECT site_id, day, bool_and(th > dh) AS future_ok FROM w WHERE units > 0 GROUP BY 1, 2) SELECT site_id, day, conserved, capacity_ok, no_invalid_action, nonnegative, coalesce(future_ok, TRUE) AS future_ok, R(unallocated_units) AS unallocated_units, conserved AND capacity_ok AND no_invalid_action AND nonnegative AND coalesce(future_ok, TRUE) AS passed FROM g LEFT JOIN t USING (site_id, day)")
def policy_audit(spark: S, sf: D) -> DataFrame:
    return policy.audit(_actions(spark, sf, "alert_L2"), 3.0)


@register(f"WITH RECURSIVE {_SHIFT}, o AS (SELECT sh.*, NOT r.is_outage AND sh.y_peak >= 0 AS valid, sh.y_peak + 1.5::DOUBLE * (in_ - out_) AS raw, theta FROM sh JOIN @rep r USING (site_id, ts), th) SELECT site_id, 'alert_L2' AS policy, count(*) AS n_hours, R(max(CASE WHEN valid THEN y_peak END)) AS observed_peak, R(max(CASE WHEN valid THEN greatest(raw, 0) END)) AS assumed_peak, R(sum(out_)) AS shifted_units, I(sum((valid AND y_peak < theta AND greatest(raw, 0) >= theta)::INT)) AS new_peak_hours, I(sum((valid AND raw < 0)::INT)) AS floored_hours FROM o GROUP BY 1")
def policy_shift_outcomes(spark: S, sf: D) -> DataFrame:
    """What shifting does to the peaks, each unit of production counting 1.5 kW."""
    df = repaired(spark, sf)
    rows = policy.outcomes(_actions(spark, sf, "alert_L2"), df.withColumn("usable", ~F.col("is_outage")), theta_of(df), 1.5, 0.2)
    return policy.policy_metrics(rows, theta_of(df)).select("site_id", "policy", "n_hours", "observed_peak", "assumed_peak", "shifted_units", "new_peak_hours", "floored_hours")


def _outcome(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.outcomes(_actions(spark, sf, "alert_L1"), df.withColumn("usable", ~F.col("is_outage")), theta_of(df), 0.0, 0.2)


@register(f"WITH {_ACT}, o AS (SELECT a.*, eligible AND a.hour IN (8, 13) AND alert AS l1, NOT r.is_outage AND a.y_peak >= 0 AS valid, theta FROM a JOIN @rep r USING (site_id, ts), th) SELECT site_id, 'alert_L1' AS policy, count(*) AS n_hours, I(sum(valid::INT)) AS n_eval, R(max(CASE WHEN valid THEN y_peak END)) AS observed_peak, R(max(CASE WHEN valid THEN y_peak * (1 - 0.2::DOUBLE * 2 / 3 * l1::INT) END)) AS assumed_peak, I(sum((valid AND y_peak >= theta AND alert)::INT)) AS tp, I(sum((valid AND y_peak < theta AND alert)::INT)) AS fp, I(sum(l1::INT)) AS action_events, I(sum((l1 AND valid AND y_peak < theta)::INT)) AS false_action_events FROM o GROUP BY 1")
def policy_outcomes(spark: S, sf: D) -> DataFrame:
    m = policy.policy_metrics(_outcome(spark, sf), theta_of(repaired(spark, sf)))
    return m.select("site_id", "policy", "n_hours", "n_eval", "observed_peak", "assumed_peak", "tp", "fp", "action_events", "false_action_events")


@register("SELECT DISTINCT R(alpha) AS alpha, R(f) AS rate_factor, R(c) AS action_cost, R(u) AS unit_cost, R(8320.0::DOUBLE * f) AS rate FROM (SELECT a AS alpha, f, 0.0 AS c, 0.0 AS u FROM (VALUES (0.1), (0.2), (0.3)) x(a), (VALUES (0.7), (1.0), (1.3)) y(f) UNION SELECT 0.2, 1.0, c, u FROM (VALUES (0.0), (1000.0), (5000.0)) x(c), (VALUES (0.0), (0.01), (0.1)) y(u))")
def cost_grid(spark: S, sf: D) -> DataFrame:
    return policy.cost_grid(spark)


@register("WITH s AS (SELECT * FROM (VALUES ('C0', 1.0, 1.0, 0, 0), ('P80', 0.8, 1.0, 0, 0), ('P90', 0.9, 1.0, 0, 0), ('P110', 1.1, 1.0, 0, 0), ('P120', 1.2, 1.0, 0, 0), ('H90', 1.0, 0.9, 0, 0), ('H110', 1.0, 1.1, 0, 0), ('T-2', 1.0, 1.0, -2, 0), ('T-1', 1.0, 1.0, -1, 0), ('T+1', 1.0, 1.0, 1, 0), ('T+2', 1.0, 1.0, 2, 0), ('P80T-2', 0.8, 1.0, -2, 0), ('P80T+2', 0.8, 1.0, 2, 0), ('P120T-2', 1.2, 1.0, -2, 0), ('P120T+2', 1.2, 1.0, 2, 0), ('S-1', 1.0, 1.0, 0, -1), ('S+1', 1.0, 1.0, 0, 1)) t(scenario, p, h, t, k)), r AS (SELECT s.*, site_id, day, hour, prod, headcount, temp FROM s, @rep WHERE day >= DATE '2024-01-24'), m AS (SELECT scenario, site_id, day, greatest(0, least(23, hour + k)) AS hour, sum(prod * p::DOUBLE) AS prod FROM r GROUP BY ALL) SELECT r.scenario, r.site_id, r.day, I(r.hour) AS hour, R(coalesce(m.prod, 0)) AS prod, R(r.headcount * h::DOUBLE) AS headcount, R(r.temp + t) AS temp FROM r LEFT JOIN m ON m.scenario = r.scenario AND m.site_id = r.site_id AND m.day = r.day AND m.hour = r.hour")
def plan_scenarios(spark: S, sf: D) -> DataFrame:
    plan = repaired(spark, sf).filter("day >= date '2024-01-24'").select("site_id", "day", "hour", "prod", "headcount", "temp")
    return policy.perturb(plan, policy.scenarios(spark))


@register("SELECT concat(site_id, '/', ts::VARCHAR) AS \"key\", 'avg' AS \"column\", 'numeric_differs' AS reason FROM (SELECT m.site_id, m.ts, m.avg AS a, r.avg AS b FROM @meter m JOIN @rep r USING (site_id, ts)) WHERE (a IS NULL) <> (b IS NULL) OR abs(a - b) > 1e-6 + 1e-6 * abs(b)")
def table_comparison(spark: S, sf: D) -> DataFrame:
    pick = lambda df: df.select("site_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "avg", "labor")
    return compare.compare(pick(meter(spark, sf)), pick(repaired(spark, sf)), ["site_id", "ts"], {"avg": "numeric", "labor": "exact"})


@register(r"SELECT doc_id, kind, n FROM (SELECT doc_id, 'email' AS kind, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n FROM documents UNION ALL SELECT doc_id, 'ipv4', len(regexp_extract_all(text, '\b([0-9]{1,3}\.){3}[0-9]{1,3}\b')) FROM documents UNION ALL SELECT doc_id, 'phone', len(regexp_extract_all(text, '\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) FROM documents UNION ALL SELECT doc_id, 'key_value', len(regexp_extract_all(text, '(token|password|secret) ?[:=]')) FROM documents UNION ALL SELECT doc_id, 'home_path', len(regexp_extract_all(text, '(/home/|/Users/|C:\\Users\\)')) FROM documents) WHERE n > 0")
def privacy_scan(spark: S, sf: D) -> DataFrame:
    return compare.scan_private(table(spark, sf, "documents"), "doc_id", "text")


@register("SELECT site_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, R(round_even(y_avg, 4)) AS y_avg_true, R(round_even(y_avg_lag168, 4)) AS y_avg_pred, R(round_even(y_peak, 4)) AS y_peak_true, R(round_even(y_peak_lag168, 4)) AS y_peak_pred, R(round_even(least(1.0::DOUBLE, y_peak_lag168 / (2 * theta)), 6)) AS peak_prob, I(y_peak_lag168 >= theta) AS peak_pred_label, I(y_cls) AS peak_true_label, 'lag168' AS model_name FROM @feat, @th WHERE day >= DATE '2024-01-24'")
def prediction_file(spark: S, sf: D) -> DataFrame:
    """The nine columns of the file and the site, for every hour of the test period, whatever its masks."""
    th = theta_of(repaired(spark, sf))
    rows = featured(spark, sf).filter("day >= date '2024-01-24'")
    four = lambda c, n: F.bround(c, 4).alias(n)
    prob = F.when(F.col("y_peak_lag168").isNotNull(), F.least(F.lit(1.0), F.col("y_peak_lag168") / (2 * th)))
    return rows.select("site_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), four("y_avg", "y_avg_true"), four("y_avg_lag168", "y_avg_pred"), four("y_peak", "y_peak_true"), four("y_peak_lag168", "y_peak_pred"), F.bround(prob, 6).alias("peak_prob"), (F.col("y_peak_lag168") >= th).cast("int").alias("peak_pred_label"), F.col("y_cls").alias("peak_true_label"), F.lit("lag168").alias("model_name"))


# --- serving, resampling, models ----------------------------------------------------------------------------------------------


@register("SELECT site_id, ts, " + ", ".join(f"R({c}) AS {c}" for c in ("y_avg_lag24", "y_peak_lag168", "roll24_avg_mean", "roll168_avg_max", "prod_cum_day", "shutdown_nth", "headcount")) + " FROM @feat WHERE day >= DATE '2024-01-24'")
def replayed_features(spark: S, sf: D) -> DataFrame:
    """Every test day served from 28 days of history: the same features as in training, though no later row was there."""
    days = meter(spark, sf).filter("day >= date '2024-01-24'").select("day").distinct()
    out = _replayed(spark, sf, days, 28)
    return out.select("site_id", "ts", "y_avg_lag24", "y_peak_lag168", "roll24_avg_mean", "roll168_avg_max", "prod_cum_day", F.col("shutdown_nth").cast("double").alias("shutdown_nth"), "headcount")


@register()
def paired_bootstrap(spark: S, sf: D) -> DataFrame:
    from loadlens.functions import resample

    rows = joins.paired(predictions(spark, sf).select("site_id", "ts", "model", F.col("y_avg").alias("y"), F.col("pred_avg").alias("pred")), "lag168", "mean", ["site_id", "ts"]).withColumn("day", F.to_date("ts"))
    n = rows.select("day").distinct().count()
    return resample.paired_mae(rows, resample.day_draws(spark, n, 2000, 42))


@register()
def rate_intervals(spark: S, sf: D) -> DataFrame:
    from loadlens.functions import resample

    rows = predictions(spark, sf).filter("model = 'lag24'")
    n = rows.select("day").distinct().count()
    return resample.cluster_rates(rows, F.hour("ts").between(9, 17), resample.day_draws(spark, n, 2000, 42), err=F.abs(F.col("y_avg") - F.col("pred_avg")))


@register()
def binomial_limits(spark: S, sf: D) -> DataFrame:
    g = evaluate.peak_table(predictions(spark, sf)).withColumn("pos", F.col("tp") + F.col("fn"))
    return stats.with_binomial_limits(g.select("model", "tp", "pos"), "tp", "pos")


@register()
def forest_cv(spark: S, sf: D) -> DataFrame:
    """Out-of-fold errors of naive, forest and regime models over all folds, both targets and all features."""
    from loadlens.plans import models

    feat = materialize(featured(spark, sf).filter("day < date '2024-01-24'"), "features")  # each fit reads them again
    fits = {"naive": models.seasonal_naive, "forest": models.forest(10, 6), "regime": models.regimes(models.forest(5, 5), (60.0, 90.0))}
    oof = models.cross_validate(feat, folds(spark), fits, list(features.FEATURES))
    mae = lambda y, p: F.avg(F.abs(F.col(y) - F.col(p)))
    return oof.groupBy("model", "fold").agg(F.count("*").alias("n"), mae("y_avg", "pred_avg").alias("mae"), mae("y_peak", "pred_peak").alias("peak_mae"))


@register()
def peak_rules(spark: S, sf: D) -> DataFrame:
    from loadlens.plans import models

    return models.peak_rules(featured(spark, sf).filter("not is_warmup and not is_outage"), ["y_peak_lag24", "roll24_peak_max", "hour", "prod", "temp"])


# --- thresholds, audits and scenarios over folds --------------------------------------------------------------------------------


@register("WITH q AS (SELECT model, fold, [0.5 + 0.499 * i / 119 FOR i IN range(120)] AS qs, quantile_cont(pred_peak, [" + ", ".join(repr(0.5 + (0.999 - 0.5) * i / 119) for i in range(120)) + "]) AS v, sum(y_cls) AS p FROM @pred GROUP BY model, fold), c AS (SELECT DISTINCT model, fold, p, round_even(x, 2) AS tau FROM (SELECT model, fold, p, unnest(v) AS x FROM q)), f AS (SELECT c.model, c.fold, tau, p, coalesce(2.0::DOUBLE * sum(CASE WHEN round(pred_peak, 9) >= tau THEN y_cls ELSE 0 END) / nullif(sum((round(pred_peak, 9) >= tau)::INT) + p, 0), 0) AS f1 FROM c JOIN pred d ON c.model = d.model AND c.fold = d.fold GROUP BY 1, 2, 3, 4), b AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY round(f1, 12) DESC, tau) AS r FROM f) SELECT model, R(median(CASE WHEN p > 0 THEN tau ELSE 0 END)) AS tau, count(*) AS n_folds FROM b WHERE r = 1 GROUP BY 1")
def median_fold_threshold(spark: S, sf: D) -> DataFrame:
    """The threshold for the test: the median of those tuned on the folds."""
    tuned = metrics.tune_threshold(materialize(predictions(spark, sf).select("model", "fold", "y_cls", "pred_peak"), "scores"), "y_cls", "pred_peak", ["model", "fold"], 0.0)
    return tuned.groupBy("model").agg(F.percentile("tau", F.lit(0.5)).alias("tau"), F.count("*").alias("n_folds"))


@register("SELECT I(fold) AS fold, role, count(*) AS n, I(sum((NOT is_warmup AND NOT is_outage AND NOT is_erp_missing)::INT)) AS n_usable, I(sum(is_warmup::INT)) AS n_warmup, I(sum(is_outage::INT)) AS n_outage, I(sum(is_erp_missing::INT)) AS n_erp_missing, I(sum(coalesce(y_cls, 0))) AS n_pos FROM (SELECT f.*, fold, CASE WHEN day <= train_end THEN 'train' ELSE 'val' END AS role FROM @feat f JOIN @folds ON day <= train_end OR day BETWEEN val_start AND val_end) GROUP BY 1, 2")
def split_audit(spark: S, sf: D) -> DataFrame:
    return splits.split_audit(splits.fold_rows(featured(spark, sf), folds(spark)), ["fold", "role"]).drop("digest")


_INNER = splits.inner_partitions("2024-01-01", "2024-01-24", 4, 3, 3, 1, 7)


@register("SELECT I(part) AS part, role, count(*) AS n, I(sum(coalesce(y_cls, 0))) AS n_pos FROM (" + " UNION ALL ".join(f"SELECT {k} AS part, CASE WHEN ts < TIMESTAMP '{b['core_end']}' THEN 'core' WHEN ts >= TIMESTAMP '{b['cal_start']}' AND ts < TIMESTAMP '{b['cal_end']}' THEN 'calibration' WHEN ts >= TIMESTAMP '{b['eval_start']}' AND ts < TIMESTAMP '{b['eval_end']}' THEN 'evaluation' END AS role, y_cls FROM {'@' if k == 0 else ''}feat" for k, b in enumerate(_INNER)) + ") WHERE role IS NOT NULL GROUP BY 1, 2")
def inner_partitions(spark: S, sf: D) -> DataFrame:
    """Rows of each inner window before the test period: core, calibration tail and evaluation."""
    parts = F.array(*(F.struct(F.lit(k).alias("part"), splits.role_of_day(**b).alias("role")) for k, b in enumerate(_INNER)))
    rows = featured(spark, sf).select("y_cls", F.explode(parts).alias("p")).filter("p.role is not null")
    return rows.groupBy("p.part", "p.role").agg(F.count("*").alias("n"), F.sum(F.coalesce("y_cls", F.lit(0))).alias("n_pos"))


@register("WITH d AS (SELECT site_id, day, string_agg(concat_ws(',', y_avg, y_peak), ';' ORDER BY ts) AS h FROM @rep GROUP BY 1, 2 HAVING count(y_avg) = 24 AND count(y_peak) = 24), c AS (SELECT * FROM d WHERE day < DATE '2024-01-10'), n AS (SELECT site_id, count(*) AS k, count(DISTINCT h) AS u FROM c GROUP BY 1) SELECT d.site_id, d.day, EXISTS (SELECT 1 FROM c WHERE c.site_id = d.site_id AND c.h = d.h) AS seen_in_core, coalesce(k, 0) AS core_days, coalesce(u, 0) AS core_profiles, coalesce(k - u, 0) AS core_repeats FROM d LEFT JOIN n USING (site_id) WHERE d.day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24'")
def profile_novelty(spark: S, sf: D) -> DataFrame:
    return splits.profile_novelty(repaired(spark, sf), splits.partition_bounds("2024-01-18", 1, 7, 7))


@register("WITH c AS (SELECT model, fold, count(*) AS n, I(sum((y_cls = 1)::INT)) AS n_pos, I(sum((y_cls <> 1)::INT)) AS n_neg, sum((y_cls = 1 AND pred_cls = 1)::INT) AS tp, sum((y_cls <> 1 AND pred_cls = 1)::INT) AS fp, sum((y_cls = 1 AND pred_cls <> 1)::INT) AS fn, sum((y_cls <> 1 AND pred_cls <> 1)::INT) AS tn, avg(abs(y_avg - pred_avg)) AS mae FROM @pred GROUP BY 1, 2) SELECT model, I(fold) AS fold, n, n_pos, n_neg, tp + fn = n_pos AND fp + tn = n_neg AND n_pos + n_neg = n AS counts_add_up, R(mae) AS mae FROM c")
def quality_arithmetic(spark: S, sf: D) -> DataFrame:
    """Whether the counts of each result add up, and its error worked out again from the rows."""
    return evaluate.check_arithmetic(predictions(spark, sf), ["model", "fold"])


def _lever_sql(name: str, source: str, lever: str, alpha: float) -> str:
    """The relation `name` (site_id, ts, day, hour, prod, y) after a lever on `source`; and name_m, the moves of its production."""
    if lever in policy.SPREADS:
        hours = ", ".join(map(str, policy.SPREADS[lever]))
        return f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN y IS NOT NULL THEN greatest(CASE WHEN hour IN ({hours}) THEN y * (1 - {alpha!r}::DOUBLE * 2 / 3) ELSE y END, 0) END AS y) FROM {source})"
    first = f"{name}_f AS (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY y DESC, ts) AS r FROM {source} WHERE y IS NOT NULL)"
    if lever == "L3":
        return (
            f"{name}_c AS (SELECT site_id, quantile_cont(prod, 0.9) AS c FROM {source} WHERE prod > 0 GROUP BY 1), {name}_d AS (SELECT x.*, c, theta, max(y) OVER (PARTITION BY x.site_id, day) >= theta AS hot FROM {source} x LEFT JOIN {name}_c USING (site_id), th), "
            f"{name}_w AS (SELECT site_id, day, hour, CASE WHEN hot AND y >= theta AND prod > c THEN c ELSE prod END AS made, CASE WHEN hot AND y >= theta AND prod > c THEN prod - c ELSE 0 END AS carry FROM {name}_d WHERE hour = 0 UNION ALL SELECT d.site_id, d.day, d.hour, CASE WHEN d.hot AND d.y >= theta AND d.prod + w.carry > c THEN c ELSE d.prod + w.carry END, CASE WHEN d.hot AND d.y >= theta AND d.prod + w.carry > c THEN d.prod + w.carry - c ELSE 0 END FROM {name}_w w JOIN {name}_d d ON d.site_id = w.site_id AND d.day = w.day AND d.hour = w.hour + 1), "
            f"{name} AS MATERIALIZED (SELECT x.* REPLACE (made + CASE WHEN x.hour = 23 THEN carry ELSE 0 END AS prod, CASE WHEN y IS NOT NULL THEN greatest(y + 1.5::DOUBLE * (made + CASE WHEN x.hour = 23 THEN carry ELSE 0 END - prod), 0) END AS y) FROM {source} x JOIN {name}_w USING (site_id, day, hour))"
        )
    if lever == "L2":
        who = f"{name}_t AS (SELECT DISTINCT site_id, day FROM (SELECT site_id, day, row_number() OVER (PARTITION BY site_id ORDER BY y DESC, ts) AS k FROM {name}_f) WHERE k <= 20), {name}_s AS (SELECT f.* FROM {name}_f f, th WHERE r = 1 AND prod > 0 AND (y >= theta OR EXISTS (SELECT 1 FROM {name}_t t WHERE t.site_id = f.site_id AND t.day = f.day)))"
        share, on = 0.2, "x.hour IN (10, 11, 15, 16) AND x.ts <> s.ts"
    else:
        who, share, on = f"{name}_s AS (SELECT f.* FROM {name}_f f, th WHERE r = 1 AND prod > 0 AND y >= theta)", 0.15, "x.hour IN (21, 22, 23, 0, 1, 2)"
    return (
        f"{first}, {who}, {name}_m AS MATERIALIZED (SELECT s.site_id, s.ts AS src, x.ts AS dst, s.prod * {share}::DOUBLE / count(*) OVER (PARTITION BY s.site_id, s.ts) AS units FROM {name}_s s JOIN {source} x ON x.site_id = s.site_id AND x.day = s.day AND {on}), "
        f"{name}_d AS (SELECT site_id, ts, sum(d) AS d FROM (SELECT site_id, src AS ts, -units AS d FROM {name}_m UNION ALL SELECT site_id, dst, units FROM {name}_m) GROUP BY 1, 2), "
        f"{name} AS MATERIALIZED (SELECT x.* REPLACE (prod + coalesce(d, 0) AS prod, CASE WHEN y IS NOT NULL THEN greatest(y + 1.5::DOUBLE * coalesce(d, 0), 0) END AS y) FROM {source} x LEFT JOIN {name}_d USING (site_id, ts))"
    )


def _chains_sql(chains: dict[str, tuple[tuple[str, ...], float]]) -> str:
    """WITH ... and the relation `e`: name, site_id, delta, months, labor, kept of each chain of levers."""
    parts = ["base AS MATERIALIZED (SELECT site_id, ts, day, hour, prod, y_peak AS y FROM @rep)", "mo AS (SELECT site_id, sum(1.0::DOUBLE / day(last_day(day))) AS months FROM (SELECT DISTINCT site_id, day FROM rep) GROUP BY 1)", "th0 AS (SELECT * FROM @th)"]
    made, ends = {}, []
    for name, (chain, alpha) in chains.items():
        at = "base"
        for i in range(len(chain)):
            key = (chain[: i + 1], alpha)
            if key not in made:
                made[key] = f"v{len(made)}"
                parts.append(_lever_sql(made[key], at, chain[i], alpha))
            at = made[key]
        labor = f"(SELECT sum(units) * 12.5 FROM {at}_m m WHERE m.site_id = z.site_id)" if chain[-1:] == ("L4",) else "0"
        ends.append(f"SELECT '{name}' AS name, z.site_id, max(b.y) - max(z.y) AS delta, coalesce({labor}, 0)::DOUBLE AS labor, (SELECT bool_and(d <= 1e-6) FROM (SELECT abs(sum(p.prod - q.prod)) AS d FROM {at} p JOIN base q USING (site_id, ts) WHERE p.site_id = z.site_id GROUP BY p.day)) AS kept FROM {at} z JOIN base b USING (site_id, ts) GROUP BY z.site_id")
    return "WITH RECURSIVE " + ", ".join(parts) + ", e AS (SELECT * FROM (" + " UNION ALL ".join(ends) + ") JOIN mo USING (site_id))"


@register(_chains_sql({k: (c, 0.2) for k, c in policy.SCENARIOS.items()}) + " SELECT name AS scenario, site_id, R(delta) AS delta_peak, R(delta * 8320 * months) AS saving, R(labor) AS extra_labor, R(delta * 8320 * months - labor) AS net, kept AS day_conserved FROM e")
def scenario_table(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.scenario_table(df, theta_of(df), 1.5)


@register(_chains_sql({f"{k}|{a}": (c, a) for a in (0.1, 0.2, 0.3) for k, c in policy.COMBINATIONS.items()}) + ", c AS (SELECT site_id, split_part(name, '|', 2)::DOUBLE AS alpha, f AS rate_factor, split_part(name, '|', 1) AS combination, delta * 8320 * months * f - labor AS net FROM e, (VALUES (0.7::DOUBLE), (1.0::DOUBLE), (1.3::DOUBLE)) x(f)), k AS (SELECT *, row_number() OVER (PARTITION BY site_id, alpha, rate_factor ORDER BY round(net, 6) DESC, len(combination)) = 1 AS best FROM c) SELECT site_id, R(alpha) AS alpha, R(rate_factor) AS rate_factor, combination, R(net) AS net, best, (SELECT count(DISTINCT combination) = 1 FROM k o WHERE o.site_id = k.site_id AND o.best) AS stable FROM k")
def lever_sensitivity(spark: S, sf: D) -> DataFrame:
    df = repaired(spark, sf)
    return policy.sensitivity(df, theta_of(df), 1.5)


@register()
def conditional_intervals(spark: S, sf: D) -> DataFrame:
    """Mean error where a condition holds and where it doesn't, with limits from draws of days; seeded, so without SQL."""
    from loadlens.functions import resample

    rows = materialize(predictions(spark, sf).filter("model = 'lag24'").select("day", "is_shutdown", "is_daytime", "hour", F.abs(F.col("y_avg") - F.col("pred_avg")).alias("e")), "errors")
    out = None
    for name, c in {"operating": F.col("is_shutdown") == 0, "startup": F.col("hour").isin(8, 13), "daytime": F.col("is_daytime") == 1}.items():
        for side in (True, False):
            part = resample.mean_limits(rows, F.col("e"), c if side else ~c, lambda n: resample.day_draws(spark, n, 2000, 42)).select(F.lit(name).alias("name"), F.lit(side).alias("inside"), "n", "mean", "low", "high")
            out = part if out is None else out.unionByName(part)
    return out


@register()
def seed_sensitivity(spark: S, sf: D) -> DataFrame:
    """How far the limits of a paired difference move with the seed: 20 seeds as a key of one job."""
    from loadlens.functions import resample

    long = predictions(spark, sf).select("site_id", "ts", "model", F.col("y_avg").alias("y"), F.col("pred_avg").alias("pred"))
    rows = joins.paired(materialize(long, "pairs"), "lag168", "mean", ["site_id", "ts"]).withColumn("day", F.to_date("ts"))
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()]  # a row a day
    return resample.seed_sensitivity(rows, resample.seed_draws(spark, days, 1, 500, range(1, 21)))
