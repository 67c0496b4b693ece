"""Statistics: profiles of columns, correlation, within-group slopes, exact binomial limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What two doubles near 1 differ by.
EPS = 2.0**-52


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, lo, hi, n_distinct, n_null in one pass."""
    one = df.agg(*(f(c).alias(f"{n}__{c}") for c in columns for n, f in (("lo", lambda c: F.min(F.col(c).cast("double"))), ("hi", lambda c: F.max(F.col(c).cast("double"))), ("nd", F.count_distinct), ("nn", lambda c: F.sum(F.col(c).isNull().cast("long"))))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"lo__{c}").alias("lo"), F.col(f"hi__{c}").alias("hi"), F.col(f"nd__{c}").alias("n_distinct"), F.col(f"nn__{c}").alias("n_null")) for c in columns))).alias("x")).select("x.*")


def quality_report(df: DataFrame, keys: list[str], readings: list[str]) -> DataFrame:
    """item, n: nulls, surplus keys, surplus whole rows, hours out of range, means that readings don't give, zero power, rows, days.

    Surplus rows come from grouped counts, which combine before the shuffle.
    """
    mean = sum((F.col(c) for c in readings), F.lit(0.0)) / len(readings)
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    plain = df.agg(F.count("*").alias("rows"), F.sum(nulls).alias("null_cells"), F.sum((~F.col("hour").between(0, 23)).cast("long")).alias("bad_hour"), F.sum((F.floor(mean + 0.5) != F.col("avg")).cast("long")).alias("avg_mismatch"), F.sum((F.col("avg") == 0).cast("long")).alias("zero_power"))
    surplus = lambda by, name: df.groupBy(*by).count().agg(F.sum(F.col("count") - 1).alias(name))
    one = plain.crossJoin(surplus(keys, "surplus_keys")).crossJoin(surplus(df.columns, "surplus_rows")).crossJoin(df.groupBy("site_id", "day").count().agg(F.count("*").alias("days")))
    return one.unpivot([], one.columns, "item", "n")


def boundary_jump(df: DataFrame, value: str, order: str) -> DataFrame:
    """site_id, median_jump, p90_jump of |first of a day - last of the day before| in physical order, and the days of its least and greatest value.

    Of equal jumps the earliest day counts.
    """
    ends = df.groupBy("site_id", "day").agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    jump = F.abs(F.col("first") - F.lag("last").over(Window.partitionBy("site_id").orderBy("day")))
    known = ends.withColumn("jump", F.round(jump, 9)).filter("jump is not null")
    at = F.struct("jump", "day")
    most = F.struct("jump", (-F.unix_date("day")).alias("d"))
    return known.groupBy("site_id").agg(F.percentile("jump", F.lit(0.5)).alias("median_jump"), F.percentile("jump", F.lit(0.9)).alias("p90_jump"), F.min(at)["day"].alias("least_day"), F.date_from_unix_date(-F.max(most)["d"]).alias("greatest_day"))


def time_order(df: DataFrame, time: str, order: str, keys: list[str]) -> DataFrame:
    """keys, n, n_null, n_repeated, n_falling, strict: whether a time column is there, unique and rising in the order of another column, for each key.

    n_repeated counts values beyond the first of each; n_falling rows whose value isn't over that of the row before. Keys without rows
    give none, so an empty table isn't strict by being absent.
    """
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.select(*keys, time, (F.col(time) <= before).alias("falls"))
    g = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(time).isNull()).alias("n_null"), (F.count(time) - F.count_distinct(time)).alias("n_repeated"), F.count_if(F.coalesce("falls", F.lit(False))).alias("n_falling"))
    return g.withColumn("strict", (F.col("n_null") == 0) & (F.col("n_repeated") == 0) & (F.col("n_falling") == 0))


def slug(c: Column, most: int = 40) -> Column:
    """A text as a name: runs of anything but letters and digits become one underscore, none at either end, at most so many characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^0-9a-zA-Z]+", "_"), r"^_+|_+$", ""), 1, most)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method, folded over its steps."""
    tiny = 1e-300
    kept = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1 / kept(1 - (a + b) * x / (a + 1))
    state = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, k: Column) -> Column:
        def once(s: Column, v: Column) -> Column:
            d, c = 1 / kept(1 + v * s["d"]), kept(1 + v / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return once(once(s, even), odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)["h"]


def log_gamma(x: Column) -> Column:
    """By Stirling's series after eight steps of the recurrence; for x > 0 to about 1e-13."""
    # The series' coefficients.
    series = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
    z = x + 8
    tail = sum(c / F.pow(z, F.lit(2 * i + 1)) for i, c in enumerate(series))
    stirling = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + tail
    return stirling - sum(F.log(x + k) for k in range(8))


def correlation_p(r: Column, n: Column, steps: int = 60) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom; null under three pairs, 0 at |r| = 1, NaN without a correlation."""
    free = (n - 2).cast("double")
    # The tail of t is the regularised incomplete beta function of df / (df + t * t), which is 1 - r * r.
    x, a, b = 1 - r * r, free / 2, F.lit(0.5)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct, mirrored = front * _beta_fraction(a, b, x, steps) / a, 1 - front * _beta_fraction(b, a, 1 - x, steps) / b
    inside = F.when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)
    return F.when(n < 3, None).when(F.isnan(r), r).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def theta(df: DataFrame, q: float = 0.95, before: str | None = None) -> DataFrame:
    """The exact quantile of y_peak before a day; rows of missing records count."""
    rows = df if before is None else df.filter(F.col("day") < F.lit(before).cast("date"))
    return rows.agg(F.percentile("y_peak", F.lit(q)).alias("theta"))


def correlation(a: str, b: str) -> Column:
    """An aggregate: the correlation of the rows that have both; NaN where either doesn't vary, as in SQL, and null without such rows.

    Spark's own corr() divides by zero there, which is an error unless ANSI mode is off.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) > 0, F.coalesce(r, F.lit(float("nan"))))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs, in one aggregate; r as correlation() gives it."""
    one = df.agg(*(correlation(a, b).alias(f"{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{columns[min(i, j)]}__{columns[max(i, j)]}").alias("r")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho of a table of models or days, by average ranks."""
    from loadlens.operators.windows import with_average_rank

    return with_average_rank(with_average_rank(df.select(a, b), a, "__ra"), b, "__rb").agg(correlation("__ra", "__rb").alias("rho"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin (from 0), n: left-closed bins, the last one closed; values outside aren't counted."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (F.col(value) >= edges[i]) & ((F.col(value) <= edges[i + 1]) if i == len(edges) - 2 else (F.col(value) < edges[i + 1]))
        b = F.when(inside, i).otherwise(b)
    return df.withColumn("bin", b).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def within_slope(df: DataFrame, x: str, y: str, group: str, keys: list[str]) -> DataFrame:
    """keys, n, beta, r2, identified of y on x with an intercept for each group: the slope of deviations from group means.

    Where x doesn't vary within groups (beyond what doubles tell apart) the slope is 0 and not identified, and r2 is that of
    the group means alone; r2 is null where y doesn't vary. Sums by key and group are enough for it, so one aggregation
    feeds another and no row is joined to its mean.
    """
    s = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y)), "syy": F.sum(F.col(y) * F.col(y))}
    g = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, group).agg(*(v.alias(k) for k, v in s.items()))
    cut = lambda a, b, ab: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), cut("sx", "sx", "sxx").alias("wxx"), cut("sx", "sy", "sxy").alias("wxy"), cut("sy", "sy", "syy").alias("wyy"), (F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("n")).alias("tyy"), F.sum("sxx").alias("axx"), F.sum("syy").alias("ayy"))
    varies = lambda part, whole: F.col(part) > EPS * F.greatest(F.lit(1.0), F.col(whole))
    t = t.withColumn("identified", varies("wxx", "axx")).withColumn("beta", F.when(F.col("identified"), F.col("wxy") / F.col("wxx")).otherwise(0.0))
    left = F.col("wyy") - 2 * F.col("beta") * F.col("wxy") + F.col("beta") * F.col("beta") * F.col("wxx")
    return t.select(*keys, "n", "beta", F.when(varies("tyy", "ayy"), 1 - left / F.col("tyy")).alias("r2"), "identified")


def _beta_below(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction: some dozens of steps, whatever a and b are."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_below(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(100_000):
        m = i // 2
        step = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + step * d or 1e-300), 1 + step / c or 1e-300
        out *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (out - 1)


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    return 1.0 if k <= 0 else _beta_below(p, k, n - k + 1)


def binomial_limits(k: int, n: int, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Exact two-sided limits of a rate by bisection on the binomial tail; (None, None) for no trials."""
    if n <= 0:
        return None, None

    def solve(f, target: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: _tail(k, n, p) if 0 < p < 1 else float(p >= 1), alpha / 2)
    high = 1.0 if k == n else solve(lambda p: _tail(k + 1, n, p) if 0 < p < 1 else float(p >= 1), 1 - alpha / 2)
    return low, high


def with_binomial_limits(df: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Adds ci_low and ci_high to rows of counts."""

    @F.pandas_udf("ci_low double, ci_high double")
    def limits(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([binomial_limits(int(a), int(b), alpha) for a, b in zip(ks, ns, strict=True)], columns=["ci_low", "ci_high"], dtype=float)

    return df.withColumn("__ci", limits(F.col(k), F.col(n))).select(*df.columns, "__ci.ci_low", "__ci.ci_high")


def half_up(x: Column) -> Column:
    """floor(x + 0.5): not round(), which differs for negatives."""
    return F.floor(x + 0.5)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through knots, level beyond the ends; at a knot given twice, the first value.

    The knots are two literal arrays in which the last one below x is looked up, so thousands of them make no deeper expression.
    """
    xs, ys = (F.lit(np.array(v, float)) for v in zip(*knots, strict=True))
    below = F.size(F.filter(xs, lambda e: e < x))
    x0, y0, x1, y1 = F.get(xs, below - 1), F.get(ys, below - 1), F.get(xs, below), F.get(ys, below)
    inside = y0 + (x - x0) * ((y1 - y0) / (x1 - x0))
    return F.when(x.isNull(), None).when(below == 0, knots[0][1]).when(below == len(knots), knots[-1][1]).otherwise(inside)
