"""Window building blocks over one series for each site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(order: str = "ts", *keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("site_id",))).orderBy(order)


def ffill(c: Column | str, w: WindowSpec) -> Column:
    """The last value so far; nulls before the first stay, so that nothing comes from the future."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rolling(f, c: Column | str, n: int, w: WindowSpec) -> Column:
    """f over the last n rows, null until there are n values."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) == n, f(c).over(frame))


def lags(df: DataFrame, columns: tuple[str, ...], steps: tuple[int, ...], w: WindowSpec) -> DataFrame:
    """Adds c_lagN; rows are hours only on a grid without gaps."""
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in steps})


def lag_matrix(df: DataFrame, c: str, n: int, w: WindowSpec) -> DataFrame:
    """Adds `c_lags`: the last n values before a row, latest first, null until there are n."""
    past = F.collect_list(c).over(w.rowsBetween(-n, -1))
    return df.withColumn(f"{c}_lags", F.when(F.size(past) == n, F.reverse(past)))


def with_run(df: DataFrame, flag: str, name: str, order: str, *keys: str) -> DataFrame:
    """Adds the place of a row in its run of true flags, from 1, and 0 where the flag is false; a run may open the series."""
    w = series(order, *keys)
    df = df.withColumn("__g", F.sum((~F.col(flag)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "__g").orderBy(order)
    place = F.sum(F.col(flag).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col(flag), place).otherwise(0).cast("int")).drop("__g")


def runs(df: DataFrame, flag: str, order: str, *keys: str, least: int = 1) -> DataFrame:
    """keys, start, end, n of the runs of true flags of `least` rows or more."""
    w = series(order, *keys)
    marked = df.withColumn("__g", F.sum((~F.col(flag)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(flag))
    found = marked.groupBy(*keys, "__g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    return found.filter(F.col("n") >= least).drop("__g")


def blocks(df: DataFrame, time: str, *keys: str, step: str = "interval 1 hour", least: int = 1) -> DataFrame:
    """keys, start, end, n of the stretches in which each row follows the one before by `step`."""
    w = series(time, *keys)
    new = F.coalesce(F.col(time) != F.lag(time).over(w) + F.expr(step), F.lit(True))
    marked = df.withColumn("__n", new.cast("int")).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__g").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("__g")


def earlier_only(df: DataFrame, value: str, order: str, *keys: str) -> Column:
    """The median of the values before each row."""
    return F.percentile(value, F.lit(0.5)).over(series(order, *keys).rowsBetween(Window.unboundedPreceding, -1))


#: Ranges of values that a key's rows are split into for running sums.
RANGES = 64


def running_sums(df: DataFrame, value: str, sums: dict[str, str], *keys: str, down: bool = False) -> DataFrame:
    """df, which has a row for each key and value, with sums of columns (by new name) over the rows up to each one in the order of the value, itself included.

    A key's rows are split into ranges of about one size, and a range's sum is what the next ones start from; so no task orders all
    rows of a key, and the result is exact wherever the ranges end. down: the greatest value first. Nulls come first going up, last going down.
    """
    at = [F.lit(i / RANGES) for i in range(1, RANGES)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*at), F.lit(1000)).alias("__e"))
    rows = df.join(edges.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__e"), same_keys(keys)) if keys else df.crossJoin(F.broadcast(edges))
    above = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("__e", lambda e: e < F.col(value))))
    rows = rows.withColumn("__range", -above if down else above).drop("__e", *(f"__k_{k}" for k in keys))
    whole = rows.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()))
    # A window of RANGES rows a key at most.
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__of"), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums))
    met = rows.join(starts, same_keys(keys) & (F.col("__range") == F.col("__of")))
    own = Window.partitionBy(*keys, "__range").orderBy(F.desc_nulls_last(value) if down else F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0)
    return met.select(*df.columns, *((F.sum(c).over(own) + F.col(f"__s_{n}")).alias(n) for n, c in sums.items()))


def same_keys(keys: tuple[str, ...] | list[str]) -> Column:
    """Equality of key columns with those of the same names behind `__k_`; nulls are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return on


def with_average_rank(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Adds ranks from 1 within keys, ties sharing their mean; nulls come first and tie.

    Rows are counted by value before anything is ordered, and distinct values are ordered by ranges.
    """
    at = running_sums(df.groupBy(*keys, value).agg(F.count("*").alias("__c")), value, {"__upto": "__c"}, *keys)
    rank = F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2
    at = at.select(*(F.col(k).alias(f"__r_{k}") for k in (*keys, value)), rank.alias(name))
    on = F.lit(True)
    for k in (*keys, value):
        on = on & df[k].eqNullSafe(at[f"__r_{k}"])
    return df.join(at, on).select(*df.columns, name)


def quantile_bins(value: str, bins: int, tie: str, *keys: str) -> Column:
    """0 to bins - 1 by quantiles of the row number: right-closed edges at equal parts of 1..n, as quantile cuts of a first-come rank give."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((r - 1) * bins / (n - 1)))).otherwise(1).cast("int") - 1
