"""Column contracts of the tables that enter and leave the library, and a check that lists violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw hourly rows. Times have no zone; measurements are doubles; NaN never enters, see clean().
RAW = "site_id long, row_seq long, date int, hour int, p15 double, p30 double, p45 double, p60 double, avg double, prod double, headcount double, labor double, temp double, wind double, humid double, rain double, tariff double, dow_code int, dom int, month_code int"
POWER = ("p15", "p30", "p45", "p60")
HISTORY = ("date", "hour", *POWER, "avg", "prod", "headcount", "labor", "temp", "wind", "humid", "rain")
PLAN = ("date", "hour", "prod", "headcount", "temp", "wind", "humid", "rain")
NULLABLE = ("wind", "rain", "headcount")
#: A plan that has any of these tells the power it is to forecast.
FORBIDDEN_IN_PLAN = (*POWER, "avg", "y_avg", "y_peak")
#: Columns of the raw table that repeat its date.
REPEATED = ("dow_code", "dom", "month_code")


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null: null is the only missing value."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | F.abs(F.col(c)).isin(float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in doubles}) if doubles else df


def missing(df: DataFrame, need: tuple[str, ...]) -> list[str]:
    return [c for c in need if c not in df.columns]


def numeric(c: str) -> Column:
    """The value as a double; null if it isn't one."""
    return F.expr(f"try_cast(cast(`{c}` as string) as double)")


def real_date(c: str) -> Column:
    """A date of a whole number YYYYMMDD; null if there is no such day."""
    return F.to_date(F.expr(f"try_to_timestamp(lpad(try_cast(`{c}` as bigint), 8, '0'), 'yyyyMMdd')"))


def violations(df: DataFrame, need: tuple[str, ...], key: tuple[str, ...], nullable: tuple[str, ...] = NULLABLE, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """code, key, message: one row for each breach of a contract; none if the table may be used.

    Missing and forbidden columns come first; for the columns there, values that aren't finite numbers, nulls where none
    may be, hours that aren't whole, days that don't exist, and keys that repeat.
    """
    spark = df.sparkSession
    fixed = [("missing_column", "", c) for c in missing(df, need)] + [("forbidden_column", "", c) for c in forbidden if c in df.columns]
    out = spark.createDataFrame(fixed, "code string, key string, message string")
    there = [c for c in need if c in df.columns]
    if missing(df, key):
        return out
    named = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    checks = []
    for c in there:
        raw, x = F.col(c), numeric(c)
        wrong = raw.isNotNull() & (x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
        checks.append(F.when(wrong, F.struct(F.lit("not_a_number").alias("code"), F.lit(c).alias("message"))))
        if c not in nullable:
            checks.append(F.when(raw.isNull(), F.struct(F.lit("null").alias("code"), F.lit(c).alias("message"))))
        if c == "hour":
            checks.append(F.when(x.isNotNull() & ((x != F.floor(x)) | ~x.between(0, 23)), F.struct(F.lit("hour").alias("code"), F.lit(c).alias("message"))))
        if c == "date":
            checks.append(F.when(x.isNotNull() & ((x != F.floor(x)) | real_date(c).isNull()), F.struct(F.lit("no_such_day").alias("code"), F.lit(c).alias("message"))))
    found = df.select(named.alias("key"), F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("v")).select("v.code", "key", "v.message")
    again = df.groupBy(named.alias("key")).count().filter("count > 1").select(F.lit("duplicate_key").alias("code"), "key", F.col("count").cast("string").alias("message"))
    return out.unionByName(found).unionByName(again)


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
