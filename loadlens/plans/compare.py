"""Comparing two tables key by key, and check tables for gates and protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATOL = RTOL = 1e-6


def compare(reference: DataFrame, current: DataFrame, keys: list[str], roles: dict[str, str], atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """keys, column, reason of every difference; empty if the tables agree.

    roles: exact, numeric (within tolerance) or provenance (not compared) for every column but the keys; a column without a role is an
    error. Keys that repeat, or that one side lacks, are differences too, and so is a null against a value.
    """
    rest = [c for c in reference.columns if c not in keys]
    if set(reference.columns) != set(current.columns):
        raise ValueError("the tables' columns differ")
    if none := [c for c in rest if c not in roles]:
        raise ValueError(f"columns without a role: {none}")
    name = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    again = reference.unionByName(current.limit(0)).groupBy(*keys).count().filter("count > 1").select(name.alias("key"), F.lit("reference_key_repeats").alias("reason"))
    again = again.unionByName(current.groupBy(*keys).count().filter("count > 1").select(name.alias("key"), F.lit("current_key_repeats").alias("reason"))).withColumn("column", F.lit(""))
    l, r = (df.select(name.alias("key"), F.lit(True).alias(f"__{s}"), *(F.col(c).alias(f"{s}_{c}") for c in rest)) for df, s in ((reference, "l"), (current, "r")))
    both = l.join(r, "key", "full")

    def wrong(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        if roles[c] == "provenance":
            return F.lit(False)
        if roles[c] == "numeric":
            return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(F.abs(a - b) > atol + rtol * F.abs(b))
        return ~a.eqNullSafe(b)

    lone = F.when(F.col("__l").isNull(), F.lit("only_current")).when(F.col("__r").isNull(), F.lit("only_reference"))
    found = F.array_compact(F.array(*(F.when(wrong(c), F.struct(F.lit(c).alias("column"), F.lit(f"{roles[c]}_differs").alias("reason"))) for c in rest)))
    cells = F.when(lone.isNotNull(), F.array(F.struct(F.lit("").alias("column"), lone.alias("reason")))).otherwise(found)
    return both.select("key", F.explode(cells).alias("x")).select("key", "x.column", "x.reason").unionByName(again.select("key", "column", "reason"))


def checks(spark: SparkSession, named: dict[str, DataFrame | bool], hard: tuple[str, ...] | None = None) -> DataFrame:
    """check, severity, passed: a table passes if it is empty, all in one job."""
    out = None
    for n, x in named.items():
        one = spark.createDataFrame([(bool(x),)], "passed boolean") if isinstance(x, bool) else x.limit(1).agg((F.count("*") == 0).alias("passed"))
        row = one.select(F.lit(n).alias("check"), F.lit("hard" if hard is None or n in hard else "warn").alias("severity"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


def require(table: DataFrame) -> None:
    """Fails with the names of hard checks that didn't pass."""
    bad = [r["check"] for r in table.filter("severity = 'hard' and not passed").collect()]
    if bad:
        raise AssertionError(f"checks failed: {bad}")


def protocol_diff(registered: dict, actual: dict, path: str = "") -> list[str]:
    """Places at which two settings differ."""
    out = []
    for k in sorted({*registered, *actual}):
        at = f"{path}/{k}"
        if k not in registered or k not in actual:
            out.append(at)
        elif isinstance(registered[k], dict) and isinstance(actual[k], dict):
            out += protocol_diff(registered[k], actual[k], at)
        elif registered[k] != actual[k]:
            out.append(at)
    return out


#: Patterns of the privacy scan, by kind.
PRIVATE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ipv4": r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b", "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "key_value": r"(token|password|secret) ?[:=]", "home_path": r"(/home/|/Users/|C:\\Users\\)"}


def scan_private(texts: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, kind, n for every text in which a pattern occurs."""
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text_col), F.lit(p)).cast("long").alias("n")) for k, p in (patterns or PRIVATE).items()]
    return texts.select(F.col(id_col), F.explode(F.array(*found)).alias("x")).select(id_col, "x.kind", "x.n").filter("n > 0")


def redact(c: Column, patterns: dict[str, str] | None = None) -> Column:
    for k, p in (patterns or PRIVATE).items():
        c = F.regexp_replace(c, p, f"<{k}>")
    return c
