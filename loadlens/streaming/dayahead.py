"""Our extension, which the reference does not have: meter readings as a stream.

Hourly rows close when the watermark passes them. Statistics of a day are emitted once, when its last hour has closed; readings later than
the watermark change nothing that was emitted, as the past-only rule asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 hours"


def hourly(events: DataFrame, sites: int = 4, late: str = LATE) -> DataFrame:
    """site_id, ts (start of the hour), n, total: events with a ts of type timestamp, late ones beyond the watermark dropped."""
    rows = events.withColumn("site_id", F.col("user_id") % sites).withWatermark("ts", late)
    g = rows.groupBy("site_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("site_id", F.col("w.start").alias("ts"), "n", "total")


def daily_origin(events: DataFrame, sites: int = 4, late: str = LATE) -> DataFrame:
    """site_id, origin_day, n, total, top: a day's statistics as of its 24:00."""
    rows = events.withColumn("site_id", F.col("user_id") % sites).withWatermark("ts", late)
    g = rows.groupBy("site_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return g.select("site_id", F.to_date("w.start").alias("origin_day"), "n", "total", "top")


def sliding(events: DataFrame, length: str = "24 hours", step: str = "1 hour", sites: int = 4, late: str = LATE) -> DataFrame:
    """site_id, end, total over windows that slide."""
    rows = events.withColumn("site_id", F.col("user_id") % sites).withWatermark("ts", late)
    return rows.groupBy("site_id", F.window("ts", length, step).alias("w")).agg(F.sum("value").alias("total")).select("site_id", F.col("w.end").alias("end"), "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, end, n of a user's stretches without a pause of `gap`."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def start(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends closed rows as Parquet; with `once` it takes what is there and ends."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
