"""Watching streams of records: windows, sessions, patterns learned as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motifloom.operators import quality, shared
from motifloom.sources.storage import remove


def windowed(records: DataFrame, metric: str, at: str = "ts", size: str = "1 hour", slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, least and most of a metric by time window (tumbling, or sliding by ``slide``); of tables and streams alike.

    ``late`` is how long a stream waits for records that are late.
    """
    rows = records.withWatermark(at, late) if late else records
    window = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.min(metric).alias("low"), F.max(metric).alias("high"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "low", "high")


def sessions(records: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of records with no pause as long as ``gap``."""
    rows = records.withWatermark(at, late) if late else records
    grouped = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watched(records: DataFrame, folder: str, on_alert: Callable[[DataFrame, int], None], rules: list | None = None) -> StreamingQuery:
    """Starts a query that checks each micro-batch of records and hands the alerts on."""

    def check(batch: DataFrame, n: int) -> None:
        raised = quality.alerts(quality.summary(batch), rules)
        if not raised.isEmpty():
            on_alert(raised, n)

    return records.writeStream.foreachBatch(check).option("checkpointLocation", folder).start()


def learning(found: DataFrame, folder: str, table: str, most: int | None = None, versions: int = 3) -> StreamingQuery:
    """Starts a query that adds the patterns (pattern, length, n) of each micro-batch to a table of them.

    Each batch writes a new version beside the last, so one that is run again
    finds its input unchanged; of the versions the latest ``versions`` stay.
    """

    def learn(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{table}/{n - 1}") if n else None
        shared.learned(before, batch, n, most=most).write.mode("overwrite").parquet(f"{table}/{n}")
        if n >= max(2, versions):  # the one before is read again if this batch is
            remove(spark, f"{table}/{n - max(2, versions)}")

    return found.writeStream.foreachBatch(learn).option("checkpointLocation", folder).start()
