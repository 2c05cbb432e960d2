"""Structured Streaming: packets in micro-batches merged by id, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def merged(source: DataFrame, path: str, key: str, order: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 16):
    """Starts a query that keeps each key's latest row in a table of versions at ``path``.

    Each batch is written as its own version, so a batch that runs again replaces itself; ``current`` reads the table.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = latest(transform(batch) if transform else batch, key, order)
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path), key, [*order, "batch"]).drop("batch")


def tumbling(events: DataFrame, every: str = "1 hour", late: str | None = None, ts: str = "ts") -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(F.window(ts, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", every: str = "1 hour", late: str | None = None, ts: str = "ts") -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, length, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
