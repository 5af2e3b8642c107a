"""Extensions beyond batches: running counts with late data, and snapshots applied as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrion.operators.upsert import collapsed, upsert


def event_windows(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than the watermark are dropped, which is this project's own rule. Works on batches and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def apply_batches(stream: DataFrame, key: str, order: list[str], fill: list[str], load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str):
    """Upserts each micro-batch into a table that ``load`` reads and ``store`` writes under the batch's number (so a repeated batch overwrites itself)."""

    def one(batch: DataFrame, number: int) -> None:
        store(upsert(load(), collapsed(batch, key, order, fill), key, fill).drop("is_new"), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
