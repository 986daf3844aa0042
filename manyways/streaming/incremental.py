"""Streaming extensions: fork statistics kept up as runs arrive, and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyways.operators.forks import run_count, stats_of, votes


def sessions(events: DataFrame, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    """Islands of each user's events: windows that a pause of `gap` closes. Works on streams and tables."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def windowed_forks(choice: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Decisions per fork and window of time."""
    w = choice.withWatermark("ts", late).groupBy(F.window("ts", width), "fork").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "fork", "n")


def keep_fork_stats(stream: DataFrame, history: str, out: str, checkpoint: str):
    """A query that appends each batch of decisions to `history`, dealt by fork, and writes statistics to `out`. Reach and modal options are
    counted again for the forks that the batch touches only; shares of all runs, which every batch moves, follow from the
    kept counts. A batch that is run again replaces its own part of the history."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "fork").parquet(history)
        touched = [r["fork"] for r in batch.select("fork").distinct().collect()]  # a vocabulary
        whole = spark.read.parquet(history)
        counts = votes(whole.filter(F.col("fork").isin(touched)))  # only these forks' files are read
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fork").parquet(f"{out}-votes")
        stats_of(spark.read.parquet(f"{out}-votes"), run_count(whole)).write.mode("overwrite").parquet(out)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
