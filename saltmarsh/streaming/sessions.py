"""Session scores that follow a growing event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.schemas import SESSION_EVENTS, struct


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(struct(SESSION_EVENTS)).option("mode", "DROPMALFORMED").json(path)


def running_accept_precision(events: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Accepts over accepts and dismisses by session and day; days end when the watermark has passed them."""
    answers = events.where(F.col("event").isin("accept", "dismiss")).withWatermark("timestamp", late)
    counts = answers.groupBy(F.window("timestamp", every), "session_id").agg(F.count_if(F.col("event") == "accept").alias("accepts"), F.count("*").alias("answers"))
    return counts.select("session_id", F.col("window.start").alias("day"), "accepts", "answers", F.round(F.col("accepts") / F.col("answers"), 6).alias("accept_precision"))
