"""Usage by event-time windows from a stream of postings or events. An addition: the batch models need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files; event times are read as timestamps."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Count and sum of values by week and type; rows later than ``late`` behind the stream are left out."""
    week = F.window("ts", "7 days", startTime="4 days")  # weeks begin on Monday
    out = events.withWatermark("ts", late).groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("week.start").alias("week_start"), "event_type", "n", "total")
