"""Consumption that follows from what was built: builds exploded through bills, and what an incomplete bill leaves unrecorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import effective_bom


def monthly_builds(jobs: DataFrame) -> DataFrame:
    """Units of each product completed a month; jobs without a completion count nowhere."""
    done = jobs.where((F.col("qty_completed") > 0) & F.col("completed_date").isNotNull())
    return done.groupBy("product_number", F.trunc("completed_date", "month").alias("month")).agg(F.sum("qty_completed").alias("completed"))


def exploded_builds(builds: DataFrame, bill: DataFrame) -> DataFrame:
    """Units of each component that a month's builds take by the bill, subassemblies resolved.

    Builds are summed by product and month before the join, so a product that
    is built all day meets its components once a month.
    """
    takes = builds.join(effective_bom(bill), "product_number")
    return takes.groupBy("component_item", "month").agg(F.sum(F.col("qty_per") * F.col("completed")).alias("qty"))


def complete_bill(bill: DataFrame, changes: DataFrame) -> DataFrame:
    """The bill with the components that were left out of it and entered later."""
    keys = ["product_number", "component_item"]
    added = changes.groupBy(*keys).agg(F.max("qty_per").cast("double").alias("qty_per")).join(bill, keys, "left_anti")
    return bill.select(*keys, "qty_per").unionByName(added)


def backflush_gaps(jobs: DataFrame, bill: DataFrame, changes: DataFrame, completed_from) -> DataFrame:
    """Each completed job's components: units taken, units the bill of that day records, and units it doesn't.

    Jobs completed after ``completed_from`` record by the complete bill. A
    component whose recorded quantity exceeds what is taken has no gap.
    """
    keys = ["product_number", "component_item"]
    recorded = effective_bom(bill).withColumnRenamed("qty_per", "recorded_per")
    needs = effective_bom(complete_bill(bill, changes)).join(recorded, keys, "left")
    done = jobs.where((F.col("qty_completed") > 0) & F.col("completed_date").isNotNull()).select("order_id", "product_number", "completed_date", "qty_completed")
    per = F.when(F.col("completed_date") > F.lit(completed_from).cast("date"), F.col("qty_per")).otherwise(F.coalesce("recorded_per", F.lit(0.0)))
    rows = done.join(needs, "product_number").withColumn("per", per)
    taken, booked = F.col("qty_per") * F.col("qty_completed"), F.col("per") * F.col("qty_completed")
    return rows.select("order_id", "component_item", "completed_date", taken.alias("taken"), booked.alias("recorded"), F.greatest(taken - booked, F.lit(0.0)).alias("unrecorded"))
