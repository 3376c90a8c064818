"""Checks as data: named values of tables against bounds, compiled into one aggregate a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A value, an aggregate over ``table``, and the least and most it may be (None: no bound)."""

    name: str
    table: str
    value: Column
    low: float | None = None
    high: float | None = None


def share(condition: Column) -> Column:
    """Percentage of rows for which a condition holds; null counts as not."""
    return 100 * F.avg(F.when(condition, 1.0).otherwise(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """Percentage that one sum is of another; null where the other is 0."""
    return 100 * F.try_divide(part.cast("double"), whole.cast("double"))


def repeated(*keys: str) -> Column:
    """Rows beyond the first of each key; a key with a null counts as repeated."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return F.count("*") - F.count_distinct(F.when(whole, F.struct(*keys)))


def strays(column: str, values: tuple[str, ...]) -> Column:
    """Rows whose value is not one of those listed; null is none."""
    return F.count(F.when(~F.col(column).isin(*values), 1))


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that point at no parent; a null points at nothing."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def verify(checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """check, value, low, high and status of every check. A value that is null fails; each table is aggregated once."""
    out = None
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table]
        one = tables[table].agg(*[c.value.cast("double").alias(f"v{k}") for k, c in enumerate(own)])
        rows = [F.struct(F.lit(c.name).alias("check"), F.col(f"v{k}").alias("value"), F.lit(c.low).cast("double").alias("low"), F.lit(c.high).cast("double").alias("high")) for k, c in enumerate(own)]
        part = one.select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    fits = F.coalesce(F.col("value") >= F.col("low"), F.col("value").isNotNull()) & F.coalesce(F.col("value") <= F.col("high"), F.col("value").isNotNull())
    return out.withColumn("status", F.when(fits, "PASS").otherwise("FAIL"))
