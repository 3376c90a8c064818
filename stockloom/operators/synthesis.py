"""Orders put together from lines, and what counts post, as windows and folds over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeseries import as_of, running_balance


def assembled_orders(lines: DataFrame, most: Column, days: int = 5, key: str = "supplier_id", day: str = "order_date", seq: str = "line_seq") -> DataFrame:
    """Lines with order_no (from 1 within the supplier) and line (from 1 within the order).

    A supplier's lines go, by day and ``seq``, into one order until it holds
    ``most`` lines (a column of the supplier) or the day is more than ``days``
    after its first. Only counts a day are folded, so a supplier's state is
    bounded by the calendar, and lines meet by supplier and day alone. Lines
    without a supplier or a day get nulls.
    """
    known = lines.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    counts = known.groupBy(key, day).agg(F.count("*").alias("n"), F.max(most).cast("bigint").alias("most"))
    series = counts.groupBy(key).agg(F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), "n"))).alias("days"))
    state = F.struct(F.lit(0).cast("bigint").alias("order_no"), F.lit(None).cast("date").alias("first"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<day:date,order_no:bigint,used:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        open_ = s["first"].isNotNull() & (F.datediff(x["day"], s["first"]) <= days)
        base, used = F.when(open_, s["order_no"]).otherwise(s["order_no"] + 1), F.when(open_, s["used"]).otherwise(F.lit(0).cast("bigint"))
        end = used + x["n"] - 1
        further = F.floor(end / F.col("most"))
        first = F.when(open_ & (further == 0), s["first"]).otherwise(x["day"])
        row = F.struct(x["day"].cast("date").alias("day"), base.alias("order_no"), used.alias("used"))
        return F.struct((base + further).alias("order_no"), first.cast("date").alias("first"), (F.pmod(end, F.col("most")) + 1).alias("used"), F.concat(s["out"], F.array(row)).alias("out"))

    starts = series.select(key, "most", F.inline(F.aggregate("days", state, step)["out"])).select(key, F.col("day").alias(day), F.col("most").alias("__most"), F.col("order_no").alias("__base"), F.col("used").alias("__used"))
    place = F.row_number().over(Window.partitionBy(key, day).orderBy(seq)) - 1 + F.col("__used")
    out = lines.join(starts, [key, day], "left")
    return out.withColumn("order_no", F.col("__base") + F.floor(place / F.col("__most"))).withColumn("line", F.when(F.col("__base").isNotNull(), F.pmod(place, F.col("__most")) + 1)).drop("__base", "__used", "__most")


def count_postings(counts: DataFrame, ledger: DataFrame, change: Column, key: str = "item_number") -> DataFrame:
    """Counts with the stock the books show (system) and the correction they post (correction), 0 where they agree.

    The books show the ledger's balance through the day and all corrections
    posted by earlier counts. After a count they show what was counted, so
    only the count before matters and nothing has to run along the series.
    Counts of one day go by count_id. ``ledger`` must not hold the corrections.
    """
    rows = as_of(counts, running_balance(ledger, change, key), key, "count_date", "balance", "txn_date").drop("txn_date")
    rows = rows.withColumn("balance", F.coalesce("balance", F.lit(0.0)))
    order = Window.partitionBy(key).orderBy("count_date", "count_id")
    posted = F.coalesce(F.lag(F.col("counted_qty") - F.col("balance")).over(order), F.lit(0.0))
    rows = rows.withColumn("system", F.bround(F.col("balance") + posted).cast("bigint"))
    return rows.withColumn("correction", F.col("counted_qty").cast("bigint") - F.col("system")).drop("balance")
