"""How far recorded stock can be trusted, and what the errors cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import POSTING_SIGN, Params
from .resolve import supplier_canonical
from .timeseries import as_of, running_balance, window_count

ITEM = "canonical_item_number"


def signed() -> Column:
    """A posting's effect on stock by its type's sign; adjustments carry their own."""
    out = None
    for kind, sign in POSTING_SIGN.items():
        value = F.col("qty") if kind == "ADJUST" else F.abs("qty") * sign
        out = F.when(F.col("txn_type") == kind, value) if out is None else out.when(F.col("txn_type") == kind, value)
    return out.otherwise(0.0)


def balances(lookups: DataFrame, ledger: DataFrame) -> DataFrame:
    """Recorded balance of item_number at day, 0 before the first posting."""
    daily = running_balance(ledger, signed(), "item_number").withColumnRenamed("txn_date", "posted_on")
    out = as_of(lookups, daily, "item_number", "day", "balance", "posted_on")
    return out.withColumn("balance", F.coalesce("balance", F.lit(0.0)))


def count_variance() -> Column:
    """Share by which a count was off; 1 where stock was found that the record didn't have."""
    off = F.try_divide(F.abs(F.col("counted_qty") - F.col("system_qty")), F.greatest(F.col("system_qty"), F.lit(1.0)))
    return F.when((F.col("system_qty") <= 0) & (F.col("counted_qty") > 0), 1.0).otherwise(off)


def last_counts(lookups: DataFrame, counts: DataFrame) -> DataFrame:
    """Look-ups with the variance and age in days of the latest count on or before day."""
    rows = counts.withColumn("variance", count_variance()).withColumnRenamed("count_date", "counted_on")
    out = as_of(lookups, rows, "item_number", "day", "variance", "counted_on")
    return out.withColumn("count_age", F.datediff("day", "counted_on"))


def reliability(items: DataFrame, ledger: DataFrame, counts: DataFrame, crosswalk: DataFrame, clusters: DataFrame, reviewed: DataFrame, mismatched: DataFrame, conversions: DataFrame, p: Params) -> DataFrame:
    """Grade and balance of every live record at the start and the end of remediation and at the as-of date.

    unreliable: in a duplicate cluster, bought in another unit without a
    conversion, or written down chronically outside counts; reliable: counted
    lately and closely; uncertain: the rest, never counted ones among them.
    After remediation merged records are cleared, conversions that were added
    by then count, and the trailing year begins with its end at the earliest.
    Retired records have no grade then: their stock is their survivor's.
    """
    end = F.lit(p.remediation_end).cast("date")
    days = [(p.remediation_start, False), (p.remediation_end, True), (p.as_of_date, True)]
    asked = F.explode(F.array(*[F.struct(F.lit(d).cast("date").alias("day"), F.lit(after).alias("after")) for d, after in days]))
    lookups = items.select("item_number", asked.alias("x")).select("item_number", "x.*")
    down = ledger.where((F.col("txn_type") == "ADJUST") & (F.col("qty") < 0) & ~F.coalesce("reason_code", F.lit("")).isin("COUNT", "CYCLE"))
    rows = window_count(last_counts(lookups, counts), down, "item_number", "day", "txn_date", p.chronic_days, F.when(F.col("after"), end))
    rows = balances(rows, ledger)
    merged = reviewed.where(F.col("decision") == "MERGE")
    retired = merged.select(F.col("retired_item_number").alias("item_number")).distinct()
    cleared = retired.unionByName(merged.select(F.col("survivor_item_number").alias("item_number"))).distinct()
    wrong_unit = crosswalk.join(mismatched.select("item_id").distinct(), "item_id").select("item_number").distinct()
    added = conversions.groupBy("item_number").agg(F.max("added_date").alias("__added"))
    for name, df in (("__member", clusters.select("item_number").distinct()), ("__retired", retired), ("__cleared", cleared), ("__unit", wrong_unit)):
        rows = rows.join(df.withColumn(name, F.lit(True)), "item_number", "left")
    rows = rows.join(added, "item_number", "left")
    holds = lambda name: F.coalesce(F.col(name), F.lit(False))
    duplicate = holds("__member") & ~(F.col("after") & holds("__cleared"))
    unit = holds("__unit") & ~(F.col("after") & F.coalesce(F.col("__added") <= F.col("day"), F.lit(False)))
    chronic = F.col("n_events") >= p.chronic_adjustments
    close = (F.col("count_age") <= p.fresh_count_days) & (F.col("variance") < p.close_count_share)
    grade = F.when(duplicate | unit | chronic, "unreliable").when(close, "reliable").otherwise("uncertain")
    return rows.withColumn("reliability", F.when(F.col("after") & holds("__retired"), None).otherwise(grade)).drop("__member", "__retired", "__cleared", "__unit", "__added")


def value_by_reliability(graded: DataFrame, costs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Records and stock value by day and grade; after remediation a retired record's stock is its survivor's."""
    survivor = reviewed.where(F.col("decision") == "MERGE").groupBy(F.col("retired_item_number").alias("item_number")).agg(F.max("survivor_item_number").alias("__survivor"))
    rows = graded.join(survivor, "item_number", "left").withColumn("holder", F.when(F.col("after"), F.coalesce("__survivor", "item_number")).otherwise(F.col("item_number")))
    held = rows.groupBy("holder", "day").agg(F.sum("balance").alias("held"), F.max(F.when(F.col("item_number") == F.col("holder"), F.col("reliability"))).alias("reliability"))
    value = F.greatest(F.col("held"), F.lit(0.0)) * F.coalesce("cost", F.lit(0.0))
    out = held.where("reliability is not null").join(costs.withColumnRenamed("item_number", "holder"), "holder", "left")
    return out.groupBy("day", "reliability").agg(F.count("*").alias("records"), F.sum(value).alias("stock_value"))


def imputed_costs(items: DataFrame) -> DataFrame:
    """Standard cost, else the class's median, else the median of all."""
    by_class = items.groupBy("item_class").agg(F.median("standard_cost").alias("class_cost"))
    whole = F.broadcast(items.agg(F.median("standard_cost").alias("any_cost")))  # one row
    out = items.join(by_class, "item_class", "left").crossJoin(whole)
    return out.select("item_number", F.coalesce("standard_cost", "class_cost", "any_cost").alias("cost"), F.col("standard_cost").isNull().alias("is_imputed"))


def delayed_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs, delayed jobs and lost days by hold reason."""
    return jobs.groupBy(F.coalesce("hold_reason", F.lit("none")).alias("hold_reason")).agg(
        F.count("*").alias("jobs"), F.count(F.when(F.col("delay_days") > 0, 1)).alias("delayed_jobs"), F.sum("delay_days").cast("bigint").alias("delay_days")
    )


def phantom_on_order(orders: DataFrame, day: str, p: Params) -> DataFrame:
    """Open lines older than the limit: how many, their open units and value."""
    rows = orders.where((F.col("status") == "OPEN") & (F.datediff(F.lit(day).cast("date"), "order_date") > p.phantom_days))
    units = F.greatest(F.col("qty_ordered") - F.coalesce("qty_received", F.lit(0.0)), F.lit(0.0))
    return rows.agg(F.count("*").alias("lines"), F.sum(units).alias("open_units"), F.sum(units * F.col("unit_price")).alias("open_value"))


def dead_stock(resolved: DataFrame, ledger: DataFrame, costs: DataFrame) -> DataFrame:
    """Dead records with stock, their units and value."""
    held = ledger.groupBy("item_number").agg(F.sum(signed()).alias("units"))
    rows = resolved.where("is_dead").join(held, "item_number").where("units > 0").join(costs, "item_number", "left")
    return rows.agg(F.count("*").alias("records"), F.sum("units").alias("units"), F.sum(F.col("units") * F.col("cost")).alias("stock_value"))


def sibling_stock(orders: DataFrame, crosswalk: DataFrame, ledger: DataFrame) -> DataFrame:
    """Order lines placed while another record of the same item held stock, with that stock."""
    several = crosswalk.groupBy(ITEM).agg(F.count("*").alias("n")).where("n > 1").select(ITEM)
    members = crosswalk.join(several, ITEM).select("item_number", ITEM)
    lines = orders.join(members, "item_number").select("po_id", "line", "item_number", ITEM, F.col("order_date").alias("day"))
    others = lines.join(members.withColumnRenamed("item_number", "sibling"), ITEM).where(F.col("sibling") != F.col("item_number"))
    asked = others.select(F.col("sibling").alias("item_number"), "day").distinct()
    stock = balances(asked, ledger).select(F.col("item_number").alias("sibling"), "day", F.greatest("balance", F.lit(0.0)).alias("held"))
    out = others.join(stock, ["sibling", "day"]).groupBy("po_id", "line", "item_number", "day").agg(F.sum("held").alias("sibling_stock"))
    return out.where("sibling_stock > 0")


def free_text_spend(orders: DataFrame, attribution: DataFrame) -> DataFrame:
    """Lines and spend under generic codes, and what of it was attributed with confirmation."""
    good = attribution.where(F.col("confirmation") == "confirmed").select("po_id").distinct().withColumn("__ok", F.lit(True))
    rows = orders.where("is_generic_item").join(good, "po_id", "left").withColumn("spend", F.col("qty_ordered") * F.col("unit_price"))
    return rows.agg(F.count("*").alias("lines"), F.sum("spend").alias("spend"), F.count("__ok").alias("confirmed_lines"), F.sum(F.when(F.col("__ok"), F.col("spend")).otherwise(0.0)).alias("confirmed_spend"))


def alias_spend(orders: DataFrame, aliases: DataFrame) -> DataFrame:
    """Spend by vendor and how much of it ran under alias records."""
    flagged = orders.join(aliases.select(F.col("alias_supplier_id").alias("supplier_id"), F.lit(True).alias("__alias")), "supplier_id", "left").withColumn("spend", F.col("qty_ordered") * F.col("unit_price"))
    rows = supplier_canonical(flagged, aliases)
    out = rows.groupBy("supplier_id").agg(F.sum("spend").alias("spend"), F.sum(F.when(F.col("__alias"), F.col("spend")).otherwise(0.0)).alias("alias_spend"))
    return out.where("alias_spend > 0")


def posting_lag(orders: DataFrame, batched: DataFrame) -> DataFrame:
    """Lead days of batched receipts against the others'."""
    rows = orders.where(F.col("received_date").isNotNull()).join(batched.withColumn("__late", F.lit(True)), ["po_id", "line"], "left")
    return rows.groupBy(F.coalesce("__late", F.lit(False)).alias("is_batched")).agg(F.count("*").alias("lines"), F.avg("actual_lead_days").alias("mean_lead_days"))


def excess_stock(position: DataFrame, points: DataFrame, daily: DataFrame, days: float = 75.0, carrying: float = 0.22) -> DataFrame:
    """Stock above the reorder point and so many days' use, its value and carrying cost by ABC class."""
    rows = position.join(points, ITEM, "left").join(daily, ITEM, "left")
    over = F.greatest(F.col("on_hand_units") - F.coalesce("reorder_point", F.lit(0.0)) - F.coalesce("daily", F.lit(0.0)) * days, F.lit(0.0)) * F.col("standard_cost")
    return rows.groupBy("abc").agg(F.count("*").alias("items"), F.sum(over).alias("excess_value"), (F.sum(over) * carrying).alias("carrying_cost"))


def products_with_stale_parts(bill: DataFrame, stale: DataFrame) -> DataFrame:
    """Products and whether any of their components has a stale reorder point."""
    marks = stale.select(F.col("item_number").alias("component_item"), F.lit(1).alias("__stale")).distinct()
    return bill.join(marks, "component_item", "left").groupBy("product_number").agg((F.coalesce(F.max("__stale"), F.lit(0)) == 1).alias("has_stale_part"), F.count("__stale").alias("stale_parts"))


def weekday_share(rows: DataFrame, day: str) -> DataFrame:
    """Rows by weekday and their share of all."""
    counted = rows.where(F.col(day).isNotNull()).groupBy(F.date_format(day, "EEEE").alias("weekday")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
