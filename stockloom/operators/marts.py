"""Marts: cleaned usage, item attributes, inventory position and supplier performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import compensated_sum, ordered
from ..functions.measures import share, signed_quantity
from ..params import Params
from .resolve import canonical, supplier_canonical

ITEM = "canonical_item_number"


def consumption_raw(usage: DataFrame) -> DataFrame:
    """Monthly usage posted to surviving records alone."""
    own = usage.where(F.col("item_number") == F.col(ITEM))
    return own.groupBy(ITEM, "month").agg(F.sum("units").cast("bigint").alias("consumption"))


def consumption_merged(usage: DataFrame) -> DataFrame:
    """Monthly usage with duplicate records merged."""
    return usage.groupBy(ITEM, "month").agg(F.sum("units").cast("bigint").alias("consumption"))


def consumption_clean(usage: DataFrame, unrecorded: DataFrame, corrections: DataFrame, crosswalk: DataFrame, period: str) -> DataFrame:
    """Usage by ``period`` with unrecorded usage added in the item's own shape and corrections taken off.

    Parts are added with a compensated sum in a fixed order (recorded, added
    back by source, keying errors, duplicates), and nothing falls below 0.
    """
    def keyed(rows: DataFrame) -> DataFrame:
        """Rows of known items with keys without nulls, so that groups and the join below share their shuffle."""
        return rows.where(F.col(ITEM).isNotNull()).withColumn("__at", F.coalesce(F.col(period), F.lit("1970-01-01").cast("date"))).withColumn("__undated", F.col(period).isNull())

    keys = [ITEM, "__at", "__undated"]
    base = keyed(usage).groupBy(*keys).agg(F.sum("units").alias("units"))
    sources = canonical(unrecorded.where("annual_unrecorded > 0"), crosswalk).where(F.col(ITEM).isNotNull())
    # totals are formed of the few items that have sources
    sourced = base.join(sources.groupBy(ITEM).agg(F.collect_list(F.struct("source_no", "annual_unrecorded")).alias("sources")).hint("shuffle_hash"), ITEM)
    added = sourced.withColumn("total", F.sum("units").over(Window.partitionBy(ITEM))).select(*keys, "units", "total", F.inline("sources"))
    amount = F.col("annual_unrecorded") * (F.col("units") / F.greatest(F.lit(1.0), F.col("total")))
    part = lambda n, source, txn, value: [*keys, n.alias("part"), source.alias("source_no"), txn.alias("txn_id"), value.alias("delta")]
    none, blank = F.lit(0), F.lit("")
    kind = F.when(F.col("correction") == "keying", 2).otherwise(3)
    pieces = added.select(*part(F.lit(1), F.col("source_no"), blank, amount)).unionByName(keyed(corrections).select(*part(kind, none, F.col("txn_id"), F.col("delta"))))
    # most periods have recorded usage alone, so only what others have beside it is gathered, and held in memory partition by partition
    beside = pieces.groupBy(*keys).agg(ordered("part", "source_no", "txn_id", value="delta").alias("deltas"))
    rows = base.withColumn("recorded", F.lit(True)).join(beside.hint("shuffle_hash"), keys, "full")
    deltas = F.concat(F.when(F.col("recorded"), F.array("units")).otherwise(F.array().cast("array<double>")), "deltas")
    consumption = F.when(F.col("deltas").isNull(), F.col("units")).otherwise(compensated_sum(deltas))
    return rows.select(ITEM, F.when(~F.col("__undated"), F.col("__at")).alias(period), F.greatest(consumption, F.lit(0.0)).alias("consumption"))


def true_demand(direct: DataFrame, backflush: DataFrame, crosswalk: DataFrame) -> DataFrame:
    # whole units are summed once, by the item that they resolve to
    demand = direct.unionByName(backflush)
    known = crosswalk.select("item_id", ITEM).distinct()
    return demand.join(known, "item_id").groupBy(ITEM, "month").agg(F.sum("qty").cast("bigint").alias("consumption"))


def segment(n_nonzero: Column, adi: Column, cv2: Column, p: Params) -> Column:
    """Demand pattern by mean interval and squared variation; fewer than two demands are intermittent."""
    steady, even = adi < p.adi_cut, cv2 < p.cv2_cut
    return (
        F.when(F.coalesce(n_nonzero, F.lit(0)) < 2, "intermittent")
        .when(steady & even, "smooth")
        .when(steady, "erratic")
        .when(even, "intermittent")
        .otherwise("lumpy")
    )


def demand_pattern(demand: DataFrame, periods: DataFrame) -> DataFrame:
    """n_nonzero, adi and cv2 of items with demand, over all periods that occur.

    Periods without demand need no row: the interval is the number of periods
    over the number with demand, the variation is over the latter.
    """
    some = demand.where("consumption > 0").withColumn("x", F.col("consumption").cast("double"))
    facts = some.groupBy(ITEM).agg(F.count("*").alias("n_nonzero"), F.avg("x").alias("mean"))
    spread = some.join(facts, ITEM).groupBy(ITEM, "n_nonzero", "mean").agg(F.avg(F.pow(F.col("x") - F.col("mean"), 2)).alias("variance"))
    many = F.broadcast(periods.agg(F.count("*").alias("n_periods")))  # one row
    return spread.crossJoin(many).select(ITEM, "n_nonzero", (F.col("n_periods") / F.col("n_nonzero")).alias("adi"), F.pow(F.sqrt("variance") / F.col("mean"), 2).alias("cv2"))


def item_attributes(items: DataFrame, crosswalk: DataFrame, demand: DataFrame, abc: DataFrame, lead_times: DataFrame, p: Params) -> DataFrame:
    """What forecast and policy read of each canonical item."""
    own = crosswalk.where(F.col("item_number") == F.col(ITEM)).select(ITEM, "item_id").distinct()
    months = demand.select("month").distinct()
    pattern = demand_pattern(demand.join(own, ITEM, "left_semi"), months)
    latest = F.broadcast(months.agg(F.add_months(F.max("month"), -12).alias("since")))  # one row
    year = demand.crossJoin(latest).where(F.col("month") > F.col("since")).groupBy(ITEM).agg(F.sum("consumption").alias("year"))
    master = items.select(F.col("item_number").alias(ITEM), "standard_cost", "item_class", "master_lead_time_days")
    leads = lead_times.select(F.col("item_number").alias(ITEM), "recommended_lead_days")
    out = own.join(master, ITEM, "left").join(pattern, ITEM, "left").join(abc, "item_id", "left").join(leads, ITEM, "left").join(year, ITEM, "left")
    return out.select(
        ITEM,
        F.coalesce("standard_cost", F.lit(1.0)).alias("standard_cost"),
        F.coalesce("item_class", F.lit("MISC")).alias("item_class"),
        segment(F.col("n_nonzero"), F.col("adi"), F.col("cv2"), p).alias("segment"),
        F.coalesce("abc", F.lit("C")).alias("abc"),
        F.coalesce("recommended_lead_days", "master_lead_time_days", F.lit(21)).cast("double").alias("corrected_lead_days"),
        F.coalesce("year", F.lit(0)).cast("double").alias("annual_consumption"),
    )


def inventory_position(attributes: DataFrame, ledger: DataFrame, orders: DataFrame, closures: DataFrame, crosswalk: DataFrame, p: Params) -> DataFrame:
    """Stock on hand and truly on order of each item at the reference date, and its value."""
    day = F.lit(p.as_of_date).cast("date")
    held = ledger.where(F.col("txn_date") <= day).groupBy(ITEM).agg(F.sum(signed_quantity()).alias("held"))
    closed = closures.where(F.col("document_type") == "PO").select(F.col("document_id").alias("po_id"), "line")
    due = orders.where((F.col("status") == "OPEN") & (F.col("order_date") <= day)).join(closed, ["po_id", "line"], "left_anti")
    due = canonical(due, crosswalk).groupBy(ITEM).agg(F.sum(F.greatest(F.col("qty_ordered") - F.coalesce("qty_received", F.lit(0.0)), F.lit(0.0))).alias("due"))
    out = attributes.join(held, ITEM, "left").join(due, ITEM, "left")
    stock = F.greatest(F.coalesce("held", F.lit(0.0)), F.lit(0.0))
    return out.select(ITEM, "abc", "segment", "standard_cost", stock.alias("on_hand_units"), F.coalesce("due", F.lit(0.0)).alias("on_order_units"), F.round(stock * F.coalesce("standard_cost", F.lit(0.0)), 2).alias("on_hand_value"))


def supplier_performance(orders: DataFrame, suppliers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Deliveries and spend of each vendor over received lines, its aliases taken together."""
    lines = supplier_canonical(orders.where(F.col("received_date").isNotNull()), aliases)
    facts = lines.groupBy("supplier_id").agg(
        F.count("*").alias("received_lines"),
        F.median("actual_lead_days").alias("median_lead_days"),
        F.percentile("actual_lead_days", 0.9).alias("p90_lead_days"),
        F.round(share(F.col("received_date") <= F.col("promised_date")), 3).alias("on_time_share"),
        F.round(share(F.col("is_rush")), 3).alias("rush_share"),
        F.round(F.sum(F.col("qty_received") * F.col("unit_price")), 2).alias("spend"),
    )
    names = suppliers.select("supplier_id", "supplier_name", "supplier_type")
    return facts.join(names, "supplier_id", "left").select("supplier_id", "supplier_name", "supplier_type", *facts.columns[1:])
