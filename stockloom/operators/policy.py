"""Reorder policy: lead-time spread, visibility, criticality, order quantities, safety stock, reorder points and the queue."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import FILL_TARGET, RECOMPUTED_Z, RULE_Z, Params
from ..shipping import ship
from .resolve import canonical, is_usage
from .timeseries import placed

ITEM = "canonical_item_number"


def by_class(table: dict[str, float], column: str = "abc", default: float | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.col(column) == k, float(v)) if out is None else out.when(F.col(column) == k, float(v))
    return out.otherwise(default if default is None else float(default))


def lead_time_spread(attributes: DataFrame, orders: DataFrame, crosswalk: DataFrame, since: str, until: str, least: int = 4) -> DataFrame:
    """Sample deviation of each item's lead times: its own from ``least`` receipts, else its class's, else all items'."""
    rows = orders.where(~F.col("is_rush") & F.col("received_date").isNotNull() & (F.col("order_date") >= F.lit(since).cast("date")) & (F.col("order_date") < F.lit(until).cast("date")))
    rows = canonical(rows, crosswalk).select(ITEM, "actual_lead_days")
    own = rows.groupBy(ITEM).agg(F.stddev_samp("actual_lead_days").alias("own"), F.count("*").alias("n"))
    classes = attributes.select(ITEM, "item_class")
    by_class = rows.join(classes, ITEM).groupBy("item_class").agg(F.stddev_samp("actual_lead_days").alias("of_class"))
    all_items = F.broadcast(rows.agg(F.stddev_samp("actual_lead_days").alias("of_all")))  # one row
    out = classes.join(own, ITEM, "left").join(by_class, "item_class", "left").crossJoin(all_items)
    return out.select(ITEM, F.coalesce(F.when(F.col("n") >= least, F.col("own")), "of_class", "of_all").alias("lead_sd"))


def unscheduled_share(ledger: DataFrame, crosswalk: DataFrame, since: str, until: str) -> DataFrame:
    """Share of each item's usage that no backflush drew."""
    rows = canonical(ledger.where(is_usage() & (F.col("txn_date") >= F.lit(since).cast("date")) & (F.col("txn_date") < F.lit(until).cast("date"))), crosswalk)
    scheduled = F.sum(F.when(F.col("txn_type") == "BACKFLUSH", F.abs("qty")).otherwise(0.0))
    return rows.groupBy(ITEM).agg((1 - F.try_divide(scheduled, F.sum(F.abs("qty")))).alias("unscheduled"))


def visibility(jobs: DataFrame, since: str, until: str) -> DataFrame:
    """Median days from release to completion and from booking to release of undelayed jobs."""
    rows = jobs.where(F.col("completed_date").isNotNull() & (F.col("due_date") >= F.lit(since).cast("date")) & (F.col("due_date") < F.lit(until).cast("date")) & (F.col("delay_days") == 0))
    return rows.agg(F.median(F.datediff("completed_date", "release_date")).alias("visibility_days"), F.median(F.datediff("release_date", "booked_date")).alias("order_book_days"))


def criticality(attributes: DataFrame, bill: DataFrame, restored: DataFrame, ledger: DataFrame, crosswalk: DataFrame, since: str, until: str) -> DataFrame:
    """line: on the corrected bill of materials; service: issued to service orders; else standard."""
    listed = bill.select("component_item").unionByName(restored.select("component_item")).distinct().withColumnRenamed("component_item", "item_number")
    on_bill = canonical(listed, crosswalk).select(ITEM).distinct().withColumn("line", F.lit(True))
    issued = ledger.where(F.col("job_id").startswith("SO-") & (F.col("txn_date") >= F.lit(since).cast("date")) & (F.col("txn_date") < F.lit(until).cast("date")))
    served = canonical(issued.select("item_number").distinct(), crosswalk).select(ITEM).distinct().withColumn("served", F.lit(True))
    out = attributes.select(ITEM).join(on_bill, ITEM, "left").join(served, ITEM, "left")
    return out.select(ITEM, F.when(F.col("line"), "line").when(F.col("served"), "service").otherwise("standard").alias("tier"))


def sigma(forecast_sd: Column, daily: Column, lead_days: Column, lead_sd: Column, h: Column, unscheduled: Column, seen_days: Column) -> Column:
    """Deviation of demand over the lead time: forecast error that scheduled demand doesn't share, and lead-time spread."""
    scale = F.sqrt(lead_days / (7.0 * h)) * F.sqrt(F.greatest(F.lit(0.05), 1 - (1 - unscheduled) * F.least(lead_days, seen_days) / F.greatest(lead_days, F.lit(1.0))))
    return F.sqrt(F.pow(forecast_sd * scale, 2) + F.pow(daily * lead_sd, 2))


def order_quantity(daily: Column, cost: Column, p: Params) -> Column:
    """Economic lot, within a least and a most number of days of use, at least one."""
    fair = F.when(cost > 0, cost).otherwise(1.0)
    lot = F.sqrt(daily * (2.0 * 365.0 * p.order_line_cost) / (fair * p.holding_rate))
    return F.greatest(F.lit(1.0), F.least(F.greatest(F.when(daily > 0, lot).otherwise(1.0), daily * p.lot_min_days), daily * p.lot_max_days))


def loss_table(errors: DataFrame, step: float = 0.01, most: float = 6.0) -> DataFrame:
    """abc, k and loss: mean of max(z - k, 0) over standardised errors, for every k of the grid.

    Errors are put on the grid first. With n errors above cell k and their sum
    s, the loss is (s - n k) / all, so the work is one pass and a running sum
    over the grid's fixed number of cells.
    """
    cells = int(round(most / step))
    cell = F.least(F.greatest(F.ceil(F.col("z") / step), F.lit(0)), F.lit(cells + 1)).cast("int")
    counted = errors.where(F.col("z").isNotNull()).groupBy("abc", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    classes = counted.groupBy("abc").agg(F.sum("n").alias("whole"))
    grid = classes.select("abc", "whole", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("k_cell"))
    # errors above k lie in cells beyond k's own
    joined = grid.join(counted.withColumnRenamed("abc", "__abc"), (F.col("abc") == F.col("__abc")) & (F.col("cell") > F.col("k_cell")), "left")
    k = F.col("k_cell") * F.lit(step)
    out = joined.groupBy("abc", "k_cell", "whole").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    return out.select("abc", F.round(k, 2).alias("k"), ((F.col("s") - F.col("n") * k) / F.col("whole")).alias("loss"))


def fill_factor(needs: DataFrame, losses: DataFrame, p: Params) -> DataFrame:
    """Least k whose expected loss fits the fill-rate target, capped; 0 without spread.

    ``needs`` has an item's abc, tier, sigma and lot. The loss table is a few
    hundred rows a class, a model's fixed grid, and goes to the tasks as it is.
    The least loss up to each k never rises, so rows are searched by halves,
    batch by batch.
    """
    order = Window.partitionBy("abc").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = losses.withColumn("least", F.min("loss").over(order)).groupBy("abc").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("rows"))
    grids = {x.abc: (np.array([r.k for r in x.rows]), np.array([r.least for r in x.rows][::-1])) for x in table.collect()}
    ship(needs.sparkSession)

    @F.arrow_udf("double")
    def first_that_fits(classes: pa.Array, allowed: pa.Array) -> pa.Array:
        coded, wanted, open_ended = classes.dictionary_encode(), allowed.to_numpy(zero_copy_only=False), allowed.is_null().to_numpy(zero_copy_only=False)
        own = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out, none = np.zeros(len(wanted)), np.ones(len(wanted), bool)
        for code, name in enumerate(coded.dictionary.to_pylist()):
            if name not in grids:
                continue
            ks, rising = grids[name]
            at = np.flatnonzero(own == code)
            place = len(ks) - np.searchsorted(rising, wanted[at], "right")
            # what fits nowhere takes the last k
            out[at], none[at] = ks[np.where(open_ended[at], len(ks) - 1, np.minimum(place, len(ks) - 1))], False
        return pa.array(out, mask=none)

    allowed = F.when(F.col("sigma") > 0, (1 - by_class(FILL_TARGET, "tier", FILL_TARGET["standard"])) * F.col("lot") / F.col("sigma"))
    rows = needs.withColumn("__k", first_that_fits(F.col("abc"), allowed.cast("double")))
    return rows.withColumn("k_fill", F.when(F.col("sigma") > 0, F.least("__k", F.lit(p.safety_cap))).otherwise(0.0)).drop("__k")


def order_level(lead_forecast: Column, unscheduled: Column, lead_days: Column, safety_stock: Column, seen_days: Column) -> Column:
    """Level to order up from: lead-time demand less what MRP already sees, and the buffer."""
    return lead_forecast - (1 - unscheduled) * lead_forecast * F.least(lead_days, seen_days) / F.greatest(lead_days, F.lit(1.0)) + safety_stock


def rule_schedule(frame: DataFrame, attributes: DataFrame, spread: DataFrame) -> DataFrame:
    """The rule without a model: last year's rate over the lead time and a buffer by class."""
    return rule_points(frame.join(attributes.select(ITEM, "abc", "corrected_lead_days"), ITEM).join(spread, ITEM, "left"))


def rule_points(rows: DataFrame) -> DataFrame:
    """The rule's points of origins that have s52, abc, corrected_lead_days and lead_sd beside them."""
    daily = F.col("s52") / 364.0
    demand = daily * F.col("corrected_lead_days")
    buffer = by_class(RULE_Z, "abc", RULE_Z["C"]) * F.sqrt(F.greatest(F.lit(1.0), demand) + F.pow(daily * F.coalesce("lead_sd", F.lit(0.0)), 2))
    return rows.select(ITEM, "t", demand.alias("lead_demand"), buffer.alias("safety_stock"), (demand + buffer).alias("reorder_point"))


def recomputed_points(usage: DataFrame, attributes: DataFrame, months: int = 36) -> DataFrame:
    """Reorder point and safety stock from mean monthly usage and lead months, rounded half to even."""
    monthly = usage.groupBy(ITEM).agg((F.sum("units") / months).alias("monthly"))
    rows = attributes.join(monthly, ITEM, "left").withColumn("monthly", F.coalesce("monthly", F.lit(0.0)))
    lead = F.greatest(F.lit(0.3), F.col("corrected_lead_days") / 30.0)
    buffer = by_class(RECOMPUTED_Z, "abc", RECOMPUTED_Z["C"]) * F.sqrt(F.greatest(F.col("monthly") * lead, F.lit(0.0)))
    return rows.select(ITEM, "abc", F.bround(F.col("monthly") * lead + buffer).alias("new_reorder_point"), F.bround(buffer).alias("new_safety_stock"))


def corrected_master(usage: DataFrame, attributes: DataFrame, until: str) -> DataFrame:
    """Reorder point and safety stock of a corrected master: the last twelve months' usage over the real lead time, at least a buffer for one unit."""
    end = F.lit(until).cast("date")
    monthly = usage.where((F.col("month") > F.add_months(end, -12)) & (F.col("month") <= end)).groupBy(ITEM).agg((F.sum("units") / 12).alias("monthly"))
    demand = F.coalesce("monthly", F.lit(0.0)) * F.col("corrected_lead_days") / 30
    buffer = by_class(RECOMPUTED_Z, "abc", RECOMPUTED_Z["C"]) * F.sqrt(F.greatest(F.lit(1.0), demand))
    rows = attributes.join(monthly, ITEM, "left")
    return rows.select(ITEM, F.bround(demand + buffer).cast("bigint").alias("reorder_point"), F.bround(buffer).cast("bigint").alias("safety_stock"))


def requirements(jobs: DataFrame, bill: DataFrame, crosswalk: DataFrame, day: str) -> DataFrame:
    """Units of each item that jobs draw that are released on ``day`` and not completed by then, whatever their status."""
    as_of = F.lit(day).cast("date")
    due = jobs.where((F.col("release_date") <= as_of) & (F.col("completed_date").isNull() | (F.col("completed_date") > as_of)))
    rows = due.join(bill.select("product_number", "component_item", "qty_per"), "product_number").withColumnRenamed("component_item", "item_number")
    return canonical(rows, crosswalk).groupBy(ITEM).agg(F.sum(F.col("qty_ordered") * F.col("qty_per")).alias("allocated"))


def reorder_queue(position: DataFrame, levels: DataFrame, needed: DataFrame, marks: dict[str, DataFrame], p: Params) -> DataFrame:
    """Status, lots and flags of every item, ranked: ORDER NOW at its level or below, ORDER SOON within days of it, then by gap.

    ``levels`` has level, daily and lot of each item; ``marks`` the items that
    carry each flag. The gap is a share of the level.
    """
    rows = position.join(levels, ITEM).join(needed, ITEM, "left")
    free = F.col("on_hand_units") + F.col("on_order_units") - F.coalesce("allocated", F.lit(0.0))
    rows = rows.withColumn("available", free).withColumn("gap", (F.col("available") - F.col("level")) / F.greatest(F.col("level"), F.lit(1.0)))
    status = F.when(F.col("available") <= F.col("level"), "ORDER NOW").when(F.col("available") <= F.col("level") + F.col("daily") * p.soon_days, "ORDER SOON").otherwise("OK")
    rows = rows.withColumn("status", status)
    lots = F.greatest(F.lit(1), F.ceil((F.col("level") - F.col("available")) / F.col("lot")))
    names = []
    for k, (name, items) in enumerate(marks.items()):
        rows = rows.join(items.distinct().withColumn(f"__m{k}", F.lit(name)), ITEM, "left")
        names.append(f"__m{k}")
    rows = rows.withColumn("flags", F.concat_ws(", ", *names)).withColumn("suggested", F.when(F.col("status") != "OK", F.col("lot") * lots).otherwise(0.0))
    rank = F.when(F.col("status") == "ORDER NOW", 0).when(F.col("status") == "ORDER SOON", 1).otherwise(2)
    return placed(rows.withColumn("__rank", rank), ["__rank", "gap", ITEM]).select(ITEM, "abc", "available", "level", "gap", "status", "suggested", "flags", "place")


def top_of_queue(queue: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """The first rows of each status."""
    most = most or {"ORDER NOW": 16, "ORDER SOON": 4, "OK": 2}
    first = F.row_number().over(Window.partitionBy("status").orderBy("place"))
    limit = F.lit(0)
    for status, n in most.items():
        limit = F.when(F.col("status") == status, n).otherwise(limit)
    return queue.withColumn("__n", first).where(F.col("__n") <= limit).select(ITEM, "status", "place")
