"""What the errors cost in a year, and how far records can be trusted before and after remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ERROR_CAUSES, GENERIC_ITEMS, INTERVIEW_HOURS, SHARED_USERS, VAGUE_REASONS, Params
from .reliability import count_variance, signed

NO_GROUP = "No master error"


def in_year(day: str, p: Params) -> Column:
    return F.year(F.col(day)) == p.cost_year


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def error_group(items: DataFrame, groups: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first group, in order, whose items hold the item, so that a dollar lands once; else NO_GROUP."""
    out, pick = items.select("item_number"), None
    for k, (name, members) in enumerate(groups):
        out = out.join(members.select("item_number").distinct().withColumn(f"__g{k}", F.lit(True)), "item_number", "left")
        pick = F.when(F.col(f"__g{k}"), name) if pick is None else pick.when(F.col(f"__g{k}"), name)
    return out.select("item_number", pick.otherwise(NO_GROUP).alias("error_group"))


def expedites(rushes: DataFrame, p: Params) -> DataFrame:
    """Rush lines of the year by cause, causes that the errors explain always among them."""
    facts = rushes.where(in_year("date", p)).groupBy("cause").agg(F.count("*").alias("lines"), F.sum("freight").alias("freight"), F.sum("premium_usd").alias("premium"))
    known = rushes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in ERROR_CAUSES])).alias("cause"), F.lit(True).alias("is_attributable"))
    out = facts.join(F.broadcast(known), "cause", "full").na.fill(0, ["lines"]).na.fill(0.0, ["freight", "premium"])
    return out.select("cause", "lines", "freight", "premium", (F.col("freight") + F.col("premium")).alias("total"), F.coalesce("is_attributable", F.lit(False)).alias("is_attributable"))


def shortages_by_cause(shortages: DataFrame, p: Params) -> DataFrame:
    """Episodes, items and held jobs of the year by cause."""
    rows = shortages.where(in_year("date", p))
    return rows.groupBy("cause").agg(F.count("*").alias("episodes"), F.count_distinct("item_number").alias("items"), F.sum("jobs").cast("bigint").alias("jobs_held"))


def known_reason() -> Column:
    """Whether an adjustment's reason says something; a count is traceable to the count."""
    return F.col("reason_code").isNotNull() & ~F.col("reason_code").isin(*VAGUE_REASONS)


def adjustments(ledger: DataFrame, dead: DataFrame, groups: DataFrame, costs: DataFrame, p: Params) -> DataFrame:
    """Value written off and up in the year by error group, on items that aren't dead, and rows by kind of reason."""
    rows = ledger.where((F.col("txn_type") == "ADJUST") & in_year("txn_date", p)).join(dead.select("item_number").distinct(), "item_number", "left_anti")
    rows = rows.join(groups, "item_number", "left").join(costs, "item_number", "left")
    value = F.col("qty") * F.coalesce("cost", F.lit(0.0))
    return rows.groupBy(F.coalesce("error_group", F.lit(NO_GROUP)).alias("error_group")).agg(
        F.count("*").alias("adjustments"), F.sum(F.when(value < 0, -value).otherwise(0.0)).alias("written_off"), F.sum(F.when(value > 0, value).otherwise(0.0)).alias("written_up"),
        F.count(F.when(~known_reason(), 1)).alias("generic_reasons"), F.sum(F.when(~known_reason(), F.abs(value)).otherwise(0.0)).alias("generic_value"),
        F.count(F.when(F.col("reason_code").isin("COUNT", "CYCLE"), 1)).alias("count_rows"),
    )


def count_corrections(counts: DataFrame, costs: DataFrame) -> DataFrame:
    """Value that cycle counts wrote down and up."""
    rows = counts.where(F.col("program") == "CYCLE").join(costs, "item_number", "left")
    change = (F.col("counted_qty") - F.col("system_qty")) * F.coalesce("cost", F.lit(0.0))
    return rows.agg(F.count("*").alias("counts"), F.sum(F.greatest(-change, F.lit(0.0))).alias("write_down"), F.sum(F.greatest(change, F.lit(0.0))).alias("write_up"), F.sum(change).alias("net"))


def never_charged(events: DataFrame, costs: DataFrame, p: Params) -> DataFrame:
    """Consumption of the year that no posting recorded, by channel."""
    rows = events.where(in_year("date", p)).join(costs, "item_number", "left")
    return rows.groupBy("channel").agg(F.count("*").alias("events"), F.count_distinct("item_number").alias("items"), F.sum(F.col("qty") * F.coalesce("cost", F.lit(0.0))).alias("value"))


def working_capital(as_is: DataFrame, corrected: DataFrame, groups: DataFrame) -> DataFrame:
    """Excess and shortfall of stock value against the corrected one, by error group; both sides have item_number and value."""
    rows = as_is.select("item_number", F.col("value").alias("a")).join(corrected.select("item_number", F.col("value").alias("c")), "item_number", "left").join(groups, "item_number", "left")
    off = F.col("a") - F.coalesce("c", F.lit(0.0))
    return rows.groupBy(F.coalesce("error_group", F.lit(NO_GROUP)).alias("error_group")).agg(
        F.count("*").alias("items"), F.sum(F.greatest(off, F.lit(0.0))).alias("excess"), F.sum(F.greatest(-off, F.lit(0.0))).alias("shortfall"), F.count(F.when(off > 0, 1)).alias("items_excess"), F.count(F.when(off < 0, 1)).alias("items_shortfall")
    )


def dead_exposure(items: DataFrame, dead: DataFrame, orders: DataFrame, costs: DataFrame) -> DataFrame:
    """Dead items that still carry a reorder point, what that suggests, and what was ever ordered on dead numbers."""
    numbers = dead.select("item_number").distinct()
    pointed = items.where(F.col("reorder_point").isNotNull()).join(numbers, "item_number", "left_semi").join(costs, "item_number", "left")
    ordered = orders.join(numbers, "item_number", "left_semi")
    a = pointed.agg(F.count("*").alias("with_reorder_point"), F.coalesce(F.sum(F.col("reorder_point") * F.col("cost")), F.lit(0.0)).alias("suggestion_value"))
    b = ordered.agg(F.count("*").alias("po_lines_ever"), F.coalesce(F.sum(F.col("qty_ordered") * F.col("unit_price")), F.lit(0.0)).alias("po_value_ever"))
    return a.crossJoin(F.broadcast(b))  # one row each


def book_stock(ledger: DataFrame, before: str | None = None) -> DataFrame:
    """item_number and units as the ledger sums them, up to the day before ``before``."""
    rows = ledger if before is None else ledger.where(F.col("txn_date") < _day(before))
    return rows.groupBy("item_number").agg(F.sum(signed()).alias("units"))


def blank_fields(live: DataFrame, ledger: DataFrame, costs: DataFrame) -> DataFrame:
    """Live records without a cost, their stock at the class's median cost, and those without a reorder point or supplier."""
    rows = live.join(book_stock(ledger), "item_number", "left").join(costs, "item_number", "left")
    units = F.when(F.col("standard_cost").isNull(), F.greatest(F.coalesce("units", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return rows.agg(
        F.count(F.when(F.col("standard_cost").isNull(), 1)).alias("blank_cost_items"), F.sum(units).alias("blank_cost_units"), F.sum(units * F.col("cost")).alias("blank_cost_value"),
        F.count(F.when(F.col("reorder_point").isNull(), 1)).alias("blank_rop_items"), F.count(F.when(F.col("primary_supplier_id").isNull(), 1)).alias("blank_supplier_items"),
    )


def unit_balances(mismatched: DataFrame, crosswalk: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items bought in another unit, and how many of them stand at or below zero in the books."""
    rows = crosswalk.join(mismatched.select("item_id").distinct(), "item_id").join(book_stock(ledger), "item_number", "left")
    return rows.agg(F.count("*").alias("items"), F.count(F.when(F.coalesce("units", F.lit(0.0)) <= 0, 1)).alias("negative_or_zero_balances"))


def posting_errors(ledger: DataFrame, corrections: DataFrame, costs: DataFrame, p: Params) -> DataFrame:
    """Rows and value of the year's wrong references, keying errors and duplicates, one row a kind."""
    rows = ledger.where(in_year("txn_date", p)).join(corrections.select("txn_id", "correction", "corrected_to"), "txn_id").join(costs, "item_number", "left")
    cost = F.coalesce("cost", F.lit(0.0))
    true = F.coalesce(F.signum("qty") * F.col("corrected_to").try_cast("double"), F.col("qty"))
    value = F.when(F.col("correction").startswith("quantity"), (F.col("qty") - true) * cost).otherwise(F.col("qty") * cost)
    return rows.groupBy("correction").agg(F.count("*").alias("postings"), F.sum(value).alias("value"))


def needless_duplicates(orders: DataFrame, sibling: DataFrame, p: Params) -> DataFrame:
    """Regular lines of the year placed while sibling records held at least as much."""
    rows = orders.where(in_year("order_date", p) & ~F.col("is_rush")).join(sibling.select("po_id", "line", "sibling_stock"), ["po_id", "line"])
    rows = rows.where(F.col("sibling_stock") >= F.col("qty_ordered"))
    return rows.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.col("qty_ordered") * F.col("unit_price")), F.lit(0.0)).alias("value"))


def _measure(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    one = before.toDF("before").crossJoin(F.broadcast(after.toDF("after")))  # one row each
    return one.select(F.lit(name).alias("measure"), F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))


def trust(t: dict[str, DataFrame], p: Params) -> DataFrame:
    """Fourteen measures of how far the system can be trusted, before and after remediation.

    ``t`` names the tables: items, live, dead, lead, recommended, stale, orders,
    clusters, reviewed, attribution, aliases, bill, restored, ledger, counts,
    value (value_by_reliability) and notes.
    """
    start, end = _day(p.remediation_start), _day(p.remediation_end)
    spark = t["items"].sparkSession
    number = lambda x: spark.range(1).select(F.lit(x).cast("double"))
    share = lambda df, condition: df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)))
    counted = lambda df: df.agg(F.count("*").cast("double").alias("n"))

    def ratio(a: DataFrame, b: DataFrame, of=lambda x, y: F.try_divide(x, y)) -> DataFrame:
        return a.toDF("x").crossJoin(F.broadcast(b.toDF("y"))).select(of(F.col("x"), F.col("y")))

    gone = t["dead"].where(F.col("disposition") == "DEACTIVATED")
    left = ratio(counted(t["items"]), counted(gone), lambda x, y: x - y)
    lead = t["lead"].where(F.col("p80_actual_lead_days").isNotNull())
    near = lambda c: F.abs(F.col(c) - F.col("p80_actual_lead_days")) <= p.lead_tolerance_days
    complete = F.col("standard_cost").isNotNull() & F.col("reorder_point").isNotNull() & F.col("primary_supplier_id").isNotNull()

    lines = t["orders"].where(in_year("order_date", p)).withColumn("value", F.col("qty_ordered") * F.col("unit_price"))
    rejected = t["reviewed"].where(F.col("decision") == "REJECT").select(F.col("retired_item_number").alias("item_number"))
    split_clusters = t["clusters"].join(t["clusters"].join(rejected, "item_number", "left_semi").select("primary_item_number").distinct(), "primary_item_number", "left_semi")
    stocked = t["attribution"].where(F.col("probable_item_number").isNotNull())
    marks = {
        "__split": (t["clusters"].select("item_number").distinct(), "item_number"), "__still": (split_clusters.select("item_number").distinct(), "item_number"),
        "__stocked": (stocked.select("po_id").distinct(), "po_id"), "__confirmed": (t["attribution"].where(F.col("confirmation") == "confirmed").select("po_id").distinct(), "po_id"),
        "__alias": (t["aliases"].select(F.col("alias_supplier_id").alias("supplier_id")).distinct(), "supplier_id"),
    }
    for name, (df, key) in marks.items():
        lines = lines.join(df.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    free = F.col("is_generic_item") & F.col("__stocked")
    spent = lambda condition: lines.agg((1 - F.try_divide(F.sum(F.when(condition, F.col("value")).otherwise(0.0)), F.sum("value"))).alias("x"))

    omitted = t["restored"].join(t["bill"], ["product_number", "component_item"], "left_anti").agg(F.count_distinct("product_number").cast("double"))
    products = t["bill"].where(F.col("product_number").startswith("PRD-")).agg(F.count_distinct("product_number").cast("double"))
    adjusted, day = t["ledger"].where(F.col("txn_type") == "ADJUST"), F.col("txn_date")
    open_lines = t["orders"].where(F.col("status") == "OPEN").withColumn("balance", F.greatest(F.col("qty_ordered") - F.coalesce("qty_received", F.lit(0.0)), F.lit(0.0)) * F.col("unit_price"))
    genuine = open_lines.agg(F.try_divide(F.sum(F.when(F.datediff(end, "order_date") <= p.phantom_days, F.col("balance")).otherwise(0.0)), F.sum("balance")))
    value_at = lambda d: t["value"].where(F.col("day") == d).agg(F.try_divide(F.sum(F.when(F.col("reliability") == "reliable", F.col("stock_value")).otherwise(0.0)), F.sum("stock_value")))
    person = ~F.col("user_id").isin(*SHARED_USERS)
    cycle = t["counts"].where(F.col("program") == "CYCLE").withColumn("variance", count_variance())
    first = cycle.where(F.col("count_date") <= end).select("item_number").distinct()
    second = cycle.where(F.col("count_date") > end).join(first, "item_number", "left_semi").groupBy("item_number").agg(F.max_by("variance", F.struct("count_date", "count_id")).alias("variance"))
    within = lambda most: second.agg(F.avg(F.when(F.col("variance") < most, 1.0).otherwise(0.0)))
    rows = [
        _measure("records in use", ratio(counted(t["live"]), counted(t["items"])), ratio(counted(t["live"]), left)),
        _measure("lead times that match delivery", share(lead, near("master_lead_time_days")), share(lead, near("recommended_lead_days"))),
        _measure("reorder points that reflect usage", ratio(counted(t["stale"]), counted(t["recommended"]), lambda x, y: 1 - F.try_divide(x, y)), number(1)),
        _measure("records with complete fields", share(t["live"], complete), number(1)),
        _measure("spend under one part number", spent(F.col("__split") | free), spent(F.col("__still") | (free & ~F.col("__confirmed")))),
        _measure("spend under one supplier record", spent(F.col("__alias")), number(1)),
        _measure("bills that match the floor", ratio(omitted, products, lambda x, y: 1 - F.try_divide(x, y)), number(1)),
        _measure("adjustments with a known cause", share(adjusted.where((day >= F.date_sub(start, 365)) & (day < start)), known_reason()), share(adjusted.where((day > _day(p.reason_code_from)) & (day <= end)), known_reason())),
        _measure("on order that will arrive", genuine, number(1)),
        _measure("postings by an identifiable user", share(t["ledger"].where((day >= F.date_sub(start, 90)) & (day < start)), person), share(t["ledger"].where((day > _day(p.login_from)) & (day <= end)), person)),
        _measure("stock value on reliable records", value_at(start), value_at(end)),
        # the second round of counts has no before
        _measure("recounts within five percent", number(None), within(p.close_count_share)),
        _measure("recounts within ten percent", number(None), within(2 * p.close_count_share)),
        _measure("critical notes brought into the system", number(0), ratio(counted(t["notes"]), counted(t["notes"]))),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def excess_value(ledger: DataFrame, usage: DataFrame, dead: DataFrame, recommended: DataFrame, costs: DataFrame, p: Params) -> DataFrame:
    """One row: value of stock at the start of remediation above the recomputed point and so many days' use, per live item."""
    start = _day(p.remediation_start)
    used = usage.where((F.col("txn_date") >= F.date_sub(start, 365)) & (F.col("txn_date") < start)).groupBy("item_number").agg((F.sum("qty") / 365.0).alias("daily"))
    rows = book_stock(ledger, p.remediation_start).join(dead.select("item_number").distinct(), "item_number", "left_anti")
    rows = rows.join(recommended.groupBy("item_number").agg(F.max("new_reorder_point").alias("point")), "item_number").join(used, "item_number", "left").join(costs, "item_number", "left")
    ceiling = F.col("point") + F.coalesce("daily", F.lit(0.0)) * p.cover_days
    return rows.agg(F.coalesce(F.sum(F.greatest(F.col("units") - ceiling, F.lit(0.0)) * F.coalesce("cost", F.lit(0.0))), F.lit(0.0)).alias("value"))


def cost_rollup(parts: dict[str, DataFrame], p: Params) -> DataFrame:
    """line, value and basis of what the errors cost in the year, and the totals by basis.

    ``parts`` has expedites, duplicates, adjustments and excess, as the functions above return them.
    """
    around = sum(h for h, counts in INTERVIEW_HOURS.values() if counts) * p.work_weeks
    spark = parts["expedites"].sparkSession
    one = lambda df, name, basis: df.toDF("value").select(F.lit(name).alias("line"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"), F.lit(basis).alias("basis"))
    unrecorded = parts["adjustments"].where(F.col("error_group") == "Unrecorded Consumption")
    rows = one(parts["expedites"].where("is_attributable").agg(F.sum("total")), "expedites that errors caused", "measured")
    rows = rows.unionByName(one(parts["duplicates"].select("value"), "purchases while a sibling record held stock", "measured"))
    rows = rows.unionByName(one(unrecorded.agg(F.greatest(F.sum("written_off") - F.sum("written_up"), F.lit(0.0))), "write-offs of unrecorded consumption", "measured"))
    rows = rows.unionByName(one(parts["excess"].select(F.col("value") * p.carrying_rate), "carrying cost of excess stock", "estimated"))
    rows = rows.unionByName(one(spark.range(1).select(F.lit(around * p.labour_rate)), "labour around the records", "estimated"))
    totals = rows.groupBy("basis").agg(F.sum("value").alias("value")).select(F.concat(F.lit("total "), "basis").alias("line"), "value", "basis")
    return rows.unionByName(totals)


def operations(jobs: DataFrame, orders: DataFrame, shortages: DataFrame, bill: DataFrame, restored: DataFrame, stale_leads: DataFrame, stale_points: DataFrame, duplicates: DataFrame, p: Params) -> DataFrame:
    """measure and value of what the errors did to the shop in the year."""
    due = jobs.where(in_year("due_date", p))
    late = F.col("completed_date").isNotNull() & (F.col("completed_date") > F.col("due_date"))
    parts = bill.select("product_number", "component_item").unionByName(restored.select("product_number", "component_item")).distinct()
    hit = parts.join(stale_leads.select(F.col("item_number").alias("component_item")).distinct(), "component_item", "left_semi").select("product_number").distinct()
    regular = orders.where(in_year("order_date", p) & ~F.col("is_rush") & ~F.col("item_number").isin(*GENERIC_ITEMS))
    stale = regular.join(stale_points.select("item_number").distinct(), "item_number", "left_semi")
    short = shortages.where(in_year("date", p))
    facts = due.agg(
        F.count("*").alias("jobs"), F.count(F.when(F.col("delay_days") > 0, 1)).alias("line stops"), F.sum("delay_days").alias("line stop days"),
        F.median(F.when(F.col("delay_days") > 0, F.col("delay_days"))).alias("median stop days"), F.count(F.when(late, 1)).alias("late shipments"), F.count(F.when(late & (F.col("delay_days") > 0), 1)).alias("late shipments after a stop"),
    )
    pieces = [
        facts, short.agg(F.count("*").alias("stockouts"), F.count_distinct("item_number").alias("items short")), due.join(hit, "product_number", "left_semi").agg(F.count("*").alias("jobs promised on stale lead times")),
        hit.agg(F.count("*").alias("products with stale lead times")), regular.agg(F.count("*").alias("regular lines")), stale.agg(F.count("*").alias("lines on stale reorder points")), duplicates.select(F.col("lines").alias("lines while a sibling held stock")),
    ]
    out = None
    for piece in pieces:
        cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").cast("double").alias("value")) for c in piece.columns])
        rows = piece.select(F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out


def headline(costs: DataFrame, capital: DataFrame, operations: DataFrame, counts: DataFrame, charged: DataFrame) -> DataFrame:
    """name and value of the figures that a summary opens with."""
    one = lambda df, name: df.toDF("value").select(F.lit(name).alias("figure"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    out = one(costs.where(F.col("line") == "expedites that errors caused").select("value"), "recurring saving")
    out = out.unionByName(one(capital.agg(F.sum("excess") - F.sum("shortfall")), "working capital, net"))
    for measure in ("stockouts", "line stops", "line stop days"):
        out = out.unionByName(one(operations.where(F.col("measure") == measure).select("value"), measure))
    out = out.unionByName(one(counts.select("net"), "misstatement corrected"))
    return out.unionByName(one(charged.where(F.col("channel") == "BACKFLUSH").select("value"), "product cost understated"))


def samples(rows: DataFrame, by: Column, keys: list[str], n: int = 2) -> DataFrame:
    """The ``n`` rows of the largest ``by``, ties by key."""
    return rows.withColumn("__by", by).orderBy(F.desc_nulls_last("__by"), *keys).limit(n).drop("__by")
