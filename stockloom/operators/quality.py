"""Sixteen kinds of record-level error, each a table of the rows that carry it, and their register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import Params
from .resolve import REPOINTED, REQUANTIFIED, REVERSED, USAGE, is_usage, null_aware_anti


def _day(value: str):
    return F.lit(value).cast("date")


def dead_records(items: DataFrame, ledger: DataFrame, orders: DataFrame, p: Params) -> DataFrame:
    """Active records with at most one movement in the look-back and no order since its start.

    Orders after the history's end rescue a record too.
    """
    since = F.add_months(_day(p.history_end), -p.dead_lookback_months)
    moved = ledger.where(F.col("txn_date").between(since, _day(p.history_end))).groupBy("item_number").agg(F.count("*").alias("movements_24m"))
    ordered = orders.where(F.col("order_date") >= since).select("item_number")
    out = items.where(F.col("status") == "ACTIVE").join(moved, "item_number", "left").withColumn("movements_24m", F.coalesce("movements_24m", F.lit(0)))
    return null_aware_anti(out.where(F.col("movements_24m") <= 1), ordered, "item_number").select("item_number", "item_class", "last_updated", "movements_24m")


def stale_lead_times(resolved: DataFrame, orders: DataFrame, p: Params) -> DataFrame:
    """Live records whose master lead time is off the median realised one by more than the allowed gap."""
    realised = orders.where(F.col("received_date").isNotNull()).groupBy("item_number").agg(F.median("actual_lead_days").alias("median_actual_lead_days"), F.count("*").alias("receipts"))
    out = resolved.where(~F.col("is_dead")).join(realised, "item_number").withColumn("gap_days", F.col("median_actual_lead_days") - F.col("master_lead_time_days"))
    return out.where(F.abs("gap_days") > p.stale_lead_gap_days).select("item_number", "master_lead_time_days", "median_actual_lead_days", "gap_days", "receipts")


def stale_reorder_points(recommended: DataFrame, p: Params) -> DataFrame:
    """Points off the recomputed ones by both the least units and the least share; a blank point is 0."""
    old = F.coalesce("old_reorder_point", F.lit(0.0))
    out = recommended.withColumn("gap_units", F.col("new_reorder_point") - old)
    wide = (F.abs("gap_units") >= p.stale_rop_min_units) & (F.abs("gap_units") >= p.stale_rop_min_share * F.greatest(old, F.lit(1.0)))
    return out.where(wide).select("item_number", "abc_class", "old_reorder_point", "new_reorder_point", "gap_units")


def duplicate_items(crosswalk: DataFrame, ledger: DataFrame) -> DataFrame:
    """All records of items with several, and the usage posted to each."""
    several = crosswalk.groupBy("canonical_item_number").agg(F.count("*").alias("n")).where("n > 1").select("canonical_item_number")
    used = ledger.where(is_usage()).groupBy("item_number").agg(F.sum(F.abs("qty")).alias("units_used"))
    out = crosswalk.join(several, "canonical_item_number").join(used, "item_number", "left")
    return out.select("item_number", "canonical_item_number", (F.col("item_number") == F.col("canonical_item_number")).alias("is_survivor"), F.coalesce("units_used", F.lit(0.0)).alias("units_used"))


def uom_mismatches(resolved: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Live records bought in another unit than stocked, without a conversion."""
    bad = resolved.where(~F.col("is_dead") & (F.col("purchase_uom") != F.col("stock_uom")) & F.col("uom_conversion").isNull())
    return bad.join(crosswalk.select("item_number", "item_id"), "item_number").select("item_number", "item_id", "item_class", "purchase_uom", "stock_uom", "standard_cost")


MISSING = {"missing_standard_cost": "standard_cost", "missing_reorder_point": "reorder_point", "missing_supplier": "primary_supplier_id"}


def missing_fields(resolved: DataFrame) -> DataFrame:
    """Live records with a blank cost, reorder point or supplier."""
    out = resolved.where(~F.col("is_dead")).select("item_number", "item_class", *[F.col(c).isNull().alias(n) for n, c in MISSING.items()])
    return out.where(" or ".join(MISSING))


def bom_omissions(changes: DataFrame, bill: DataFrame) -> DataFrame:
    """Restored components that the recorded bill doesn't have."""
    return changes.join(bill, ["product_number", "component_item"], "left_anti").select("product_number", "component_item", "qty_per", "change_date")


def supplier_fragments(suppliers: DataFrame) -> DataFrame:
    """Suppliers whose normalised names several records share."""
    out = suppliers.withColumn("n_records", F.count("*").over(Window.partitionBy("supplier_name_norm")))
    return out.where("n_records > 1").select("supplier_id", "supplier_name", "supplier_name_norm", "n_records")


def unrecorded_consumption(ledger: DataFrame, chronic: DataFrame) -> DataFrame:
    """Write-offs outside the count programs on items that a bill of materials omits; a blank reason counts."""
    omitted = chronic.where(F.col("root_cause") == "BOM omission").select("item_number")
    off = (F.col("txn_type") == "ADJUST") & (F.col("qty") < 0) & ~F.coalesce("reason_code", F.lit("")).isin("COUNT", "CYCLE")
    return ledger.where(off).join(omitted, "item_number").select("txn_id", "item_number", "txn_date", "qty", "reason_code")


def _corrected(corrections: DataFrame, ledger: DataFrame, kind: str) -> DataFrame:
    return corrections.where(F.col("correction") == kind).select("txn_id", "corrected_from", "corrected_to").join(ledger, "txn_id")


def wrong_references(corrections: DataFrame, ledger: DataFrame) -> DataFrame:
    out = _corrected(corrections, ledger, REPOINTED)
    return out.select("txn_id", "txn_date", "txn_type", "qty", F.col("corrected_from").alias("posted_item_number"), F.col("corrected_to").alias("correct_item_number"))


def quantity_errors(corrections: DataFrame, ledger: DataFrame) -> DataFrame:
    out = _corrected(corrections, ledger, REQUANTIFIED)
    return out.select("txn_id", "item_number", "txn_date", "txn_type", F.col("corrected_from").cast("double").alias("posted_qty"), F.col("corrected_to").cast("double").alias("correct_qty"))


def duplicate_postings(ledger: DataFrame, corrections: DataFrame, p: Params) -> DataFrame:
    """Movements equal to one posted at most so many days before, and whether the reversal was confirmed."""
    same = ["item_number", "txn_type", "qty", *[F.coalesce(c, F.lit("NA")) for c in ("job_id", "location", "user_id")]]
    order = Window.partitionBy(*same).orderBy("txn_date", "txn_time", "txn_id")
    out = ledger.where(F.col("txn_type").isin(*USAGE, "RECEIPT")).withColumn("gap_days", F.datediff("txn_date", F.lag("txn_date").over(order)).cast("bigint"))
    confirmed = corrections.where(F.col("correction") == REVERSED).select("txn_id").distinct().withColumn("is_confirmed", F.lit(True))
    out = out.where(F.col("gap_days") <= p.duplicate_gap_days).join(confirmed, "txn_id", "left")
    return out.select("txn_id", "item_number", "txn_type", "qty", "txn_date", "gap_days", F.coalesce("is_confirmed", F.lit(False)).alias("is_confirmed"))


def catch_all_adjustments(ledger: DataFrame) -> DataFrame:
    vague = F.col("reason_code").isNull() | F.col("reason_code").isin("ADJ", "VAR", "MISC", "COUNT")
    return ledger.where((F.col("txn_type") == "ADJUST") & vague).select("txn_id", "item_number", "txn_date", "qty", "reason_code", "user_id")


def free_text_purchases(orders: DataFrame, attribution: DataFrame) -> DataFrame:
    out = orders.where("is_generic_item").join(attribution, "po_id", "left")
    return out.select("po_id", "line", F.col("item_number").alias("generic_code"), "description_text", "order_date", "qty_ordered", "unit_price", "probable_item_number", "confidence", "confirmation")


def batched_postings(orders: DataFrame, batched: DataFrame) -> DataFrame:
    out = orders.join(batched, ["po_id", "line"])
    return out.select("po_id", "line", "item_number", "supplier_id", "order_date", "received_date", F.date_format("received_date", "EEEE").alias("posted_weekday"))


def open_documents(orders: DataFrame, jobs: DataFrame, p: Params) -> DataFrame:
    """Open order lines of any age, and jobs open past their due date at the history's end."""
    is_open = F.col("status") == "OPEN"
    lines = orders.where(is_open).select(
        F.lit("PO").alias("document_type"), F.col("po_id").alias("document_id"), "line", F.col("order_date").alias("document_date"), (F.col("qty_ordered") - F.coalesce("qty_received", F.lit(0.0))).alias("open_qty")
    )
    late = jobs.where(is_open & (F.col("due_date") < _day(p.history_end))).select(
        F.lit("JOB").alias("document_type"), F.col("order_id").alias("document_id"), F.lit(None).cast("int").alias("line"), F.col("due_date").alias("document_date"), (F.col("qty_ordered") - F.col("qty_completed")).cast("double").alias("open_qty")
    )
    return lines.unionByName(late)


#: Number, name and table of every error in the register.
REGISTER = (
    (1, "Dead records never deactivated", "Item master"),
    (2, "Stale lead times", "Item master (live items)"),
    (3, "Stale reorder points", "Item master (live items)"),
    (4, "Duplicate item records", "Item master (live items)"),
    (5, "UOM mismatch", "Item master (live items)"),
    (6, "Missing and placeholder fields", "Item master (live items)"),
    (7, "BOM omissions", "Bill of materials"),
    (8, "Supplier fragmentation", "Supplier master"),
    (9, "Unrecorded consumption", "Inventory ledger"),
    (10, "Wrong references", "Inventory ledger"),
    (11, "Quantity and unit errors", "Inventory ledger"),
    (12, "Duplicate postings", "Inventory ledger"),
    (13, "Adjustments as a catch-all", "Inventory ledger (adjustments)"),
    (14, "Free-text purchases", "Purchase orders"),
    (15, "Batched and backdated postings", "Purchase orders"),
    (16, "Open documents never closed", "Purchase orders"),
    (16, "Open documents never closed", "Production orders"),
)


def error_register(flagged: list[DataFrame], scopes: dict[str, DataFrame]) -> DataFrame:
    """Rows flagged and in scope of every line of REGISTER.

    ``flagged`` has one table a line; ``scopes`` has the tables in scope by
    erp_table, of which each is counted once.
    """
    out = None
    counts = {name: df.agg(F.count("*").alias("rows_in_scope")).withColumn("erp_table", F.lit(name)) for name, df in scopes.items()}
    scope = None
    for c in counts.values():
        scope = c if scope is None else scope.unionByName(c)
    for k, ((number, name, table), rows) in enumerate(zip(REGISTER, flagged, strict=True)):
        # one line counts items rather than records
        count = F.count_distinct("item_id") if number == 5 else F.count("*")
        line = rows.agg(count.alias("rows_flagged")).select(F.lit(k).alias("k"), F.lit(number).alias("error_no"), F.lit(name).alias("error"), F.lit(table).alias("erp_table"), "rows_flagged")
        out = line if out is None else out.unionByName(line)
    out = out.join(F.broadcast(scope), "erp_table")  # one row a table
    # the bill of materials in scope has the omitted lines as well
    total = F.when(F.col("error_no") == 7, F.col("rows_in_scope") + F.col("rows_flagged")).otherwise(F.col("rows_in_scope"))
    return out.select("error_no", "error", "erp_table", "rows_flagged", total.alias("rows_in_scope"))


def rows_with_errors(scopes: list[tuple[str, DataFrame, list[str], list[DataFrame]]]) -> DataFrame:
    """For each table the rows that carry at least one error, and the rows in scope.

    ``scopes`` has a name, the table, its key and the flagged rows of its errors.
    """
    out = None
    for name, table, key, flagged in scopes:
        bad = None
        for rows in flagged:
            keys = rows.select(*key)
            bad = keys if bad is None else bad.unionByName(keys)
        found = table.join(bad.distinct().withColumn("__bad", F.lit(1)), key, "left").agg(F.count("__bad").alias("rows_with_error"), F.count("*").alias("rows_in_scope"))
        found = found.select(F.lit(name).alias("erp_table"), "rows_with_error", "rows_in_scope")
        out = found if out is None else out.unionByName(found)
    return out
