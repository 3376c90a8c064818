"""Remediation tables computed from the records: what to close, convert, recompute and attribute.

Where the review that the tables stand for was a person's judgement, a hash of
the record's key decides, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from .resolve import REPOINTED, REQUANTIFIED, REVERSED, canonical

ITEM = "canonical_item_number"


def _draw(*keys: str) -> Column:
    """A number from 0 to 1 by a hash of the key."""
    return F.pmod(F.xxhash64(*keys), F.lit(10_000)) / 10_000.0


def dead_dispositions(items: DataFrame, ledger: DataFrame, p: Params, kept: float = 0.10) -> DataFrame:
    """Obsolete records (numbers from ``p.obsolete_from``) and whether the review kept them; one with a stray movement may be kept."""
    token = F.split_part("item_number", F.lit("-"), F.lit(2))
    dead = items.where(F.when(token.rlike("^[0-9]+$"), token.try_cast("int")) >= p.obsolete_from).select("item_number")
    moved = ledger.where(F.col("txn_date") >= F.add_months(F.lit(p.history_end).cast("date"), -p.dead_lookback_months)).select("item_number").distinct().withColumn("__moved", F.lit(True))
    keep = F.coalesce("__moved", F.lit(False)) & (_draw("item_number") < kept)
    return dead.join(moved, "item_number", "left").select("item_number", F.when(keep, "KEPT").otherwise("DEACTIVATED").alias("disposition"))


def duplicate_decisions(crosswalk: DataFrame, rejected: float = 0.06) -> DataFrame:
    """Retired records of each cluster, merged unless the cluster's review rejected them."""
    rows = crosswalk.where(F.col("item_number") != F.col(ITEM))
    return rows.select(F.col("item_number").alias("retired_item_number"), F.col(ITEM).alias("survivor_item_number"), F.when(_draw(ITEM) < rejected, "REJECT").otherwise("MERGE").alias("decision"))


def supplier_aliases(suppliers: DataFrame) -> DataFrame:
    """Suppliers of equal normalised name, all but the least id pointing to it."""
    least = suppliers.groupBy("supplier_name_norm").agg(F.min("supplier_id").alias("canonical_supplier_id"), F.count("*").alias("n")).where("n > 1")
    out = suppliers.join(least, "supplier_name_norm").where(F.col("supplier_id") != F.col("canonical_supplier_id"))
    return out.select(F.col("supplier_id").alias("alias_supplier_id"), "canonical_supplier_id")


def missing_conversions(mismatches: DataFrame, usual: dict[str, float]) -> DataFrame:
    """A conversion for each item bought in another unit, from the usual contents of the unit."""
    factor = F.lit(None).cast("double")
    for unit, value in usual.items():
        factor = F.when(F.col("purchase_uom") == unit, float(value)).otherwise(factor)
    return mismatches.dropDuplicates(["item_number"]).select("item_number", "purchase_uom", "stock_uom", factor.alias("conversion"))


def lead_times(orders: DataFrame, items: DataFrame, least: int = 3) -> DataFrame:
    """Median and 80th percentile lead time of items with enough receipts; the recommendation rounds half to even."""
    rows = orders.where(F.col("received_date").isNotNull() & ~F.col("is_rush"))
    facts = rows.groupBy("item_number").agg(F.median("actual_lead_days").alias("median_actual_lead_days"), F.percentile("actual_lead_days", 0.8).alias("p80_actual_lead_days"), F.count("*").alias("sample_size")).where(F.col("sample_size") >= least)
    return facts.join(items.select("item_number", "master_lead_time_days"), "item_number").withColumn("recommended_lead_days", F.bround("median_actual_lead_days").cast("int"))


def chronic_adjustments(ledger: DataFrame, bill: DataFrame, restored: DataFrame, p: Params) -> DataFrame:
    """Items written down often in the year to the history's end outside counts, and the likely cause."""
    end = F.lit(p.history_end).cast("date")
    down = ledger.where((F.col("txn_type") == "ADJUST") & (F.col("qty") < 0) & F.col("txn_date").between(F.date_sub(end, p.chronic_days), end) & ~F.coalesce("reason_code", F.lit("")).isin("COUNT", "CYCLE"))
    facts = down.groupBy("item_number").agg(F.count("*").alias("adj_count_12m"), F.sum("qty").alias("net_qty")).where(F.col("adj_count_12m") >= p.chronic_adjustments)
    listed = bill.select(F.col("component_item").alias("item_number")).distinct().withColumn("__on", F.lit(True))
    omitted = restored.select(F.col("component_item").alias("item_number")).distinct().withColumn("__back", F.lit(True))
    out = facts.join(listed, "item_number", "left").join(omitted, "item_number", "left")
    return out.select("item_number", "adj_count_12m", "net_qty", (-F.col("net_qty") / 12).alias("implied_monthly"), F.coalesce("__on", F.lit(False)).alias("on_bom"), F.when(F.col("__back"), "BOM omission").otherwise("Keying").alias("root_cause"))


def closures(orders: DataFrame, jobs: DataFrame, day: str, p: Params) -> DataFrame:
    """Documents to close: order lines open beyond the limit, and open jobs that have completed units, as line 1."""
    today = F.lit(day).cast("date")
    lines = orders.where((F.col("status") == "OPEN") & (F.datediff(today, "order_date") > p.phantom_days)).select(F.lit("PO").alias("document_type"), F.col("po_id").alias("document_id"), "line")
    done = jobs.where((F.col("status") == "OPEN") & (F.col("qty_completed") > 0)).select(F.lit("JOB").alias("document_type"), F.col("order_id").alias("document_id"), F.lit(1).alias("line"))
    return lines.unionByName(done)


def spreadsheet_reconciliation(notes: DataFrame, book: DataFrame, position: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """The buyer's own figure against the books: which is closer to the corrected stock, and what was done.

    ``book`` has item_number and units as the ledger sums them. A note without a figure disagrees with nothing.
    """
    rows = canonical(notes.withColumnRenamed("item_ref", "item_number"), crosswalk).join(position.select(ITEM, "on_hand_units"), ITEM, "left").join(book, "item_number", "left")
    erp = F.greatest(F.coalesce("units", F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("erp_on_hand", erp).withColumn("truth", F.coalesce("on_hand_units", F.lit(0.0)))
    disagree = F.coalesce(F.col("on_hand_estimate") != F.col("erp_on_hand"), F.lit(False))
    closer = F.abs(F.col("on_hand_estimate") - F.col("truth")) < F.abs(F.col("erp_on_hand") - F.col("truth"))
    return rows.select(
        "item_number", F.col("on_hand_estimate").alias("spreadsheet_on_hand"), "erp_on_hand",
        F.when(~disagree, "agree").when(closer, "spreadsheet").otherwise("erp").alias("closer_to_truth"),
        F.when(~disagree, "no change").when(closer, "corrected ERP to counted value").otherwise("kept ERP; spreadsheet updated").alias("action"),
    )


def bill_changes(bill: DataFrame, restored: DataFrame) -> DataFrame:
    """The change log's edges that the recorded bill lacks, with the bill's own quantity of the component elsewhere beside them."""
    usual = bill.groupBy("component_item").agg(F.median("qty_per").alias("usual_qty_per"))
    missing = restored.join(bill.select("product_number", "component_item"), ["product_number", "component_item"], "left_anti")
    return missing.join(usual, "component_item", "left").select("product_number", "component_item", "qty_per", "usual_qty_per")


def posting_corrections(wrong: DataFrame, keyed: DataFrame, doubled: DataFrame) -> DataFrame:
    """The corrections of three kinds of posting error as one table, with what was and what is in words.

    ``wrong`` has txn_id, posted_item_number and correct_item_number; ``keyed`` txn_id, posted_qty and correct_qty; ``doubled`` txn_id and original_txn_id.
    """
    arrow = lambda a, b: F.concat(F.coalesce(F.col(a).cast("string"), F.lit("")), F.lit(" -> "), F.coalesce(F.col(b).cast("string"), F.lit("")))
    one = lambda df, kind, detail: df.select(F.lit(kind).alias("correction"), "txn_id", detail.alias("detail"))
    out = one(wrong, REPOINTED, arrow("posted_item_number", "correct_item_number"))
    out = out.unionByName(one(keyed, REQUANTIFIED, arrow("posted_qty", "correct_qty")))
    return out.unionByName(one(doubled, REVERSED, F.concat(F.lit("duplicate of "), "original_txn_id")))


def attribution_decisions(candidates: DataFrame, sure: float = 0.62) -> DataFrame:
    """Free-text lines with a probable item, confirmed from a confidence on."""
    return candidates.withColumn("confirmation", F.when(F.col("confidence") >= sure, "confirmed").otherwise("rejected"))
