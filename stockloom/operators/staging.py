"""Staging: every source table renamed, typed and given its derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import GENERIC_ITEMS


def normalized_name(name: Column) -> Column:
    """Letters of a company name in lower case, without one legal form at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]", ""), "(inc|llc|ltd|plc|co)$", "")


def first_number(note: Column) -> Column:
    """The first run of digits in a note, null without one."""
    return F.regexp_extract(note, "([0-9]+)", 1).try_cast("int")


def side_of_arrow(detail: Column, part: int) -> Column:
    """The left (1) or right (2) side of ``from -> to``."""
    return F.trim(F.split_part(detail, F.lit("->"), F.lit(part)))


_c = F.col


def _typed(kind: str, *names: str) -> dict[str, Column]:
    return {n: _c(n).cast(kind) for n in names}


def _same(*names: str) -> dict[str, Column]:
    return {n: _c(n) for n in names}


def _columns(table: str) -> dict[str, Column]:
    """Staged columns of a source table, in order."""
    match table:
        case "item_master":
            return {
                **_same("item_number", "description"), "stock_uom": _c("uom"), **_same("purchase_uom"), **_typed("double", "uom_conversion"), **_same("item_class"),
                **_typed("double", "standard_cost", "reorder_point", "safety_stock"), **_typed("int", "master_lead_time_days"),
                **_same("primary_supplier_id", "status", "created_by"), **_typed("date", "created_date", "last_updated"),
            }
        case "supplier_master":
            return {**_same("supplier_id", "supplier_name", "supplier_type", "payment_terms", "status"), "supplier_name_norm": normalized_name(_c("supplier_name"))}
        case "bill_of_materials":
            return {**_same("product_number", "component_item"), **_typed("double", "qty_per"), **_same("uom"), **_typed("date", "effective_date")}
        case "production_orders":
            return {
                **_same("order_id", "product_number", "configuration_code"), **_typed("int", "qty_ordered", "qty_completed"), **_same("customer_id"),
                **_typed("date", "booked_date", "release_date", "due_date", "completed_date"), **_same("status", "hold_reason"), **_typed("int", "delay_days"),
            }
        case "service_orders":
            return {**_same("order_id"), **_typed("int", "line"), **_same("item_number", "customer_id"), **_typed("date", "order_date", "ship_date"), **_typed("double", "qty", "unit_price")}
        case "purchase_orders":
            received, ordered = _c("received_date").cast("date"), _c("order_date").cast("date")
            return {
                **_same("po_id"), **_typed("int", "line"), **_same("item_number", "description_text"), "is_generic_item": _c("item_number").isin(*GENERIC_ITEMS), **_same("supplier_id"),
                **_typed("date", "order_date", "promised_date", "received_date"), **_typed("double", "qty_ordered", "qty_received", "unit_price"), **_same("status"),
                "is_rush": _c("rush").cast("boolean"), **_typed("double", "freight"), "actual_lead_days": F.datediff(received, ordered).cast("bigint"),
            }
        case "inventory_transactions":
            # the time stays zero-padded text: it is only ever an order
            return {
                **_same("txn_id", "item_number"), **_typed("date", "txn_date"), **_same("txn_time"), "txn_week": F.trunc(_c("txn_date").cast("date"), "week"),
                "txn_type": _c("type"), **_typed("double", "qty"), **_same("uom", "job_id", "reason_code", "location", "user_id"),
            }
        case "cycle_counts":
            variance = _c("counted_qty").cast("double") - _c("system_qty").cast("double")
            return {**_same("count_id", "item_number"), **_typed("date", "count_date"), **_typed("double", "system_qty", "counted_qty"), "count_variance": variance, **_same("counter_id", "program")}
        case "buyer_spreadsheet":
            return {**_same("item_ref", "on_hand_note"), "on_hand_estimate": first_number(_c("on_hand_note")), **_same("lead_time_note", "reorder_note", "preferred_supplier_note"), **_typed("date", "last_updated")}
        case "dead_item_dispositions":
            return {**_same("item_number", "disposition", "reason", "decided_by"), **_typed("date", "decision_date")}
        case "duplicate_crosswalk":
            return {**_same("retired_item_number", "survivor_item_number", "reason", "reviewer", "decision"), **_typed("date", "decision_date")}
        case "supplier_crosswalk":
            return _same("alias_supplier_id", "canonical_supplier_id", "reason")
        case "uom_conversions":
            return {**_same("item_number", "purchase_uom", "stock_uom"), **_typed("double", "conversion"), **_typed("date", "added_date")}
        case "lead_time_computation":
            return {
                **_same("item_number", "supplier_id"), "master_lead_time_days": _c("master_lead_time").cast("int"), "median_actual_lead_days": _c("median_actual").cast("double"),
                "p80_actual_lead_days": _c("p80_actual").cast("double"), **_typed("int", "sample_size"), "recommended_lead_days": _c("recommended_lead_time").cast("int"), **_typed("date", "computed_date"),
            }
        case "parameter_recommendations":
            return {**_same("item_number", "abc_class"), **_typed("double", "service_level", "old_reorder_point", "old_safety_stock", "new_reorder_point", "new_safety_stock")}
        case "chronic_adjustment_list":
            return {**_same("item_number"), **_typed("int", "adj_count_12m"), **_typed("double", "net_qty", "implied_monthly"), **_typed("boolean", "on_bom"), **_same("root_cause")}
        case "bom_change_log":
            return {**_same("product_number", "component_item"), **_typed("double", "qty_per"), "change_source": _c("source"), **_typed("date", "change_date")}
        case "posting_corrections":
            return {
                **_same("correction", "txn_id", "detail"), "corrected_from": side_of_arrow(_c("detail"), 1), "corrected_to": side_of_arrow(_c("detail"), 2),
                **_same("reviewed_by"), **_typed("date", "corrected_date"),
            }
        case "open_document_closures":
            return {**_same("document_type", "document_id"), **_typed("int", "line"), **_typed("date", "closed_date"), **_same("confirmation_source")}
        case "free_text_attribution":
            return {**_same("po_id", "probable_item_number"), **_typed("double", "confidence"), **_same("confirmation")}
        case "true_direct_demand" | "true_backflush":
            return {**_typed("int", "item_id"), **_typed("date", "month"), **_typed("bigint", "qty")}
        case "duplicate_clusters":
            return {**_same("item_number"), "primary_item_number": _c("primary_item")}
        case "abc_by_item":
            return {**_typed("int", "item_id"), **_same("abc")}
        case "unrecorded_usage":
            return {**_typed("int", "source_no"), **_same("item_number"), **_typed("double", "annual_unrecorded")}
        case "uom_mismatch_items":
            return _typed("int", "item_id")
        case "rushes":
            return {**_typed("date", "date"), **_same("item_number", "cause"), **_typed("double", "freight", "premium_usd")}
        case "shortages":
            return {**_typed("date", "date"), **_same("item_number", "cause"), **_typed("int", "jobs")}
        case "unrecorded_events":
            return {**_typed("date", "date"), **_same("item_number"), **_typed("double", "qty"), **_same("channel")}
        case "batched_receipts":
            return {**_same("po_id"), **_typed("int", "line")}
    raise KeyError(table)


def stage(table: str, source: DataFrame) -> DataFrame:
    return source.select(*[c.alias(n) for n, c in _columns(table).items()])
