"""Readers and writers of extracts, hand-off tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw extracts and reference tables: column -> type, blanks are null.
SCHEMAS: dict[str, str] = {
    "item_master": "item_number string, description string, uom string, purchase_uom string, uom_conversion double, item_class string, standard_cost double, reorder_point double, safety_stock double, master_lead_time_days int, primary_supplier_id string, status string, created_by string, created_date date, last_updated date",
    "supplier_master": "supplier_id string, supplier_name string, supplier_type string, payment_terms string, status string",
    "bill_of_materials": "product_number string, component_item string, qty_per int, uom string, effective_date date",
    "production_orders": "order_id string, product_number string, configuration_code string, qty_ordered int, qty_completed int, customer_id string, booked_date date, release_date date, due_date date, completed_date date, status string, hold_reason string, delay_days int",
    "service_orders": "order_id string, line int, item_number string, customer_id string, order_date date, ship_date date, qty int, unit_price double",
    "purchase_orders": "po_id string, line int, item_number string, description_text string, supplier_id string, order_date date, promised_date date, received_date date, qty_ordered int, qty_received int, unit_price double, status string, rush boolean, freight double",
    "inventory_transactions": "txn_id string, item_number string, txn_date date, txn_time string, type string, qty int, uom string, job_id string, reason_code string, location string, user_id string",
    "cycle_counts": "count_id string, item_number string, count_date date, system_qty int, counted_qty int, counter_id string, program string",
    "buyer_spreadsheet": "item_ref string, on_hand_note string, lead_time_note string, reorder_note string, preferred_supplier_note string, last_updated date",
    "dead_item_dispositions": "item_number string, disposition string, reason string, decided_by string, decision_date date",
    "duplicate_crosswalk": "retired_item_number string, survivor_item_number string, reason string, reviewer string, decision string, decision_date date",
    "supplier_crosswalk": "alias_supplier_id string, canonical_supplier_id string, reason string",
    "uom_conversions": "item_number string, purchase_uom string, stock_uom string, conversion double, added_date date",
    "lead_time_computation": "item_number string, supplier_id string, master_lead_time int, median_actual double, p80_actual double, sample_size int, recommended_lead_time int, computed_date date",
    "parameter_recommendations": "item_number string, abc_class string, service_level double, old_reorder_point double, old_safety_stock double, new_reorder_point double, new_safety_stock double",
    "chronic_adjustment_list": "item_number string, adj_count_12m int, net_qty double, implied_monthly double, on_bom boolean, root_cause string",
    "bom_change_log": "product_number string, component_item string, qty_per double, source string, change_date date",
    "posting_corrections": "correction string, txn_id string, detail string, reviewed_by string, corrected_date date",
    "open_document_closures": "document_type string, document_id string, line int, closed_date date, confirmation_source string",
    "free_text_attribution": "po_id string, probable_item_number string, confidence double, confirmation string",
    "true_direct_demand": "item_id int, month date, qty bigint",
    "true_backflush": "item_id int, month date, qty bigint",
    "duplicate_clusters": "item_number string, primary_item string",
    "abc_by_item": "item_id int, abc string",
    "unrecorded_usage": "source_no int, item_number string, annual_unrecorded double",
    "uom_mismatch_items": "item_id int",
    "batched_receipts": "po_id string, line int",
    "rushes": "date date, item_number string, cause string, freight double, premium_usd double",
    "shortages": "date date, item_number string, cause string, jobs int",
    "unrecorded_events": "date date, item_number string, qty double, channel string",
}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """An extract with a header, by its declared schema; an empty field is null."""
    return spark.read.schema(SCHEMAS[table]).option("header", True).option("mode", "FAILFAST").csv(path)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that is one document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Rows, nested ones too, as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in one order over all files: ranges of it are dealt out, and each is sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
