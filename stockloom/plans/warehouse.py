"""All models over one set of source tables, built on demand."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histories, marts, quality, resolve, staging, timeseries
from ..functions.measures import periods_of_lead
from ..params import Params
from ..shared import removed, written
from ..sources import erp_views, files

ITEM = "canonical_item_number"


class Warehouse:
    """Staged tables and models of one extract. DataFrames are plans; only models that many others read are written when first asked for."""

    def __init__(self, raw: Callable[[str], DataFrame], params: Params | None = None):
        self._raw = raw
        self._staged: dict[str, DataFrame] = {}
        self._paths: list[tuple[SparkSession, str]] = []
        self._built: dict[object, DataFrame] = {}
        self.params = params or Params()

    @classmethod
    def over_star_schema(cls, spark: SparkSession, folder: str, params: Params | None = None) -> Warehouse:
        """The ERP views over part, supplier, lineitem and orders in ``folder``."""

        def raw(name: str) -> DataFrame:
            tables, query = erp_views.VIEWS[name]
            return spark.sql(query, **{t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables})

        return cls(raw, params or Params(obsolete_from=erp_views.OBSOLETE_FROM))

    @classmethod
    def over_extracts(cls, spark: SparkSession, folder: str, params: Params | None = None) -> Warehouse:
        """CSV extracts, one file a table."""
        return cls(lambda name: files.read_csv(spark, f"{folder}/{name}.csv", name), params)

    def _shared(self, df: DataFrame, name: str) -> DataFrame:
        """A model that many others read, written once."""
        out, path = written(df, name)
        self._paths.append((df.sparkSession, path))
        return out

    def once(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        """A further shared model, by a key of the caller's."""
        if key not in self._built:
            self._built[key] = self._shared(build(), "model")
        return self._built[key]

    def keep(self, spark: SparkSession, path: str) -> None:
        """A folder that goes with the shared models, at the latest when the driver ends."""
        self._paths.append((spark, path))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)  # only what exists can be marked
        store.deleteOnExit(at)

    def release(self) -> None:
        """Delete the shared models' tables."""
        while self._paths:
            removed(*self._paths.pop())

    def stg(self, name: str) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = staging.stage(name, self._raw(name))
        return self._staged[name]

    @cached_property
    def crosswalk(self) -> DataFrame:
        return resolve.item_crosswalk(self.stg("item_master"), self.stg("duplicate_clusters"), self.params.obsolete_from)

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve.items_resolved(self.stg("item_master"), self.crosswalk, self.stg("dead_item_dispositions"))

    @cached_property
    def usage(self) -> DataFrame:
        return resolve.recorded_usage(self.stg("inventory_transactions"), self.crosswalk)

    @cached_property
    def ledger(self) -> DataFrame:
        return resolve.corrected_ledger(self.stg("inventory_transactions"), self.stg("posting_corrections"), self.crosswalk)

    @cached_property
    def usage_corrections(self) -> DataFrame:
        return resolve.usage_corrections(self.stg("inventory_transactions"), self.stg("posting_corrections"), self.crosswalk)

    @cached_property
    def effective_bom(self) -> DataFrame:
        return resolve.effective_bom(self.stg("bill_of_materials"))

    def rule(self, number: int) -> DataFrame:
        """The rows that one of the sixteen errors flags."""
        p, s = self.params, self.stg
        ledger, orders, corrections = s("inventory_transactions"), s("purchase_orders"), s("posting_corrections")
        match number:
            case 1:
                return quality.dead_records(s("item_master"), ledger, orders, p)
            case 2:
                return quality.stale_lead_times(self.resolved, orders, p)
            case 3:
                return quality.stale_reorder_points(s("parameter_recommendations"), p)
            case 4:
                return quality.duplicate_items(self.crosswalk, ledger)
            case 5:
                return quality.uom_mismatches(self.resolved, self.crosswalk)
            case 6:
                return quality.missing_fields(self.resolved)
            case 7:
                return quality.bom_omissions(s("bom_change_log"), s("bill_of_materials"))
            case 8:
                return quality.supplier_fragments(s("supplier_master"))
            case 9:
                return quality.unrecorded_consumption(ledger, s("chronic_adjustment_list"))
            case 10:
                return quality.wrong_references(corrections, ledger)
            case 11:
                return quality.quantity_errors(corrections, ledger)
            case 12:
                return quality.duplicate_postings(ledger, corrections, p)
            case 13:
                return quality.catch_all_adjustments(ledger)
            case 14:
                return quality.free_text_purchases(orders, s("free_text_attribution"))
            case 15:
                return quality.batched_postings(orders, s("batched_receipts"))
            case 16:
                return quality.open_documents(orders, s("production_orders"), p)
        raise KeyError(number)

    @cached_property
    def register(self) -> DataFrame:
        ledger = self.stg("inventory_transactions")
        scopes = {
            "Item master": self.stg("item_master"), "Item master (live items)": self.resolved.where(~F.col("is_dead")), "Bill of materials": self.stg("bill_of_materials"), "Supplier master": self.stg("supplier_master"),
            "Inventory ledger": ledger, "Inventory ledger (adjustments)": ledger.where(F.col("txn_type") == "ADJUST"), "Purchase orders": self.stg("purchase_orders"), "Production orders": self.stg("production_orders"),
        }
        documents = self.rule(16)
        flagged = [self.rule(n) for n in range(1, 16)] + [documents.where(F.col("document_type") == kind) for kind in ("PO", "JOB")]
        flagged[11] = flagged[11].where("is_confirmed")
        return quality.error_register(flagged, scopes)

    @cached_property
    def monthly_raw(self) -> DataFrame:
        return marts.consumption_raw(self.usage)

    @cached_property
    def monthly_merged(self) -> DataFrame:
        return marts.consumption_merged(self.usage)

    @cached_property
    def monthly_clean(self) -> DataFrame:
        return marts.consumption_clean(self.usage, self.stg("unrecorded_usage"), self.usage_corrections, self.crosswalk, "month")

    @cached_property
    def weekly_clean(self) -> DataFrame:
        return self._shared(marts.consumption_clean(self.usage, self.stg("unrecorded_usage"), self.usage_corrections.where("is_usage_posting"), self.crosswalk, "week"), "weekly_clean")

    @cached_property
    def true_demand(self) -> DataFrame:
        return self._shared(marts.true_demand(self.stg("true_direct_demand"), self.stg("true_backflush"), self.crosswalk), "true_demand")

    @cached_property
    def attributes(self) -> DataFrame:
        return self._shared(marts.item_attributes(self.stg("item_master"), self.crosswalk, self.true_demand, self.stg("abc_by_item"), self.stg("lead_time_computation"), self.params), "attributes")

    @cached_property
    def position(self) -> DataFrame:
        return self._shared(marts.inventory_position(self.attributes, self.ledger, self.stg("purchase_orders"), self.stg("open_document_closures"), self.crosswalk, self.params), "position")

    @cached_property
    def suppliers(self) -> DataFrame:
        return marts.supplier_performance(self.stg("purchase_orders"), self.stg("supplier_master"), self.stg("supplier_crosswalk"))

    @cached_property
    def weekly_histories(self) -> DataFrame:
        """Attributes, horizon in weeks and cleaned weekly usage of each item, one row an item."""
        return self._shared(self.beside(self.weekly_clean), "histories")

    def beside(self, usage: DataFrame) -> DataFrame:
        """Attributes and horizon of each item beside a weekly usage."""
        return histories.histories(usage, self.attributes.withColumn("h", periods_of_lead(F.col("corrected_lead_days"), 7)))

    def weeks(self, features: list[str], keep: list[str] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
        """Features of the items' weeks, formed anew by each plan that reads them; they are never written."""
        return histories.periods(self.weekly_histories, features, keep, start, stop)

    @cached_property
    def monthly_grid(self) -> DataFrame:
        return timeseries.dense(self.monthly_merged, self.attributes, "month", "1 month")

    def frame(self, keep: tuple[str, ...] = (), start: int = histories.YEAR, stop: int | None = None) -> DataFrame:
        """One row an item and origin: features of the weeks before it, the target from it on, and attributes named in ``keep``."""
        return self.weeks(["week", *histories.FRAME], [ITEM, "h", *keep], start, stop).select(ITEM, "t", "week", "h", *histories.FRAME, *keep)
