"""Resolution of records to canonical items, and corrections laid over the ledger.

Nothing in a source table is changed: merges, deactivations and corrections are
columns and rows joined at read time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE = ("ISSUE", "BACKFLUSH")
REPOINTED, REQUANTIFIED, REVERSED = "re-pointed to correct item", "quantity corrected", "duplicate posting reversed"


def is_usage(kind: str = "txn_type") -> Column:
    return F.col(kind).isin(*USAGE)


def item_crosswalk(item_master: DataFrame, clusters: DataFrame, obsolete_from: int = 100_000) -> DataFrame:
    """Live records (a number below ``obsolete_from`` after the first hyphen) with the record they resolve to."""
    token = F.split_part("item_number", F.lit("-"), F.lit(2))
    # a token of other than digits gives null, which no comparison keeps
    number = F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))
    live = item_master.select("item_number", number.alias("item_id")).where(F.col("item_id") < obsolete_from)
    return live.join(clusters, "item_number", "left").select("item_number", "item_id", F.coalesce("primary_item_number", "item_number").alias("canonical_item_number"))


def canonical(rows: DataFrame, crosswalk: DataFrame, keep: str = "left") -> DataFrame:
    """Rows with canonical_item_number; records that resolve to nothing stand for themselves."""
    out = rows.join(crosswalk.select("item_number", F.col("canonical_item_number").alias("__resolved")), "item_number", keep)
    return out.withColumn("canonical_item_number", F.coalesce("__resolved", "item_number")).drop("__resolved")


def items_resolved(item_master: DataFrame, crosswalk: DataFrame, dispositions: DataFrame) -> DataFrame:
    """The item master with what each record resolves to, whether it survives and whether it is dead.

    A membership test against a list that has a null is false here, not null.
    """
    dead = dispositions.select("item_number").distinct().withColumn("__dead", F.lit(True))
    out = canonical(item_master, crosswalk).join(dead, "item_number", "left")
    return out.select(*item_master.columns, "canonical_item_number", (F.col("item_number") == F.col("canonical_item_number")).alias("is_survivor"), F.coalesce("__dead", F.lit(False)).alias("is_dead"))


def recorded_usage(ledger: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Issues and backflushes of live records, as positive units by month and Monday week."""
    # the ledger isn't sorted: records are held in memory partition by partition
    out = canonical(ledger.where(is_usage()), crosswalk.hint("shuffle_hash"), "inner")
    return out.select("txn_id", "item_number", "canonical_item_number", "txn_type", F.trunc("txn_date", "month").alias("month"), F.col("txn_week").alias("week"), F.abs("qty").alias("units"))


def null_aware_anti(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``excluded``, as SQL's NOT IN reads it.

    A null among the excluded keys leaves no row; a null key stays only where nothing is excluded.
    """
    facts = excluded.agg(F.count("*").alias("__n"), F.count(F.when(F.col(key).isNull(), 1)).alias("__nulls"))
    out = rows.join(excluded.select(key).distinct(), key, "left_anti")
    out = out.crossJoin(F.broadcast(facts))  # one row
    return out.where((F.col("__nulls") == 0) & (F.col(key).isNotNull() | (F.col("__n") == 0))).select(*rows.columns)


def corrected_ledger(ledger: DataFrame, corrections: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """The ledger without reversed postings, with items re-pointed, quantities corrected and canonical items."""
    of = lambda kind: corrections.where(F.col("correction") == kind)
    rows = null_aware_anti(ledger, of(REVERSED), "txn_id")
    rows = rows.join(of(REPOINTED).select("txn_id", F.col("corrected_to").alias("__item")), "txn_id", "left")
    rows = rows.join(of(REQUANTIFIED).select("txn_id", F.col("corrected_to").try_cast("double").alias("__qty")), "txn_id", "left")
    rows = rows.select(
        "txn_id", "txn_date", "txn_week", "txn_type", "job_id", "reason_code", F.coalesce("__item", "item_number").alias("item_number"), F.coalesce(F.signum("qty") * F.col("__qty"), "qty").alias("qty")
    )
    return canonical(rows, crosswalk)


def usage_corrections(ledger: DataFrame, corrections: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """What corrections change in usage: keying errors of any posting, reversed duplicates of usage postings."""
    wanted = corrections.where(F.col("correction").isin(REQUANTIFIED, REVERSED))
    # the ledger is neither sorted nor resolved: corrections are held in memory partition by partition, and few postings are left
    joined = canonical(ledger.join(wanted.hint("shuffle_hash"), "txn_id"), crosswalk, "inner").withColumn("month", F.trunc("txn_date", "month"))
    keyed = F.col("correction") == REQUANTIFIED
    change = F.when(keyed, F.col("corrected_to").try_cast("double") - F.col("corrected_from").try_cast("double")).otherwise(-F.abs("qty"))
    return joined.where(keyed | is_usage()).select(
        "txn_id", "canonical_item_number", "month", F.col("txn_week").alias("week"), is_usage().alias("is_usage_posting"), F.when(keyed, "keying").otherwise("duplicate").alias("correction"), change.alias("delta")
    )


def supplier_canonical(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Rows with supplier ids resolved through the alias list."""
    names = crosswalk.select(F.col("alias_supplier_id").alias("supplier_id"), F.col("canonical_supplier_id").alias("__supplier"))
    return rows.join(names, "supplier_id", "left").withColumn("supplier_id", F.coalesce("__supplier", "supplier_id")).drop("__supplier")


def effective_bom(bill: DataFrame, prefix: str = "SUB-") -> DataFrame:
    """Components of each product with quantities through one level of subassemblies."""
    sub = F.col("component_item").startswith(prefix)
    top = bill.where(~F.col("product_number").startswith(prefix))
    direct = top.where(~sub).select("product_number", "component_item", "qty_per")
    inner = bill.where(F.col("product_number").startswith(prefix)).select(F.col("product_number").alias("part"), F.col("component_item").alias("inner_item"), F.col("qty_per").alias("inner_qty"))
    through = top.where(sub).join(inner, F.col("component_item") == F.col("part")).select("product_number", F.col("inner_item").alias("component_item"), (F.col("qty_per") * F.col("inner_qty")).alias("qty_per"))
    return direct.unionByName(through).groupBy("product_number", "component_item").agg(F.sum("qty_per").alias("qty_per"))
