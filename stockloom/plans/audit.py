"""Queries of checks, picks by rank, rank correlations, visibility, documents and the textbook loss."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import normal_loss
from ..operators import checks, histories, schedule, tallies, timeseries
from ..operators.checks import Check
from ..operators.resolve import canonical
from ..params import SHARED_USERS
from ..shared import folder
from ..sources import files
from . import learned, oracle, planning
from .warehouse import Warehouse

P = oracle.P
ITEM = "canonical_item_number"
TEST = oracle.TEST
ON_FLOOR = ("ISSUE", "BACKFLUSH", "RECEIPT")
#: Reasons that say nothing of an adjustment, and how many of the dearest A items the buyer tracks.
GENERIC_REASONS, TRACKED = ("", "nan", "ADJ", "VAR", "MISC", "COUNT"), 120


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- realism ---------------------------------------------------------------------

#: What is checked, and the least and most it should be.
BOUNDS = {
    "Item master records": (2200, 2600), "Live share of master (%)": (55, 65), "Inventory transactions": (150_000, 260_000), "PO lines": (15_000, 40_000), "Production orders": (5000, 7500), "Service orders": (3500, 5500),
    "Top 20% live items = % of spend": (70, 85), "Top 20% items = % of consumption value": (70, 80), "Dead items (% of master)": (35, 45), "Dead items still carrying a reorder point (%)": (25, 35),
    "Live items lead-time diff > 3 days (%)": (55, 75), "Live items lead-time diff > 7 days (%)": (20, 30), "Live items in duplicate clusters (%)": (5, 8), "Number of duplicate clusters": (60, 90), "UOM-mismatch items": (40, 55),
    "Live items with a blocking blank field (%)": (10, 15), "Live items item_class = MISC (%)": (10, 14), "Products with a BOM omission (%)": (4, 12), "Adjustment share of quantity moved (%)": (15, 25),
    "Adjustments with blank/generic reason (%)": (60, 75), "Free-text PO lines (%)": (10, 14), "Free-text lines matching a stocked item (%)": (50, 60), "Receipts posted on the peak weekday (%)": (35, 50),
    "PO lines open > 90 days (%)": (5, 8), "Completed jobs left open (%)": (6, 10), "Floor/receiving txns under shared logins (%)": (60, 85),
}


def realism(w: Warehouse) -> DataFrame:
    """Whether volumes, concentration and defect levels are those of a shop of this kind."""
    p = w.params
    token = F.split_part("item_number", F.lit("-"), F.lit(2))
    number = F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))
    master = w.stg("item_master").withColumn("is_dead", F.coalesce(number >= p.obsolete_from, F.lit(False)))
    live, ledger, orders, jobs = master.where(~F.col("is_dead")), w.stg("inventory_transactions"), w.stg("purchase_orders"), w.stg("production_orders")
    names = live.select("item_number").distinct()
    bought = orders.join(names, "item_number", "left_semi").groupBy("item_number").agg(F.sum(F.coalesce("qty_received", F.lit(0.0)) * F.coalesce("unit_price", F.lit(0.0))).alias("value"))
    costs = master.groupBy("item_number").agg(F.coalesce(F.max("standard_cost"), F.lit(0.0)).alias("cost"))
    used = ledger.where(F.col("txn_type").isin("ISSUE", "BACKFLUSH")).join(costs, "item_number", "left").groupBy("item_number").agg(F.sum(F.abs("qty") * F.coalesce("cost", F.lit(0.0))).alias("value"))
    medians = orders.where(F.col("received_date").isNotNull()).groupBy("item_number").agg(F.median("actual_lead_days").alias("median"))
    drift = live.select("item_number", "master_lead_time_days").join(medians, "item_number").select(F.abs(F.col("median") - F.col("master_lead_time_days")).alias("gap")).where("gap is not null")
    clusters = w.stg("duplicate_clusters").agg(F.count_distinct("primary_item_number").alias("n"), F.count("*").alias("records"))
    clusters = clusters.crossJoin(F.broadcast(live.agg(F.count("*").alias("live"))))  # one row each
    bill = w.stg("bill_of_materials")
    omitted = w.stg("bom_change_log").join(bill.select("product_number", "component_item").distinct(), ["product_number", "component_item"], "left_anti").agg(F.count_distinct("product_number").alias("n"))
    products = omitted.crossJoin(F.broadcast(bill.where(F.col("product_number").startswith("PRD-")).agg(F.count_distinct("product_number").alias("products"))))  # one row each
    stocked = w.stg("free_text_attribution").where(F.col("probable_item_number").isNotNull()).select("po_id").distinct().withColumn("stocked", F.lit(True))
    free = orders.where("is_generic_item").join(stocked, "po_id", "left")
    weekdays = ledger.where("txn_type = 'RECEIPT'").groupBy(F.dayofweek("txn_date").alias("weekday")).agg(F.count("*").alias("n"))
    tables = {
        "master": master, "live": live, "ledger": ledger, "orders": orders, "jobs": jobs, "service": w.stg("service_orders"), "spend": timeseries.concentration(bought, "value", "item_number", 0.2, rounded_up=False),
        "used": timeseries.concentration(used, "value", "item_number", 0.2, rounded_up=False), "drift": drift, "clusters": clusters, "mismatch": w.stg("uom_mismatch_items"), "products": products, "free": free, "weekdays": weekdays,
        "before": ledger.where(F.col("txn_date") < F.lit(p.remediation_start).cast("date")), "old": orders.where(F.col("order_date") < F.date_sub(F.lit(p.history_end).cast("date"), p.phantom_days)),
    }
    kind, qty = F.col("txn_type"), F.abs("qty")
    n, adjusted = F.count("*"), F.col("txn_type") == "ADJUST"
    vague = F.col("reason_code").isNull() | F.col("reason_code").isin(*GENERIC_REASONS)
    blank = F.col("standard_cost").isNull() | F.col("reorder_point").isNull() | F.col("primary_supplier_id").isNull()
    of_rows = lambda condition, among: checks.ratio(F.count(F.when(among & condition, 1)), F.count(F.when(among, 1)))
    values = [
        ("master", n), ("master", checks.share(~F.col("is_dead"))), ("ledger", n), ("orders", n), ("jobs", n), ("service", F.count_distinct("order_id")),
        ("spend", 100 * F.first("top_share")), ("used", 100 * F.first("top_share")), ("master", checks.share(F.col("is_dead"))), ("master", of_rows(F.col("reorder_point").isNotNull(), F.col("is_dead"))),
        ("drift", checks.share(F.col("gap") > 3)), ("drift", checks.share(F.col("gap") > 7)), ("clusters", F.first(100 * F.col("n") / F.greatest(F.lit(1), F.col("live") - (F.col("records") - F.col("n"))))), ("clusters", F.first("n")), ("mismatch", n),
        ("live", checks.share(blank)), ("live", checks.share(F.col("item_class") == "MISC")), ("products", F.first(F.try_divide(100 * F.col("n"), F.col("products")))),
        ("before", checks.ratio(F.sum(F.when(adjusted, qty)), F.sum(F.when(kind.isin(*ON_FLOOR), qty)))), ("before", of_rows(vague, adjusted)),
        ("orders", checks.share(F.col("is_generic_item"))), ("free", checks.share(F.col("stocked"))), ("weekdays", checks.ratio(F.max("n"), F.sum("n"))),
        ("old", checks.share(F.col("status") == "OPEN")), ("jobs", of_rows(F.col("status") == "OPEN", F.col("qty_completed") > 0)), ("ledger", of_rows(F.col("user_id").isin(*SHARED_USERS), kind.isin(*ON_FLOOR))),
    ]
    rules = [Check(name, table, value, *BOUNDS[name]) for name, (table, value) in zip(BOUNDS, values, strict=True)]
    return checks.verify(rules, tables).withColumnRenamed("check", "name")


_DEAD = f"ifnull(try_cast(regexp_extract(item_number, '^[^-]*-([0-9]+)(-|$)', 1) as int) >= {P.obsolete_from}, false)"
_PERCENT = "avg(if(ifnull({}, false), 100, 0))"
_REALISM_VALUES = [
    "(select count(*) from master)", f"(select {_PERCENT.format('not is_dead')} from master)", "(select count(*) from stg_inventory_transactions)", "(select count(*) from stg_purchase_orders)", "(select count(*) from raw_production_orders)",
    "(select count(distinct order_id) from raw_service_orders)", "(select 100 * sum(value) filter (place <= floor(n * 0.2)) / sum(value) from bought)", "(select 100 * sum(value) filter (place <= floor(n * 0.2)) / sum(value) from used)",
    f"(select {_PERCENT.format('is_dead')} from master)", f"(select {_PERCENT.format('reorder_point is not null')} from master where is_dead)", f"(select {_PERCENT.format('gap > 3')} from drift)", f"(select {_PERCENT.format('gap > 7')} from drift)",
    "(select 100 * count(distinct primary_item_number) / greatest(1, (select count(*) from master where not is_dead) - (count(*) - count(distinct primary_item_number))) from stg_duplicate_clusters)",
    "(select count(distinct primary_item_number) from stg_duplicate_clusters)", "(select count(*) from stg_uom_mismatch_items)",
    f"(select {_PERCENT.format('standard_cost is null or reorder_point is null or primary_supplier_id is null')} from master where not is_dead)", f"(select {_PERCENT.format(chr(39).join(('item_class = ', 'MISC', '')))} from master where not is_dead)",
    "(select 100 * count(distinct product_number) / (select count(distinct product_number) from stg_bill_of_materials where product_number like 'PRD-%') from dq_07)",
    f"(select 100 * sum(abs(qty)) filter (txn_type = 'ADJUST') / sum(abs(qty)) filter (txn_type in ({_quoted(ON_FLOOR)})) from stg_inventory_transactions where txn_date < date '{P.remediation_start}')",
    f"(select avg(if(reason_code is null or reason_code in ({_quoted(GENERIC_REASONS)}), 100, 0)) from stg_inventory_transactions where txn_date < date '{P.remediation_start}' and txn_type = 'ADJUST')",
    f"(select {_PERCENT.format('is_generic_item')} from stg_purchase_orders)", "(select avg(if(po_id in (select po_id from raw_free_text_attribution where probable_item_number is not null), 100, 0)) from stg_purchase_orders where is_generic_item)",
    "(select 100 * max(n) / sum(n) from (select count(*) as n from stg_inventory_transactions where txn_type = 'RECEIPT' group by dayofweek(txn_date)))",
    f"(select avg(if(status = 'OPEN', 100, 0)) from stg_purchase_orders where order_date < date '{P.history_end}' - {P.phantom_days})", "(select avg(if(status = 'OPEN', 100, 0)) from raw_production_orders where qty_completed > 0)",
    f"(select avg(if(user_id in ({_quoted(SHARED_USERS)}), 100, 0)) from stg_inventory_transactions where txn_type in ({_quoted(ON_FLOOR)}))",
]
_REALISM = f"""
with master as (select *, {_DEAD} as is_dead from stg_item_master),
  ranked as (select item_number, sum(ifnull(qty_received, 0) * ifnull(unit_price, 0)) as value from stg_purchase_orders where item_number in (select item_number from master where not is_dead) group by 1),
  bought as (select value, row_number() over (order by value desc) as place, count(*) over () as n from ranked),
  unit_costs as (select item_number, ifnull(max(standard_cost), 0) as cost from stg_item_master group by 1),
  used_value as (select item_number, sum(abs(qty) * ifnull(cost, 0)) as value from moves left join unit_costs using (item_number) group by 1),
  used as (select value, row_number() over (order by value desc) as place, count(*) over () as n from used_value),
  drift as (select abs(median - master_lead_time_days) as gap from master join (select item_number, median(actual_lead_days) as median from stg_purchase_orders where received_date is not null group by 1) using (item_number) where not is_dead and median - master_lead_time_days is not null),
  found as (select * from (values {", ".join(f"('{name}', {value}::double, {low}::double, {high}::double)" for (name, (low, high)), value in zip(BOUNDS.items(), _REALISM_VALUES, strict=True))}) v(name, value, low, high))
select *, if(ifnull(value between low and high, false), 'PASS', 'FAIL') as status from found"""


# --- integrity -------------------------------------------------------------------

KEYS = {"item_master": ("item_number",), "supplier_master": ("supplier_id",), "inventory_transactions": ("txn_id",), "purchase_orders": ("po_id", "line"), "production_orders": ("order_id",), "cycle_counts": ("count_id",)}
VALUES = {("inventory_transactions", "txn_type"): ("RECEIPT", "ISSUE", "BACKFLUSH", "ADJUST"), ("purchase_orders", "status"): ("OPEN", "CLOSED"), ("production_orders", "status"): ("OPEN", "COMPLETED"), ("item_master", "status"): ("ACTIVE",)}
PARENTS = {("inventory_transactions", "item_number"): ("item_master", "item_number"), ("purchase_orders", "supplier_id"): ("supplier_master", "supplier_id"), ("bill_of_materials", "component_item"): ("item_master", "item_number"), ("purchase_orders", "item_number"): ("item_master", "item_number"), ("item_master", "primary_supplier_id"): ("supplier_master", "supplier_id")}


def integrity(w: Warehouse) -> DataFrame:
    """Rows that repeat a key, hold a value that is none, or point at nothing: none in a sound table."""
    rules = [Check(f"{t}: repeated {', '.join(k)}", t, checks.repeated(*k), None, 0) for t, k in KEYS.items()]
    rules += [Check(f"{t}: strange {c}", t, checks.strays(c, v), None, 0) for (t, c), v in VALUES.items()]
    tables = {t: w.stg(t) for t in {c.table for c in rules}}
    for (t, c), (parent, key) in PARENTS.items():
        tables[f"{t}.{c}"] = checks.orphans(w.stg(t), c, w.stg(parent), key)
        rules.append(Check(f"{t}: {c} without {parent}", f"{t}.{c}", F.count("*"), None, 0))
    return checks.verify(rules, tables).select(F.col("check").alias("name"), F.col("value").cast("bigint").alias("rows"), "status")


_INTEGRITY = "select name, rows::bigint as rows, if(rows = 0, 'PASS', 'FAIL') as status from (" + " union all ".join(
    [f"select '{t}: repeated {', '.join(k)}' as name, count(*) - count(distinct ({', '.join(k)})) filter ({' and '.join(f'{c} is not null' for c in k)}) as rows from stg_{t}" for t, k in KEYS.items()]
    + [f"select '{t}: strange {c}', count(*) filter ({c} not in ({_quoted(v)})) from stg_{t}" for (t, c), v in VALUES.items()]
    + [f"select '{t}: {c} without {p}', count(*) from stg_{t} where {c} is not null and {c} not in (select {k} from stg_{p} where {k} is not null)" for (t, c), (p, k) in PARENTS.items()]
) + ")"


# --- ranks and picks -----------------------------------------------------------------


def _totals(w: Warehouse) -> DataFrame:
    totals = w.monthly_grid.groupBy(ITEM).agg(F.sum("s").alias("total"))
    return totals.join(w.attributes.select(ITEM, "segment"), ITEM)


def _ranked_rows(w: Warehouse) -> DataFrame:
    rows = w.frame(("standard_cost", "corrected_lead_days", "annual_consumption"), stop=TEST - 26)
    rows = rows.where(F.col("target").isNotNull() & (F.col("t") + F.col("h") <= TEST - 26))
    # sums that differ by how they were added up are equal
    return rows.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in RANKED])


RANKED = [*planning.NUMERIC, "target"]


def _rank_matrix(w: Warehouse) -> DataFrame:
    formed = [c for c in RANKED if c in histories.FEATURES]

    def taken(batch: pa.RecordBatch) -> tuple[list[tallies.Numbers], np.ndarray]:
        columns = {c: tallies.numbers(batch.column(c)) for c in RANKED}
        closed = batch.column("t").to_numpy() + columns["h"][0]
        # sums that differ by how they were added up are equal
        return [(tallies.rounded(x, 6), known) for x, known in columns.values()], np.where(columns["target"][1] & (closed <= TEST - 26), 0, -1)

    keep = [c for c in RANKED if c not in formed]
    return tallies.rank_matrix(w.weekly_histories, formed, keep, taken, RANKED, histories.YEAR, TEST - 26, lambda: timeseries.rank_matrix(_ranked_rows(w), RANKED))


_RANKS = f"""
with rows as (select row_number() over () as row, * from (select {", ".join(f"round({c}::double, 6) as {c}" for c in RANKED)} from frame join (select canonical_item_number, standard_cost, corrected_lead_days, annual_consumption from attributes) using (canonical_item_number) where target is not null and t + h <= {TEST - 26})),
  ranked as (select {", ".join(f"if({c} is null, null, rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2) as {c}" for c in RANKED)} from rows)
select a, b, spearman from (select unnest([{", ".join(f"{{'a': '{a}', 'b': '{b}', 'spearman': corr({a}, {b})}}" for i, a in enumerate(RANKED) for b in RANKED[i + 1 :])}], recursive := true) from ranked)"""


# --- visibility ------------------------------------------------------------------------


def _visible(w: Warehouse) -> DataFrame:
    """Component demand of jobs within each item's own lead time, at every month's first day."""
    lines = w.stg("production_orders").join(w.effective_bom, "product_number").withColumnRenamed("component_item", "item_number")
    demand = canonical(lines, w.crosswalk).select(ITEM, F.col("release_date").alias("release"), F.col("due_date").alias("due"), (F.col("qty_ordered") * F.col("qty_per")).alias("qty"))
    months = w.stg("production_orders").agg(F.explode(F.sequence(F.trunc(F.min("release_date"), "month"), F.max("due_date"), F.expr("interval 1 month"))).alias("origin"))
    lead = w.attributes.select(ITEM, F.round("corrected_lead_days").cast("int").alias("lead"))
    return timeseries.visible_within_lead(demand, months, lead)


_VISIBLE = """
with origins as (select unnest(generate_series(date_trunc('month', min(release_date)), max(due_date), interval 1 month))::date as origin from raw_production_orders),
  needs as (select ifnull(x.canonical_item_number, b.component_item) as canonical_item_number, release_date, due_date, qty_ordered * b.qty_per as qty
    from raw_production_orders j join effective_bom b using (product_number) left join crosswalk x on x.item_number = b.component_item)
select canonical_item_number, origin, sum(qty) as visible from needs join attributes using (canonical_item_number)
join origins on due_date > origin and due_date <= origin + round(corrected_lead_days)::int and (release_date is null or release_date <= origin) group by all having sum(qty) > 0"""


# --- documents --------------------------------------------------------------------------


def _path(w: Warehouse, name: str) -> str:
    spark = w.attributes.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    w.keep(spark, path)
    return path


def _schedule_documents(w: Warehouse) -> DataFrame:
    """The schedule as one document an item, with an entry and a point an origin, written, read back and taken apart."""
    rows, path = planning.planned(w), _path(w, "schedule")
    kept = [c for c in rows.columns if c not in (ITEM, "reorder_point")]
    # an item has an entry for each origin, so a document is bounded by the calendar
    entries = F.array_sort(F.collect_list(F.struct("t", *[c for c in kept if c != "t"])))
    points = F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("string"), "reorder_point")))
    files.write_documents(rows.groupBy(ITEM).agg(entries.alias("entries"), points.alias("points")), path)
    fields = ", ".join(f"{c}: {dict(rows.dtypes)[c]}" for c in ["t", *[c for c in kept if c != "t"]])
    read = rows.sparkSession.read.schema(f"{ITEM} string, entries array<struct<{fields}>>, points map<string, double>").json(path)
    out = read.select(ITEM, "points", F.explode("entries").alias("e")).select(ITEM, "e.*", F.col("points")[F.col("e.t").cast("string")].alias("reorder_point"))
    return out.select(*rows.columns)


def _factor_document(w: Warehouse) -> DataFrame:
    """Bias factors by segment as one document with a map, written, read back and taken apart."""
    fixed, path = schedule.corrected(planning.tested(w)), _path(w, "factors")
    factors = fixed.groupBy("segment").agg(F.first("factor").alias("factor"), F.count("*").alias("n"))
    document = factors.agg(F.map_from_entries(F.collect_list(F.struct("segment", F.struct("factor", "n")))).alias("factors"))  # one row a segment
    files.write_documents(document.coalesce(1), path)
    read = files.read_documents(fixed.sparkSession, path, "factors map<string, struct<factor: double, n: bigint>>")
    return read.select(F.explode("factors").alias("segment", "x")).select("segment", "x.factor", "x.n")


def _sorted_ledger(w: Warehouse) -> DataFrame:
    """The ledger written in order, read back, with each posting's place."""
    ledger, path = w.stg("inventory_transactions").select("txn_id", "txn_date", "item_number", "qty"), _path(w, "ledger")
    files.write_sorted(ledger, path, ["txn_date", "txn_id"])
    return timeseries.placed(ledger.sparkSession.read.schema(ledger.schema).parquet(path), ["txn_date", "txn_id"])


_ERF = "list_reduce(list_prepend({'term': x, 'sum': x}, list_transform(range(1, 81), lambda n: {'term': n::double, 'sum': 0::double})), lambda s, e: {'term': s.term * 2 * x * x / (2 * e.term + 1), 'sum': s.sum + s.term * 2 * x * x / (2 * e.term + 1)}).sum * exp(-x * x) * 2 / sqrt(pi())"


def add_queries(add: Callable[..., None]) -> None:
    add("aud_realism", realism, _REALISM, ("value",))
    add("aud_integrity", integrity, _INTEGRITY)
    add(
        "agg_positional",
        lambda w: timeseries.positional(_totals(w), "total", ITEM, 0.6, "segment"),
        "select segment, canonical_item_number, total from (select segment, canonical_item_number, sum(s) as total from monthly join attributes using (canonical_item_number) group by all) qualify row_number() over (partition by segment order by total, canonical_item_number) = floor(count(*) over (partition by segment) * 0.6) + 1",
    )
    add(
        "agg_top_a_items",
        lambda w: w.attributes.where("abc = 'A'").select(ITEM, (F.col("annual_consumption") * F.col("standard_cost")).alias("value")).orderBy(F.desc("value"), ITEM).limit(TRACKED),
        f"select canonical_item_number, annual_consumption * standard_cost as value from attributes where abc = 'A' order by value desc, canonical_item_number limit {TRACKED}",
        ("value",),
    )
    add("agg_rank_matrix", _rank_matrix, _RANKS, ("spearman",))
    add("join_visible_lead", _visible, _VISIBLE, ("visible",))
    add("src_schedule_round_trip", _schedule_documents, "from schedule", ("forecast", "raw", "level", "safety_stock", "reorder_point", "share", "lot"))
    add("src_factor_document", _factor_document, "select segment, sum(target) / sum(pred) as factor, count(*) as n from tested group by 1", ("factor",))
    add("src_sorted_ledger", _sorted_ledger, "select txn_id, txn_date, item_number, qty, row_number() over (order by txn_date, txn_id) as place from stg_inventory_transactions")
    add(
        "pol_normal_loss",
        lambda w: planning.losses(w).select("abc", "k", "loss", normal_loss(F.col("k")).alias("normal")),
        f"select abc, k, loss, exp(-k * k / 2) / sqrt(2 * pi()) - k * (1 - (1 + {_ERF}) / 2) as normal from (select *, k / sqrt(2) as x from losses)",
        ("loss", "normal"),
    )
    add("ml_scales", lambda w: learned.scales(w), f"select canonical_item_number, avg(change) as scale from (select *, abs(s - lag(s) over (partition by canonical_item_number order by t)) as change from grid where t < {TEST}) group by 1", ("scale",))
