"""Queries of the monthly frame, of what merging duplicate records gains, and of what builds take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import signed_quantity
from ..operators import builds, forecast, policy, synthesis, timeseries
from . import oracle
from .warehouse import Warehouse

P = oracle.P
ITEM = "canonical_item_number"

_FRAME = """
select canonical_item_number, t, month, h, list_sum(history[t + 1 : t + h]) as target,
  case when t >= f then 'test' when t >= f - 6 and t + h <= f then 'validation' when t + h <= f - 6 then 'train' else 'gap' end as part,
  (t - ifnull(list_max(list_filter(range(0, t), lambda i: history[i + 1] > 0)), -1) - 1)::int as since_nz,
  list_avg(history[t - 2 : t]) - list_avg(history[t - 5 : t]) as trend, history[t] / (list_avg(history[t - 5 : t]) + 1) as spike,
  quarter(month)::int as quarter, month(month) % 3 = 1 as opens_quarter
from (select *, len(history) - h - 11 as f from monthly join histories using (canonical_item_number) join horizons using (canonical_item_number))
where t >= 12 and t + h <= len(history)"""


def _best(series: str) -> str:
    """Common table expressions over ``series`` (kind, k, history): long, every method's forecast one month ahead, and best, the method of each."""
    smooth = f"lambda a, x: a + {P.croston_alpha}::double * (x - a)"
    return f"""
steps as (select kind, k, history, unnest(range(greatest(12, len(history) - 12), len(history))) as origin from ({series})),
  parts as (select *, list_filter(history[1 : origin], lambda x: x > 0) as sold, list_filter(range(1, origin + 1), lambda i: history[i] > 0) as spots from steps),
  gapped as (select *, list_transform(range(1, len(spots) + 1), lambda i: (spots[i] - ifnull(spots[i - 1], 0))::double) as gaps from parts),
  wide as (select kind, k, origin, history[origin + 1] as actual, history[origin] as naive, list_avg(history[origin - 2 : origin]) as ma3,
    list_reduce(history[1 : origin], lambda l, x: {P.ses_alpha}::double * x + {1 - P.ses_alpha}::double * l) as ses,
    ifnull(list_reduce(case when len(sold) > 0 then sold end, {smooth}) / list_reduce(case when len(gaps) > 0 then gaps end, {smooth}) * {1 - P.croston_alpha / 2}::double, 0) as croston,
    history[origin - 11] as snaive from gapped),
  long as (unpivot wide on naive, ma3, ses, croston, snaive into name method value forecast),
  best as (select kind, k, method, wape from (
    select kind, k, method, list_position(['naive', 'ma3', 'ses', 'croston', 'snaive'], method) as place, round(sum(abs(actual - forecast)) / nullif(sum(actual), 0), 9) as wape from long group by all)
    qualify row_number() over (partition by kind, k order by wape nulls last, place) = 1)"""


_GAIN = f"""
with clusters as (select canonical_item_number, count(*) as records from crosswalk group by 1 having count(*) > 1),
  apart as (select x.item_number as k, list(ifnull(u.s, 0) order by m.t) as history from crosswalk x semi join clusters using (canonical_item_number) cross join months m
    left join (select item_number, month, sum(units)::double as s from usage group by all) u on u.item_number = x.item_number and u.month = m.month group by 1),
{_best("select 'record' as kind, k, history from apart union all select 'item', canonical_item_number, history from histories")},
  summed as (select x.canonical_item_number, origin, sum(actual) as actual, sum(forecast) as forecast from long join best using (kind, k, method) join crosswalk x on x.item_number = k where kind = 'record' group by all),
  errors as (select canonical_item_number, round(sum(abs(actual - forecast)) / nullif(sum(actual), 0), 9) as before from summed group by 1)
select c.canonical_item_number, c.records, e.before, b.wape as after, (e.before - b.wape) / nullif(e.before, 0) as gain
from clusters c join errors e using (canonical_item_number) join best b on b.kind = 'item' and b.k = c.canonical_item_number"""

_TAKEN = """
with whole as (select product_number, component_item, qty_per from stg_bill_of_materials
    union all select product_number, component_item, max(qty_per)::double from stg_bom_change_log where (product_number, component_item) not in (select (product_number, component_item) from stg_bill_of_materials) group by all),
  needs as (select product_number, component_item, sum(qty_per) as qty_per from (
    select product_number, component_item, qty_per from whole where product_number not like 'SUB-%' and component_item not like 'SUB-%'
    union all select a.product_number, b.component_item, a.qty_per * b.qty_per from whole a join whole b on b.product_number = a.component_item where a.product_number not like 'SUB-%') group by all)
"""
_GAPS = f"""{_TAKEN}
select component_item, count(*) as jobs, sum(taken) as taken, sum(booked) as recorded, sum(greatest(taken - booked, 0)) as unrecorded from (
  select n.component_item, n.qty_per * qty_completed as taken, if(completed_date > date '{P.remediation_end}', n.qty_per, ifnull(r.qty_per, 0)) * qty_completed as booked
  from raw_production_orders join needs n using (product_number) left join effective_bom r on r.product_number = n.product_number and r.component_item = n.component_item
  where qty_completed > 0 and completed_date is not null) group by 1"""


_POSTINGS = """
with stock as (select item_number, txn_date, sum(sum(change)) over (partition by item_number order by txn_date) as balance from signed_ledger
    where not (txn_type = 'ADJUST' and ifnull(reason_code, '') in ('COUNT', 'CYCLE')) group by item_number, txn_date),
  seen as (select c.*, ifnull(s.balance, 0) as balance from stg_cycle_counts c asof left join stock s on s.item_number = c.item_number and c.count_date >= s.txn_date),
  booked as (select *, round_even(balance + ifnull(lag(counted_qty - balance) over (partition by item_number order by count_date, count_id), 0), 0)::bigint as system from seen)
select count_id, item_number, count_date, counted_qty::bigint as counted, system, counted_qty::bigint - system as correction from booked"""

_CORRECTED = f"""
select canonical_item_number, round_even(d + b, 0)::bigint as reorder_point, round_even(b, 0)::bigint as safety_stock from (
  select a.canonical_item_number, ifnull(m, 0) * corrected_lead_days / 30 as d, case abc when 'A' then 2.054::double when 'B' then 1.645::double else 1.282::double end * sqrt(greatest(1, ifnull(m, 0) * corrected_lead_days / 30)) as b
  from attributes a left join (select canonical_item_number, sum(units) / 12 as m from usage where month > date '{P.history_end}' - interval 12 month and month <= date '{P.history_end}' group by 1) using (canonical_item_number))"""


def _postings(w: Warehouse) -> DataFrame:
    counted = (F.col("txn_type") == "ADJUST") & F.coalesce("reason_code", F.lit("")).isin("COUNT", "CYCLE")
    rows = synthesis.count_postings(w.stg("cycle_counts").select("count_id", "item_number", "count_date", "counted_qty"), w.stg("inventory_transactions").where(~counted), signed_quantity())
    return rows.select("count_id", "item_number", "count_date", F.col("counted_qty").cast("bigint").alias("counted"), "system", "correction")


def _orders(w: Warehouse) -> DataFrame:
    lines = w.stg("purchase_orders").where(~F.col("is_rush")).withColumn("line_seq", F.struct("po_id", "line")).withColumnRenamed("line", "po_line")
    kinds = w.stg("supplier_master").select("supplier_id", F.when(F.col("supplier_type") == "DISTRIBUTOR", 15).otherwise(2).alias("most"))
    return synthesis.assembled_orders(lines.join(kinds, "supplier_id"), F.col("most")).select("po_id", "po_line", "supplier_id", "order_date", "order_no", "line")


def _gain(w: Warehouse) -> DataFrame:
    several = w.crosswalk.groupBy(ITEM).agg(F.count("*").alias("n")).where("n > 1").select(ITEM)
    members = w.crosswalk.join(several, ITEM).select("item_number", ITEM)
    own = w.usage.groupBy(F.col("item_number").alias(ITEM), "month").agg(F.sum("units").alias("consumption"))
    records = timeseries.dense(own, members.select(F.col("item_number").alias(ITEM)), "month", "1 month")
    merged = w.monthly_grid.join(several, ITEM, "left_semi")
    return forecast.merge_gain(forecast.history_arrays(merged), forecast.history_arrays(records), members, w.params)


def _gaps(w: Warehouse) -> DataFrame:
    rows = builds.backflush_gaps(w.stg("production_orders"), w.stg("bill_of_materials"), w.stg("bom_change_log"), w.params.remediation_end)
    return rows.groupBy("component_item").agg(F.count("*").alias("jobs"), *[F.sum(c).alias(c) for c in ("taken", "recorded", "unrecorded")])


def add_queries(add: Callable[..., None]) -> None:
    add(
        "fc_monthly_frame",
        lambda w: timeseries.monthly_frame(w.monthly_grid, w.attributes).select(ITEM, "t", "month", "h", "target", "part", "since_nz", "trend", "spike", "quarter", "opens_quarter"),
        _FRAME,
        ("target", "trend", "spike"),
    )
    add(
        "fc_one_step",
        lambda w: forecast.best_one_step(forecast.one_step(forecast.history_arrays(w.monthly_grid), w.params)),
        f"with {_best('select 0 as kind, canonical_item_number as k, history from histories')} select k as canonical_item_number, method, wape from best",
        ("wape",),
    )
    add("fc_merge_gain", _gain, _GAIN, ("before", "after", "gain"))
    add(
        "bom_exploded_builds",
        lambda w: builds.exploded_builds(builds.monthly_builds(w.stg("production_orders")), w.stg("bill_of_materials")),
        "select component_item, date_trunc('month', completed_date)::date as month, sum(qty_per * qty_completed) as qty from raw_production_orders join effective_bom using (product_number) where qty_completed > 0 and completed_date is not null group by all",
        ("qty",),
    )
    add("bom_backflush_gaps", _gaps, _GAPS, ("taken", "recorded", "unrecorded"))
    add("gen_order_assembly", _orders)
    add("gen_count_postings", _postings, _POSTINGS)
    add("pol_corrected_master", lambda w: policy.corrected_master(w.usage, w.attributes, w.params.history_end), _CORRECTED)
