"""The models in DuckDB's SQL, as named views that a query's text collects."""

from __future__ import annotations

import re

from ..params import Params
from ..sources import erp_views

P = Params(obsolete_from=erp_views.OBSOLETE_FROM)
#: Orders that show lead times, and weeks: held-out rows begin, the schedule begins, the last one whose outcome counts.
SINCE, UNTIL = "1999-01-01", "2001-01-01"
TEST, FORWARD, LAST = 300, 326, 356

#: Staged tables that differ from their source in more than order.
STAGED = {
    "item_master": "select * exclude (uom), uom as stock_uom from raw_item_master",
    "supplier_master": "select *, regexp_replace(regexp_replace(lower(supplier_name), '[^a-z]', '', 'g'), '(inc|llc|ltd|plc|co)$', '') as supplier_name_norm from raw_supplier_master",
    "bill_of_materials": "select * replace (qty_per::double as qty_per) from raw_bill_of_materials",
    "purchase_orders": "select * exclude (rush), item_number = any(['NONSTOCK', 'MISC', 'SHOPSUPPLY']) as is_generic_item, rush as is_rush, (received_date - order_date)::bigint as actual_lead_days from raw_purchase_orders",
    "inventory_transactions": "select * exclude (type), type as txn_type, date_trunc('week', txn_date)::date as txn_week from raw_inventory_transactions",
    "cycle_counts": "select *, counted_qty - system_qty as count_variance from raw_cycle_counts",
    "buyer_spreadsheet": "select *, try_cast(nullif(regexp_extract(on_hand_note, '[0-9]+'), '') as int) as on_hand_estimate from raw_buyer_spreadsheet",
    "lead_time_computation": "select item_number, supplier_id, master_lead_time as master_lead_time_days, median_actual as median_actual_lead_days, p80_actual as p80_actual_lead_days, sample_size, recommended_lead_time as recommended_lead_days, computed_date from raw_lead_time_computation",
    "bom_change_log": "select * exclude (source), source as change_source from raw_bom_change_log",
    "posting_corrections": "select *, trim(string_split(detail, '->')[1]) as corrected_from, coalesce(trim(string_split(detail, '->')[2]), '') as corrected_to from raw_posting_corrections",
    "duplicate_clusters": "select item_number, primary_item as primary_item_number from raw_duplicate_clusters",
    "true_direct_demand": "select item_id::int as item_id, month, qty from raw_true_direct_demand",
    "true_backflush": "select item_id::int as item_id, month, qty from raw_true_backflush",
    "abc_by_item": "select item_id::int as item_id, abc from raw_abc_by_item",
    "uom_mismatch_items": "select item_id::int as item_id from raw_uom_mismatch_items",
}

_END = f"date '{P.history_end}'"
_ASOF = f"date '{P.as_of_date}'"

VIEWS: dict[str, str] = {
    # --- resolution
    "crosswalk": f"""
select i.item_number, i.item_id, ifnull(c.primary_item_number, i.item_number) as canonical_item_number
from (select item_number, try_cast(regexp_extract(item_number, '^[^-]*-([0-9]+)(-|$)', 1) as int) as item_id from stg_item_master) i
left join stg_duplicate_clusters c on c.item_number = i.item_number where i.item_id < {P.obsolete_from}""",
    "resolved": """
select i.*, ifnull(x.canonical_item_number, i.item_number) as canonical_item_number,
  x.canonical_item_number is null or x.canonical_item_number = i.item_number as is_survivor,
  exists (from stg_dead_item_dispositions d where d.item_number = i.item_number) as is_dead
from stg_item_master i left join crosswalk x on x.item_number = i.item_number""",
    "live": "from resolved where not is_dead",
    "moves": "select * from stg_inventory_transactions where txn_type = any(['ISSUE', 'BACKFLUSH'])",
    "usage": """
select t.txn_id, t.item_number, x.canonical_item_number, t.txn_type, date_trunc('month', t.txn_date)::date as month, t.txn_week as week, abs(t.qty) as units
from moves t, crosswalk x where x.item_number = t.item_number""",
    "ledger_corrected": """
select t.txn_id, t.txn_date, t.txn_week, t.txn_type, t.job_id, t.reason_code, t.item_number, t.qty, ifnull(x.canonical_item_number, t.item_number) as canonical_item_number
from (
  select l.* replace (ifnull(r.corrected_to, l.item_number) as item_number, ifnull(sign(l.qty) * try_cast(q.corrected_to as double), l.qty) as qty)
  from stg_inventory_transactions l
  anti join (from stg_posting_corrections where correction like 'duplicate%') v on v.txn_id = l.txn_id
  left join (from stg_posting_corrections where correction like 're-pointed%') r on r.txn_id = l.txn_id
  left join (from stg_posting_corrections where correction like 'quantity%') q on q.txn_id = l.txn_id) t
left join crosswalk x on x.item_number = t.item_number""",
    "usage_fixes": """
with known as (select l.*, x.canonical_item_number from stg_inventory_transactions l join crosswalk x on x.item_number = l.item_number)
select k.txn_id, k.canonical_item_number, date_trunc('month', k.txn_date)::date as month, k.txn_week as week, k.txn_type in ('ISSUE', 'BACKFLUSH') as is_usage_posting,
  if(c.correction like 'quantity%', 'keying', 'duplicate') as correction,
  if(c.correction like 'quantity%', try_cast(c.corrected_to as double) - try_cast(c.corrected_from as double), -abs(k.qty)) as delta
from known k join stg_posting_corrections c on c.txn_id = k.txn_id
where c.correction like 'quantity%' or (c.correction like 'duplicate%' and k.txn_type in ('ISSUE', 'BACKFLUSH'))""",
    "effective_bom": """
select product_number, component_item, sum(qty_per) as qty_per from (
  select product_number, component_item, qty_per from stg_bill_of_materials where product_number like 'PRD-%' and component_item not like 'SUB-%'
  union all by name
  select a.product_number, b.component_item, a.qty_per * b.qty_per as qty_per from stg_bill_of_materials a join stg_bill_of_materials b on b.product_number = a.component_item where a.product_number like 'PRD-%')
group by all""",
    # --- data quality
    "dq_01": f"""
select i.item_number, i.item_class, i.last_updated, count(t.txn_id) as movements_24m
from stg_item_master i left join stg_inventory_transactions t on t.item_number = i.item_number and t.txn_date >= {_END} - interval 2 year and t.txn_date <= {_END}
where i.status = 'ACTIVE' and not exists (from stg_purchase_orders p where p.item_number = i.item_number and p.order_date >= {_END} - interval 2 year)
group by all having count(t.txn_id) < 2""",
    "dq_02": f"""
select * from (
  select l.item_number, any_value(l.master_lead_time_days) as master_lead_time_days, quantile_cont(p.actual_lead_days, 0.5) as median_actual_lead_days,
    quantile_cont(p.actual_lead_days, 0.5) - any_value(l.master_lead_time_days) as gap_days, count(*) as receipts
  from live l join stg_purchase_orders p on p.item_number = l.item_number and p.received_date is not null group by l.item_number)
where gap_days not between -{P.stale_lead_gap_days} and {P.stale_lead_gap_days}""",
    "dq_03": f"""
select item_number, abc_class, old_reorder_point, new_reorder_point, new_reorder_point - ifnull(old_reorder_point, 0) as gap_units
from raw_parameter_recommendations where abs(gap_units) >= greatest({P.stale_rop_min_units}, {P.stale_rop_min_share} * greatest(ifnull(old_reorder_point, 0), 1))""",
    "dq_04": """
select x.item_number, x.canonical_item_number, x.item_number = x.canonical_item_number as is_survivor, ifnull((select sum(abs(m.qty)) from moves m where m.item_number = x.item_number), 0) as units_used
from crosswalk x qualify count(*) over (partition by x.canonical_item_number) > 1""",
    "dq_05": "select item_number, x.item_id, item_class, purchase_uom, stock_uom, standard_cost from live join crosswalk x using (item_number) where purchase_uom is distinct from stock_uom and uom_conversion is null",
    "dq_06": """
select item_number, item_class, isnull(standard_cost) as missing_standard_cost, isnull(reorder_point) as missing_reorder_point, isnull(primary_supplier_id) as missing_supplier
from (select *, standard_cost + reorder_point as filled from live) where filled is null or primary_supplier_id is null""".replace("isnull(standard_cost)", "standard_cost is null").replace("isnull(reorder_point)", "reorder_point is null").replace("isnull(primary_supplier_id)", "primary_supplier_id is null"),
    "dq_07": "select product_number, component_item, qty_per, change_date from stg_bom_change_log l where not exists (from stg_bill_of_materials b where (b.product_number, b.component_item) = (l.product_number, l.component_item))",
    "dq_08": "select supplier_id, supplier_name, supplier_name_norm, count(*) over same as n_records from stg_supplier_master window same as (partition by supplier_name_norm) qualify count(*) over same > 1",
    "dq_09": """
select t.txn_id, t.item_number, t.txn_date, t.qty, t.reason_code from stg_inventory_transactions t
where t.txn_type = 'ADJUST' and t.qty < 0 and (t.reason_code is null or not t.reason_code in ('COUNT', 'CYCLE')) and t.item_number in (select item_number from raw_chronic_adjustment_list where root_cause like 'BOM%')""",
    "dq_10": "select txn_id, txn_date, txn_type, qty, corrected_from as posted_item_number, corrected_to as correct_item_number from stg_inventory_transactions natural join (select txn_id, corrected_from, corrected_to from stg_posting_corrections where correction like 're-pointed%')",
    "dq_11": "select txn_id, item_number, txn_date, txn_type, corrected_from::double as posted_qty, corrected_to::double as correct_qty from stg_inventory_transactions natural join (select txn_id, corrected_from, corrected_to from stg_posting_corrections where correction like 'quantity%')",
    "dq_12": f"""
select txn_id, item_number, txn_type, qty, txn_date, (txn_date - before)::bigint as gap_days, exists (from stg_posting_corrections c where c.txn_id = q.txn_id and c.correction like 'duplicate%') as is_confirmed
from (select *, lag(txn_date) over (partition by item_number, txn_type, qty, ifnull(job_id, 'NA'), ifnull(location, 'NA'), ifnull(user_id, 'NA') order by txn_date, txn_time, txn_id) as before
  from stg_inventory_transactions where txn_type <> 'ADJUST') q
where txn_date - before <= {P.duplicate_gap_days}""",
    "dq_13": "select txn_id, item_number, txn_date, qty, reason_code, user_id from stg_inventory_transactions where txn_type = 'ADJUST' and ifnull(reason_code, 'ADJ') in ('ADJ', 'VAR', 'MISC', 'COUNT')",
    "dq_14": "select p.po_id, p.line, p.item_number as generic_code, p.description_text, p.order_date, p.qty_ordered, p.unit_price, f.probable_item_number, f.confidence, f.confirmation from stg_purchase_orders p left join raw_free_text_attribution f on f.po_id = p.po_id where p.is_generic_item",
    "dq_15": "select po_id, line, item_number, supplier_id, order_date, received_date, strftime(received_date, '%A') as posted_weekday from stg_purchase_orders semi join raw_batched_receipts using (po_id, line)",
    "dq_16": f"""
select 'PO' as document_type, po_id as document_id, line, order_date as document_date, qty_ordered - ifnull(qty_received, 0) as open_qty from stg_purchase_orders where status = 'OPEN'
union all by name
select 'JOB' as document_type, order_id as document_id, due_date as document_date, (qty_ordered - qty_completed)::double as open_qty from raw_production_orders where status = 'OPEN' and {_END} > due_date""",
    # --- marts
    "usage_raw": "select canonical_item_number, month, sum(units)::bigint as consumption from usage where canonical_item_number = item_number group by all",
    "usage_merged": "select canonical_item_number, month, sum(units)::bigint as consumption from usage group by all",
    "true_demand": "select canonical_item_number, month, sum(qty)::bigint as consumption from (from stg_true_direct_demand union all from stg_true_backflush) d join (select distinct item_id, canonical_item_number from crosswalk) s using (item_id) group by all",
    "attributes": f"""
with own as (select distinct canonical_item_number, item_id from crosswalk where item_number = canonical_item_number),
  demand as (select canonical_item_number, month, consumption::double as x from true_demand semi join own using (canonical_item_number) where consumption > 0),
  facts as (select canonical_item_number, count(*) as n, (select count(distinct month) from true_demand) / count(*) as adi, pow(stddev_pop(x) / avg(x), 2) as cv2 from demand group by 1),
  year as (select canonical_item_number, sum(consumption) as year from true_demand where month > (select max(month) - interval 1 year from true_demand) group by 1)
select o.canonical_item_number, ifnull(i.standard_cost, 1) as standard_cost, ifnull(i.item_class, 'MISC') as item_class,
  case when ifnull(f.n, 0) < 2 then 'intermittent' else {{(true, true): 0}} end as segment, ifnull(a.abc, 'C') as abc,
  coalesce(l.recommended_lead_days, i.master_lead_time_days, 21)::double as corrected_lead_days, ifnull(y.year, 0)::double as annual_consumption
from own o left join stg_item_master i on i.item_number = o.canonical_item_number left join facts f using (canonical_item_number) left join stg_abc_by_item a on a.item_id = o.item_id
left join stg_lead_time_computation l on l.item_number = o.canonical_item_number left join year y using (canonical_item_number)""".replace(
        "{(true, true): 0}", f"(['lumpy', 'intermittent', 'erratic', 'smooth'])[1 + 2 * (f.adi < {P.adi_cut})::int + (f.cv2 < {P.cv2_cut})::int]"
    ),
    "inventory": f"""
with held as (select canonical_item_number, sum(if(txn_type in ('RECEIPT', 'ADJUST'), qty, -abs(qty))) as held from ledger_corrected where txn_date <= {_ASOF} group by 1),
  due as (select ifnull(x.canonical_item_number, p.item_number) as canonical_item_number, sum(greatest(p.qty_ordered - ifnull(p.qty_received, 0), 0)) as due
    from (from stg_purchase_orders anti join (select document_id as po_id, line from raw_open_document_closures where document_type = 'PO') using (po_id, line)) p left join crosswalk x using (item_number)
    where p.status = 'OPEN' and p.order_date <= {_ASOF} group by 1)
select canonical_item_number, abc, segment, standard_cost, greatest(ifnull(held, 0), 0) as on_hand_units, ifnull(due, 0) as on_order_units, round(greatest(ifnull(held, 0), 0) * standard_cost, 2) as on_hand_value
from attributes left join held using (canonical_item_number) left join due using (canonical_item_number)""",
    "suppliers": """
with lines as (select ifnull(a.canonical_supplier_id, p.supplier_id) as supplier_id, p.* exclude (supplier_id) from stg_purchase_orders p left join raw_supplier_crosswalk a on a.alias_supplier_id = p.supplier_id where p.received_date is not null)
select supplier_id, any_value(s.supplier_name) as supplier_name, any_value(s.supplier_type) as supplier_type, count(*) as received_lines, quantile_cont(actual_lead_days, 0.5) as median_lead_days,
  quantile_cont(actual_lead_days, 0.9) as p90_lead_days, round(count(*) filter (received_date <= promised_date) / count(*), 3) as on_time_share, round(count(*) filter (is_rush) / count(*), 3) as rush_share,
  round(sum(qty_received * unit_price), 2) as spend
from lines left join stg_supplier_master s using (supplier_id) group by supplier_id""",
    # --- time series
    "calendar": "select (row_number() over (order by w) - 1)::int as t, w::date as week from (select unnest(generate_series((select min(week) from usage_weekly), (select max(week) from usage_weekly), interval 7 day)) as w)",
    "grid": "select a.canonical_item_number, c.t, c.week, ifnull(u.consumption, 0)::double as s from attributes a cross join calendar c left join usage_weekly u on u.canonical_item_number = a.canonical_item_number and u.week = c.week",
    "months": "select (row_number() over (order by m) - 1)::int as t, m::date as month from (select unnest(generate_series((select min(month) from usage_merged), (select max(month) from usage_merged), interval 1 month)) as m)",
    "monthly": "select a.canonical_item_number, c.t, c.month, ifnull(u.consumption, 0)::double as s from attributes a cross join months c left join usage_merged u on u.canonical_item_number = a.canonical_item_number and u.month = c.month",
    "histories": "select canonical_item_number, list(s order by t) as history from monthly group by 1",
    "horizons": "select canonical_item_number, greatest(1, round_even(corrected_lead_days / 30, 0))::int as h from attributes",
    "signed_ledger": "select *, case txn_type when 'ADJUST' then qty when 'RECEIPT' then abs(qty) else -abs(qty) end as change from stg_inventory_transactions",
    "balances": "select item_number, txn_date, sum(sum(change)) over (partition by item_number order by txn_date) as balance from signed_ledger group by item_number, txn_date",
    "lookups": "select distinct item_number, count_date as day from stg_cycle_counts",
    "counted": "select item_number, count_date as counted_on, max(if(system_qty <= 0 and counted_qty > 0, 1, abs(counted_qty - system_qty) / greatest(system_qty, 1))) as variance from stg_cycle_counts group by all",
    "costs": "select item_number, coalesce(standard_cost, median(standard_cost) over (partition by item_class), (select median(standard_cost) from stg_item_master)) as cost, standard_cost is null as is_imputed from stg_item_master",
    "duplicate_members": "select distinct item_number from stg_duplicate_clusters",
    "merges": "select retired_item_number as retired, survivor_item_number as survivor from raw_duplicate_crosswalk where decision = 'MERGE'",
    "unit_items": "select item_number from crosswalk semi join stg_uom_mismatch_items using (item_id)",
    "stale_leads": f"select item_number from stg_lead_time_computation where abs(median_actual_lead_days - master_lead_time_days) > {P.stale_lead_gap_days}",
    "item_groups": """
select item_number, case when item_number in (from duplicate_members) then 'Duplicate Item Records' when item_number in (from unit_items) then 'UOM Mismatch'
  when item_number in (select item_number from raw_unrecorded_usage) then 'Unrecorded Consumption' when item_number in (select item_number from dq_03) then 'Stale Reorder Points'
  when item_number in (from stale_leads) then 'Stale Lead Times' when item_number in (select item_number from dq_11) then 'Quantity and Unit Errors'
  when item_number in (select posted_item_number from dq_10 union select correct_item_number from dq_10) then 'Wrong References'
  when item_number in (select item_number from stg_inventory_transactions semi join (select txn_id from stg_posting_corrections where correction like 'duplicate%') using (txn_id)) then 'Duplicate Postings'
  else 'No master error' end as error_group from stg_item_master""",
    "graded": f"""
with asked as (select i.item_number, d.day, d.after from stg_item_master i, (values (date '{P.remediation_start}', false), (date '{P.remediation_end}', true), (date '{P.as_of_date}', true)) d(day, after)
    where i.item_number not in (select item_number from stg_dead_item_dispositions)),
  facts as (select a.item_number, a.day, a.after, c.variance, c.counted_on, (select count(*) from stg_inventory_transactions t where t.item_number = a.item_number and t.txn_type = 'ADJUST' and t.qty < 0
      and coalesce(t.reason_code, '') not in ('COUNT', 'CYCLE') and t.txn_date <= a.day and t.txn_date >= if(a.after, greatest(a.day - 365, date '{P.remediation_end}'), a.day - 365)) as n_events
    from asked a asof left join counted c on c.item_number = a.item_number and c.counted_on <= a.day),
  marks as (select f.*, f.item_number in (from duplicate_members) and not (after and f.item_number in (select retired from merges union select survivor from merges)) as dup,
      f.item_number in (from unit_items) and not (after and f.item_number in (select item_number from raw_uom_conversions u where u.added_date <= f.day)) as unit,
      after and f.item_number in (select retired from merges) as retired from facts f)
select item_number, day, after, n_events, case when retired then null when dup or unit or n_events >= 3 then 'unreliable'
  when day - counted_on <= 90 and variance < 0.05 then 'reliable' else 'uncertain' end as reliability from marks""",
    "graded_value": """
with held as (select g.item_number, g.day, g.after, g.reliability, ifnull(b.balance, 0) as balance from graded g asof left join balances b on b.item_number = g.item_number and b.txn_date <= g.day),
  rolled as (select item_number, day, reliability, balance + if(after, ifnull((select sum(r.balance) from held r join merges m on m.retired = r.item_number where m.survivor = h.item_number and r.day = h.day), 0), 0) as held from held h where reliability is not null)
select day, reliability, count(*) as records, sum(greatest(held, 0) * ifnull(cost, 0)) as stock_value from rolled left join costs using (item_number) group by all""",
    "frame": """
select g.canonical_item_number, g.t, g.week, a.h, if(g.t + a.h <= (select max(t) + 1 from calendar), list_sum(l.history[g.t + 1 : g.t + a.h]), null) as target, s4, s13, s26, s52, nz13, nz52, since_nz, cv13,
  s4 / 4 - s13 / 13 as trend, list_sum(l.history[g.t - 51 : g.t - 52 + least(a.h, 52)]) as ly, list_sum(l.history[1 : g.t]) / g.t as mean_all, weekofyear(g.week)::int as woy, month(g.week)::int as month
from (select *, sum(s) over (w rows between 4 preceding and 1 preceding) as s4, sum(s) over (w rows between 13 preceding and 1 preceding) as s13, sum(s) over (w rows between 26 preceding and 1 preceding) as s26,
    sum(s) over (w rows between 52 preceding and 1 preceding) as s52, count(*) filter (s > 0) over (w rows between 13 preceding and 1 preceding) as nz13, count(*) filter (s > 0) over (w rows between 52 preceding and 1 preceding) as nz52,
    (t - ifnull(max(if(s > 0, t, null)) over (w rows between unbounded preceding and 1 preceding), -1)) as since_nz,
    if(avg(s) over (w rows between 13 preceding and 1 preceding) > 0, stddev_pop(s) over (w rows between 13 preceding and 1 preceding) / avg(s) over (w rows between 13 preceding and 1 preceding), 0) as cv13
  from grid window w as (partition by canonical_item_number order by t)) g
join (select canonical_item_number, greatest(1, round_even(corrected_lead_days / 7, 0))::int as h from attributes) a using (canonical_item_number)
join (select canonical_item_number, list(s order by t) as history from grid group by 1) l using (canonical_item_number) where g.t >= 52""",
    "bases": "select *, s4 / 4 * h as ma4, s13 / 13 * h as ma13, s52 / 52 * h as ma52, ly as snaive from frame",
    "tested": f"select b.*, segment, abc, s13 / 13 * h as pred from bases b join attributes using (canonical_item_number) where target is not null and t >= {TEST} and t + h <= {FORWARD}",
    "methods": """
select segment, arg_min(method, (wape, place)) as method, min(wape) as wape from (
  select segment, method, place, sum(abs(target - f)) / sum(target) as wape from (select segment, target, unnest([{'f': ma4, 'method': 'ma4', 'place': 0}, {'f': ma13, 'method': 'ma13', 'place': 1}, {'f': ma52, 'method': 'ma52', 'place': 2}, {'f': snaive, 'method': 'snaive', 'place': 3}], recursive := true) from tested)
  group by all having sum(target) <> 0) group by 1""",
    "fixed": "select *, pred * ifnull(sum(target) over (partition by segment) / nullif(sum(pred) over (partition by segment), 0), 1) as pred_c from tested",
    "own_spread": "select canonical_item_number, any_value(abc) as abc, any_value(segment) as segment, stddev_samp(target - pred_c) as sd from fixed group by 1",
    "spread": """
select a.canonical_item_number, coalesce(o.sd, s.sd, (select median(sd) from own_spread)) as sd from attributes a left join own_spread o using (canonical_item_number)
left join (select segment, stddev_samp(target - pred_c) as sd from fixed group by 1) s on s.segment = a.segment""",
    "std_errors": "select f.abc, (target - pred_c) / o.sd as z from fixed f join own_spread o using (canonical_item_number) where o.sd > 0",
    "losses": "select abc, round(k / 100, 2) as k, avg(greatest(z - round(k / 100, 2), 0)) as loss from std_errors, (select unnest(range(601)) as k) group by all",
    "lead_spread": f"""
with rows as (select ifnull(x.canonical_item_number, p.item_number) as canonical_item_number, actual_lead_days as d from stg_purchase_orders p left join crosswalk x using (item_number)
  where not is_rush and received_date is not null and order_date >= date '{SINCE}' and order_date < date '{UNTIL}')
select a.canonical_item_number, coalesce(if(o.n >= 4, o.sd, null), c.sd, (select stddev_samp(d) from rows)) as lead_sd from attributes a
left join (select canonical_item_number, count(*) as n, stddev_samp(d) as sd from rows group by 1) o using (canonical_item_number)
left join (select item_class, stddev_samp(d) as sd from rows join attributes using (canonical_item_number) group by 1) c using (item_class)""",
    "unscheduled_shares": f"select ifnull(x.canonical_item_number, m.item_number) as canonical_item_number, 1 - ifnull(sum(abs(qty)) filter (txn_type = 'BACKFLUSH'), 0) / sum(abs(qty)) as unscheduled from moves m left join crosswalk x using (item_number) where txn_date >= date '{SINCE}' and txn_date < date '{UNTIL}' group by 1",
    "seen_days": f"select median(completed_date - release_date)::double as visibility_days, median(release_date - booked_date)::double as order_book_days from raw_production_orders where completed_date is not null and delay_days = 0 and due_date >= date '{SINCE}' and due_date < date '{UNTIL}'",
    "tiers": f"""
with listed as (select distinct ifnull(x.canonical_item_number, c.component_item) as i from (select component_item from stg_bill_of_materials union select component_item from stg_bom_change_log) c left join crosswalk x on x.item_number = c.component_item),
  served as (select distinct ifnull(x.canonical_item_number, t.item_number) as i from stg_inventory_transactions t left join crosswalk x using (item_number) where job_id like 'SO-%' and txn_date >= date '{SINCE}' and txn_date < date '{UNTIL}')
select canonical_item_number, case when canonical_item_number in (from listed) then 'line' when canonical_item_number in (from served) then 'service' else 'standard' end as tier from attributes""",
    "points": f"""
with facts as (select f.canonical_item_number, f.t, f.h, a.abc, a.corrected_lead_days as l, a.standard_cost as cost, tier, s.sd, ifnull(p.lead_sd, 0) as lead_sd, ifnull(u.unscheduled, 1) as share,
    s13 / 13 * f.h * ifnull(b.factor, 1) as pc, (select visibility_days + order_book_days from seen_days) as seen
  from frame f join attributes a using (canonical_item_number) join spread s using (canonical_item_number) join tiers using (canonical_item_number) left join lead_spread p using (canonical_item_number)
  left join unscheduled_shares u using (canonical_item_number) left join (select segment, sum(target) / nullif(sum(pred), 0) as factor from tested group by 1) b on b.segment = a.segment where f.t >= {FORWARD}),
  daily as (select *, pc / (7.0::double * h) as d, sd * sqrt(l / (7.0::double * h)) * sqrt(greatest(0.05::double, 1 - (1 - share) * least(l, seen) / greatest(l, 1))) as sd_fc from facts),
  sized as (select *, sqrt(pow(sd_fc, 2) + pow(d * lead_sd, 2)) as sigma, greatest(1, least(greatest(if(d > 0, sqrt(2 * d * 365 * 35 / (0.25::double * if(cost > 0, cost, 1))), 1), d * 14), d * 120)) as lot from daily),
  tables as (select abc, list(k order by k) as ks, list(loss order by k) as table_of from losses group by 1),
  filled as (select z.*, if(sigma > 0, least(4, ifnull(ks[list_position(list_transform(table_of, lambda x: x <= (1 - if(tier = 'line', 0.99::double, 0.985::double)) * lot / sigma), true)], ks[-1])), 0) * sigma as ss from sized z left join tables using (abc))
select canonical_item_number, t, h, pc as forecast, d * l - (1 - share) * d * l * least(l, seen) / greatest(l, 1) + ss as level, ss as safety_stock, d * l + ss as reorder_point, share, lot from filled""",
    "schedule": f"""
with recursive rows as (select canonical_item_number, t, h, forecast, reorder_point as raw, round(level, 2) as level, round(safety_stock, 2) as safety_stock, round(reorder_point, 2) as applied, round(share, 3) as share, round(lot, 1) as lot from points),
walk as (
  select * from rows where t = {FORWARD}
  union all
  select r.canonical_item_number, r.t, r.h, r.forecast, r.raw, if(w.applied > 0 and abs(r.raw - w.applied) / w.applied <= {P.hysteresis}, w.level, r.level), if(w.applied > 0 and abs(r.raw - w.applied) / w.applied <= {P.hysteresis}, w.safety_stock, r.safety_stock),
    if(w.applied > 0 and abs(r.raw - w.applied) / w.applied <= {P.hysteresis}, w.applied, r.applied), if(w.applied > 0 and abs(r.raw - w.applied) / w.applied <= {P.hysteresis}, w.share, r.share), if(w.applied > 0 and abs(r.raw - w.applied) / w.applied <= {P.hysteresis}, w.lot, r.lot)
  from walk w join rows r on r.canonical_item_number = w.canonical_item_number and r.t = w.t + 1)
select canonical_item_number, t, h, forecast, raw, level, safety_stock, applied as reorder_point, share, lot from walk""",
    "live_rows": f"""
select s.canonical_item_number, s.t, s.forecast, s.safety_stock, b.* exclude (canonical_item_number, t), segment, abc, strftime(b.week, '%Y-%m') as period, b.t + b.h <= {LAST} and target is not null as is_scored,
  case ifnull(m.method, 'ma52') when 'ma4' then ma4 when 'ma13' then ma13 when 'snaive' then snaive else ma52 end as base, target <= s.forecast + s.safety_stock as covered
from schedule s join bases b on b.canonical_item_number = s.canonical_item_number and b.t = s.t join attributes a on a.canonical_item_number = s.canonical_item_number left join methods m using (segment)""",
    "book": "select item_number, sum(change) as units from signed_ledger group by 1",
}


def _clean(period: str, only_usage: bool) -> str:
    return f"""
with base as (select canonical_item_number, {period}, sum(units) as units from usage group by all),
  parts as (
    select canonical_item_number, {period}, 0 as part, 0 as source_no, '' as txn_id, units as delta from base
    union all
    select b.canonical_item_number, b.{period}, 1, u.source_no, '', u.annual_unrecorded * (b.units / greatest(1, sum(b.units) over (partition by b.canonical_item_number, u.source_no)))
    from base b join (select source_no, annual_unrecorded, ifnull(x.canonical_item_number, u.item_number) as canonical_item_number from raw_unrecorded_usage u left join crosswalk x on x.item_number = u.item_number where annual_unrecorded > 0) u using (canonical_item_number)
    union all
    select canonical_item_number, {period}, if(correction = 'keying', 2, 3), 0, txn_id, delta from usage_fixes {"where is_usage_posting" if only_usage else ""})
select canonical_item_number, {period}, greatest(0, list_reduce(list({{'t': delta, 'l': 0::double}} order by part, source_no, txn_id),
  lambda a, x: {{'t': a.t + (x.t - a.l), 'l': ((a.t + (x.t - a.l)) - a.t) - (x.t - a.l)}}).t) as consumption
from parts group by all"""


VIEWS["usage_weekly"] = _clean("week", True)
VIEWS["usage_monthly_clean"] = _clean("month", False)


def _register() -> str:
    from ..operators.quality import REGISTER

    scope = {
        "Item master": "stg_item_master", "Item master (live items)": "live", "Bill of materials": "stg_bill_of_materials", "Supplier master": "stg_supplier_master", "Inventory ledger": "stg_inventory_transactions",
        "Inventory ledger (adjustments)": "(from stg_inventory_transactions where txn_type = 'ADJUST')", "Purchase orders": "stg_purchase_orders", "Production orders": "raw_production_orders",
    }
    lines = []
    for number, name, table in REGISTER:
        what = "count(distinct item_id)" if number == 5 else "count(*)"
        where = {12: " where is_confirmed", 16: f" where document_type = '{'JOB' if table.startswith('Prod') else 'PO'}'"}.get(number, "")
        flagged = f"(select {what} from dq_{number:02d}{where})"
        lines.append(f"select {number}::int as error_no, '{name}' as error, '{table}' as erp_table, {flagged} as rows_flagged, (select count(*) from {scope[table]}){f' + {flagged}' if number == 7 else ''} as rows_in_scope")
    return "\nunion all\n".join(lines)


VIEWS["register"] = _register()


def _definition(name: str) -> str | None:
    if name in VIEWS:
        return VIEWS[name]
    if name.startswith("raw_") and name[4:] in erp_views.VIEWS:
        return erp_views.oracle_sql(name[4:])
    if name.startswith("stg_") and name[4:] in erp_views.VIEWS:
        return STAGED.get(name[4:], f"from raw_{name[4:]}")
    return None


def query(sql: str, doubles: tuple[str, ...] = (), digits: int = 6) -> str:
    """``sql`` with the views it uses in front, and columns of ``doubles`` rounded."""
    order: list[str] = []

    def collect(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", text)):
            if name not in order and name not in path and (found := _definition(name)) is not None:
                collect(found, (*path, name))
                if name not in order:
                    order.append(name)

    collect(sql, ())
    # a text literal may hold a view's name; an unused view costs nothing
    views = ",\n".join(f"{n} as materialized ({_definition(n)})" for n in order)
    columns = f"* replace ({', '.join(f'round({c}, {digits}) as {c}' for c in doubles)})" if doubles else "*"
    return f"with {views}\nselect {columns} from ({sql})"
