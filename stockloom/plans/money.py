"""Queries of what the errors cost and how far records can be trusted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import finance, reliability
from ..params import ERROR_CAUSES, GENERIC_ITEMS, SHARED_USERS, VAGUE_REASONS
from . import oracle
from .warehouse import Warehouse

P = oracle.P


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_START, _END, _YEAR = f"date '{P.remediation_start}'", f"date '{P.remediation_end}'", P.cost_year
_KNOWN = f"(reason_code is not null and reason_code not in ({_list(VAGUE_REASONS)}))"
_ADJUSTMENTS = f"""
select error_group, count(*) as adjustments, sum(greatest(-v, 0)) as written_off, sum(greatest(v, 0)) as written_up, count(*) filter (not known) as generic_reasons,
  sum(if(known, 0, abs(v))) as generic_value, count(*) filter (reason_code in ('COUNT', 'CYCLE')) as count_rows
from (select ifnull(g.error_group, 'No master error') as error_group, t.qty * ifnull(c.cost, 0) as v, {_KNOWN} as known, reason_code
  from stg_inventory_transactions t left join item_groups g using (item_number) left join costs c using (item_number)
  where t.txn_type = 'ADJUST' and year(t.txn_date) = {_YEAR} and t.item_number not in (select item_number from stg_dead_item_dispositions)) group by 1"""
_EXPEDITES = f"""
select cause, ifnull(lines, 0) as lines, ifnull(freight, 0) as freight, ifnull(premium, 0) as premium, ifnull(freight, 0) + ifnull(premium, 0) as total, cause in ({_list(ERROR_CAUSES)}) as is_attributable
from (select cause, count(*) as lines, sum(freight) as freight, sum(premium_usd) as premium from raw_rushes where year(date) = {_YEAR} group by 1)
full join (select unnest([{_list(ERROR_CAUSES)}]) as cause) using (cause)"""
_DUPLICATES = f"""
with pairs as (select p.po_id, p.line, p.qty_ordered, p.unit_price, p.order_date as day, s.item_number as sibling from stg_purchase_orders p join crosswalk x on x.item_number = p.item_number
    join crosswalk s on s.canonical_item_number = x.canonical_item_number and s.item_number <> p.item_number where year(p.order_date) = {_YEAR} and not p.is_rush),
  held as (select q.po_id, q.line, any_value(q.qty_ordered) as qty, any_value(q.unit_price) as price, sum(greatest(ifnull(b.balance, 0), 0)) as held from pairs q asof left join balances b on b.item_number = q.sibling and b.txn_date <= q.day group by 1, 2)
select count(*) as lines, ifnull(sum(qty * price), 0) as value from held where held >= qty and held > 0"""
_EXCESS = f"""
select ifnull(sum(greatest(b.units - (r.point + ifnull(u.daily, 0) * {P.cover_days}), 0) * ifnull(c.cost, 0)), 0) as value
from (select item_number, sum(change) as units from signed_ledger where txn_date < {_START} group by 1) b
join (select item_number, max(new_reorder_point) as point from raw_parameter_recommendations group by 1) r using (item_number) left join costs c using (item_number)
left join (select item_number, sum(qty) / 365.0::double as daily from moves where txn_date >= {_START} - 365 and txn_date < {_START} group by 1) u using (item_number)
where item_number not in (select item_number from stg_dead_item_dispositions)"""
_CAPITAL = """
with as_is as (select b.item_number, greatest(b.units, 0) * cost as a from book b join costs using (item_number)),
  corrected as (select canonical_item_number as item_number, on_hand_units * cost as c from inventory join costs on costs.item_number = canonical_item_number),
  both_sides as (select item_number, a - ifnull(c, 0) as off, ifnull(error_group, 'No master error') as error_group from as_is left join corrected using (item_number) left join item_groups using (item_number))
select error_group, count(*) as items, sum(greatest(off, 0)) as excess, sum(greatest(-off, 0)) as shortfall, count(*) filter (off > 0) as items_excess, count(*) filter (off < 0) as items_shortfall from both_sides group by 1"""
_CHARGED = f"select channel, count(*) as events, count(distinct item_number) as items, sum(qty * ifnull(cost, 0)) as value from raw_unrecorded_events left join costs using (item_number) where year(date) = {_YEAR} group by 1"
_COUNTS = "select count(*) as counts, sum(greatest(-d, 0)) as write_down, sum(greatest(d, 0)) as write_up, sum(d) as net from (select (counted_qty - system_qty) * ifnull(cost, 0) as d from stg_cycle_counts left join costs using (item_number) where program = 'CYCLE')"
_COST = f"""
with lines as (
  select 'expedites that errors caused' as line, (select sum(total) from ({_EXPEDITES}) where is_attributable) as value, 'measured' as basis
  union all select 'purchases while a sibling record held stock', (select value from ({_DUPLICATES})), 'measured'
  union all select 'write-offs of unrecorded consumption', (select greatest(sum(written_off) - sum(written_up), 0) from ({_ADJUSTMENTS}) where error_group = 'Unrecorded Consumption'), 'measured'
  union all select 'carrying cost of excess stock', (select value * 0.22::double from ({_EXCESS})), 'estimated'
  union all select 'labour around the records', (6 + 8) * 50 * 38.0::double, 'estimated')
select line, ifnull(value, 0) as value, basis from lines union all select 'total ' || basis, sum(ifnull(value, 0)), basis from lines group by basis"""
_OPERATIONS = f"""
with due as (select * from raw_production_orders where year(due_date) = {_YEAR}),
  hit as (select distinct product_number from (select product_number, component_item from stg_bill_of_materials union select product_number, component_item from stg_bom_change_log) where component_item in (from stale_leads)),
  regular as (select * from stg_purchase_orders where year(order_date) = {_YEAR} and not is_rush and item_number not in ({_list(GENERIC_ITEMS)})),
  facts as (select count(*) as jobs, count(*) filter (delay_days > 0) as stops, sum(delay_days) as days, median(delay_days) filter (delay_days > 0) as middle, count(*) filter (completed_date > due_date) as late,
    count(*) filter (completed_date > due_date and delay_days > 0) as late_stops from due)
select measure, value::double as value from (
  select 'jobs' as measure, jobs as value from facts union all select 'line stops', stops from facts union all select 'line stop days', days from facts union all select 'median stop days', middle from facts
  union all select 'late shipments', late from facts union all select 'late shipments after a stop', late_stops from facts
  union all select 'stockouts', count(*) from raw_shortages where year(date) = {_YEAR} union all select 'items short', count(distinct item_number) from raw_shortages where year(date) = {_YEAR}
  union all select 'jobs promised on stale lead times', count(*) from due where product_number in (from hit) union all select 'products with stale lead times', count(*) from hit
  union all select 'regular lines', count(*) from regular union all select 'lines on stale reorder points', count(*) from regular where item_number in (select item_number from dq_03)
  union all select 'lines while a sibling held stock', lines from ({_DUPLICATES}))"""
_TRUST = f"""
with n as (select (select count(*) from stg_item_master) as items, (select count(*) from live) as live, (select count(*) from stg_dead_item_dispositions where disposition = 'DEACTIVATED') as gone),
  lead as (select * from stg_lead_time_computation where p80_actual_lead_days is not null),
  rejected as (select item_number from stg_duplicate_clusters where primary_item_number in (select primary_item_number from stg_duplicate_clusters where item_number in (select retired_item_number from raw_duplicate_crosswalk where decision = 'REJECT'))),
  lines as (select *, qty_ordered * unit_price as v, is_generic_item and po_id in (select po_id from raw_free_text_attribution where probable_item_number is not null) as free,
    po_id in (select po_id from raw_free_text_attribution where confirmation = 'confirmed') as sure, item_number in (from duplicate_members) as split, item_number in (from rejected) as still,
    supplier_id in (select alias_supplier_id from raw_supplier_crosswalk) as alias from stg_purchase_orders where year(order_date) = {_YEAR}),
  adjusted as (select txn_date, {_KNOWN} as known from stg_inventory_transactions where txn_type = 'ADJUST'),
  users as (select txn_date, user_id not in ({_list(SHARED_USERS)}) as person from stg_inventory_transactions),
  open_lines as (select greatest(qty_ordered - ifnull(qty_received, 0), 0) * unit_price as v, {_END} - order_date <= {P.phantom_days} as fresh from stg_purchase_orders where status = 'OPEN'),
  cycle as (select *, if(system_qty <= 0 and counted_qty > 0, 1, abs(counted_qty - system_qty) / greatest(system_qty, 1)) as variance from stg_cycle_counts where program = 'CYCLE'),
  second as (select arg_max(variance, (count_date, count_id)) as variance from cycle where count_date > {_END} and item_number in (select item_number from cycle where count_date <= {_END}) group by item_number)
select measure, before::double as before, after::double as after from (
  select 'records in use' as measure, live / items as before, live / (items - gone) as after from n
  union all select 'lead times that match delivery', avg(if(abs(master_lead_time_days - p80_actual_lead_days) <= 3, 1, 0)), avg(if(abs(recommended_lead_days - p80_actual_lead_days) <= 3, 1, 0)) from lead
  union all select 'reorder points that reflect usage', 1 - (select count(*) from dq_03) / (select count(*) from raw_parameter_recommendations), 1
  union all select 'records with complete fields', avg(if(standard_cost is null or reorder_point is null or primary_supplier_id is null, 0, 1)), 1 from live
  union all select 'spend under one part number', 1 - sum(if(split or free, v, 0)) / sum(v), 1 - sum(if(still or (free and not sure), v, 0)) / sum(v) from lines
  union all select 'spend under one supplier record', 1 - sum(if(alias, v, 0)) / sum(v), 1 from lines
  union all select 'bills that match the floor', 1 - (select count(distinct product_number) from dq_07) / (select count(distinct product_number) from stg_bill_of_materials where product_number like 'PRD-%'), 1
  union all select 'adjustments with a known cause', (select avg(if(known, 1, 0)) from adjusted where txn_date >= {_START} - 365 and txn_date < {_START}), (select avg(if(known, 1, 0)) from adjusted where txn_date > date '{P.reason_code_from}' and txn_date <= {_END})
  union all select 'on order that will arrive', sum(if(fresh, v, 0)) / sum(v), 1 from open_lines
  union all select 'postings by an identifiable user', (select avg(if(person, 1, 0)) from users where txn_date >= {_START} - 90 and txn_date < {_START}), (select avg(if(person, 1, 0)) from users where txn_date > date '{P.login_from}' and txn_date <= {_END})
  union all select 'stock value on reliable records', (select sum(stock_value) filter (reliability = 'reliable') / sum(stock_value) from graded_value where day = {_START}), (select sum(stock_value) filter (reliability = 'reliable') / sum(stock_value) from graded_value where day = {_END})
  union all select 'recounts within five percent', null, (select avg(if(variance < 0.05, 1, 0)) from second)
  union all select 'recounts within ten percent', null, (select avg(if(variance < 0.1, 1, 0)) from second)
  union all select 'critical notes brought into the system', 0, 1)"""
_HEADLINE = f"""
select figure, ifnull(value, 0)::double as value from (
  select 'recurring saving' as figure, (select sum(total) from ({_EXPEDITES}) where is_attributable) as value union all select 'working capital, net', (select sum(excess) - sum(shortfall) from ({_CAPITAL}))
  union all select measure, value from ({_OPERATIONS}) where measure in ('stockouts', 'line stops', 'line stop days')
  union all select 'misstatement corrected', (select net from ({_COUNTS})) union all select 'product cost understated', (select value from ({_CHARGED}) where channel = 'BACKFLUSH'))"""


def _groups(w: Warehouse) -> DataFrame:
    lead = w.stg("lead_time_computation").where(F.abs(F.col("median_actual_lead_days") - F.col("master_lead_time_days")) > w.params.stale_lead_gap_days)
    wrong = w.rule(10)
    referred = wrong.select(F.col("posted_item_number").alias("item_number")).unionByName(wrong.select(F.col("correct_item_number").alias("item_number")))
    doubled = w.stg("inventory_transactions").join(w.stg("posting_corrections").where(F.col("correction").startswith("duplicate")).select("txn_id"), "txn_id", "left_semi")
    return finance.error_group(w.stg("item_master"), [
        ("Duplicate Item Records", w.stg("duplicate_clusters")), ("UOM Mismatch", w.crosswalk.join(w.stg("uom_mismatch_items"), "item_id")), ("Unrecorded Consumption", w.stg("unrecorded_usage")),
        ("Stale Reorder Points", w.rule(3)), ("Stale Lead Times", lead), ("Quantity and Unit Errors", w.rule(11)), ("Wrong References", referred), ("Duplicate Postings", doubled),
    ])


def add_queries(add: Callable, graded: Callable[[Warehouse], DataFrame], costs: Callable[[Warehouse], DataFrame]) -> None:
    """Register this module's queries."""
    ledger = lambda w: w.stg("inventory_transactions")
    dead = lambda w: w.stg("dead_item_dispositions")
    stale_leads = lambda w: w.stg("lead_time_computation").where(F.abs(F.col("median_actual_lead_days") - F.col("master_lead_time_days")) > w.params.stale_lead_gap_days)
    adjusted = lambda w: finance.adjustments(ledger(w), dead(w), _groups(w), costs(w), w.params)
    expedited = lambda w: finance.expedites(w.stg("rushes"), w.params)
    duplicated = lambda w: finance.needless_duplicates(w.stg("purchase_orders"), reliability.sibling_stock(w.stg("purchase_orders"), w.crosswalk, ledger(w)), w.params)
    usage = lambda w: ledger(w).where(F.col("txn_type").isin("ISSUE", "BACKFLUSH"))
    excess = lambda w: finance.excess_value(ledger(w), usage(w), dead(w), w.stg("parameter_recommendations"), costs(w), w.params)
    charged = lambda w: finance.never_charged(w.stg("unrecorded_events"), costs(w), w.params)
    counted = lambda w: finance.count_corrections(w.stg("cycle_counts"), costs(w))

    def capital(w: Warehouse) -> DataFrame:
        as_is = finance.book_stock(ledger(w)).join(costs(w), "item_number").select("item_number", (F.greatest(F.col("units"), F.lit(0.0)) * F.col("cost")).alias("value"))
        right = w.position.select(F.col("canonical_item_number").alias("item_number"), "on_hand_units").join(costs(w), "item_number").select("item_number", (F.col("on_hand_units") * F.col("cost")).alias("value"))
        return finance.working_capital(as_is, right, _groups(w))

    def cost(w: Warehouse) -> DataFrame:
        return finance.cost_rollup({"expedites": expedited(w), "duplicates": duplicated(w), "adjustments": adjusted(w), "excess": excess(w)}, w.params)

    def operations(w: Warehouse) -> DataFrame:
        return finance.operations(w.stg("production_orders"), w.stg("purchase_orders"), w.stg("shortages"), w.stg("bill_of_materials"), w.stg("bom_change_log"), stale_leads(w), w.rule(3), duplicated(w), w.params)

    def trust(w: Warehouse) -> DataFrame:
        s = w.stg
        return finance.trust({
            "items": s("item_master"), "live": w.resolved.where(~F.col("is_dead")), "dead": dead(w), "lead": s("lead_time_computation"), "recommended": s("parameter_recommendations"), "stale": w.rule(3),
            "orders": s("purchase_orders"), "clusters": s("duplicate_clusters"), "reviewed": s("duplicate_crosswalk"), "attribution": s("free_text_attribution"), "aliases": s("supplier_crosswalk"),
            "bill": s("bill_of_materials"), "restored": s("bom_change_log"), "ledger": ledger(w), "counts": s("cycle_counts"), "notes": s("buyer_spreadsheet"),
            "value": reliability.value_by_reliability(graded(w), costs(w), s("duplicate_crosswalk")),
        }, w.params)

    add("fin_error_groups", _groups, "from item_groups")
    add("fin_expedites", expedited, _EXPEDITES, ("freight", "premium", "total"))
    add("fin_shortages", lambda w: finance.shortages_by_cause(w.stg("shortages"), w.params), f"select cause, count(*) as episodes, count(distinct item_number) as items, sum(jobs)::bigint as jobs_held from raw_shortages where year(date) = {_YEAR} group by 1")
    add("fin_adjustments", adjusted, _ADJUSTMENTS, ("written_off", "written_up", "generic_value"))
    add("fin_count_corrections", counted, _COUNTS, ("write_down", "write_up", "net"))
    add("fin_never_charged", charged, _CHARGED, ("value",))
    add("fin_working_capital", capital, _CAPITAL, ("excess", "shortfall"))
    add(
        "fin_dead_exposure",
        lambda w: finance.dead_exposure(w.stg("item_master"), dead(w), w.stg("purchase_orders"), costs(w)),
        """
select (select count(*) from d where reorder_point is not null) as with_reorder_point, (select ifnull(sum(reorder_point * cost), 0) from d join costs using (item_number)) as suggestion_value,
  count(*) as po_lines_ever, ifnull(sum(qty_ordered * unit_price), 0) as po_value_ever from (select * from stg_purchase_orders semi join stg_dead_item_dispositions using (item_number))""".replace("from d ", "from (select * from stg_item_master semi join stg_dead_item_dispositions using (item_number)) "),
        ("suggestion_value", "po_value_ever"),
    )
    add(
        "fin_blank_fields",
        lambda w: finance.blank_fields(w.resolved.where(~F.col("is_dead")), ledger(w), costs(w)),
        """
select count(*) filter (standard_cost is null) as blank_cost_items, sum(if(standard_cost is null, greatest(ifnull(units, 0), 0), 0)) as blank_cost_units,
  sum(if(standard_cost is null, greatest(ifnull(units, 0), 0), 0) * cost) as blank_cost_value, count(*) filter (reorder_point is null) as blank_rop_items, count(*) filter (primary_supplier_id is null) as blank_supplier_items
from live left join book using (item_number) left join costs using (item_number)""",
        ("blank_cost_value",),
    )
    add("fin_unit_balances", lambda w: finance.unit_balances(w.stg("uom_mismatch_items"), w.crosswalk, ledger(w)), "select count(*) as items, count(*) filter (ifnull(units, 0) <= 0) as negative_or_zero_balances from unit_items left join book using (item_number)")
    add(
        "fin_posting_errors",
        lambda w: finance.posting_errors(ledger(w), w.stg("posting_corrections"), costs(w), w.params),
        f"""
select correction, count(*) as postings, sum(if(correction like 'quantity%', qty - ifnull(sign(qty) * try_cast(corrected_to as double), qty), qty) * ifnull(cost, 0)) as value
from stg_inventory_transactions join stg_posting_corrections using (txn_id) left join costs using (item_number) where year(txn_date) = {_YEAR} group by 1""",
        ("value",),
    )
    add("fin_needless_duplicates", duplicated, _DUPLICATES, ("value",))
    add("fin_excess_value", excess, _EXCESS, ("value",))
    add("fin_cost_rollup", cost, _COST, ("value",))
    add("fin_operations", operations, _OPERATIONS, ("value",))
    add("fin_trust", trust, _TRUST, ("before", "after"))
    add("fin_headline", lambda w: finance.headline(cost(w), capital(w), operations(w), counted(w), charged(w)), _HEADLINE, ("value",))
    add("aud_lead_samples", lambda w: finance.samples(w.rule(2).select("item_number", "gap_days"), F.col("gap_days"), ["item_number"]), "select item_number, gap_days from dq_02 order by gap_days desc, item_number limit 2", ("gap_days",))
    add(
        "aud_point_samples",
        lambda w: finance.samples(w.rule(3).where("old_reorder_point is not null").select("item_number", "old_reorder_point", "new_reorder_point"), F.abs(F.col("new_reorder_point") - F.col("old_reorder_point")), ["item_number"]),
        "select item_number, old_reorder_point, new_reorder_point from dq_03 where old_reorder_point is not null order by abs(new_reorder_point - old_reorder_point) desc, item_number limit 2",
    )
