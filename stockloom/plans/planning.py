"""Queries from forecasts to levels, the order queue and monitoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories, learning, monitoring, policy, schedule, tallies
from ..operators.resolve import canonical
from ..shared import written
from . import oracle
from .warehouse import Warehouse

ITEM = "canonical_item_number"
TEST, FORWARD, LAST, SINCE, UNTIL = oracle.TEST, oracle.FORWARD, oracle.LAST, oracle.SINCE, oracle.UNTIL
NUMERIC = ["s4", "s13", "s26", "s52", "nz13", "nz52", "since_nz", "cv13", "trend", "ly", "mean_all", "standard_cost", "corrected_lead_days", "annual_consumption", "h"]
CATEGORIES = ["segment", "abc", "item_class"]
#: What the schedule reads of an origin beside its prediction.
READ = ["week", "target", "s4", "s13", "s52", "ly"]
#: What a point is made of beside an origin's prediction.
FACTS = ["abc", "corrected_lead_days", "standard_cost", "tier", "lead_sd", "unscheduled", "sd"]
#: Rows of origins from one on, and before another, with READ, h, segment, abc and pred, beside facts of their items, if any are given.
Predict = Callable[..., DataFrame]


def beside(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their items' facts, in a stated number of partitions: adaptive plans would size them by the rows, before each becomes a calendar's."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.drop(*[c for c in facts.columns if c != ITEM]).repartition(parts, ITEM).join(facts, ITEM)


def rate(w: Warehouse, start: int, stop: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The 13-week rate over each row's horizon, as a stand-in for a model. Facts meet the histories, one row an item, before weeks are formed; an item's weeks lie together and in order."""
    if facts is None:
        return schedule.rate_predictions(w.weeks(READ, [ITEM, "h", "segment", "abc"], start, stop))
    return schedule.rate_predictions(histories.periods(beside(w.weekly_histories, facts), READ, [ITEM, "h", "segment", *FACTS], start, stop))


def tested(w: Warehouse, predict: Predict = rate) -> DataFrame:
    return w.once(("tested", predict), lambda: schedule.held_out(predict(w, TEST, FORWARD), TEST, FORWARD))


def losses(w: Warehouse, predict: Predict = rate) -> DataFrame:
    return w.once(("losses", predict), lambda: policy.loss_table(schedule.standard_errors(schedule.corrected(tested(w, predict)))))


def points(w: Warehouse, predict: Predict = rate, start: int = FORWARD, stop: int | None = None, carry: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Raw points of every item and origin of the forward window, or of some origins; ``carry`` says what else rows bring along."""
    held = tested(w, predict)
    fixed = schedule.corrected(held)
    factors = held.groupBy("segment").agg(F.coalesce(F.try_divide(F.sum("target"), F.sum("pred")), F.lit(1.0)).alias("factor"))
    ledger, orders, bill = w.stg("inventory_transactions"), w.stg("purchase_orders"), w.stg("bill_of_materials")
    facts = w.attributes.select(ITEM, "abc", "corrected_lead_days", "standard_cost")
    facts = facts.join(policy.criticality(w.attributes, bill, w.stg("bom_change_log"), ledger, w.crosswalk, SINCE, UNTIL), ITEM).join(policy.lead_time_spread(w.attributes, orders, w.crosswalk, SINCE, UNTIL), ITEM)
    facts = facts.join(policy.unscheduled_share(ledger, w.crosswalk, SINCE, UNTIL), ITEM, "left").join(schedule.error_spread(fixed, w.attributes), ITEM).select(ITEM, *FACTS)
    rows = predict(w, start, stop, facts)
    more = carry(rows) if carry else rows.select(ITEM, "t", "h", "segment", "pred", *FACTS)
    rows = more.join(F.broadcast(factors), "segment", "left").withColumn("pred_c", F.col("pred") * F.coalesce("factor", F.lit(1.0))).drop("pred", "factor")  # one row a segment
    seen = policy.visibility(w.stg("production_orders"), SINCE, UNTIL).select((F.col("visibility_days") + F.col("order_book_days")).alias("seen"))
    kept = [c for c in rows.columns if c not in (ITEM, "t", "h", "pred_c", *FACTS, *([] if carry else ["segment"]))]
    return schedule.raw_points(rows, seen, losses(w, predict), w.params, kept)


def planned(w: Warehouse, predict: Predict = rate) -> DataFrame:
    return schedule.applied(points(w, predict), w.params, together=predict is rate)


def moves(w: Warehouse) -> DataFrame:
    """The rate's schedule without what changes no point, each origin beside the one before."""
    return schedule.applied(points(w), w.params, together=True, kept=(), before=True)


def live(w: Warehouse, predict: Predict = rate) -> DataFrame:
    """Scheduled forecasts beside what followed, in one pass; written, as status reads them twice."""
    return w.once(("live", predict), lambda: _live(w, predict))


def _live(w: Warehouse, predict: Predict) -> DataFrame:
    methods = schedule.base_methods(tested(w, predict))
    rows = schedule.applied(points(w, predict, carry=lambda rows: schedule.followed(rows, methods, LAST, tuple(FACTS))), w.params, together=predict is rate, kept=("safety_stock",))
    return rows.select("period", "segment", "is_scored", "target", "forecast", "base", (F.col("target") <= F.col("forecast") + F.col("safety_stock")).alias("covered"))


def outcomes(w: Warehouse) -> DataFrame:
    """Stockouts and held jobs of each month, beside the means of the cost year's months."""
    months = w.stg("shortages").groupBy(F.date_format("date", "yyyy-MM").alias("period")).agg(F.count("*").alias("events"), F.sum("jobs").alias("held"))
    reference = months.where(F.substring("period", 1, 4) == str(w.params.cost_year)).agg(F.avg("events").alias("ref_events"), F.avg("held").alias("ref_held"))
    return months.crossJoin(F.broadcast(reference))  # one row


def status(w: Warehouse, predict: Predict = rate) -> DataFrame:
    return schedule.period_status(live(w, predict), schedule.corrected(tested(w, predict)), outcomes(w), w.params)


def queue(w: Warehouse, predict: Predict = rate) -> DataFrame:
    last = planned(w, predict).where(F.col("t") == LAST).withColumn("daily", F.col("forecast") / F.greatest(F.lit(1.0), 7.0 * F.col("h"))).select(ITEM, "level", "daily", "lot")
    jobs = policy.requirements(w.stg("production_orders"), w.stg("bill_of_materials"), w.crosswalk, w.params.as_of_date)
    attributed = w.stg("free_text_attribution").where(F.col("confirmation") == "confirmed").select(F.col("probable_item_number").alias("item_number"))
    stale = w.stg("lead_time_computation").where(F.abs(F.col("median_actual_lead_days") - F.col("master_lead_time_days")) > w.params.stale_lead_gap_days)
    marks = {
        "Merged record": w.crosswalk.where(F.col("item_number") != F.col(ITEM)).select(ITEM), "Lead time corrected": canonical(stale.select("item_number"), w.crosswalk).select(ITEM),
        "BOM corrected": canonical(w.stg("bill_of_materials").select(F.col("component_item").alias("item_number")), w.crosswalk).select(ITEM), "History restored": canonical(attributed, w.crosswalk).select(ITEM),
    }
    return policy.reorder_queue(w.position, last, jobs, marks, w.params)


def _rule_schedule(w: Warehouse) -> DataFrame:
    """The rule's points; the spread of lead times joins the histories, one row an item, and the weeks formed of them bring it along."""
    spread = policy.lead_time_spread(w.attributes, w.stg("purchase_orders"), w.crosswalk, SINCE, UNTIL)
    parts = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stated partitions, as adaptive plans would size them by the histories, before each becomes a calendar's rows
    rows = w.weekly_histories.repartition(parts, ITEM).join(spread, ITEM, "left")
    return policy.rule_points(histories.periods(rows, ["s52"], [ITEM, "abc", "corrected_lead_days", "lead_sd"], 52))


def _training_rows(w: Warehouse) -> DataFrame:
    """Rows known at the first origin of each month; weeks are counted by horizon, never formed for each item."""
    origins = histories.counted(w.weekly_histories, [], FORWARD).groupBy(F.trunc("week", "month").alias("month")).agg(F.min("t").alias("origin"))
    return monitoring.training_rows_known(histories.counted(w.weekly_histories, ["h"], 52), origins.select("origin"), F.sum("n_rows"))


def _drift(w: Warehouse) -> DataFrame:
    """Distance of the forward window's inputs from the training rows', of every feature but those of the calendar.

    Values are counted where they are formed; categories, the same in all of an
    item's weeks, are counted by horizon, and no weeks are formed for them.
    """
    rows, formed = w.weekly_histories, [c for c in NUMERIC if c in histories.FEATURES]

    def taken(batch: pa.RecordBatch) -> tuple[list[tallies.Numbers], np.ndarray]:
        columns = {c: tallies.numbers(batch.column(c)) for c in NUMERIC}
        t, h = batch.column("t").to_numpy(), columns["h"][0]
        # nine digits, so that equal values computed in another order stay equal
        return [(tallies.rounded(np.log1p(np.maximum(x, 0.0)), 9), known) for x, known in columns.values()], np.where(t + h <= TEST - 26, 0, np.where(t >= FORWARD, 1, -1))

    names = F.array(*map(F.lit, NUMERIC))
    counts = tallies.counts(rows, formed, [c for c in NUMERIC if c not in formed], taken, 2, histories.YEAR)
    # read once for the edges and once for the bins
    counted, _ = written(counts.select(F.element_at(names, F.col("column") + 1).alias("feature"), F.col("value").alias("v"), F.col("n0").alias("n_p"), F.col("n1").alias("n_q")), "counts")
    out = monitoring.counted_drift(counted)
    reference = F.col("t") + F.col("h") <= TEST - 26
    parts = {"n_p": reference, "n_q": ~reference & (F.col("t") >= FORWARD)}
    for column in CATEGORIES:
        alike = histories.counted(rows, ["h", column], histories.YEAR)
        out = out.unionByName(monitoring.counted_category_drift(alike.select(column, *[F.when(part, F.col("n_rows")).otherwise(0).alias(n) for n, part in parts.items()]), column))
    return monitoring.drift_flags(out, w.params)


def _drift_sql() -> str:
    columns = ", ".join(f"{{'feature': '{c}', 'v': round(ln(1 + greatest({c}::double, 0)), 9)}}" for c in NUMERIC)
    groups = " union all ".join(f"select '{c}' as feature, {c} as bin, is_reference from both_parts" for c in CATEGORIES)
    return f"""
with both_parts as (select f.*, a.* exclude (canonical_item_number), t + h <= {TEST - 26} as is_reference from frame f join attributes a using (canonical_item_number) where t + h <= {TEST - 26} or t >= {FORWARD}),
  long as (select is_reference, unnest([{columns}], recursive := true) from both_parts),
  quantiles as (select feature, list_sort(list_distinct(quantile_cont(v, [{", ".join(str(k / 20) for k in range(21))}]))) as q, min(v) as low, max(v) as high from long where is_reference and v is not null group by 1),
  edges as (select feature, if(len(q) < 3, list_transform(range(21), lambda k: low + (high - low) * k / 20), q) as e from quantiles),
  cells as (select feature, is_reference, len(list_filter(e[2 : len(e) - 1], lambda x: x <= v)) as bin from long join edges using (feature) where v is not null),
  counted as (select feature, bin, count(*) filter (is_reference) as n_p, count(*) filter (not is_reference) as n_q from cells group by all),
  numeric as (select feature, bin::varchar as bin, ifnull(n_p, 0) as n_p, ifnull(n_q, 0) as n_q from (select feature, unnest(range(len(e) - 1)) as bin from edges) left join counted using (feature, bin)),
  every as (from numeric union all select feature, bin, count(*) filter (is_reference), count(*) filter (not is_reference) from ({groups}) group by all),
  shares as (select feature, (n_p / sum(n_p) over f + 1e-9::double) / (1 + count(*) over f * 1e-9::double) as p, (n_q / sum(n_q) over f + 1e-9::double) / (1 + count(*) over f * 1e-9::double) as q from every window f as (partition by feature)),
  found as (select feature, sqrt(greatest(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 0)) as distance from shares group by 1)
select feature, distance, distance >= {oracle.P.drift_threshold} as drifted from found"""


_ACCURACY = """count(*) as n_forecasts, count(*) filter (is_scored) as n_scored, sum(abs(target - forecast)) filter (is_scored) / nullif(sum(target) filter (is_scored), 0) as wape,
  sum(abs(target - base)) filter (is_scored) / nullif(sum(target) filter (is_scored), 0) as base_wape, sum(forecast - target) filter (is_scored) / nullif(sum(target) filter (is_scored), 0) as bias, avg(if(covered, 1, 0)) filter (is_scored) as coverage"""
_STATUS = f"""
with whole as (select period, {_ACCURACY} from live_rows group by 1),
  reference as (select sum(abs(target - pred_c)) / sum(target) as w from fixed),
  by_pattern as (select segment, sum(abs(target - pred_c)) / nullif(sum(target), 0) as w from fixed group by 1),
  patterns as (select period, max(case when a.wape > p.w + 0.05::double then 2 when a.wape > p.w then 1 else 0 end) as wl, max(if(abs(bias) > 0.10::double, 2, 0)) as bl
    from (select period, segment, {_ACCURACY} from live_rows group by all having count(*) filter (is_scored) >= 150) a join by_pattern p using (segment) group by 1),
  months as (select strftime(date, '%Y-%m') as period, count(*) as events, sum(jobs) as held from raw_shortages group by 1),
  worse as (select period, events > (select avg(events) from months where period like '{oracle.P.cost_year}%') or held > (select avg(held) from months where period like '{oracle.P.cost_year}%') as worse from months),
  marked as (select w.*, n_scored >= 0.8::double * n_forecasts as is_matured, ifnull(worse, false) as outcomes_worse, wl, bl, (select w from reference) as r from whole w left join patterns using (period) left join worse using (period)),
  levels as (select period, n_forecasts, n_scored, wape, base_wape, bias, is_matured, if(is_matured, case when wape > r + 0.03::double then 2 when wape > r then 1 else 0 end, 0) as wape_level, if(is_matured and abs(bias) > 0.10::double, 2, 0) as bias_level,
    if(is_matured, ifnull(wl, 0), 0) as pattern_wape_level, if(is_matured, ifnull(bl, 0), 0) as pattern_bias_level, outcomes_worse from marked)
select *, case when greatest(wape_level, bias_level, pattern_wape_level, pattern_bias_level) = 2 then 'RETRAIN' when greatest(wape_level, bias_level, pattern_wape_level, pattern_bias_level) > 0 or outcomes_worse then 'INVESTIGATE' else 'HEALTHY' end as status from levels"""
_QUEUE = f"""
with needs as (select ifnull(x.canonical_item_number, b.component_item) as canonical_item_number, sum(j.qty_ordered * b.qty_per) as need
    from raw_production_orders j join stg_bill_of_materials b using (product_number) left join crosswalk x on x.item_number = b.component_item
    where j.release_date <= {oracle._ASOF} and ifnull(j.completed_date > {oracle._ASOF}, true) group by 1),
  merged as (select canonical_item_number from crosswalk where item_number <> canonical_item_number),
  leads as (select ifnull(x.canonical_item_number, l.item_number) as i from stale_leads l left join crosswalk x using (item_number)),
  bills as (select ifnull(x.canonical_item_number, l.component_item) as i from stg_bill_of_materials l left join crosswalk x on x.item_number = l.component_item),
  history as (select ifnull(x.canonical_item_number, f.probable_item_number) as i from raw_free_text_attribution f left join crosswalk x on x.item_number = f.probable_item_number where confirmation = 'confirmed'),
  rows as (select i.canonical_item_number, i.abc, on_hand_units + on_order_units - ifnull(need, 0) as available, s.level, s.lot, s.forecast / greatest(1, 7.0::double * s.h) as daily
    from inventory i join schedule s on s.canonical_item_number = i.canonical_item_number and s.t = {LAST} left join needs n on n.canonical_item_number = i.canonical_item_number),
  marked as (select *, (available - level) / greatest(level, 1) as gap, case when available <= level then 'ORDER NOW' when available <= level + daily * 14 then 'ORDER SOON' else 'OK' end as status from rows)
select canonical_item_number, abc, available, level, gap, status, if(status = 'OK', 0, lot * greatest(1, ceil((level - available) / lot))) as suggested,
  array_to_string(list_filter([if(canonical_item_number in (from merged), 'Merged record', ''), if(canonical_item_number in (from leads), 'Lead time corrected', ''), if(canonical_item_number in (from bills), 'BOM corrected', ''), if(canonical_item_number in (from history), 'History restored', '')], lambda x: x <> ''), ', ') as flags,
  row_number() over (order by if(status = 'OK', 2, if(status = 'ORDER SOON', 1, 0)), gap, canonical_item_number) as place from marked"""


def add_queries(add: Callable, model: Predict) -> None:
    """Register this module's queries; ``model`` gives the learned model's predictions."""
    fixed = lambda w: schedule.corrected(tested(w))
    errors = lambda w: schedule.standard_errors(fixed(w))
    add("pol_base_methods", lambda w: schedule.base_methods(tested(w)), "from methods", ("wape",))
    add("pol_bias_factors", lambda w: fixed(w).groupBy("segment").agg(F.first("factor").alias("factor"), F.count("*").alias("n")), "select segment, sum(target) / sum(pred) as factor, count(*) as n from tested group by 1", ("factor",))
    add("pol_error_spread", lambda w: schedule.error_spread(fixed(w), w.attributes), "from spread", ("sd",))
    levels = ((0.98, "A"), (0.95, "B"), (0.9, "C"))
    add("pol_safety_factors", lambda w: schedule.safety_factors(errors(w)), " union all ".join(f"select '{a}' as abc, quantile_cont(z, {q}) as factor from std_errors where abc = '{a}' having count(*) > 0" for q, a in levels), ("factor",))
    add("pol_loss_table", losses, "from losses", ("loss",))
    add("pol_sigma_lot", lambda w: points(w, rate, FORWARD, FORWARD + 1).select(ITEM, "forecast", "safety_stock", "reorder_point", "lot"), f"select canonical_item_number, forecast, safety_stock, reorder_point, lot from points where t = {FORWARD}", ("forecast", "safety_stock", "reorder_point", "lot"))
    add("pol_points", points, "from points", ("forecast", "level", "safety_stock", "reorder_point", "share", "lot"))
    add("pol_schedule", planned, "from schedule", ("forecast", "raw", "level", "safety_stock", "reorder_point", "share", "lot"))
    add(
        "pol_churn",
        lambda w: schedule.churn(moves(w), w.params),
        """
select avg(if(raw_before > 0 and abs(raw - raw_before) > 0.2::double * raw_before, 1, 0)) as raw_moves, avg(if(before > 0 and abs(reorder_point - before) > 0.2::double * before, 1, 0)) as applied_moves, avg(if(abs(reorder_point - before) > 1e-9::double, 1, 0)) as applied_changes
from (select raw, reorder_point, lag(raw) over w as raw_before, lag(reorder_point) over w as before from schedule window w as (partition by canonical_item_number order by t)) where before is not null""",
        ("raw_moves", "applied_moves", "applied_changes"),
    )
    add(
        "pol_rule_schedule",
        _rule_schedule,
        """
select canonical_item_number, t, d as lead_demand, b as safety_stock, d + b as reorder_point from (
  select canonical_item_number, t, s52 / 364 * corrected_lead_days as d, case abc when 'A' then 2.05::double when 'B' then 1.64::double else 1.28::double end * sqrt(greatest(1, s52 / 364 * corrected_lead_days) + pow(s52 / 364 * ifnull(lead_sd, 0), 2)) as b
  from frame join attributes using (canonical_item_number) left join lead_spread using (canonical_item_number))""",
        ("lead_demand", "safety_stock", "reorder_point"),
    )
    add("pol_reorder_queue", queue, _QUEUE, ("available", "level", "gap", "suggested"))
    add(
        "pol_queue_top",
        lambda w: policy.top_of_queue(queue(w)),
        f"select canonical_item_number, status, place from ({_QUEUE}) qualify row_number() over (partition by status order by place) <= case status when 'ORDER NOW' then 16 when 'ORDER SOON' then 4 else 2 end",
    )
    add("pol_schedule_learned", lambda w: planned(w, model), None, ("forecast", "raw", "level", "safety_stock", "reorder_point", "share", "lot"))
    add("mon_monthly_accuracy", lambda w: schedule.accuracy(live(w), ["period"]), f"select period, {_ACCURACY} from live_rows group by 1", ("wape", "base_wape", "bias", "coverage"))
    add("mon_segment_accuracy", lambda w: schedule.accuracy(live(w), ["segment"], 150), f"select segment, {_ACCURACY} from live_rows group by 1 having count(*) filter (is_scored) >= 150", ("wape", "base_wape", "bias", "coverage"))
    add("mon_status", status, _STATUS, ("wape", "base_wape", "bias"))
    add("mon_status_learned", lambda w: status(w, model), None, ("wape", "base_wape", "bias"))
    add("mon_feature_drift", _drift, _drift_sql(), ("distance",))
    add(
        "mon_training_rows",
        _training_rows,
        f"select o.origin, (select count(*) from frame where t + h <= o.origin) as training_rows from (select min(t) as origin from frame where t >= {FORWARD} group by date_trunc('month', week)) o",
    )
    add(
        "ml_split_summary",
        lambda w: schedule.split_summary(dict(zip(("train", "validation", "test"), learning.split(w.weeks(["week", "target"], [ITEM, "h"], 52), TEST), strict=True))),
        f"""
select part, min(week) as first, max(week) as last, count(*) as n_rows, count(distinct canonical_item_number) as items, avg(target) as target_mean, median(target) as target_median, avg(if(target = 0, 1, 0)) as zero_share
from (select *, case when t + h <= {TEST - 26} then 'train' when t >= {TEST - 26} and t + h <= {TEST} then 'validation' when t >= {TEST} then 'test' end as part from frame where target is not null) where part is not null group by 1""",
        ("target_mean", "target_median", "zero_share"),
    )
