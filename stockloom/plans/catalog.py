"""Queries by name: each a DataFrame over a data folder, with DuckDB's SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.measures import periods_of_lead
from ..operators import finance, forecast, monitoring, policy, quality, reliability, remediation, schedule, timeseries
from ..operators.timeseries import ITEM
from ..sources import erp_views
from . import audit, learned, money, monthly, oracle, planning
from .warehouse import Warehouse

Build = Callable[[Warehouse], DataFrame]
SINCE, UNTIL = oracle.SINCE, oracle.UNTIL


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None
    doubles: tuple[str, ...] = ()


CATALOG: dict[str, Query] = {}


def _add(name: str, build: Build, sql: str | None = None, doubles: tuple[str, ...] = ()) -> None:
    CATALOG[name] = Query(build, sql, doubles)


_open: dict[tuple[str, str], tuple[tuple, Warehouse]] = {}


def _version(spark: SparkSession, folder: str) -> tuple:
    """Sizes and times of the tables' files; they change when a folder is rewritten."""
    out = []
    for table in sorted({t for tables, _ in erp_views.VIEWS.values() for t in tables}):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(path) if files.exists(path) else []
        out.append((table, tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)))
    return tuple(out)


def _warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """The models over a folder, kept for the session while its files stay the same, so that shared models are computed once."""
    key, version = (spark.sparkContext.applicationId, folder), _version(spark, folder)
    if key not in _open or _open[key][0] != version:
        clear(folder)
        _open[key] = version, Warehouse.over_star_schema(spark, folder)
    return _open[key][1]


def clear(folder: str | None = None) -> None:
    """Forget the models over a folder, or all, and delete their tables."""
    for key in [k for k in _open if folder in (None, k[1])]:
        _open.pop(key)[1].release()


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    q = CATALOG[name]
    out = q.build(_warehouse(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in q.doubles}) if q.doubles else out


def sql(name: str) -> str | None:
    q = CATALOG[name]
    return oracle.query(q.sql, q.doubles) if q.sql else None


# --- staging ---------------------------------------------------------------------

for _table in erp_views.VIEWS:
    _add(f"stg_{_table}", lambda w, t=_table: w.stg(t), f"select * from stg_{_table}")

# --- resolution --------------------------------------------------------------------

_add("item_crosswalk", lambda w: w.crosswalk, "select * from crosswalk")
_add("items_resolved", lambda w: w.resolved.select("item_number", "canonical_item_number", "is_survivor", "is_dead"), "select item_number, canonical_item_number, is_survivor, is_dead from resolved")
_add("recorded_usage", lambda w: w.usage, "select * from usage")
_add("ledger_corrected", lambda w: w.ledger, "select * from ledger_corrected")
_add("usage_corrections", lambda w: w.usage_corrections, "select * from usage_fixes")
_add("bom_effective", lambda w: w.effective_bom, "select * from effective_bom")

# --- data quality --------------------------------------------------------------------

_NAMES = ("dead_records", "stale_lead_times", "stale_reorder_points", "duplicate_items", "uom_mismatch", "missing_fields", "bom_omissions", "supplier_fragmentation", "unrecorded_consumption", "wrong_references", "quantity_errors", "duplicate_postings", "catch_all_adjustments", "free_text_purchases", "batched_postings", "open_documents")
for _n, _name in enumerate(_NAMES, 1):
    _add(f"dq_{_n:02d}_{_name}", lambda w, n=_n: w.rule(n), f"select * from dq_{_n:02d}")
_add("dq_error_register", lambda w: w.register, "select * from register")

# --- marts ---------------------------------------------------------------------------

_add("consumption_raw", lambda w: w.monthly_raw, "select * from usage_raw")
_add("consumption_merged", lambda w: w.monthly_merged, "select * from usage_merged")
_add("consumption_monthly_clean", lambda w: w.monthly_clean, "select * from usage_monthly_clean", ("consumption",))
_add("consumption_weekly_clean", lambda w: w.weekly_clean, "select * from usage_weekly", ("consumption",))
_add("true_demand", lambda w: w.true_demand, "select * from true_demand")
_add("item_attributes", lambda w: w.attributes, "select * from attributes")
_add("inventory_position", lambda w: w.position, "select * from inventory", ("on_hand_value",))
_add("supplier_performance", lambda w: w.suppliers, "select * from suppliers", ("median_lead_days", "p90_lead_days"))

# --- windows and sequences -----------------------------------------------------------

_PAST = "window past as (partition by canonical_item_number order by t rows between {} preceding and 1 preceding)"
_add(
    "win_trailing_sums",
    lambda w: w.weeks(["s4", "s13", "s26", "s52", "nz13", "nz52"]),
    "select canonical_item_number, t, "
    + ", ".join(f"ifnull(sum(s) over (partition by canonical_item_number order by t rows between {k} preceding and 1 preceding), 0) as s{k}" for k in (4, 13, 26, 52))
    + ", "
    + ", ".join(f"count(*) filter (s > 0) over (partition by canonical_item_number order by t rows between {k} preceding and 1 preceding) as nz{k}" for k in (13, 52))
    + " from grid",
    ("s4", "s13", "s26", "s52"),
)
_add(
    "win_since_nonzero",
    lambda w: w.weeks(["since_nz"]).withColumn("since_nz", F.col("since_nz").cast("bigint")),
    "select canonical_item_number, t, (t - ifnull(max(if(s > 0, t, null)) over past, -1))::bigint as since_nz from grid " + _PAST.format("unbounded"),
)
_add(
    "win_variation_13",
    lambda w: w.weeks(["cv13"]),
    "select canonical_item_number, t, if(avg(s) over past > 0, stddev_pop(s) over past / avg(s) over past, 0) as cv13 from grid " + _PAST.format(13),
    ("cv13",),
)
_add(
    "win_forward_target",
    lambda w: w.weeks(["target", "ly"], [ITEM, "h"], 52).select(ITEM, "t", "h", "target", "ly"),
    """
select g.canonical_item_number, g.t, a.h, if(g.t + a.h <= (select max(t) + 1 from calendar), list_sum(l.history[g.t + 1 : g.t + a.h]), null) as target, list_sum(l.history[g.t - 51 : g.t - 52 + a.h]) as ly
from grid g join (select canonical_item_number, greatest(1, round_even(corrected_lead_days / 7, 0))::int as h from attributes) a using (canonical_item_number)
join (select canonical_item_number, list(s order by t) as history from grid group by 1) l using (canonical_item_number) where g.t >= 52""",
    ("target", "ly"),
)
_add("win_weekly_frame", lambda w: w.frame().withColumns({c: F.col(c).cast("bigint") for c in ("nz13", "nz52", "since_nz")}), "from frame", ("target", "s4", "s13", "s26", "s52", "cv13", "trend", "ly", "mean_all"))
_WINDOWS = (3, 6, 12)
_add(
    "win_monthly_lags",
    lambda w: timeseries.lagged_features(w.monthly_grid).withColumns({c: F.col(c).cast("bigint") for c in (*[f"nz{k}" for k in _WINDOWS], "since_nz")}).drop("month"),
    "select canonical_item_number, t, "
    + ", ".join(f"lag(s, {k}, 0) over w as lag{k}" for k in (1, 2, 3, 6, 12))
    + "".join(f", ifnull({f} over (w rows between {k} preceding and 1 preceding), 0) as {n}{k}" for k in _WINDOWS for f, n in (("avg(s)", "mean"), ("stddev_pop(s)", "std"), ("count(*) filter (s > 0)", "nz")))
    + ", t - ifnull(max(if(s > 0, t, null)) over (w rows between unbounded preceding and 1 preceding), -1) as since_nz, ifnull(avg(s) over (w rows between unbounded preceding and 1 preceding), 0) as mean_all"
    + ", if(avg(s) over (w rows between unbounded preceding and 1 preceding) > 0, stddev_pop(s) over (w rows between unbounded preceding and 1 preceding) / avg(s) over (w rows between unbounded preceding and 1 preceding), 0) as cv_all"
    + " from monthly window w as (partition by canonical_item_number order by t)",
    (*[f"{n}{k}" for k in _WINDOWS for n in ("mean", "std")], "mean_all", "cv_all"),
)
_add(
    "win_running_balance",
    lambda w: timeseries.running_balance(w.stg("inventory_transactions"), reliability.signed(), "item_number"),
    "select * from balances",
)
_add(
    "win_abc_pareto",
    lambda w: timeseries.abc_classes(w.attributes.withColumn("value", F.col("annual_consumption") * F.col("standard_cost")), w.params.abc_a, w.params.abc_b),
    f"""
select canonical_item_number, value, share, if(share <= {oracle.P.abc_a}, 'A', if(share <= {oracle.P.abc_b}, 'B', 'C')) as abc from (
  select canonical_item_number, value, sum(value) over (order by value desc, canonical_item_number rows unbounded preceding) / sum(value) over () as share
  from (select canonical_item_number, annual_consumption * standard_cost as value from attributes))""",
    ("value", "share"),
)
_add(
    "win_deciles",
    lambda w: timeseries.deciles(w.attributes, "annual_consumption", ITEM),
    "select canonical_item_number, annual_consumption, greatest(0, ceil((row_number() over (order by annual_consumption, canonical_item_number) - 1) * 10 / (count(*) over () - 1)) - 1)::int as bin from attributes",
)
_add("win_sticky_levels", lambda w: forecast.history_arrays(w.monthly_grid).select(ITEM, folds.sticky(F.col("history"), w.params.hysteresis).alias("applied")))
_add(
    "win_churn",
    lambda w: forecast.history_arrays(w.monthly_grid).select(ITEM, folds.share_changed(F.col("history"), 0.2).cast("bigint").alias("moves")),
    "select canonical_item_number, count(*) filter (abs(s - before) > 0.2 * before and before > 0) as moves from (select *, lag(s) over (partition by canonical_item_number order by t) as before from monthly) group by 1",
)

# --- joins -----------------------------------------------------------------------------

_lookups = lambda w: w.stg("cycle_counts").select("item_number", F.col("count_date").alias("day")).distinct()
_add(
    "join_asof_balance",
    lambda w: reliability.balances(_lookups(w), w.stg("inventory_transactions")).select("item_number", "day", "balance"),
    "select l.item_number, l.day, ifnull(b.balance, 0) as balance from lookups l asof left join balances b on b.item_number = l.item_number and b.txn_date <= l.day",
)
_add(
    "join_last_count",
    lambda w: reliability.last_counts(w.stg("item_master").select("item_number", F.lit(w.params.as_of_date).cast("date").alias("day")), w.stg("cycle_counts")).select("item_number", "day", "variance", "counted_on", F.col("count_age").cast("bigint").alias("count_age")),
    f"select l.item_number, l.day, c.variance, c.counted_on, (l.day - c.counted_on)::bigint as count_age from (select item_number, date '{oracle.P.as_of_date}' as day from stg_item_master) l asof left join counted c on c.item_number = l.item_number and c.counted_on <= l.day",
    ("variance",),
)
_add(
    "join_range_count",
    lambda w: timeseries.window_count(_lookups(w), w.stg("inventory_transactions").where("txn_type = 'ADJUST' and qty < 0"), "item_number", "day", "txn_date", 365).withColumn("n_events", F.col("n_events").cast("bigint")),
    "select l.item_number, l.day, (select count(*) from stg_inventory_transactions t where t.item_number = l.item_number and t.txn_type = 'ADJUST' and t.qty < 0 and t.txn_date <= l.day and t.txn_date >= l.day - 365) as n_events from lookups l",
)
_add(
    "join_bom_requirements",
    lambda w: policy.requirements(w.stg("production_orders"), w.effective_bom, w.crosswalk, w.params.as_of_date),
    f"""
select ifnull(x.canonical_item_number, b.component_item) as canonical_item_number, sum(j.qty_ordered * b.qty_per) as allocated
from raw_production_orders j join effective_bom b using (product_number) left join crosswalk x on x.item_number = b.component_item
where j.release_date <= date '{oracle.P.as_of_date}' and ifnull(j.completed_date > date '{oracle.P.as_of_date}', true) group by 1""",
)
_add(
    "join_sibling_stock",
    lambda w: reliability.sibling_stock(w.stg("purchase_orders"), w.crosswalk, w.stg("inventory_transactions")),
    """
with pairs as (select p.po_id, p.line, p.item_number, p.order_date as day, s.item_number as sibling from stg_purchase_orders p join crosswalk x on x.item_number = p.item_number
  join crosswalk s on s.canonical_item_number = x.canonical_item_number and s.item_number <> p.item_number)
select q.po_id, q.line, q.item_number, q.day, sum(greatest(b.balance, 0)) as sibling_stock from pairs q asof join balances b on b.item_number = q.sibling and b.txn_date <= q.day
group by all having sum(greatest(b.balance, 0)) > 0""",
)
_add(
    "join_stale_products",
    lambda w: reliability.products_with_stale_parts(w.stg("bill_of_materials"), w.rule(3)),
    "select b.product_number, count(s.item_number) > 0 as has_stale_part, count(s.item_number) as stale_parts from stg_bill_of_materials b left join dq_03 s on s.item_number = b.component_item group by 1",
)

_add(
    "join_visible_demand",
    lambda w: timeseries.visible_demand(w.stg("production_orders"), "product_number", "qty_ordered"),
    """
select product_number, m.origin, sum(qty_ordered)::bigint as visible from raw_production_orders j
join (select unnest(generate_series(date '1994-01-01', date '2003-12-01', interval 1 month))::date as origin) m on j.release_date <= m.origin and j.due_date > m.origin and j.due_date <= m.origin + 30
group by all""",
)
_add(
    "win_trailing_year",
    lambda w: w.weeks(["mean52"]),
    "select canonical_item_number, t, if(t >= 13, avg(s) over past, null) as mean52 from grid " + _PAST.format(52),
    ("mean52",),
)
_add(
    "agg_growth",
    lambda w: timeseries.growth(w.monthly_grid),
    "select canonical_item_number, if(avg(s) = 0, null, regr_slope(s, t) * 12 / avg(s)) as growth from monthly group by 1",
    ("growth",),
)
_add(
    "dq_rows_with_errors",
    lambda w: quality.rows_with_errors([
        ("Item master", w.stg("item_master"), ["item_number"], [w.rule(n) for n in (1, 2, 3, 4, 5, 6)]),
        ("Inventory ledger", w.stg("inventory_transactions"), ["txn_id"], [w.rule(n) for n in (9, 10, 11, 12, 13)]),
        ("Purchase orders", w.stg("purchase_orders"), ["po_id", "line"], [w.rule(14), w.rule(15), w.rule(16).where("document_type = 'PO'").withColumnRenamed("document_id", "po_id")]),
    ]),
    "select 'Item master' as erp_table, count(*) filter (item_number in (" + " union ".join(f"select item_number from dq_{n:02d}" for n in range(1, 7)) + """)) as rows_with_error, count(*) as rows_in_scope from stg_item_master
union all select 'Inventory ledger', count(*) filter (txn_id in (""" + " union ".join(f"select txn_id from dq_{n:02d}" for n in range(9, 14)) + """)), count(*) from stg_inventory_transactions
union all select 'Purchase orders', count(*) filter ((po_id, line) in (select (po_id, line) from dq_14 union select (po_id, line) from dq_15 union select (document_id, line) from dq_16 where document_type = 'PO')), count(*) from stg_purchase_orders""",
)
# --- aggregates ------------------------------------------------------------------------

_add(
    "agg_concentration",
    lambda w: timeseries.concentration(w.attributes, "annual_consumption", ITEM),
    "select sum(annual_consumption) filter (place <= ceil(n * 0.2)) / sum(annual_consumption) as top_share from (select annual_consumption, row_number() over (order by annual_consumption desc, canonical_item_number) as place, count(*) over () as n from attributes)",
    ("top_share",),
)
_add(
    "agg_spearman",
    lambda w: timeseries.spearman(w.attributes, "annual_consumption", "corrected_lead_days"),
    """
select corr(a, b) as spearman from (select rank() over (order by annual_consumption) + (count(*) over (partition by annual_consumption) - 1) / 2 as a,
  rank() over (order by corrected_lead_days) + (count(*) over (partition by corrected_lead_days) - 1) / 2 as b from attributes)""",
    ("spearman",),
)
_add(
    "agg_segment_crosstab",
    lambda w: w.attributes.groupBy("segment").pivot("abc", ["A", "B", "C"]).agg(F.count(F.lit(1))).na.fill(0),
    "select segment, count(*) filter (abc = 'A') as \"A\", count(*) filter (abc = 'B') as \"B\", count(*) filter (abc = 'C') as \"C\" from attributes group by segment",
)
_add(
    "agg_lead_quantiles",
    lambda w: w.stg("purchase_orders").where("actual_lead_days is not null").groupBy("supplier_id").agg(*[F.percentile("actual_lead_days", q).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.8, 0.9)], F.stddev_samp("actual_lead_days").alias("sd")),
    "select supplier_id, " + ", ".join(f"quantile_cont(actual_lead_days, {q}) as p{int(q * 100)}" for q in (0.1, 0.5, 0.8, 0.9)) + ", stddev_samp(actual_lead_days) as sd from stg_purchase_orders where actual_lead_days is not null group by 1",
    ("p10", "p50", "p80", "p90", "sd"),
)
_add(
    "agg_user_mode",
    lambda w: w.stg("inventory_transactions").groupBy("item_number").agg(F.mode("user_id", True).alias("user_id")),
    "select item_number, user_id from (select item_number, user_id, count(*) as n from stg_inventory_transactions group by all) qualify row_number() over (partition by item_number order by n desc, user_id) = 1",
)
_add(
    "agg_weekday_share",
    lambda w: reliability.weekday_share(w.stg("purchase_orders"), "received_date"),
    "select strftime(received_date, '%A') as weekday, count(*) as n, count(*) / sum(count(*)) over () as share from stg_purchase_orders where received_date is not null group by 1",
    ("share",),
)

# --- forecasts -------------------------------------------------------------------------

_horizons = lambda w: w.attributes.select(ITEM, periods_of_lead(F.col("corrected_lead_days"), 30).alias("h"))


def _forecast(method: str) -> Build:
    def build(w: Warehouse) -> DataFrame:
        rows = forecast.history_arrays(w.monthly_grid).join(_horizons(w), ITEM)
        return rows.select(ITEM, forecast.forecasts(F.col("history"), F.col("h"), w.params)[method].alias("forecast"))

    return build


_add("fc_naive", _forecast("naive"), "select canonical_item_number, history[-1] * h as forecast from histories join horizons using (canonical_item_number)", ("forecast",))
_add("fc_moving_average_6", _forecast("ma6"), "select canonical_item_number, list_avg(history[-6:]) * h as forecast from histories join horizons using (canonical_item_number)", ("forecast",))
_add("fc_seasonal_naive", _forecast("snaive"), "select canonical_item_number, list_sum(history[len(history) - 11 : len(history) - 12 + h]) as forecast from histories join horizons using (canonical_item_number)", ("forecast",))
_add("fc_exponential_smoothing", _forecast("ses"), f"select canonical_item_number, list_reduce(history, lambda l, x: {oracle.P.ses_alpha} * x + {1 - oracle.P.ses_alpha} * l) * h as forecast from histories join horizons using (canonical_item_number)", ("forecast",))
_add(
    "fc_croston",
    _forecast("croston"),
    f"""
select canonical_item_number, if(z = 0, 0, z / gap * {1 - oracle.P.croston_alpha / 2}) * h as forecast from (
  select canonical_item_number,
    ifnull(list_reduce(list(s order by t) filter (s > 0), lambda a, x: a + {oracle.P.croston_alpha} * (x - a)), 0) as z,
    ifnull(list_reduce(list(gap order by t) filter (s > 0), lambda a, x: a + {oracle.P.croston_alpha} * (x - a)), 1) as gap
  from (select *, (t - ifnull(max(if(s > 0, t, null)) over (partition by canonical_item_number order by t rows between unbounded preceding and 1 preceding), -1))::double as gap from monthly) group by 1)
join horizons using (canonical_item_number)""",
    ("forecast",),
)


def _backtest(w: Warehouse) -> DataFrame:
    return forecast.backtest(forecast.history_arrays(w.monthly_grid), _horizons(w), w.params)


_BACKTEST = """
with origins as (select canonical_item_number, h, history, unnest(range(greatest(12, len(history) - h - 11), len(history) - h + 1)) as origin from histories join horizons using (canonical_item_number)),
  scored as (select canonical_item_number, origin, list_sum(history[origin + 1 : origin + h]) as actual, history[origin] * h as naive, list_avg(history[greatest(1, origin - 2) : origin]) * h as ma3,
    list_avg(history[greatest(1, origin - 5) : origin]) * h as ma6, list_sum(history[origin - 11 : least(origin - 12 + h, origin)]) as snaive, list_reduce(history[1 : origin], lambda l, x: 0.3::double * x + 0.7::double * l) * h as ses,
      ifnull(list_reduce(case when len(sold) > 0 then sold end, lambda a, x: a + 0.1::double * (x - a)) / list_reduce(case when len(spots) > 0 then list_transform(range(1, len(spots) + 1), lambda i: (spots[i] - ifnull(spots[i - 1], 0))::double) end, lambda a, x: a + 0.1::double * (x - a)) * 0.95::double, 0) * h as croston
    from (select *, list_filter(history[1 : origin], lambda x: x > 0) as sold, list_filter(range(1, origin + 1), lambda i: history[i] > 0) as spots from origins)),
  long as (unpivot scored on naive, ma3, ma6, ses, croston, snaive into name method value forecast)
"""


def _accuracy(rows: str, by: str, methods: tuple[str, ...]) -> str:
    """SQL of every method's errors by group, and the best method, over ``rows`` (by, method, actual, forecast)."""
    return f"""
facts as (select {by}, method, sum(abs(actual - forecast)) / nullif(sum(actual), 0) as wape, sum(forecast - actual) / nullif(sum(actual), 0) as bias, count(*) as n from ({rows}) group by all),
  best as (select {by}, arg_min(method, (wape, list_position([{", ".join(f"'{m}'" for m in methods)}], method))) as best_method, min(wape) as best_wape from facts where wape is not null group by 1)
select {by}, method, wape, bias, n, best_method, best_wape from facts left join best using ({by})"""
_add(
    "fc_backtest",
    lambda w: _backtest(w).groupBy(ITEM, "method").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("abs_error"), F.sum("actual").alias("actual")),
    _BACKTEST + "select canonical_item_number, method, count(*) as n, sum(abs(actual - forecast)) as abs_error, sum(actual) as actual from long group by all",
    ("abs_error",),
)
_add(
    "fc_accuracy_by_segment",
    lambda w: forecast.accuracy(_backtest(w).join(w.attributes.select(ITEM, "segment"), ITEM), ["segment"]),
    _BACKTEST.rstrip() + "," + _accuracy("select segment, method, actual, forecast from long join attributes using (canonical_item_number)", "segment", ("naive", "ma3", "ma6", "ses", "croston", "snaive")),
    ("wape", "bias", "best_wape"),
)
_add(
    "fc_best_method",
    lambda w: forecast.wide_accuracy(schedule.with_bases(w.weeks(["target", "s4", "s13", "s52", "ly"], ["h", "abc"], 52)).where("target is not null").withColumnRenamed("target", "actual"), schedule.BASES, ["abc"]),
    "with " + _accuracy("select abc, method, target as actual, forecast from (unpivot (select abc, target, ma4, ma13, ma52, snaive from bases join (select canonical_item_number, abc from attributes) using (canonical_item_number) where target is not null) on ma4, ma13, ma52, snaive into name method value forecast)", "abc", ("ma4", "ma13", "ma52", "snaive")).lstrip(),
    ("wape", "bias", "best_wape"),
)

# --- policy ----------------------------------------------------------------------------

_add(
    "pol_lead_sd",
    lambda w: policy.lead_time_spread(w.attributes, w.stg("purchase_orders"), w.crosswalk, SINCE, UNTIL),
    "from lead_spread",
    ("lead_sd",),
)
_add(
    "pol_unscheduled_share",
    lambda w: policy.unscheduled_share(w.stg("inventory_transactions"), w.crosswalk, SINCE, UNTIL),
    "from unscheduled_shares",
    ("unscheduled",),
)
_add(
    "pol_visibility",
    lambda w: policy.visibility(w.stg("production_orders"), SINCE, UNTIL),
    "from seen_days",
)
_add(
    "pol_criticality",
    lambda w: policy.criticality(w.attributes, w.stg("bill_of_materials"), w.stg("bom_change_log"), w.stg("inventory_transactions"), w.crosswalk, SINCE, UNTIL),
    "from tiers",
)
_add(
    "pol_recomputed_points",
    lambda w: policy.recomputed_points(w.usage, w.attributes, 84),
    """
select a.canonical_item_number, a.abc, round_even(m * l + b, 0) as new_reorder_point, round_even(b, 0) as new_safety_stock from (
  select a.*, m, l, case abc when 'A' then 2.054::double when 'B' then 1.645::double else 1.282::double end * sqrt(greatest(m * l, 0)) as b
  from (select a.*, ifnull(u.units, 0) / 84 as m, greatest(0.3::double, corrected_lead_days / 30) as l from attributes a left join (select canonical_item_number, sum(units) as units from usage group by 1) u using (canonical_item_number)) a) a""",
)


# --- reliability and money -------------------------------------------------------------


def _graded(w: Warehouse) -> DataFrame:
    live = w.stg("item_master").join(w.stg("dead_item_dispositions").select("item_number").distinct(), "item_number", "left_anti")
    return reliability.reliability(live, w.stg("inventory_transactions"), w.stg("cycle_counts"), w.crosswalk, w.stg("duplicate_clusters"), w.stg("duplicate_crosswalk"), w.stg("uom_mismatch_items"), w.stg("uom_conversions"), w.params)


_add("rel_classes", lambda w: _graded(w).select("item_number", "day", "reliability", "n_events"), "select item_number, day, reliability, n_events from graded")
_add(
    "rel_value",
    lambda w: reliability.value_by_reliability(_graded(w), _costs(w), w.stg("duplicate_crosswalk")),
    "from graded_value",
    ("stock_value",),
)


def _costs(w: Warehouse) -> DataFrame:
    return reliability.imputed_costs(w.stg("item_master")).select("item_number", "cost")


_add("fin_cost_imputed", lambda w: reliability.imputed_costs(w.stg("item_master")), "select * from costs", ("cost",))


_add(
    "fin_delayed_jobs",
    lambda w: reliability.delayed_jobs(w.stg("production_orders")),
    "select ifnull(hold_reason, 'none') as hold_reason, count(*) as jobs, count(*) filter (delay_days > 0) as delayed_jobs, sum(delay_days)::bigint as delay_days from raw_production_orders group by 1",
)
_add(
    "fin_phantom_on_order",
    lambda w: reliability.phantom_on_order(w.stg("purchase_orders"), w.params.history_end, w.params),
    f"select count(*) as lines, sum(u) as open_units, sum(u * unit_price) as open_value from (select greatest(qty_ordered - ifnull(qty_received, 0), 0) as u, unit_price from stg_purchase_orders where status = 'OPEN' and {oracle._END} - order_date > {oracle.P.phantom_days})",
    ("open_value",),
)
_add(
    "fin_dead_stock",
    lambda w: reliability.dead_stock(w.resolved, w.stg("inventory_transactions"), reliability.imputed_costs(w.stg("item_master")).select("item_number", "cost")),
    "select count(*) as records, sum(u) as units, sum(u * cost) as stock_value from (select item_number, sum(change) as u from signed_ledger group by 1 having sum(change) > 0) join (select item_number from resolved where is_dead) using (item_number) join costs using (item_number)",
    ("stock_value",),
)
_add(
    "fin_free_text_spend",
    lambda w: reliability.free_text_spend(w.stg("purchase_orders"), w.stg("free_text_attribution")),
    "select count(*) as lines, sum(s) as spend, count(*) filter (ok) as confirmed_lines, sum(if(ok, s, 0)) as confirmed_spend from (select qty_ordered * unit_price as s, po_id in (select po_id from raw_free_text_attribution where confirmation = 'confirmed') as ok from stg_purchase_orders where is_generic_item)",
    ("spend", "confirmed_spend"),
)
_add(
    "fin_alias_spend",
    lambda w: reliability.alias_spend(w.stg("purchase_orders"), w.stg("supplier_crosswalk")),
    "select ifnull(a.canonical_supplier_id, p.supplier_id) as supplier_id, sum(qty_ordered * unit_price) as spend, sum(if(a.alias_supplier_id is null, 0, qty_ordered * unit_price)) as alias_spend from stg_purchase_orders p left join raw_supplier_crosswalk a on a.alias_supplier_id = p.supplier_id group by 1 having count(a.alias_supplier_id) > 0",
    ("spend", "alias_spend"),
)
_add(
    "fin_posting_lag",
    lambda w: reliability.posting_lag(w.stg("purchase_orders"), w.stg("batched_receipts")),
    "select (po_id, line) in (select (po_id, line) from raw_batched_receipts) as is_batched, count(*) as lines, avg(actual_lead_days) as mean_lead_days from stg_purchase_orders where received_date is not null group by 1",
    ("mean_lead_days",),
)
_add(
    "fin_excess_stock",
    lambda w: reliability.excess_stock(
        w.position, policy.recomputed_points(w.usage, w.attributes, 84).select(ITEM, F.col("new_reorder_point").alias("reorder_point")), w.attributes.select(ITEM, (F.col("annual_consumption") / 365).alias("daily"))
    ),
    """
select abc, count(*) as items, sum(o) as excess_value, sum(o) * 0.22::double as carrying_cost from (
  select i.abc, greatest(on_hand_units - round_even(m * l + case i.abc when 'A' then 2.054::double when 'B' then 1.645::double else 1.282::double end * sqrt(greatest(m * l, 0)), 0) - annual_consumption / 365 * 75, 0) * i.standard_cost as o
  from inventory i join (select a.*, ifnull(u.units, 0) / 84 as m, greatest(0.3::double, corrected_lead_days / 30) as l from attributes a left join (select canonical_item_number, sum(units) as units from usage group by 1) u using (canonical_item_number)) a using (canonical_item_number)) group by 1""",
    ("excess_value", "carrying_cost"),
)

# --- monitoring ------------------------------------------------------------------------

_add(
    "mon_class_drift",
    lambda w: monitoring.category_drift(w.stg("inventory_transactions").where("txn_date < '2000-01-01'"), w.stg("inventory_transactions").where("txn_date >= '2000-01-01'"), "txn_type"),
    """
with n as (select txn_type, count(*) filter (txn_date < '2000-01-01') as a, count(*) filter (txn_date >= '2000-01-01') as b from stg_inventory_transactions group by 1),
  s as (select (a / sum(a) over () + 1e-9::double) / (1 + count(*) over () * 1e-9::double) as p, (b / sum(b) over () + 1e-9::double) / (1 + count(*) over () * 1e-9::double) as q from n)
select 'txn_type' as feature, sqrt(sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2) as distance from s""",
    ("distance",),
)
_add(
    "mon_input_quality",
    lambda w: monitoring.input_quality(w.weekly_clean, w.attributes),
    """
select avg(if(consumption is null, 1, 0)) as null_share, count(*) filter (consumption < 0) as negative_rows, count(distinct canonical_item_number) filter (canonical_item_number not in (select canonical_item_number from attributes)) as unknown_items,
  (select arg_max(total, week) / avg(total) filter (week < (select max(week) from usage_weekly)) from (select week, sum(consumption) as total from usage_weekly group by 1)) as last_ratio
from usage_weekly""",
    ("last_ratio",),
)


# --- remediation -----------------------------------------------------------------------

_add("rem_dead_dispositions", lambda w: remediation.dead_dispositions(w.stg("item_master"), w.stg("inventory_transactions"), w.params))
_add("rem_duplicate_decisions", lambda w: remediation.duplicate_decisions(w.crosswalk))
_add(
    "rem_supplier_aliases",
    lambda w: remediation.supplier_aliases(w.stg("supplier_master")),
    "select supplier_id as alias_supplier_id, least_id as canonical_supplier_id from (select supplier_id, min(supplier_id) over (partition by supplier_name_norm) as least_id from stg_supplier_master) where supplier_id > least_id",
)
_add("rem_uom_conversions", lambda w: remediation.missing_conversions(w.rule(5), {"BOX": 12.0}), "select distinct item_number, purchase_uom, stock_uom, 12::double as conversion from dq_05")
_add(
    "rem_lead_times",
    lambda w: remediation.lead_times(w.stg("purchase_orders"), w.stg("item_master")),
    """
select item_number, median(actual_lead_days)::double as median_actual_lead_days, quantile_cont(actual_lead_days, 0.8) as p80_actual_lead_days, count(*) as sample_size, any_value(master_lead_time_days) as master_lead_time_days,
  round_even(median(actual_lead_days), 0)::int as recommended_lead_days
from stg_purchase_orders join stg_item_master using (item_number) where received_date is not null and not is_rush group by 1 having count(*) >= 3""",
    ("p80_actual_lead_days",),
)
_add(
    "rem_chronic_adjustments",
    lambda w: remediation.chronic_adjustments(w.stg("inventory_transactions"), w.stg("bill_of_materials"), w.stg("bom_change_log"), w.params),
    f"""
select item_number, count(*) as adj_count_12m, sum(qty) as net_qty, -sum(qty) / 12 as implied_monthly, item_number in (select component_item from stg_bill_of_materials) as on_bom,
  if(item_number in (select component_item from stg_bom_change_log), 'BOM omission', 'Keying') as root_cause
from stg_inventory_transactions where txn_type = 'ADJUST' and qty < 0 and txn_date >= {oracle._END} - {oracle.P.chronic_days} and txn_date <= {oracle._END} and ifnull(reason_code, '') not in ('COUNT', 'CYCLE')
group by 1 having count(*) >= {oracle.P.chronic_adjustments}""",
    ("implied_monthly",),
)
_add(
    "rem_closures",
    lambda w: remediation.closures(w.stg("purchase_orders"), w.stg("production_orders"), w.params.history_end, w.params),
    f"""
select 'PO' as document_type, po_id as document_id, line from stg_purchase_orders where status = 'OPEN' and order_date < {oracle._END} - {oracle.P.phantom_days}
union all by name select 'JOB' as document_type, order_id as document_id, 1 as line from raw_production_orders where status = 'OPEN' and qty_completed > 0""",
)
_add(
    "rem_spreadsheet",
    lambda w: remediation.spreadsheet_reconciliation(w.stg("buyer_spreadsheet"), finance.book_stock(w.stg("inventory_transactions")), w.position, w.crosswalk),
    """
with rows as (select b.item_ref as item_number, on_hand_estimate as spreadsheet_on_hand, greatest(ifnull(units, 0), 0) as erp_on_hand, ifnull(i.on_hand_units, 0) as truth
  from stg_buyer_spreadsheet b left join crosswalk x on x.item_number = b.item_ref left join inventory i on i.canonical_item_number = ifnull(x.canonical_item_number, b.item_ref) left join book on book.item_number = b.item_ref),
marked as (select *, ifnull(spreadsheet_on_hand <> erp_on_hand, false) as disagree, abs(spreadsheet_on_hand - truth) < abs(erp_on_hand - truth) as closer from rows)
select item_number, spreadsheet_on_hand, erp_on_hand, if(not disagree, 'agree', if(closer, 'spreadsheet', 'erp')) as closer_to_truth,
  if(not disagree, 'no change', if(closer, 'corrected ERP to counted value', 'kept ERP; spreadsheet updated')) as action from marked""",
)
_add(
    "rem_bill_changes",
    lambda w: remediation.bill_changes(w.stg("bill_of_materials"), w.stg("bom_change_log")),
    """
select l.product_number, l.component_item, l.qty_per, (select median(qty_per) from stg_bill_of_materials b where b.component_item = l.component_item)::double as usual_qty_per
from stg_bom_change_log l where (l.product_number, l.component_item) not in (select (product_number, component_item) from stg_bill_of_materials)""",
)
_add(
    "rem_posting_corrections",
    lambda w: remediation.posting_corrections(
        w.rule(10), w.rule(11).select("txn_id", F.col("posted_qty").cast("bigint").alias("posted_qty"), F.col("correct_qty").cast("bigint").alias("correct_qty")),
        w.rule(12).where("is_confirmed").select("txn_id", F.regexp_replace("txn_id", "-D$", "").alias("original_txn_id")),
    ),
    """
select 're-pointed to correct item' as correction, txn_id, concat(posted_item_number, ' -> ', correct_item_number) as detail from dq_10
union all select 'quantity corrected', txn_id, concat(posted_qty::bigint, ' -> ', correct_qty::bigint) from dq_11
union all select 'duplicate posting reversed', txn_id, 'duplicate of ' || regexp_replace(txn_id, '-D$', '') from dq_12 where is_confirmed""",
)
_add(
    "rem_attribution_decisions",
    lambda w: remediation.attribution_decisions(w.stg("free_text_attribution").select("po_id", "confidence")),
    "select po_id, confidence, if(confidence < 0.62, 'rejected', 'confirmed') as confirmation from raw_free_text_attribution",
)

money.add_queries(_add, _graded, _costs)
monthly.add_queries(_add)
planning.add_queries(_add, learned.predictions)
learned.add_queries(_add)
audit.add_queries(_add)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, n=name: run(n, spark, folder)) for name in CATALOG}


def oracles() -> dict[str, str]:
    return {name: text for name in CATALOG if (text := sql(name))}
