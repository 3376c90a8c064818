"""Models on hand-made rows with known results."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions import folds
from stockloom.operators import finance, forecast, marts, monitoring, policy, quality, reliability, resolve, schedule, staging, timeseries
from stockloom.params import Params
from stockloom.plans import catalog
from stockloom.sources import erp_views, files

D = dt.date
ITEM = "canonical_item_number"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} array<double>" for n in names)).select(column.alias("x")).first().x


def test_staging_helpers(spark):
    df = spark.createDataFrame([("Acme Tool Co", "~68 on hand", "A-1 -> B-2"), ("ACME-tool, Inc", "none", "5 -> 7"), ("Disco", None, "odd")], "n string, note string, d string")
    out = df.select(staging.normalized_name(F.col("n")), staging.first_number(F.col("note")), staging.side_of_arrow(F.col("d"), 1), staging.side_of_arrow(F.col("d"), 2)).collect()
    assert [tuple(r) for r in out] == [("acmetool", 68, "A-1", "B-2"), ("acmetool", None, "5", "7"), ("dis", None, "odd", "")]


def test_crosswalk_keeps_live_numbers(spark):
    master = spark.createDataFrame([("A-00001",), ("A-00002-X",), ("A-100000",), ("A-ZZ",), ("LOOSE",), (None,)], "item_number string")
    clusters = spark.createDataFrame([("A-00002-X", "A-00001")], "item_number string, primary_item_number string")
    assert rows(resolve.item_crosswalk(master, clusters)) == [("A-00001", 1, "A-00001"), ("A-00002-X", 2, "A-00001")]


@pytest.mark.parametrize(("excluded", "kept"), [(["a"], ["b"]), (["a", None], []), ([], ["a", "b", None])])
def test_not_in_with_nulls(spark, excluded, kept):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([(x,) for x in excluded], "k string")
    assert {r.k for r in resolve.null_aware_anti(left, right, "k").collect()} == set(kept)


def _ledger(spark, data):
    return spark.createDataFrame(data, "txn_id string, item_number string, txn_date date, txn_time string, txn_week date, txn_type string, qty double, uom string, job_id string, reason_code string, location string, user_id string")


def test_corrected_ledger_repoints_and_requantifies(spark):
    day = D(2024, 1, 1)
    base = lambda i, item, qty: (i, item, day, "08:00", day, "ISSUE", qty, "EA", None, None, None, None)
    ledger = _ledger(spark, [base("1", "A-1", -5.0), base("2", "A-1", 4.0), base("3", "A-1", 3.0)])
    fixes = spark.createDataFrame(
        [("re-pointed to correct item", "1", "A-2", "A-1"), ("quantity corrected", "1", "2", "50"), ("quantity corrected", "2", "many", "4"), ("duplicate posting reversed", "3", "", "")], "correction string, txn_id string, corrected_to string, corrected_from string"
    )
    crosswalk = spark.createDataFrame([("A-1", 1, "A-1"), ("A-2", 2, "A-1")], f"item_number string, item_id int, {ITEM} string")
    assert rows(resolve.corrected_ledger(ledger, fixes, crosswalk), "txn_id", "item_number", "qty", ITEM) == [("1", "A-2", -2.0, "A-1"), ("2", "A-1", 4.0, "A-1")]


def test_duplicate_postings_by_gap_and_nulls(spark):
    base = lambda i, day, job=None: (i, "A", D(2024, 1, day), "08:00", D(2024, 1, 1), "ISSUE", 5.0, "EA", job, None, None, None)
    ledger = _ledger(spark, [base("1", 1), base("2", 1), base("3", 2), base("4", 4), base("5", 4, "J")])
    fixes = spark.createDataFrame([("duplicate posting reversed", "3")], "correction string, txn_id string")
    out = quality.duplicate_postings(ledger, fixes, Params())
    assert rows(out, "txn_id", "gap_days", "is_confirmed") == [("2", 0, False), ("3", 1, True)]


def test_stale_reorder_point_thresholds(spark):
    df = spark.createDataFrame([("a", 10.0, 15.0), ("b", 20.0, 25.0), ("c", None, 5.0), ("d", 0.0, 4.9), ("e", 16.0, 20.8)], "item_number string, old_reorder_point double, new_reorder_point double").withColumn("abc_class", F.lit("A"))
    assert [r[0] for r in rows(quality.stale_reorder_points(df, Params()), "item_number")] == ["a", "c"]


def test_compensated_sum(spark):
    values = [1e16, 1.0, -1e16, 1.0]
    assert one(spark, folds.compensated_sum(F.col("v")), v=values) == _kahan(values)
    assert one(spark, folds.compensated_sum(F.col("v")), v=[0.1] * 10) == 1.0
    assert one(spark, folds.compensated_sum(F.col("v")), v=[]) is None


def _kahan(values):
    total = lost = 0.0
    for x in values:
        due = x - lost
        new = total + due
        lost, total = (new - total) - due, new
    return total


def test_smoothing(spark):
    h = [3.0, 0.0, 0.0, 6.0, 1.0]
    level = h[0]
    for x in h[1:]:
        level = 0.3 * x + 0.7 * level
    assert one(spark, folds.exponential_smoothing(F.col("v"), 0.3), v=h) == pytest.approx(level)
    assert one(spark, folds.exponential_smoothing(F.col("v"), 0.3), v=[]) is None
    assert one(spark, folds.croston(F.col("v"), 0.1), v=[0.0, 0.0]) == 0.0
    assert one(spark, folds.croston(F.col("v"), 0.1), v=[0.0, 0.0, 9.0]) == pytest.approx(9 / 3 * 0.95)
    z, p = 3.0, 1.0
    for x, gap in ((6.0, 3), (1.0, 1)):
        z, p = z + 0.1 * (x - z), p + 0.1 * (gap - p)
    assert one(spark, folds.croston(F.col("v"), 0.1), v=h) == pytest.approx(z / p * 0.95)


def test_sticky_values(spark):
    assert one(spark, folds.sticky(F.col("v"), 0.2), v=[100.0, 120.0, 120.01, 97.0, 96.0, 0.0, 5.0]) == [100.0, 100.0, 120.01, 120.01, 96.0, 0.0, 5.0]
    assert one(spark, folds.share_changed(F.col("v"), 0.2), v=[100.0, 120.0, 150.0, 0.0, 7.0]) == 2


def test_segments(spark):
    p = Params()
    df = spark.createDataFrame([(1, 1.0, 0.1), (9, 1.31, 0.48), (9, 1.31, 0.49), (9, 1.32, 0.48), (9, 1.32, 0.5), (None, None, None)], "n int, adi double, cv2 double")
    got = [r[0] for r in df.select(marts.segment(F.col("n"), F.col("adi"), F.col("cv2"), p)).collect()]
    assert got == ["intermittent", "smooth", "erratic", "intermittent", "lumpy", "intermittent"]


def test_clean_usage_floors_at_zero(spark):
    month = D(2024, 1, 1)
    usage = spark.createDataFrame([("t", "A", "A", month, 10.0)], f"txn_id string, item_number string, {ITEM} string, month date, units double")
    unrecorded = spark.createDataFrame([(1, "A", 5.0), (2, "A", 0.0)], "source_no int, item_number string, annual_unrecorded double")
    fixes = spark.createDataFrame([("x", "A", month, "keying", -2.0), ("y", "B", month, "duplicate", -3.0)], f"txn_id string, {ITEM} string, month date, correction string, delta double")
    crosswalk = spark.createDataFrame([("A", 1, "A")], f"item_number string, item_id int, {ITEM} string")
    assert rows(marts.consumption_clean(usage, unrecorded, fixes, crosswalk, "month")) == [("A", month, 13.0), ("B", month, 0.0)]


def test_as_of_looks_back_inclusively(spark):
    looks = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("a", D(2024, 1, 5), 2), ("a", D(2024, 1, 9), 3), ("b", D(2024, 1, 5), 4)], "k string, day date, n int")
    events = spark.createDataFrame([("a", D(2024, 1, 5), 7.0), ("a", D(2024, 1, 5), 6.0), ("a", D(2024, 1, 6), 1.0)], "k string, on date, v double")
    out = timeseries.as_of(looks, events, "k", "day", "v", "on")
    assert sorted(((r.n, r.v, r.on) for r in out.collect()), key=str) == [(1, None, None), (2, 7.0, D(2024, 1, 5)), (3, 1.0, D(2024, 1, 6)), (4, None, None)]


def _series(spark, values):
    start = D(2024, 1, 1)
    data = [("A", start + dt.timedelta(7 * t), float(v)) for t, v in enumerate(values) if v]
    data += [("B", start, 1.0), ("B", start + dt.timedelta(7 * (len(values) - 1)), 1.0)]
    return spark.createDataFrame(data, f"{ITEM} string, week date, consumption double"), spark.createDataFrame([("A", 10.5), ("B", 40.0)], f"{ITEM} string, corrected_lead_days double")


def test_grid_partitions_and_gaps(spark):
    week = dt.date(2024, 1, 1)
    series = spark.createDataFrame([("A", week, 2.0), ("A", week + dt.timedelta(14), None), ("B", week + dt.timedelta(21), 4.5), ("C", None, 9.0), (None, week, 1.0)], f"{ITEM} string, week date, consumption double")
    items = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 1)], f"{ITEM} string, other int")
    grid = timeseries.dense(series, items, "week")
    assert rows(grid, ITEM, "t", "s") == [("A", 0, 2.0), ("A", 1, 0.0), ("A", 2, 0.0), ("A", 3, 0.0), ("B", 0, 0.0), ("B", 1, 0.0), ("B", 2, 0.0), ("B", 3, 4.5), ("C", 0, 0.0), ("C", 1, 0.0), ("C", 2, 0.0), ("C", 3, 0.0)]
    # adaptive plans don't fold a grid of few items into one task, and windows on items don't shuffle it again
    grid.collect()
    assert grid.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = timeseries.weekly_frame(grid, items.select(ITEM).distinct().withColumn("corrected_lead_days", F.lit(7.0)))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "Window" in above and "Exchange hashpartitioning" not in above.split("Join")[0]
    assert timeseries.dense(series.limit(0), items, "week").count() == 0


def test_weekly_frame_against_numpy(spark):
    r = np.random.default_rng(1)
    s = r.poisson(1.2, 80) * r.integers(0, 2, 80)
    s[0] = s[-1] = 1
    series, attributes = _series(spark, s)
    frame = timeseries.weekly_frame(timeseries.dense(series, attributes, "week"), attributes)
    got = {x.t: x for x in frame.where(F.col(ITEM) == "A").collect()}
    assert sorted(got) == list(range(52, 80))
    h = 2  # 10.5 days are 1.5 weeks, rounded half to even
    for t, x in got.items():
        assert (x.h, x.s4, x.s13, x.s52) == (h, s[t - 4 : t].sum(), s[t - 13 : t].sum(), s[t - 52 : t].sum())
        assert x.nz13 == (s[t - 13 : t] > 0).sum() and x.ly == s[t - 52 : t - 52 + h].sum()
        assert x.target == (s[t : t + h].sum() if t + h <= 80 else None)
        before = np.flatnonzero(s[:t])
        assert x.since_nz == t - before[-1]
        m = s[t - 13 : t].mean()
        assert x.cv13 == pytest.approx(s[t - 13 : t].std() / m if m else 0.0)


def test_abc_and_deciles(spark):
    df = spark.createDataFrame([(f"i{k}", float(v)) for k, v in enumerate([80, 10, 5, 3, 1, 1, 0])], f"{ITEM} string, value double")
    assert [r[1] for r in rows(timeseries.abc_classes(df, 0.8, 0.95), ITEM, "abc")] == ["A", "B", "B", "C", "C", "C", "C"]
    ranks = spark.createDataFrame([(f"{k:03d}", float(k)) for k in range(103)], "k string, v double")
    bins = [r[1] for r in rows(timeseries.deciles(ranks, "v", "k"), "k", "bin")]
    want = [max(0, math.ceil(k * 10 / 102) - 1) for k in range(103)]
    assert bins == want


def test_backtest_origins(spark):
    series = spark.createDataFrame([("A", [float(k) for k in range(20)])], f"{ITEM} string, history array<double>")
    horizons = spark.createDataFrame([("A", 3)], f"{ITEM} string, h int")
    out = forecast.backtest(series, horizons, Params()).where("method = 'naive'")
    assert rows(out, "origin", "actual", "forecast") == [(o, float(3 * o + 3), float(3 * (o - 1))) for o in range(12, 18)]


def test_drift(spark):
    r = np.random.default_rng(2)
    both = lambda v, w: spark.createDataFrame([("x", float(x), ref) for ref, z in ((True, v), (False, w)) for x in z], "feature string, value double, is_reference boolean")
    a = r.gamma(2.0, 10.0, 400)
    same = monitoring.drift(both(a, a)).first().distance
    b = a + 40
    v, w = np.log1p(a), np.log1p(b)
    edges = np.unique(np.quantile(v, np.linspace(0, 1, 21)))[1:-1]
    p, q = (np.bincount(np.searchsorted(edges, z, "right"), minlength=20) / 400 + 1e-9 for z in (v, w))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    want = np.sqrt((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)
    assert same == pytest.approx(0, abs=1e-7)
    assert monitoring.drift(both(a, b)).first().distance == pytest.approx(want, abs=1e-9)
    constant = [3.0] * 10
    assert monitoring.drift(both(constant, constant)).first().distance == pytest.approx(0, abs=1e-6)


def test_loss_table_and_fill_factor(spark):
    r = np.random.default_rng(3)
    z = r.normal(size=300)
    errors = spark.createDataFrame([("A", float(x)) for x in z], "abc string, z double")
    table = policy.loss_table(errors)
    got = {round(x.k, 2): x.loss for x in table.collect()}
    for k in (0.0, 0.5, 1.37, 6.0):
        assert got[k] == pytest.approx(np.maximum(z - k, 0).mean(), abs=1e-9)
    needs = spark.createDataFrame([("i", "A", "line", 10.0, 50.0), ("j", "A", "line", 0.0, 50.0)], f"{ITEM} string, abc string, tier string, sigma double, lot double")
    found = {x[0]: x.k_fill for x in policy.fill_factor(needs, table, Params()).select(ITEM, "k_fill").collect()}
    want = min(k for k, loss in got.items() if loss <= 0.01 * 50 / 10)
    assert found == {"i": pytest.approx(want), "j": 0.0}


def test_counts_and_reliability(spark):
    counts = spark.createDataFrame([(0.0, 5.0), (10.0, 10.4), (-3.0, 0.0)], "system_qty double, counted_qty double").select(reliability.count_variance().alias("v"))
    assert [r.v for r in counts.collect()] == [1.0, pytest.approx(0.04), 3.0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "supplier_master.csv").write_text('supplier_id,supplier_name,supplier_type,payment_terms,status\nS1,"A, B and C",X,,ACTIVE\n')
    df = files.read_csv(spark, str(tmp_path / "supplier_master.csv"), "supplier_master")
    assert df.first() == ("S1", "A, B and C", "X", None, "ACTIVE")
    for write, read in ((files.write_parquet, spark.read.parquet), (files.write_documents, spark.read.json)):
        write(df, str(tmp_path / write.__name__))
        assert read(str(tmp_path / write.__name__)).first().supplier_name == "A, B and C"
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), "supplier_master").count() == 1
    assert set(files.SCHEMAS) == set(__import__("stockloom.sources.erp_views", fromlist=["VIEWS"]).VIEWS)


def test_streaming_weeks(spark, tmp_path):
    from stockloom.streaming import usage

    spark.sql("select 1L event_id, timestamp_ntz'2024-01-03 10:00:00' ts, 1L user_id, 'a' event_type, 2.0D value, '' props union all select 2L, timestamp_ntz'2024-01-07 23:00:00', 1L, 'a', 3.0D, '' union all select 3L, timestamp_ntz'2024-01-08 00:00:00', 1L, 'a', 4.0D, ''").write.parquet(str(tmp_path / "in"))
    q = usage.weekly_usage(usage.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select cast(week_start as date), total from weeks")) == [(D(2024, 1, 1), 5.0), (D(2024, 1, 8), 4.0)]


def test_reliability_grades(spark):
    p = Params()
    start, end = D.fromisoformat(p.remediation_start), D.fromisoformat(p.remediation_end)
    items = spark.createDataFrame([(f"I-{k}",) for k in range(1, 7)], "item_number string")
    year_before = start - dt.timedelta(days=365)
    postings = [(f"I-{k}", d, "ADJUST", -1.0, r) for k, d, r in [(2, year_before, None)] * 3 + [(3, year_before - dt.timedelta(days=1), None)] + [(3, year_before, None)] * 2 + [(4, start, "COUNT")] * 5]
    ledger = spark.createDataFrame(postings, "item_number string, txn_date date, txn_type string, qty double, reason_code string")
    counts = spark.createDataFrame([("I-4", start, 100.0, 101.0), ("I-5", start - dt.timedelta(days=91), 100.0, 100.0)], "item_number string, count_date date, system_qty double, counted_qty double")
    crosswalk = spark.createDataFrame([(f"I-{k}", k, f"I-{k}") for k in range(1, 7)], "item_number string, item_id int, canonical_item_number string")
    clusters = spark.createDataFrame([("I-5", "I-5"), ("I-6", "I-5")], "item_number string, primary_item_number string")
    reviewed = spark.createDataFrame([("I-6", "I-5", "MERGE")], "retired_item_number string, survivor_item_number string, decision string")
    none = spark.createDataFrame([], "item_id int")
    added = spark.createDataFrame([], "item_number string, added_date date")
    out = reliability.reliability(items, ledger, counts, crosswalk, clusters, reviewed, none, added, p)
    found = {(x.item_number, x.day): x.reliability for x in out.collect()}
    # never counted; three write-downs, the first exactly 365 days before; one a day too early; counts are no write-downs; a duplicate
    assert [found[f"I-{k}", start] for k in range(1, 7)] == ["uncertain", "unreliable", "uncertain", "reliable", "unreliable", "unreliable"]
    # after remediation the window begins anew, merged records are cleared and retired ones have no grade
    assert [found[f"I-{k}", end] for k in (2, 5, 6)] == ["uncertain", "uncertain", None]


def test_error_groups_and_reasons(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_number string")
    group = lambda *n: spark.createDataFrame([(x,) for x in n], "item_number string")
    assert rows(finance.error_group(items, [("first", group("a")), ("second", group("a", "b"))])) == [("a", "first"), ("b", "second"), ("c", finance.NO_GROUP)]
    reasons = spark.createDataFrame([("COUNT",), ("VAR",), (None,), ("",), ("SCRAP",)], "reason_code string")
    assert [r[0] for r in reasons.select(finance.known_reason()).collect()] == [True, False, False, False, True]


def test_applied_points_stick_and_churn(spark):
    raw = [100.0, 110.0, 121.0, 120.0, 0.0, 5.0]
    points = spark.createDataFrame([("i", t, 2, float(t), x, 1.0, x, 0.5, 7.0) for t, x in enumerate(raw)], f"{ITEM} string, t int, h int, forecast double, level double, safety_stock double, reorder_point double, share double, lot double")
    out = schedule.applied(points, Params()).orderBy("t").collect()
    assert [x.reorder_point for x in out] == [100.0, 100.0, 121.0, 121.0, 0.0, 5.0] and [x.forecast for x in out] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    facts = schedule.churn(schedule.applied(points, Params()), Params()).first()
    assert facts.applied_changes == pytest.approx(3 / 5) and facts.applied_moves == pytest.approx(2 / 5)


def test_queue_order_and_flags(spark):
    position = spark.createDataFrame([(k, "A", float(x), 0.0) for k, x in (("a", 5), ("b", 1), ("c", 12), ("d", 100))], f"{ITEM} string, abc string, on_hand_units double, on_order_units double")
    levels = spark.createDataFrame([(k, 10.0, 0.5, 4.0) for k in "abcd"], f"{ITEM} string, level double, daily double, lot double")
    needed = spark.createDataFrame([("d", 85.0)], f"{ITEM} string, allocated double")
    marks = {"one": spark.createDataFrame([("b",), ("b",)], f"{ITEM} string"), "two": spark.createDataFrame([("b",), ("a",)], f"{ITEM} string")}
    out = policy.reorder_queue(position, levels, needed, marks, Params())
    assert rows(out, "place", ITEM, "status", "suggested", "flags") == [(1, "b", "ORDER NOW", 12.0, "one, two"), (2, "a", "ORDER NOW", 8.0, "two"), (3, "c", "ORDER SOON", 4.0, ""), (4, "d", "ORDER SOON", 4.0, "")]


def test_window_count_includes_both_ends(spark):
    events = spark.createDataFrame([("k", D(2020, 1, d)) for d in (1, 2, 2, 11)], "key string, day date")
    asked = spark.createDataFrame([("k", D(2020, 1, 11)), ("k", D(2020, 1, 12)), ("x", D(2020, 1, 1))], "key string, at date")
    assert rows(timeseries.window_count(asked, events, "key", "at", "day", 10)) == [("k", D(2020, 1, 11), 4), ("k", D(2020, 1, 12), 3), ("x", D(2020, 1, 1), 0)]


def test_keys_of_any_length_stay_apart(spark):
    keys = [1, 42, 9998, 9999, 10000, 99998, 99999, 100000, 100002, 1000001, 1234567]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    found = rows.selectExpr("k", f"{erp_views.item_no('k')} as item", f"{erp_views.supplier_no('k')} as supplier").collect()
    assert len({r.item for r in found}) == len({r.supplier for r in found}) == len(keys)
    assert {r.k: (r.item, r.supplier) for r in found if r.k in (42, 1234567)} == {42: ("ITM-00042", "SUP-0042"), 1234567: ("ITM-1234567", "SUP-1234567")}
    master = rows.selectExpr(f"{erp_views.item_no('k')} as item_number")
    none = spark.createDataFrame([], "item_number string, primary_item_number string")
    live = resolve.item_crosswalk(master, none, erp_views.OBSOLETE_FROM)
    assert {r.item_id for r in live.collect()} == {k for k in keys if k % 50 != 49}


def test_jobs_draw_until_they_are_completed(spark):
    day = D(2001, 6, 30)
    jobs = [("p", D(2001, 6, 30), None, 1, "OPEN"), ("p", D(2001, 6, 1), D(2001, 7, 1), 10, "CLOSED"), ("p", D(2001, 6, 1), day, 100, "OPEN"), ("p", D(2001, 7, 1), None, 1000, "OPEN"), ("p", None, None, 10000, "OPEN")]
    jobs = spark.createDataFrame(jobs, "product_number string, release_date date, completed_date date, qty_ordered int, status string")
    bill = spark.createDataFrame([("p", "c", 2.0), ("p", "old", 1.0)], "product_number string, component_item string, qty_per double")
    names = spark.createDataFrame([("old", "new")], f"item_number string, {ITEM} string")
    assert {r[ITEM]: r.allocated for r in policy.requirements(jobs, bill, names, "2001-06-30").collect()} == {"c": 22.0, "new": 11.0}


def test_models_of_a_folder_are_built_anew_when_it_changes(spark, tmp_path):
    def put(n):
        for table in ("part", "supplier", "lineitem", "orders"):
            spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(n).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables here")
    put(20)
    one = catalog._warehouse(spark, str(tmp_path))
    assert catalog._warehouse(spark, str(tmp_path)) is one
    put(10)
    assert catalog._warehouse(spark, str(tmp_path)) is not one
    catalog.clear(str(tmp_path))
