"""Plans and bounds of steps that large tables go through."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from stockloom.operators import forecast, histories, marts, resolve
from stockloom.plans import catalog

ITEM = "canonical_item_number"
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def crosswalk(spark):
    return spark.createDataFrame([("A", 1, "A"), ("B", 2, "A"), ("C", 3, "C")], f"item_number string, item_id int, {ITEM} string")


def test_corrections_meet_the_ledger_before_its_records_are_resolved(spark):
    day = dt.date(2024, 1, 3)
    ledger = spark.createDataFrame([("1", "A", day, day, "ISSUE", -5.0), ("2", "B", day, day, "RECEIPT", 4.0), ("3", "X", day, day, "ISSUE", 2.0)], "txn_id string, item_number string, txn_date date, txn_week date, txn_type string, qty double")
    fixes = [(resolve.REVERSED, "1", None, None), (resolve.REQUANTIFIED, "2", "4", "7"), (resolve.REVERSED, "2", None, None), (resolve.REVERSED, "3", None, None)]
    corrections = spark.createDataFrame(fixes, "correction string, txn_id string, corrected_from string, corrected_to string")
    out = resolve.usage_corrections(ledger, corrections, crosswalk(spark))
    assert sorted((r.txn_id, r[ITEM], r.correction, r.delta) for r in out.collect()) == [("1", "A", "duplicate", -5.0), ("2", "A", "keying", 3.0)]
    found = plan(out)
    assert "SortMergeJoin [txn_id" not in found and "ShuffledHashJoin [txn_id" in found


def test_only_periods_with_more_than_usage_are_gathered(spark):
    week, later = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    rows = [("A", week, 10.0), ("A", week, 2.0), ("A", None, 4.0), ("C", week, 0.1), ("C", later, 3.0)]
    usage = spark.createDataFrame(rows, f"{ITEM} string, week date, units double")
    unrecorded = spark.createDataFrame([(1, "B", 8.0)], "source_no int, item_number string, annual_unrecorded double")
    fixes = spark.createDataFrame([("x", "C", later, "duplicate", -4.0), ("y", "D", None, "keying", 6.0)], f"txn_id string, {ITEM} string, week date, correction string, delta double")
    out = marts.consumption_clean(usage, unrecorded, fixes, crosswalk(spark), "week")
    want = {("A", week): 18.0, ("A", None): 6.0, ("C", week): 0.1, ("C", later): 0.0, ("D", None): 6.0}
    assert {(r[ITEM], r.week): r.consumption for r in out.collect()} == want
    # recorded usage is grouped by hash alone; before, each of its rows was gathered in an array as well
    gathered = [line for line in plan(out).splitlines() if "collect_list" in line and "units" in line]
    assert not gathered and "FullOuter" in plan(out)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_rule_points_form_weeks_after_their_last_shuffle(spark):
    above = plan(catalog.run("pol_rule_schedule", spark, FOLDER)).split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above


def test_weeks_are_counted_without_being_formed(spark):
    rows = [("A", 1), ("B", 2), ("C", 2), ("D", None)]
    items = spark.createDataFrame(rows, f"{ITEM} string, h int")
    usage = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("B", dt.date(2024, 2, 12), 1.0)], f"{ITEM} string, week date, consumption double")
    whole = histories.histories(usage, items)
    out = histories.counted(whole, ["h"], 3)
    formed = histories.periods(whole, ["week"], ["h"], 3).groupBy("h", "t", "week").count()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, formed.collect()), key=repr)
    assert "MapInArrow" not in plan(out) and not histories.counted(whole, ["h"], 7).take(1)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
@pytest.mark.parametrize(("name", "readings"), [("mon_training_rows", 0), ("fc_best_method", 1)])
def test_weeks_are_formed_no_more_often_than_needed(spark, name, readings):
    assert plan(catalog.run(name, spark, FOLDER)).count("MapInArrow") == readings


def test_wide_accuracy_is_that_of_long_rows(spark):
    rows = [("A", 1.0, 2.0, 0.0), ("A", 3.0, 2.0, 4.0), ("B", 0.0, 1.0, 1.0), ("C", 5.0, 5.0, None)]
    wide = spark.createDataFrame(rows, "abc string, actual double, p double, q double")
    long = forecast.accuracy(forecast.long_methods(wide, ("p", "q"), ["abc", "actual"]), ["abc"])
    out = forecast.wide_accuracy(wide, ("p", "q"), ["abc"]).select(*long.columns)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, long.collect()), key=repr)
