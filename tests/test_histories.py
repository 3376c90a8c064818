"""Rows that numpy forms from whole histories, against plain windows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stockloom.operators import histories, schedule, timeseries

ITEM = "canonical_item_number"


@pytest.fixture(scope="module")
def usage(spark):
    r = random.Random(5)
    start = dt.date(2020, 1, 6)
    rows = [(k, start + dt.timedelta(7 * t), r.choice((None, 0.0, 1.0, 0.1, r.random() * 9))) for k in "abcd" for t in range(90) if t in (0, 89) or r.random() < 0.4]
    items = spark.createDataFrame([("a", 7.0), ("b", 40.0), ("c", 500.0), ("none", 21.0)], f"{ITEM} string, corrected_lead_days double")
    series = spark.createDataFrame([*rows, ("a", None, 5.0)], f"{ITEM} string, week date, consumption double")
    return series, items.join(timeseries._horizon(items), ITEM)


def test_frame_is_that_of_windows(usage):
    series, items = usage
    whole = histories.histories(series, items)
    grid = timeseries.dense(series, items, "week")
    exact = timeseries.weekly_frame(grid, items)
    found = histories.periods(whole, ["week", *histories.FRAME], [ITEM, "h"], 52).select(*exact.columns)
    told = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert told(found) == told(exact) and found.count() == 4 * 38
    trailing = grid.select(ITEM, "t", *[timeseries.trailing_sum(k).alias(f"s{k}") for k in (4, 52)], timeseries.trailing_nonzero(52).alias("nz52"), timeseries.since_nonzero().alias("since_nz"), timeseries.trailing_variation(13).alias("cv13"), timeseries.trailing_mean(52, 13).alias("mean52"))
    assert told(histories.periods(whole, ["s4", "s52", "nz52", "since_nz", "cv13", "mean52"])) == told(trailing)
    part = histories.periods(whole, ["week", *histories.FRAME], [ITEM, "h"], 60, 70).select(*exact.columns)
    assert told(part) == told(exact.where("t >= 60 and t < 70"))


def test_frame_takes_no_shuffle_of_rows(spark, usage):
    series, items = usage
    whole = spark.createDataFrame(histories.histories(series, items).collect(), histories.histories(series, items).schema)
    plan = histories.periods(whole, histories.FRAME, [ITEM, "h"], 52)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert histories.periods(histories.histories(series.limit(0), items), ["s"]).count() == 0


def test_split_summary_counts_values(spark):
    rows = [("a", dt.date(2020, 1, 6), 0.0), ("a", dt.date(2020, 1, 13), 3.0), ("b", dt.date(2020, 1, 6), 3.0), ("b", dt.date(2020, 1, 20), None), ("c", dt.date(2020, 1, 13), 8.5)]
    df = spark.createDataFrame(rows, f"{ITEM} string, week date, target double")
    out = schedule.split_summary({"some": df, "none": df.limit(0)})
    found = {x.part: tuple(x)[1:] for x in out.collect()}
    assert found["some"] == (dt.date(2020, 1, 6), dt.date(2020, 1, 20), 5, 3, 14.5 / 4, 3.0, 0.2)
    assert found["none"] == (None, None, 0, 0, None, None, None)
    # a median beside a distinct count would gather values by item
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
