"""Made-up histories, builds, the monthly frame and merging on hand-made rows and against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions.measures import signed_quantity
from stockloom.operators import builds, forecast, synthesis, timeseries
from stockloom.params import Params

D = dt.date
ITEM = "canonical_item_number"


def _orders_by_hand(lines, most, days):
    out, state = {}, {}
    for supplier, day, seq in sorted(lines):
        no, first, used = state.get(supplier, (0, None, 0))
        if first is None or (day - first).days > days or used == most[supplier]:
            no, first, used = no + 1, day, 0
        used += 1
        state[supplier] = (no, first, used)
        out[(supplier, day, seq)] = (no, used)
    return out


@pytest.mark.parametrize("spread", [3, 60])
def test_orders_are_assembled_as_line_by_line(spark, spread):
    r = random.Random(spread)
    most = {"hot": 7, "b": 1, "c": 3}
    lines = [(r.choice(["hot", "hot", "hot", "b", "c"]), D(2000, 1, 1) + dt.timedelta(r.randrange(spread)), k) for k in range(400)]
    df = spark.createDataFrame([(*x, most[x[0]]) for x in lines], "supplier_id string, order_date date, line_seq int, most int").repartition(7)
    found = {(x.supplier_id, x.order_date, x.line_seq): (x.order_no, x.line) for x in synthesis.assembled_orders(df, F.col("most")).collect()}
    assert found == _orders_by_hand(lines, most, 5)


def test_orders_of_nulls_and_of_nothing(spark):
    schema = "supplier_id string, order_date date, line_seq int, most int"
    df = spark.createDataFrame([(None, D(2000, 1, 1), 1, 2), ("a", None, 2, 2), ("a", D(2000, 1, 1), 3, 2)], schema)
    found = {x.line_seq: (x.order_no, x.line) for x in synthesis.assembled_orders(df, F.col("most")).collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (1, 1)}
    assert synthesis.assembled_orders(spark.createDataFrame([], schema), F.col("most")).count() == 0


def test_counts_post_what_the_books_miss(spark):
    ledger = spark.createDataFrame([("a", D(2000, 1, 1), "RECEIPT", 10.0), ("a", D(2000, 1, 5), "ISSUE", 4.0)], "item_number string, txn_date date, txn_type string, qty double")
    days = [("1", "a", D(2000, 1, 2), 8.0), ("2", "a", D(2000, 1, 6), 5.0), ("3", "a", D(2000, 1, 6), 5.0), ("4", "b", D(2000, 1, 1), 3.0)]
    counts = spark.createDataFrame(days, "count_id string, item_number string, count_date date, counted_qty double")
    found = {r.count_id: (r.system, r.correction) for r in synthesis.count_postings(counts, ledger, signed_quantity()).collect()}
    # after the first count the books hold 8, after the issue 4, after the second count 5
    assert found == {"1": (10, -2), "2": (4, 1), "3": (5, 0), "4": (0, 3)}


def test_builds_take_what_bills_say(spark):
    jobs = spark.createDataFrame(
        [("j1", "PRD-1", D(2000, 1, 3), 2), ("j2", "PRD-1", D(2001, 1, 3), 1), ("j3", "PRD-1", None, 0)], "order_id string, product_number string, completed_date date, qty_completed int"
    )
    bill = spark.createDataFrame([("PRD-1", "a", 1.0), ("PRD-1", "SUB-1", 2.0), ("SUB-1", "b", 3.0)], "product_number string, component_item string, qty_per double")
    changes = spark.createDataFrame([("SUB-1", "c", 5)], "product_number string, component_item string, qty_per int")
    made = builds.exploded_builds(builds.monthly_builds(jobs), bill)
    assert sorted((r.component_item, r.month, r.qty) for r in made.collect()) == [("a", D(2000, 1, 1), 2.0), ("a", D(2001, 1, 1), 1.0), ("b", D(2000, 1, 1), 12.0), ("b", D(2001, 1, 1), 6.0)]
    gaps = {(r.order_id, r.component_item): (r.taken, r.recorded, r.unrecorded) for r in builds.backflush_gaps(jobs, bill, changes, "2000-12-31").collect()}
    assert gaps == {("j1", "a"): (2, 2, 0), ("j1", "b"): (12, 12, 0), ("j1", "c"): (20, 0, 20), ("j2", "a"): (1, 1, 0), ("j2", "b"): (6, 6, 0), ("j2", "c"): (10, 10, 0)}


def test_monthly_parts_do_not_overlap(spark):
    s = [float((7 * k) % 5) for k in range(60)]
    grid = spark.createDataFrame([("a", k, D(2000 + k // 12, k % 12 + 1, 1), x) for k, x in enumerate(s)], f"{ITEM} string, t int, month date, s double")
    found = {r.t: r for r in timeseries.monthly_frame(grid, spark.createDataFrame([("a", 90.0)], f"{ITEM} string, corrected_lead_days double")).collect()}
    assert sorted(found) == list(range(12, 58))
    first, opens = 60 - 3 - 11, 60 - 3 - 11 - 6
    for t, r in found.items():
        part = "test" if t >= first else "validation" if t >= opens and t + 3 <= first else "train" if t + 3 <= opens else "gap"
        past = np.array(s[:t])
        assert (r.part, r.target) == (part, sum(s[t : t + 3]))
        assert r.since_nz == t - 1 - np.nonzero(past)[0][-1]
        assert (r.trend, r.spike) == (pytest.approx(past[-3:].mean() - past[-6:].mean()), pytest.approx(past[-1] / (past[-6:].mean() + 1)))


def test_merging_alternating_records_helps(spark):
    schema = f"{ITEM} string, history array<double>"
    merged = spark.createDataFrame([("a", [10.0] * 36), ("z", [0.0] * 36)], schema)
    halves = [10.0 if k % 2 else 0.0 for k in range(36)]
    records = spark.createDataFrame([("a", halves), ("a2", [10 - x for x in halves]), ("z", [0.0] * 36), ("z2", [0.0] * 36)], schema)
    members = spark.createDataFrame([("a", "a"), ("a2", "a"), ("z", "z"), ("z2", "z")], f"item_number string, {ITEM} string")
    found = {r[ITEM]: r for r in forecast.merge_gain(merged, records, members, Params()).collect()}
    assert (found["a"].records, found["a"].after) == (2, 0.0)
    # seasonal naive is right for both records
    assert (found["a"].before, found["a"].gain) == (0.0, None)
    assert (found["z"].before, found["z"].after, found["z"].gain) == (None, None, None)
