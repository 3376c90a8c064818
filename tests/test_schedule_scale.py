"""The schedule's search and fold over many rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators import marts, schedule
from stockloom.params import SERVICE_LEVEL, Params
from stockloom.plans import catalog, planning
from stockloom.plans.warehouse import Warehouse

ITEM = "canonical_item_number"
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
@pytest.mark.parametrize("name", ["pol_schedule", "pol_churn"])
def test_origins_are_not_shuffled_and_no_lambda_runs_over_them(spark, name):
    found = plan(catalog.run(name, spark, FOLDER))
    # the uppermost step that forms weeks is the schedule's own; what it reads stands below
    above = found.split("MapInArrow")[:2]
    assert "hashpartitioning" not in "".join(above) and "Window" not in "".join(above)
    assert "aggregate(" not in found.split("SortMergeJoin")[0]


@pytest.mark.parametrize("together", [True, False])
def test_points_hold_across_batches(spark, together):
    r = random.Random(3)
    series = {f"i{k}": [r.choice((None, 0.0, -1.0, 10.0 + 6 * r.random())) if r.random() < 0.2 else 10 + 6 * r.random() for _ in range(r.choice((1, 2, 30)))] for k in range(60)}
    rows = [(i, t, 2, float(t), 1.0 * t, x, x, 0.5, 7.0, f"{i}-{t}") for i, xs in series.items() for t, x in enumerate(xs)]
    if not together:
        r.shuffle(rows)
    points = spark.createDataFrame(rows, f"{ITEM} string, t int, h int, forecast double, level double, safety_stock double, reorder_point double, share double, lot double, own string").coalesce(1)
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(small)
    spark.conf.set(small, "7")
    try:
        out = {(x[ITEM], x.t): x for x in schedule.applied(points, Params(), together=together, before=True).collect()}
    finally:
        spark.conf.set(small, usual)
    assert len(out) == len(rows)
    for i, xs in series.items():
        last, origin, raw_before, before = None, 0, None, None
        for t, x in enumerate(xs):
            if not (last is not None and x is not None and last > 0 and abs(x - last) / last <= Params().hysteresis):
                last, origin = None if x is None else round(x, 2), t
            found = out[i, t]
            assert (found.raw, found.level, found.own) == (x, float(origin), f"{i}-{t}") and (found.raw_before, found.before) == (raw_before, before)
            assert found.reorder_point == (None if last is None else pytest.approx(last, abs=0.011))
            last, raw_before, before = found.reorder_point, x, found.reorder_point


def test_safety_factors_are_exact_without_a_class_in_one_task(spark):
    r = random.Random(5)
    rows = [("A", r.gauss(0, 1)) for _ in range(1001)] + [("B", float(r.randrange(-3, 4))) for _ in range(500)] + [("C", -2.5), ("D", 1.0)]
    errors = spark.createDataFrame(rows, "abc string, z double")
    out = schedule.safety_factors(errors)
    want = {abc: errors.where(f"abc = '{abc}'").agg(F.percentile("z", level)).first()[0] for abc, level in SERVICE_LEVEL.items()}
    assert {x.abc: x.factor for x in out.collect()} == want
    assert "percentile(" not in plan(out)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_demand_is_summed_once_more_than_its_sources(spark):
    w = Warehouse.over_star_schema(spark, FOLDER)
    found = plan(marts.true_demand(w.stg("true_direct_demand"), w.stg("true_backflush"), w.crosswalk))
    assert not [line for line in found.splitlines() if "Aggregate(keys=[item_id" in line and "sum(" in line]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_shuffled_predictions_give_the_same_schedule(spark):
    w = Warehouse.over_star_schema(spark, FOLDER)

    def shuffled(w, start, stop=None, facts=None):
        rows = planning.rate(w, start, stop).repartition(3, "t")
        return rows if facts is None else planning.beside(rows, facts)

    own, other = planning.planned(w), planning.planned(w, shuffled)
    # factors are sums in another order, so last digits may differ
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in df.select(*own.columns).collect())
    assert plain(own) == plain(other)
