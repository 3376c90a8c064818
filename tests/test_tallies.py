"""Values that are counted and ranked in the tasks that form them."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from stockloom.operators import histories, tallies, timeseries
from stockloom.plans import audit, catalog

ITEM = "canonical_item_number"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    r = np.random.default_rng(5)
    items = spark.createDataFrame([(f"i{k}", 1 + k % 3, None if k % 4 == 0 else math.nan if k == 5 else float(k % 6)) for k in range(30)], f"{ITEM} string, h int, cost double")
    usage = [(f"i{k}", dt.date(2024, 1, 1) + dt.timedelta(weeks=int(t)), float(r.integers(1, 9))) for k in range(30) for t in r.choice(40, 12, replace=False)]
    return histories.histories(spark.createDataFrame(usage, f"{ITEM} string, week date, consumption double"), items).cache()


def taking(later):
    """s4, target and cost; rows of t from 30 on are in the group ``later``."""

    def taken(batch):
        t = batch.column("t").to_numpy()
        return [tallies.numbers(batch.column(c)) for c in ("s4", "target", "cost")], np.where(t < 20, 0, np.where(t >= 30, later, -1))

    return taken


@pytest.mark.parametrize("merged", [1 << 19, 4])
def test_counts_are_those_of_the_rows(spark, whole, monkeypatch, merged):
    monkeypatch.setattr(tallies, "MERGED", merged)
    monkeypatch.setattr(histories, "ROWS", 100)
    found = {(r.column, repr(r.value)): (r.n0, r.n1) for r in tallies.counts(whole, ["s4", "target"], ["cost"], taking(1), 2, 5).collect()}
    want = {}
    for r in histories.periods(whole, ["s4", "target"], ["cost"], 5).collect():
        for k, v in enumerate((r.s4, r.target, r.cost)):
            if v is not None and (r.t < 20 or r.t >= 30):
                want.setdefault((k, repr(v)), [0, 0])[r.t >= 30] += 1
    assert found == {k: tuple(n) for k, n in want.items()} and any(k[1] == "nan" for k in found)


@pytest.mark.parametrize("most", [1 << 23, 3])
def test_ranks_of_formed_rows_are_those_of_the_frame(spark, whole, monkeypatch, most):
    monkeypatch.setattr(tallies, "LOOKED_UP", most)
    rows = histories.periods(whole, ["s4", "target"], ["cost"], 5, 35).where("t < 20 or t >= 30")
    # one that is no number is the greatest
    plain, asked = timeseries.rank_matrix(rows.withColumn("cost", F.when(F.isnan("cost"), 1e9).otherwise(F.col("cost"))), ["s4", "target", "cost"]).collect(), []
    out = tallies.rank_matrix(whole, ["s4", "target"], ["cost"], taking(0), ["s4", "target", "cost"], 5, 35, lambda: asked.append(1) or timeseries.rank_matrix(rows.withColumn("cost", F.when(F.isnan("cost"), 1e9).otherwise(F.col("cost"))), ["s4", "target", "cost"])).collect()
    assert [(x.a, x.b) for x in out] == [(x.a, x.b) for x in plain] and [x.spearman for x in out] == pytest.approx([x.spearman for x in plain], abs=1e-12)
    assert len(asked) == (most == 3)


def test_rounding_is_away_from_zero():
    x = np.array([0.0078125, -0.0078125, 2.5e-7, 0.1 + 0.2, 7.0, -0.0, np.inf])
    assert tallies.rounded(x, 6).tolist() == [0.007813, -0.007813, 0.0, 0.3, 7.0, 0.0, np.inf]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_rank_matrix_forms_no_frame(spark, monkeypatch):
    monkeypatch.setattr(audit.timeseries, "rank_matrix", lambda *_: pytest.fail("rows left their tasks"))
    assert Counter(x.a for x in catalog.run("agg_rank_matrix", spark, FOLDER).collect())["s4"] == 15


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_drift_of_categories_forms_no_weeks(spark):
    # before, the frame was formed anew for each sample of each category
    assert "MapInArrow" not in catalog.run("mon_feature_drift", spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
