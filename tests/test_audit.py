"""Checks, picks by place, rank correlations, visibility within lead times and the textbook loss, against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockloom.functions.measures import erf, normal_loss
from stockloom.operators import checks, timeseries
from stockloom.operators.checks import Check

D = dt.date
ITEM = "canonical_item_number"


def test_checks_are_one_aggregate_a_table(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "x", 3.0), (None, None, 4.0)], "k int, kind string, x double")
    none = rows.limit(0)
    rules = [
        Check("rows", "t", F.count("*"), 4, 4), Check("share", "t", checks.share(F.col("x") > 2), 50, 60), Check("too many", "t", checks.share(F.col("x") > 2), None, 49.9), Check("repeated", "t", checks.repeated("k"), None, 0),
        Check("strange", "t", checks.strays("kind", ("a", "b")), None, 0), Check("ratio", "t", checks.ratio(F.sum("x"), F.sum("k")), 200, None), Check("no value", "none", checks.share(F.col("x") > 2), None, None), Check("nothing", "none", F.count("*"), 0, 0),
        Check("no whole", "none", checks.ratio(F.sum("x"), F.sum("k")), 0, 100),
    ]
    found = checks.verify(rules, {"t": rows, "none": none})
    assert found._jdf.queryExecution().toString().count("Scan") <= 2 * 4 * 2
    out = {r.check: (r.value, r.status) for r in found.collect()}
    assert out["rows"] == (4.0, "PASS") and out["share"] == (50.0, "PASS") and out["too many"] == (50.0, "FAIL")
    assert out["repeated"] == (2.0, "FAIL") and out["strange"] == (1.0, "FAIL") and out["ratio"] == (225.0, "PASS")
    assert out["no value"] == (None, "FAIL") and out["nothing"] == (0.0, "PASS") and out["no whole"] == (None, "FAIL")
    parents = spark.createDataFrame([("a",), (None,)], "name string")
    assert sorted(r.kind for r in checks.orphans(rows, "kind", parents, "name").collect()) == ["b", "x"]


def _values(r, n):
    return [(f"k{k:04d}", r.choice("abc"), r.choice((0.0, 0.0, 0.0, 1.0, float(r.randrange(50)), r.random() * 1e6, -float(r.randrange(9))))) for k in range(n)]


def test_places_and_picks(spark):
    rows = _values(random.Random(1), 700)
    df = spark.createDataFrame(rows, "key string, g string, v double").repartition(5)
    out = {x.key: x.place for x in timeseries.placed(df, ["v", "key"], ["g"]).collect()}
    for g in "abc":
        own = sorted((v, k) for k, h, v in rows if h == g)
        assert [out[k] for _, k in own] == list(range(1, len(own) + 1))
    for share in (0.0, 0.25, 0.6, 0.999):
        picked = {x.g: x.key for x in timeseries.positional(df, "v", "key", share, "g").collect()}
        assert picked == {g: (own := sorted((v, k) for k, h, v in rows if h == g))[int(len(own) * share)][1] for g in "abc"}
    assert timeseries.placed(df.limit(0), ["v", "key"]).count() == 0 and timeseries.positional(df.limit(0), "v", "key", 0.6, "g").count() == 0


def test_concentration_and_classes_with_many_zeros(spark):
    r = random.Random(2)
    rows = [(f"k{k:04d}", 0.0 if r.random() < 0.6 else r.random() ** 3 * 1000) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, value double")
    ranked = sorted((v for _, v in rows), reverse=True)
    for up, k in ((True, math.ceil(100.2)), (False, 100)):
        del up, k
    assert timeseries.concentration(df, "value", "key").first().top_share == pytest.approx(sum(ranked[:100]) / sum(ranked))
    some = df.limit(7)
    top = sorted((x.value for x in some.collect()), reverse=True)
    assert timeseries.concentration(some, "value", "key", 0.2, rounded_up=False).first().top_share == pytest.approx(top[0] / sum(top))
    assert timeseries.concentration(some, "value", "key", 0.2).first().top_share == pytest.approx(sum(top[:2]) / sum(top))
    out = {x.key: x for x in timeseries.abc_classes(df, 0.8, 0.95, "key").collect()}
    total = reached = 0.0
    total = sum(ranked)
    for k, v in sorted(rows, key=lambda x: (-x[1], x[0])):
        reached += v
        assert out[k].share == pytest.approx(reached / total)
        assert v > 0 or out[k].abc == "C"


def test_rank_matrix_is_that_of_average_ranks(spark):
    r = random.Random(3)
    rows = [(float(k % 7), r.choice((0.0, -0.0, 1.5, None)), r.random(), float(k // 9), None) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    table = pd.DataFrame(rows, columns=list("abcde")).astype(float)
    # nulls rank nowhere, so ranks are over a column's own values
    exact = table.rank().corr()
    out = {(x.a, x.b): x.spearman for x in timeseries.rank_matrix(df, list("abcde")).collect()}
    assert len(out) == 10
    for (a, b), value in out.items():
        assert (value is None or math.isnan(value)) if "e" in (a, b) else value == pytest.approx(exact.loc[a, b])


def test_visible_within_lead(spark):
    r = random.Random(4)
    start = D(2020, 1, 1)
    day = lambda k: start + dt.timedelta(k)
    lines = [(r.choice("abch"), None if r.random() < 0.1 else day(r.randrange(300)), None if r.random() < 0.05 else day(r.randrange(320)), float(r.randrange(1, 9)) / 2) for _ in range(600)]
    lines += [("h", day(5), day(100), 1.0)] * 500 + [("z", day(1), day(50), 1.0)]
    lead = {"a": 30, "b": 1, "c": 90, "h": 45, "none": 10}
    origins = [day(k) for k in range(0, 330, 7)]
    found = timeseries.visible_within_lead(
        spark.createDataFrame(lines, "k string, release date, due date, qty double"), spark.createDataFrame([(o,) for o in origins], "origin date"), spark.createDataFrame(list(lead.items()), "k string, lead int"), "k"
    )
    exact = {}
    for k, days in lead.items():
        for o in origins:
            q = sum(q for i, rel, due, q in lines if i == k and due and o < due <= o + dt.timedelta(days) and (rel is None or rel <= o))
            if q:
                exact[k, o] = q
    assert {(x.k, x.origin): x.visible for x in found.collect()} == exact


def test_normal_loss(spark):
    grid = [k / 100 for k in range(-400, 601, 7)]
    out = spark.createDataFrame([(k,) for k in grid], "k double").select("k", erf(F.col("k") / math.sqrt(2)).alias("e"), normal_loss(F.col("k")).alias("loss")).collect()
    for x in out:
        assert x.e == pytest.approx(math.erf(x.k / math.sqrt(2)), abs=1e-12)
        assert x.loss == pytest.approx(math.exp(-x.k * x.k / 2) / math.sqrt(2 * math.pi) - x.k * 0.5 * math.erfc(x.k / math.sqrt(2)), abs=1e-11)


def test_forward_sums_are_those_of_the_frame(spark):
    r = random.Random(6)
    rows = [(k, t, D(2020, 1, 6) + dt.timedelta(7 * t), float(r.choice((0, 0, r.randrange(9))))) for k in ("a", "b") for t in range(70)] + [("short", t, D(2020, 1, 6) + dt.timedelta(7 * t), 1.0) for t in range(20)]
    grid = spark.createDataFrame(rows, f"{ITEM} string, t int, week date, s double").repartition(3)
    items = spark.createDataFrame([("a", 21.0), ("b", 500.0), ("short", 7.0)], f"{ITEM} string, corrected_lead_days double")
    series = {k: [x[3] for x in rows if x[0] == k] for k in ("a", "b")}
    out = {(x[ITEM], x.t): x for x in timeseries.forward_sums(grid, items).collect()}
    assert set(out) == {(k, t) for k in series for t in range(52, 70)}
    for (k, t), x in out.items():
        s, h = series[k], {"a": 3, "b": 71}[k]
        assert (x.h, x.target, x.ly) == (h, sum(s[t : t + h]) if t + h <= 70 else None, sum(s[t - 52 : min(t - 52 + h, t)]))
