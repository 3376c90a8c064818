"""Search, trees, Shapley values, preparation and the learned models, against brute force, planted targets and SQL."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import learning, schedule, trees
from stockloom.operators.search import Real, Whole, propose, search, spread

ITEM = learning.ITEM
SMALL = {"trees": 30, "depth": 3, "rate": 0.2, "rows": 0.8, "columns": 0.8, "least": 2, "ridge": 1.0}


# --- search ------------------------------------------------------------------

SURFACE = {"a": Whole(150, 400, 50), "b": Real(0.01, 100.0, log=True), "c": Real(-3.0, 3.0), "d": Whole(1, 16)}


def _loss(p):
    return (p["a"] - 300) ** 2 / 1e4 + math.log10(p["b"] / 0.3) ** 2 + (p["c"] - 1.2) ** 2 + (p["d"] - 5) ** 2 / 20


def _other_loss(p):
    return abs(p["a"] - 200) / 100 + abs(math.log10(p["b"] / 20)) + abs(p["c"] + 2) + 0.3 * abs(p["d"] - 12)


@pytest.mark.parametrize(("trials", "most"), [(12, 0.9), (15, 0.8), (30, 0.6)])
def test_search_beats_even_draws(trials, most):
    def even(seed):
        r = np.random.default_rng([seed, 7])
        return [{k: v.back(v.inner()[0] + (v.inner()[1] - v.inner()[0]) * r.random()) for k, v in SURFACE.items()} for _ in range(trials)]

    for loss in (_loss, _other_loss):
        ours = np.array([min(x for _, x in search(SURFACE, lambda ps, loss=loss: [loss(p) for p in ps], trials, seed)) for seed in range(60)])
        drawn = np.array([min(map(loss, even(seed))) for seed in range(60)])
        assert np.median(ours) < most * np.median(drawn) and np.mean(ours < drawn) > 0.6


def test_search_keeps_to_its_space_and_repeats():
    seen = []
    found = search(SURFACE, lambda ps: [seen.append(len(ps)) or 0.0] * len(ps), 12, 5)
    assert len(found) == 12 and seen == [4, 3, 3, 2]
    assert found == search(SURFACE, lambda ps: [0.0] * len(ps), 12, 5)
    for p, _ in found:
        assert p["a"] in range(150, 401, 50) and 0.01 <= p["b"] <= 100 and -3 <= p["c"] <= 3 and p["d"] in range(1, 17)
    assert {p["a"] for p in spread(SURFACE, 6, np.random.default_rng(1))} == set(range(150, 401, 50))
    assert propose({"a": Whole(3, 3)}, [({"a": 3}, math.inf), ({"a": 3}, 1.0)], np.random.default_rng(1)) == {"a": 3}


def test_ranges_are_the_stated_ones():
    assert {k: set(v) for k, v in learning.SPACE.items()} == {"linear": {"alpha"}, "forest": {"trees", "depth", "least"}, "boosted": {"trees", "depth", "rate", "rows", "columns", "least", "ridge"}}
    assert all(p["trees"] in range(250, 601, 50) and 3 <= p["depth"] <= 8 and 0.02 <= p["rate"] <= 0.15 for p in spread(learning.SPACE["boosted"], 12, np.random.default_rng(2)))


# --- trees ---------------------------------------------------------------------


def _slow_value(tree, row, node=0):
    while tree["left"][node]:
        node = tree["left"][node] + (row[tree["feature"][node]] > tree["cut"][node])
    return tree["value"][node]


def _expected(tree, row, known, node=0):
    """A tree's value where only ``known`` features are: others go on by cover."""
    left = tree["left"][node]
    if not left:
        return tree["value"][node]
    f = tree["feature"][node]
    if f in known:
        return _expected(tree, row, known, left + (row[f] > tree["cut"][node]))
    return sum(tree["cover"][c] / tree["cover"][node] * _expected(tree, row, known, c) for c in (left, left + 1))


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_are_those_of_enumeration(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 6, (200, 4)).astype(np.int16)
    y = x[:, 0] * 2.0 + (x[:, 1] > 2) * x[:, 2] + r.normal(size=200)
    tree = trees.grow(x, y, np.ones(200), np.arange(4), 5, 2, 0.5)
    rows = x[:12]
    found = trees.shapley(tree, rows)
    assert trees.predict(tree, rows) == pytest.approx([_slow_value(tree, row) for row in rows])
    assert found.sum(axis=1) == pytest.approx(trees.predict(tree, rows) - trees.mean(tree))
    for row, values in zip(rows, found, strict=True):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            exact = sum(
                math.factorial(n) * math.factorial(3 - n) / math.factorial(4) * (_expected(tree, row, {*s, j}) - _expected(tree, row, set(s)))
                for n in range(4) for s in itertools.combinations(others, n)
            )
            assert values[j] == pytest.approx(exact)


def test_a_tree_splits_where_error_falls_most():
    r = np.random.default_rng(3)
    x = r.integers(0, 9, (120, 3)).astype(np.int16)
    y = np.where(x[:, 1] > 4, 5.0, 0.0) + r.normal(size=120)
    tree = trees.grow(x, y, np.ones(120), np.arange(3), 1, 5, 0.0)
    errors = {}
    for f, cut in itertools.product(range(3), range(8)):
        left = x[:, f] <= cut
        if 5 <= left.sum() <= 115:
            errors[f, cut] = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
    f, cut = min(errors, key=errors.get)
    assert (tree["feature"][0], tree["cut"][0]) == (f, cut)
    left = x[:, f] <= cut
    assert tree["value"][1:].tolist() == pytest.approx([y[left].mean(), y[~left].mean()]) and tree["cover"].tolist() == [120, left.sum(), 120 - left.sum()]
    assert len(trees.grow(x, np.ones(120), np.ones(120), np.arange(3), 4, 1, 0.0)["left"]) == 1
    assert trees.predict(trees.grow(x[:0], y[:0], np.zeros(0), np.arange(3), 4, 1, 1.0), x[:2]).tolist() == [0.0, 0.0]


# --- frames ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    """40 items of 60 weeks; log1p of the target is 1 + 0.5 s4 - 0.25 s13, and 2 more for the segment ``lumpy``."""
    rows = spark.range(2400).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).cast("int").alias("t"))
    value = lambda seed, most: (F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1000)) / 1000.0 * most)
    rows = rows.select(F.concat(F.lit("i"), "k").alias(ITEM), "t", F.lit(2.0).alias("h"), *[value(j, 4.0).alias(c) for j, c in enumerate(learning.NUMBERS) if c != "h"], F.element_at(F.array(F.lit("smooth"), F.lit("lumpy")), (F.col("k") % 2 + 1).cast("int")).alias("segment"), F.lit("A").alias("abc"), F.lit("c").alias("item_class"))
    return rows.withColumn("target", F.expm1(1 + 0.5 * F.col("s4") - 0.25 * F.col("s13") + F.when(F.col("segment") == "lumpy", 2.0).otherwise(0.0))).cache()


def test_linear_model_recovers_a_planted_target(spark, frame):
    train, validation, test = learning.split(frame, 50, 10)
    model = learning.fit("linear", {"alpha": 1e-6}, train.unionByName(validation))
    assert learning.score(learning.predict(model, test)) < 1e-4
    parts = learning.explained(model, test).collect()
    assert all(x.logged == pytest.approx(x["mean"] + sum(x[c] for c in learning.FEATURES)) for x in parts)
    means = {r.feature: r.mean_abs for r in learning.mean_absolute(learning.explained(model, test)).collect()}
    assert {f for f, v in means.items() if v > 0.05} == {"s4", "s13", "segment"}


def test_ridge_is_its_closed_form(spark, frame):
    train = frame.where("t < 5")
    model = learning.fit("linear", {"alpha": 7.0}, train)
    rows = model.preparing.transform(train).select("features", F.log1p("target").alias("y")).collect()
    x, y = np.stack([r.features.toArray() for r in rows]), np.array([r.y for r in rows])
    exact = np.linalg.solve(x.T @ x + 7.0 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.abs(np.array(model.linear.stages[0].coefficients) - exact).max() < 1e-6


@pytest.mark.parametrize(("kind", "params"), [("forest", {"trees": 20, "depth": 9, "least": 2}), ("boosted", SMALL | {"trees": 120})])
def test_tree_models_learn_are_saved_and_explained(spark, frame, tmp_path, kind, params):
    train, _, test = learning.split(frame, 50, 10)
    model = learning.fit(kind, params, train)
    assert learning.score(learning.predict(model, test)) < 0.25
    for _ in range(2):
        learning.save(model, str(tmp_path / "m"))
    again = learning.load(str(tmp_path / "m"))
    told = lambda m: sorted(map(tuple, learning.predict(m, test).select(ITEM, "t", "pred").collect()))
    assert told(again) == told(model) and again.params == params
    found = learning.explained(again, test, 50).collect()
    assert len(found) == 50
    logs = {(i, t): math.log1p(p) for i, t, p in told(model)}
    for x in found:
        assert x.logged == pytest.approx(x["mean"] + sum(x[c] for c in learning.FEATURES)) and x.logged == pytest.approx(logs[x[ITEM], x.t])
    shares = {r.feature: r.importance for r in learning.importance(again).collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "segment" and shares["s4"] > 0.05


def test_medians_and_categories_come_from_training_rows_alone(spark, frame):
    train = frame.where("t < 20").withColumn("standard_cost", F.when(F.col("t") > 2, F.col("standard_cost")))
    wild = frame.where("t >= 50").withColumns({"standard_cost": F.lit(1e9), "segment": F.lit("unseen"), "abc": F.lit("none")})
    median = train.agg(F.percentile_approx("standard_cost", 0.5, 10_000)).first()[0]
    preparing = learning.preparation(False).fit(train)
    missing = wild.withColumn("standard_cost", F.lit(None).cast("double"))
    out = preparing.transform(missing).select("standard_cost__n", "segment__c", "abc__c").distinct().collect()
    assert len(out) == 1 and out[0].standard_cost__n == pytest.approx(median, rel=1e-2) and (out[0].segment__c, out[0].abc__c) == (2.0, 1.0)
    # a linear model predicts rows of a category that it hasn't seen
    assert learning.predict(learning.fit("linear", {"alpha": 1.0}, train), missing).where("pred is not null").count() == missing.count()


def test_numbers_that_are_none(spark):
    weeks = spark.createDataFrame([("a", 1, float("nan"))], f"{ITEM} string, t int, s4 double")
    weeks = weeks.withColumns({c: F.lit(1.0) for c in learning.NUMBERS if c not in ("s4", "standard_cost", "corrected_lead_days", "annual_consumption")})
    items = spark.createDataFrame([("a", None, "B", "c", float("inf"), None, 2.0)], f"{ITEM} string, segment string, abc string, item_class string, corrected_lead_days double, annual_consumption double, standard_cost double")
    x = learning.with_attributes(weeks, items).first()
    assert (x.s4, x.corrected_lead_days, x.annual_consumption, x.standard_cost, x.segment) == (None, None, None, 2.0, "none")


def test_trials_select_the_least_error(spark, frame, monkeypatch):
    small = {"linear": {"alpha": Real(0.01, 100.0, log=True)}, "forest": {"trees": Whole(4, 12, 4), "depth": Whole(2, 5), "least": Whole(1, 8)}, "boosted": learning.SPACE["boosted"] | {"trees": Whole(20, 40, 10)}}
    monkeypatch.setattr(learning, "SPACE", small)
    trials = learning.trial_table(frame, 50, trials=4, most=600).cache()
    rows = trials.collect()
    assert {(r.candidate, r.trial) for r in rows} == {(k, n) for k in small for n in range(4)} and all(0 <= r.validation_wape < 2 for r in rows)
    best = learning.best_trials(trials)
    assert {k: e for k, (_, e) in best.items()} == {k: min(r.validation_wape for r in rows if r.candidate == k) for k in small}
    out = {r.candidate: r for r in learning.candidates(frame, trials, 50).collect()}
    assert [k for k, r in out.items() if r.selected] == ["linear"] and out["linear"].test_wape < 0.05
    curve = learning.learning_curve(frame, trials, 50).orderBy("share").collect()
    assert [x.share for x in curve] == [0.1, 0.25, 0.5, 0.75, 1.0] and [x.training_rows for x in curve] == sorted(x.training_rows for x in curve)
    model = learning.selected(frame, trials, 50)
    assert model.kind == "linear" and learning.score(learning.predict(model, frame.where("t >= 50"))) < 0.05


def test_cleaning_tiers_keep_their_order(spark, frame):
    noise = F.pmod(F.xxhash64(ITEM, "t", F.lit(99)), F.lit(1000)) / 250.0
    tiers = {"clean": frame, "noisy": frame.withColumn("s4", F.col("s4") + noise)}
    rows = {r.tier: r.test_wape for r in learning.cleaning_tiers(tiers, "linear", {"alpha": 0.1}, 50).collect()}
    assert rows["clean"] < rows["noisy"]


def test_selection_prefers_the_favourite_within_slack():
    assert learning.select({"linear": 0.30, "boosted": 0.304}) == "boosted"
    assert learning.select({"linear": 0.30, "boosted": 0.306}) == "linear"


LIFT = """
with long as (unpivot (select segment, target, ma4, ma13, ma52, snaive from tested) on ma4, ma13, ma52, snaive into name method value forecast),
  methods as (select segment, method from (select segment, method, sum(abs(target - forecast)) / nullif(sum(target), 0) as w from long group by all)
    qualify row_number() over (partition by segment order by w nulls last, list_position(['ma4', 'ma13', 'ma52', 'snaive'], method)) = 1),
  rows as (select t.*, method, case method when 'ma4' then ma4 when 'ma13' then ma13 when 'ma52' then ma52 else snaive end as base, nullif(scale * h, 0) as unit
    from tested t join methods using (segment) left join scales using (canonical_item_number)),
  levels as (select 'segment' as level, segment as value, * from rows union all select 'abc', abc, * from rows union all select 'all', 'all', * from rows),
  found as (select level, value, count(*) as n, sum(abs(target - pred)) / nullif(sum(target), 0) as model_wape, sum(abs(target - base)) / nullif(sum(target), 0) as base_wape,
    avg(abs(target - pred)) filter (unit > 0) / avg(unit) filter (unit > 0) as mase, sum(pred - target) / nullif(sum(target), 0) as bias, if(level = 'segment', max(method), null) as method from levels group by level, value)
select level, value, n, model_wape, base_wape, (base_wape - model_wape) / nullif(base_wape, 0) as lift, mase, bias, method from found"""


def test_lift_is_its_sql(spark):
    rows = spark.range(600).select(F.concat(F.lit("i"), F.col("id") % 25).alias(ITEM), (F.col("id") % 37).cast("int").alias("t"), (F.col("id") % 4 + 1).alias("h"), F.element_at(F.array(*map(F.lit, ("smooth", "lumpy", "erratic"))), (F.col("id") % 3 + 1).cast("int")).alias("segment"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("abc"),
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(90)).cast("double")).alias(c) for k, c in enumerate(("target", "pred", *schedule.BASES))]).withColumn("target", F.when(F.col("segment") == "erratic", 0.0).otherwise(F.col("target")))
    grid = spark.createDataFrame([(f"i{k}", t, float((k * t) % 5)) for k in range(24) for t in range(12)], f"{ITEM} string, t int, s double")
    scales = learning.one_step_scales(grid, 10)
    con = duckdb.connect()
    tested, scale = rows.toPandas(), scales.toPandas()
    assert scale.set_index(ITEM).scale["i3"] == pytest.approx(np.abs(np.diff([(3 * t) % 5 for t in range(10)])).mean())
    con.register("tested", tested)
    con.register("scales", scale)
    plain = lambda found: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found], key=repr)
    names = ("level", "value", "n", "model_wape", "base_wape", "lift", "mase", "bias", "method")
    assert plain(learning.lift(rows, schedule.BASES, scales).select(*names).collect()) == plain(con.execute(LIFT).fetchall())
