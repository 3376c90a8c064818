"""Medians in one reading, samples without features, and trees that rows walk in blocks."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stockloom.operators import learning, trees

ITEM = "canonical_item_number"


def _rows(spark, n=3000):
    r = random.Random(4)
    numbers = lambda: [r.choice((None, float("nan"), -r.random(), 0.0, -0.0, 7.0, 1e9 * r.random())) for _ in learning.NUMBERS]
    rows = [(f"i{k % 40}", k // 40, *numbers(), *[r.choice(("a", "b", "none")) for _ in learning.CATEGORIES], r.random()) for k in range(n)]
    names = ", ".join([f"{ITEM} string, t int", *[f"{c} double" for c in learning.NUMBERS], *[f"{c} string" for c in learning.CATEGORIES], "target double"])
    return rows, spark.createDataFrame(rows, names).repartition(5)


def test_medians_are_elements_of_middle_rank(spark):
    rows, df = _rows(spark)
    stand = learning.typical(df).collect()
    for k, c in enumerate(learning.NUMBERS):
        known = sorted(x[2 + k] for x in rows if x[2 + k] is not None and not math.isnan(x[2 + k]))
        assert {x[c] for x in stand} == {known[math.ceil(len(known) / 2) - 1]}
    assert all({x[c] for x in stand} == {"a", "b", "none"} for c in learning.CATEGORIES)


def test_medians_within_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(learning, "COARSE", 60)  # all positive values begin in a few cells
    r = random.Random(9)
    values = [1 + r.random() for _ in range(2001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    df = df.select(*[F.col("v").alias(c) for c in learning.NUMBERS], *[F.lit("x").alias(c) for c in learning.CATEGORIES])
    assert all(x == sorted(values)[1000] for x in learning.typical(df).first()[: len(learning.NUMBERS)])


def test_sample_reads_features_of_its_items_alone(spark):
    _, df = _rows(spark)
    df = df.withColumn("h", F.lit(2))
    asked = []
    base = learning.Frames.of(df)
    frames = learning.Frames(lambda start, stop, items: asked.append(items) or base.whole(start, stop, items), base.slim)
    told = lambda x: sorted(map(repr, x.collect()))
    part = lambda rows: rows.where("t < 60")
    assert told(learning.sampled_from(frames, part, 30)) == told(learning.sampled(part(df), 30))
    assert asked[0].count() < 40
    assert told(learning.sampled_from(frames, part, 9999)) == told(part(df)) and asked[1] is None


def test_rows_walk_trees_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    x = r.integers(0, 20, (500, 4)).astype(np.int16)
    y = np.where(r.random(500) < 0.5, 0.0, x[:, 0] * x[:, 1] / 9.0)
    found = list(trees.boost(x, y, {"trees": 12, "depth": 5, "rate": 0.1, "rows": 0.9, "columns": 1.0, "least": 2, "ridge": 1.0}, 1))

    def one(tree, row):
        k = 0
        while tree["left"][k]:
            k = tree["left"][k] + (row[tree["feature"][k]] > tree["cut"][k])
        return tree["value"][k]

    monkeypatch.setattr(trees, "BLOCK", 64)
    assert np.allclose(trees.summed([trees.routed(t) for t in found], x), [sum(one(t, row) for t in found) for row in x])


def test_linear_model_is_that_of_the_rows(spark):
    _, df = _rows(spark, 800)
    alpha = 3.0
    model = learning.fit("linear", {"alpha": alpha}, df)
    found = learning._prepared(model.preparing, df, ["target"]).collect()
    x, y = np.array([r.features.toArray() for r in found]), np.log1p([r.target for r in found])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0, ddof=1)[x.std(axis=0) > 0], 1)
    expected = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    line = model.linear.stages[0]
    assert np.allclose(line.coefficients.toArray(), expected, atol=1e-9) and abs(line.intercept - y.mean()) < 1e-9


def test_moments_of_parts_add_up(spark):
    _, df = _rows(spark, 800)
    raw = learning.preparation(True)
    fixed = learning.Pipeline(stages=raw.getStages()[:-1]).fit(learning.typical(df)).transform(df.withColumn("label", F.log1p("target")))
    one, many = learning.moments_of(fixed.coalesce(1)), learning.moments_of(fixed)
    assert one.n == many.n == 800 and np.allclose(one.mean, many.mean) and np.allclose(one.cross, many.cross, rtol=1e-9)
