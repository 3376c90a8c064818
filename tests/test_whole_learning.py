"""Models learn from all rows, and trees that all tasks grow together are those of one task."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import growing, learning, trees
from stockloom.operators.search import Real, Whole

ITEM = learning.ITEM
BOOSTED = {"trees": 6, "depth": 4, "rate": 0.3, "rows": 1.0, "columns": 1.0, "least": 2, "ridge": 1.0}


def rows_of(spark, n, weeks=60):
    rows = spark.range(n).select(F.concat(F.lit("i"), F.floor(F.col("id") / weeks)).alias(ITEM), (F.col("id") % weeks).cast("int").alias("t"), "id")
    value = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 250.0
    rows = rows.select(ITEM, "t", F.lit(2.0).alias("h"), *[value(j).alias(c) for j, c in enumerate(learning.NUMBERS) if c != "h"], F.element_at(F.array(F.lit("smooth"), F.lit("lumpy")), (F.col("id") % 2 + 1).cast("int")).alias("segment"), F.lit("A").alias("abc"), F.lit("c").alias("item_class"))
    return rows.withColumn("target", F.expm1(1 + 0.5 * F.col("s4") - 0.25 * F.col("s13") + F.when(F.col("segment") == "lumpy", 2.0).otherwise(0.0)))


@pytest.mark.parametrize(("kind", "params"), [("boosted", BOOSTED | {"trees": 1}), ("forest", {"trees": 1, "depth": 3, "least": 1})])
def test_trees_learn_from_all_rows(spark, kind, params):
    # before, about 12,000 of them
    model = learning.fit(kind, params, rows_of(spark, 18_000))
    assert model.nodes.where("tree = 0 and node = 0").first().cover == 18_000


def test_search_sees_all_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "SPACE", {"boosted": learning.SPACE["boosted"]})
    monkeypatch.setattr(learning, "tune", lambda kind, train, validation, trials, ground, **known: seen.append((train.count(), validation.count(), ground.n, ground.table.count())) or [(BOOSTED, 0.5)])
    frame = rows_of(spark, 18_000)
    learning.trial_table(frame, 50)
    train, validation, _ = (part.count() for part in learning.split(frame, 50))
    # before, about 4,000 of each
    assert seen == [(train, validation, train, train)] and min(train, validation) > 6000


def test_curve_learns_from_shares_of_all_rows(spark, monkeypatch):
    frame = rows_of(spark, 18_000)
    trials = spark.createDataFrame([("boosted", 0, list(BOOSTED), [float(v) for v in BOOSTED.values()], 0.5)], "candidate string, trial int, names array<string>, values array<double>, validation_wape double")
    out = learning.learning_curve(frame, trials, 56, shares=(0.5, 1.0)).orderBy("share").collect()
    whole = learning.learned_from(frame, 56).count()
    assert out[1].training_rows == whole > 15_000 and abs(out[0].training_rows / whole - 0.5) < 0.05
    assert all(0 < r.train_wape < 1 and 0 < r.test_wape < 1 for r in out)


def test_all_held_out_rows_are_explained(spark):
    rows = rows_of(spark, 4000)
    model = learning.fit("linear", {"alpha": 1.0}, rows)
    assert learning.explained(model, rows, None).count() == 4000


def test_bins_hold_equal_shares_of_all_rows(spark):
    rows = rows_of(spark, 6000).withColumn("s26", F.when(F.col("t") < 50, 0.0).otherwise(F.col("s26") - 2))
    preparing = learning.preparation(False).fit(rows)
    edges, n = learning.edges_of(preparing.transform(rows))
    assert n == 6000 and len(edges) == len(learning.FEATURES) and len(edges[learning.FEATURES.index("h")]) == 0
    values = {c: np.array([r[0] for r in rows.select(c).collect()]) for c in ("s4", "s26")}
    codes = np.bincount(trees.binned(values["s4"][:, None], [edges[0]]).ravel(), minlength=trees.BINS)
    assert len(codes) == trees.BINS and codes.max() < 2 * 6000 / trees.BINS
    # most are one value, which no bin shares with greater ones
    assert set(np.searchsorted(edges[2], [0.0, 1.9])) == {list(edges[2]).index(0.0), len(edges[2])}


def _by_place(nodes):
    return [tuple(r) for r in nodes.select("tree", "node", "feature", "cut", "left", "value", "cover").orderBy("tree", "node").collect()]


def test_boosted_trees_of_all_tasks_are_those_of_one(spark, monkeypatch):
    rows = rows_of(spark, 5000)
    alone = _by_place(learning.fit("boosted", BOOSTED, rows).nodes)
    monkeypatch.setattr(growing, "HELD", 100)
    monkeypatch.setattr(growing, "BLOCK", 300)
    monkeypatch.setattr(growing, "LINEAGE", 4)
    together = _by_place(learning.fit("boosted", BOOSTED, rows).nodes)
    assert len(alone) == len(together) > 60
    for a, b in zip(alone, together, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_no_more_than_two_checkpoints_of_blocks_are_kept(spark, monkeypatch):
    monkeypatch.setattr(growing, "LINEAGE", 2)
    rows = growing.Rows(spark.createDataFrame([(k, [k % 7], float(k)) for k in range(50)], growing.CODED), 1, 1)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(growing.folder(spark))
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    tree = {name: np.array([{"feature": -1, "value": 0.5, "cover": 50}.get(name, 0)]).astype(kind) for name, kind in trees.NODE}
    total = lambda number, x, y, held: held.sum(axis=1)
    seen = []
    for _ in range(9):
        rows.update({0: tree})
        assert rows.added_up([total])[0] == pytest.approx([0.5 * 50 * rows.updates])
        seen.append(len(list(top.glob("rdd-*"))))
    rows.released()
    assert max(seen) == 2 and not list(top.glob("rdd-*"))


def test_forest_is_grown_to_its_ends_in_rounds(spark, monkeypatch):
    rows = rows_of(spark, 5000)
    params = {"trees": 5, "depth": 9, "least": 3}
    monkeypatch.setattr(growing, "HELD", 700)
    monkeypatch.setattr(growing, "ROUND", 2 * 5000 * 32)
    monkeypatch.setattr(growing, "MESSAGES", 1)
    monkeypatch.setattr(learning, "WALKED", 600)
    model = learning.fit("forest", params, rows)
    found = learning.ensemble(model)
    assert len(found) == 5 and model.nodes.select("tree", "node").distinct().count() == model.nodes.count()
    for tree in found:
        inner = np.flatnonzero(tree["left"])
        children = np.concatenate([tree["left"][inner], tree["left"][inner] + 1])
        assert tree["cover"][0] == 5000 and sorted(children) == list(range(1, len(tree["left"])))
        assert np.allclose(tree["cover"][tree["left"][inner]] + tree["cover"][tree["left"][inner] + 1], tree["cover"][inner])
        assert tree["cover"].min() >= 3 and 4 < trees.depth_of(tree) <= 9 and len(inner) > 30
    assert learning.score(learning.predict(model, rows)) < 0.2


def test_drawn_rows_are_as_many_as_there_are():
    sizes = np.array([300.0, 0.0, 700.0])
    parts = [trees.drawn(sizes, k, 5) for k in range(3)]
    assert sum(p.sum() for p in parts) == 1000 and [len(p) for p in parts] == [300, 0, 700] and 0.55 < np.mean(np.concatenate(parts) > 0) < 0.72


def test_search_with_trees_of_all_tasks(spark, monkeypatch):
    frame = rows_of(spark, 6000)
    monkeypatch.setattr(learning, "SPACE", {"forest": {"trees": Whole(3, 5), "depth": Whole(3, 6), "least": Whole(1, 4)}, "boosted": learning.SPACE["boosted"] | {"trees": Whole(8, 12), "rate": Real(0.2, 0.4)}})
    monkeypatch.setattr(growing, "HELD", 500)
    out = learning.trial_table(frame, 56, trials=2).collect()
    assert len(out) == 4 and all(0 < r.validation_wape < 0.8 for r in out)


@pytest.mark.parametrize("kept", [0, 3, 1024])
def test_heavier_children_have_what_lighter_ones_lack(monkeypatch, kept):
    r = np.random.default_rng(8)
    x = r.integers(0, 30, (3000, 5)).astype(np.int8)
    y = x[:, 0] * 0.3 + (x[:, 1] > 9) * x[:, 2] + r.normal(size=3000)
    monkeypatch.setattr(trees, "KEPT", kept)
    summed, bincount = [], np.bincount
    monkeypatch.setattr(trees.np, "bincount", lambda key, *rest: summed.append(len(key)) or bincount(key, *rest))
    tree = trees.grow(x, y, np.ones(3000), np.arange(5), 7, 3, 0.5)
    monkeypatch.undo()
    # before, every level summed all of its rows for each feature, and for its nodes
    assert (sum(summed) < 0.75 * 7 * 13 * 3000) == (kept == 1024)
    plan, told = trees.planned(np.arange(5), 7, 3, 0.5), None
    try:
        while True:
            told = plan.send(None if told is None else trees.sums(np.ascontiguousarray(x.T), y, np.ones(3000), *told, np.arange(5)))
    except StopIteration as end:
        other = end.value[0]
    assert tree["left"].tolist() == other["left"].tolist() and all(np.allclose(tree[k], other[k]) for k in tree)
    left = np.flatnonzero(tree["left"])
    assert np.allclose(tree["cover"][left], tree["cover"][tree["left"][left]] + tree["cover"][tree["left"][left] + 1])


def test_search_leaves_no_tables(spark, monkeypatch):
    frame = rows_of(spark, 3000)
    monkeypatch.setattr(learning, "SPACE", {"forest": {"trees": Whole(2, 3), "depth": Whole(3, 4), "least": Whole(1, 4)}})
    monkeypatch.setattr(growing, "HELD", 500)
    top = Path(growing.folder(spark).removeprefix("file://"))
    before = set(top.iterdir())
    learning.trial_table(frame, 56, trials=2)
    assert {p.name for p in set(top.iterdir()) - before} == set()
