"""Queries of the learned demand model; the search runs once a session over a folder, and its trials are a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories, learning, schedule
from ..shared import folder
from . import oracle, planning
from .warehouse import Warehouse

ITEM = "canonical_item_number"
TEST, FORWARD = oracle.TEST, oracle.FORWARD
_OWN = (*learning.CATEGORIES, "corrected_lead_days", "annual_consumption", "standard_cost")


def frame(w: Warehouse, start: int = histories.YEAR) -> DataFrame:
    """The frame with the model's features; attributes come along from the histories, so nothing is joined."""
    return learning.typed(w.frame(_OWN, start))


def frames(rows: DataFrame) -> learning.Frames:
    """The frame as it is formed from histories that have the model's attributes."""

    def whole(start: int | None, stop: int | None, items: DataFrame | None) -> DataFrame:
        return learning.typed(histories.periods(learning.only(rows, items), ["week", *histories.FRAME], [ITEM, "h", *_OWN], histories.YEAR if start is None else start, stop))

    return learning.Frames(whole, lambda start, stop: histories.periods(rows, ["target"], [ITEM, "h"], histories.YEAR if start is None else start, stop))


def trials(w: Warehouse) -> DataFrame:
    return w.once("trials", lambda: learning.trial_table(frames(w.weekly_histories), TEST))


def _model(w: Warehouse) -> learning.Model:
    """The selected model, saved in the shared folder by the first query that asks for it and read by the others."""
    marker = w.once("model", lambda: _saved(w))
    return learning.load(marker.first().path)


def _saved(w: Warehouse) -> DataFrame:
    spark = w.attributes.sparkSession
    path = f"{folder(spark)}/selected-{spark.sparkContext.applicationId}-{id(w)}"
    learning.save(learning.selected(frames(w.weekly_histories), trials(w), TEST), path)
    w.keep(spark, path)
    return spark.createDataFrame([(path,)], "path string")


def predictions(w: Warehouse, start: int = TEST, stop: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Origins from the first held-out one on with the selected model's pred, beside what the schedule reads and facts of their items, if any are given."""
    rows = w.once("predictions", lambda: _predicted(w)).where(F.col("t") >= start)
    rows = rows if stop is None else rows.where(F.col("t") < stop)
    return rows if facts is None else planning.beside(rows, facts)


def _predicted(w: Warehouse) -> DataFrame:
    whole = {c: F.col(c).cast("int").alias(c) for c in ("t", "h")}
    known = w.frame(("segment", "abc")).dtypes
    out = learning.predict(_model(w), frame(w, TEST))
    return out.select(ITEM, *whole.values(), *[F.col(c).cast(dict(known)[c]).alias(c) for c in ("segment", "abc", *planning.READ)], "pred")


def scales(w: Warehouse) -> DataFrame:
    """Mean one-step error of every item before the held-out weeks."""
    return w.weeks(["change"], stop=TEST).groupBy(ITEM).agg(F.avg("change").alias("scale"))


def _lift(w: Warehouse) -> DataFrame:
    return learning.lift(planning.tested(w, predictions), schedule.BASES, scales(w))


def _tiers(w: Warehouse) -> DataFrame:
    series = {"recorded": w.usage.where(F.col("item_number") == F.col(ITEM)), "merged": w.usage}
    whole = {k: w.once(("tier", k), lambda u=u: w.beside(u.groupBy(ITEM, "week").agg(F.sum("units").alias("consumption")))) for k, u in series.items()}
    tiers = {k: frames(x) for k, x in (whole | {"clean": w.weekly_histories}).items()}
    best = learning.best_trials(trials(w))
    kind = learning.select({k: error for k, (_, error) in best.items()})
    return learning.cleaning_tiers(tiers, kind, best[kind][0], TEST)


def _closed(rows: DataFrame) -> DataFrame:
    """Held-out rows that close before the forward window."""
    return rows.where(F.col("target").isNotNull() & (F.col("t") + F.col("h") <= FORWARD))


def _shap(w: Warehouse) -> DataFrame:
    """Shapley values of some held-out rows."""
    return learning.explained(_model(w), learning.sampled_from(frames(w.weekly_histories), _closed, learning.EXPLAINED_ROWS, TEST, FORWARD))


def _shap_importance(w: Warehouse) -> DataFrame:
    """Mean absolute Shapley value of each feature over all held-out rows."""
    return learning.mean_absolute(learning.explained(_model(w), _closed(frames(w.weekly_histories).whole(TEST, FORWARD, None)), None))


def _importance(w: Warehouse) -> DataFrame:
    model = _model(w)
    if model.kind == "linear":
        # a linear model's share of a feature is that of its mean absolute part
        parts = learning.mean_absolute(learning.explained(model, frames(w.weekly_histories).whole(None, TEST, None), None))
        return parts.crossJoin(F.broadcast(parts.agg(F.sum("mean_abs").alias("total")))).select("feature", (F.col("mean_abs") / F.col("total")).alias("importance"))  # one row
    return learning.importance(model)


def add_queries(add: Callable[..., None]) -> None:
    add("ml_trials", lambda w: trials(w).select("candidate", "trial", F.to_json(F.map_from_arrays("names", "values")).alias("params"), "validation_wape"))
    add("ml_candidates", lambda w: learning.candidates(frames(w.weekly_histories), trials(w), TEST))
    add("ml_learning_curve", lambda w: learning.learning_curve(frames(w.weekly_histories), trials(w), TEST))
    add("ml_importance", _importance)
    add("ml_shap", lambda w: _shap(w))
    add("ml_shap_importance", _shap_importance)
    add("ml_lift", _lift)
    add("ml_cleaning_tiers", _tiers)
