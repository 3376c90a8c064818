"""Baseline forecasts, rolling-origin backtests and accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import croston, exponential_smoothing
from ..functions.measures import bias, wape
from ..params import Params

ITEM = "canonical_item_number"
METHODS = ("naive", "ma3", "ma6", "ses", "croston", "snaive")
#: Compared one period ahead, in the order that decides ties.
ONE_STEP = ("naive", "ma3", "ses", "croston", "snaive")


def history_arrays(grid: DataFrame) -> DataFrame:
    """Each item's whole series as one array, in order."""
    rows = F.array_sort(F.collect_list(F.struct("t", "s")))
    return grid.groupBy(ITEM).agg(F.transform(rows, lambda r: r["s"]).alias("history"))


def _last_mean(h: Column, k: int) -> Column:
    n = F.least(F.size(h), F.lit(k))
    return F.try_divide(F.aggregate(F.slice(h, F.size(h) - n + 1, n), F.lit(0.0), lambda a, x: a + x), n.cast("double"))


def _span(h: Column, start: Column, length: Column) -> Column:
    """Sum of ``length`` values of a 0-based array position on."""
    return F.aggregate(F.slice(h, start + 1, length), F.lit(0.0), lambda a, x: a + x)


def forecasts(h: Column, horizon: Column, p: Params, season: int = 12) -> dict[str, Column]:
    """Demand over the horizon by each method, from the history before the origin."""
    n = F.size(h)
    begin = F.greatest(n - season, F.lit(0))
    return {
        "naive": F.element_at(h, -1) * horizon,
        "ma3": _last_mean(h, 3) * horizon,
        "ma6": _last_mean(h, 6) * horizon,
        "ses": exponential_smoothing(h, p.ses_alpha) * horizon,
        "croston": croston(h, p.croston_alpha) * horizon,
        "snaive": _span(h, begin, F.least(horizon, n - begin)),
    }


def backtest(series: DataFrame, horizons: DataFrame | None, p: Params, origins: int = 12, least: int = 12) -> DataFrame:
    """item, origin, method, forecast and actual of the last ``origins`` origins whose horizon has closed; it is one period without ``horizons``."""
    rows = series.withColumn("h", F.lit(1)) if horizons is None else series.join(horizons, ITEM)
    last = F.size("history") - F.col("h")
    first = F.greatest(F.lit(least), last - origins + 1)
    rows = rows.where(first <= last).withColumn("origin", F.explode(F.sequence(first, last)))
    rows = rows.select(ITEM, "h", "origin", F.slice("history", F.lit(1), F.col("origin")).alias("past"), _span(F.col("history"), F.col("origin"), F.col("h")).alias("actual"))
    methods = forecasts(F.col("past"), F.col("h"), p)
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("place"), v.alias("forecast")) for k, (m, v) in enumerate(methods.items())])
    return rows.select(ITEM, "origin", "actual", F.inline(pairs))


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """WAPE and bias of every method by group, and the best method; ties go to the earlier one."""
    facts = scored.groupBy(*by, "method", "place").agg(wape("actual", "forecast").alias("wape"), bias("actual", "forecast").alias("bias"), F.count("*").alias("n"))
    best = facts.where(F.col("wape").isNotNull()).groupBy(*by).agg(F.min_by("method", F.struct("wape", "place")).alias("best_method"), F.min("wape").alias("best_wape"))
    return facts.drop("place").join(best, by, "left")


def wide_accuracy(wide: DataFrame, methods: tuple[str, ...], by: list[str]) -> DataFrame:
    """``accuracy`` of rows that have every method's forecast in a column of its name, in one reading; no row is repeated for its methods."""
    facts = wide.groupBy(*by).agg(F.count("*").alias("n"), *[f("actual", m).alias(f"{name}_{m}") for m in methods for name, f in (("wape", wape), ("bias", bias))])
    cells = F.array(*[F.struct(F.col(f"wape_{m}").alias("wape"), F.lit(k).alias("place"), F.lit(m).alias("method"), F.col(f"bias_{m}").alias("bias")) for k, m in enumerate(methods)])
    best = F.array_min(F.filter(cells, lambda x: x["wape"].isNotNull()))
    rows = facts.select(*by, "n", best.alias("best"), F.inline(cells))
    return rows.select(*by, "method", "wape", "bias", "n", F.col("best.method").alias("best_method"), F.col("best.wape").alias("best_wape"))


def long_methods(wide: DataFrame, methods: tuple[str, ...], keep: list[str]) -> DataFrame:
    """One row a method, with its place for ties."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("place"), F.col(m).alias("forecast")) for k, m in enumerate(methods)])
    return wide.select(*keep, F.inline(pairs))


def one_step(series: DataFrame, p: Params, origins: int = 12) -> DataFrame:
    """Every method one period ahead, at the last ``origins`` origins."""
    return backtest(series, None, p, origins).where(F.col("method").isin(*ONE_STEP))


def best_one_step(scored: DataFrame) -> DataFrame:
    """item, method and wape of each item's best method, ties to the earlier one; the first, with a null, where nothing was demanded."""
    facts = scored.groupBy(ITEM, "method", "place").agg(F.round(wape("actual", "forecast"), 9).alias("wape"))
    rank = F.struct(F.coalesce("wape", F.lit(float("inf"))), "place")
    return facts.groupBy(ITEM).agg(F.min_by("method", rank).alias("method"), F.min("wape").alias("wape"))


def merge_gain(merged: DataFrame, records: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """One-step WAPE of merged items, forecast as their records apart and as one series.

    ``members`` names the records (item_number) of each item. ``records``
    holds a series for each of them under its own number, over the calendar of
    ``merged``. Before the merge each record is forecast by its own best
    method and the forecasts are added up. ``gain`` is the share of the error
    that the merge removes, null where there was none.
    """
    scored = one_step(records, p)
    apart = scored.join(best_one_step(scored).select(ITEM, "method"), [ITEM, "method"]).withColumnRenamed(ITEM, "item_number")
    summed = apart.join(members.select("item_number", ITEM), "item_number").groupBy(ITEM, "origin").agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))
    before = summed.groupBy(ITEM).agg(F.round(wape("actual", "forecast"), 9).alias("before"))
    after = best_one_step(one_step(merged, p)).select(ITEM, F.col("wape").alias("after"))
    counts = members.groupBy(ITEM).agg(F.count("*").alias("records"))
    return counts.join(before, ITEM).join(after, ITEM).withColumn("gain", F.try_divide(F.col("before") - F.col("after"), F.col("before")))
