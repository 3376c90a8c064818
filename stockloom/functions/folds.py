"""Folds over ordered arrays: compensated sums, smoothing, sticky values. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compensated_sum(values: Column) -> Column:
    """Kahan's sum of an array in its order, the same to the last digit wherever it runs; null for an empty array."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))

    def step(state: Column, x: Column) -> Column:
        due = x - state["lost"]
        total = state["total"] + due
        return F.struct(total.alias("total"), ((total - state["total"]) - due).alias("lost"))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda s: s["total"]))


def ordered(*keys: str, value: str) -> Column:
    """Aggregate: the values of a group in the order of ``keys``."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(k) for k in keys], F.col(value).alias("__value"))))
    return F.transform(rows, lambda r: r["__value"])


def exponential_smoothing(values: Column, alpha: float) -> Column:
    """Last level of simple exponential smoothing that starts at the first value; null for an empty array."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    level = F.aggregate(rest, F.element_at(values, 1), lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)
    return F.when(F.size(values) > 0, level)


def croston(values: Column, alpha: float, unbiased: bool = True) -> Column:
    """Demand rate of Croston's method: smoothed size over smoothed interval; 0 where nothing was ever demanded.

    ``unbiased`` takes the Syntetos-Boylan factor 1 - alpha / 2.
    """
    start = F.struct(F.lit(-1.0).alias("size"), F.lit(1.0).alias("interval"), F.lit(0.0).alias("since"))

    def step(s: Column, x: Column) -> Column:
        since = s["since"] + 1
        first = s["size"] < 0
        hit = x > 0
        size = F.when(hit & first, x).when(hit, s["size"] + alpha * (x - s["size"])).otherwise(s["size"])
        interval = F.when(hit & first, since).when(hit, s["interval"] + alpha * (since - s["interval"])).otherwise(s["interval"])
        return F.struct(size.alias("size"), interval.alias("interval"), F.when(hit, 0.0).otherwise(since).alias("since"))

    factor = 1 - alpha / 2 if unbiased else 1.0
    return F.aggregate(values, start, step, lambda s: F.when(s["size"] < 0, 0.0).otherwise(s["size"] / s["interval"] * factor))


def sticky(values: Column, band: float) -> Column:
    """Each value as applied: the last applied one stays while the new one is within ``band`` of it, as a share of it."""

    def step(applied: Column, x: Column) -> Column:
        last = F.try_element_at(applied, F.lit(-1))
        kept = F.when((last > 0) & (F.abs(x - last) <= band * last), last).otherwise(x)
        return F.concat(applied, F.array(kept))

    return F.aggregate(values, F.array().cast("array<double>"), step)


def share_changed(values: Column, band: float = 0.0) -> Column:
    """Steps of a sequence that move by more than ``band`` of the value before."""
    before, after = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.size(F.filter(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p: (p["a"] > 0) & (F.abs(p["b"] - p["a"]) > band * p["a"])))
