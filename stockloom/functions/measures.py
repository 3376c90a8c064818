"""Accuracy, quantile and distance measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wape(actual: str, forecast: str) -> Column:
    """Sum of absolute errors over the sum of actuals; null where nothing was demanded."""
    return F.try_divide(F.sum(F.abs(F.col(actual) - F.col(forecast))), F.sum(actual))


def bias(actual: str, forecast: str) -> Column:
    return F.try_divide(F.sum(F.col(forecast) - F.col(actual)), F.sum(actual))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def signed_quantity(kind: str = "txn_type", qty: str = "qty") -> Column:
    """Effect of a posting on stock: receipts and adjustments as signed, everything else out."""
    return F.when(F.col(kind).isin("RECEIPT", "ADJUST"), F.col(qty)).otherwise(-F.abs(qty))


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("int")


def erf(x: Column, terms: int = 80) -> Column:
    """The error function, by its series of positive terms; exact to 1e-14 for values up to 4 either way."""
    x = x.cast("double")
    step = lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("term"), x.alias("sum")), step)
    return series["sum"] * F.exp(-x * x) * (2 / math.sqrt(math.pi))


def normal_loss(k: Column) -> Column:
    """Expected shortfall beyond ``k`` deviations of a standard normal error."""
    k = k.cast("double")
    return F.exp(-k * k / 2) / math.sqrt(2 * math.pi) - k * (1 - (1 + erf(k / math.sqrt(2))) / 2)


def periods_of_lead(lead_days: Column, days: float) -> Column:
    """A lead time in whole periods, at least one."""
    return F.greatest(F.lit(1), round_half_even(lead_days / F.lit(float(days))))
