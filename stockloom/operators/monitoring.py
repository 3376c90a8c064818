"""Forecast monitoring: drift, accuracy by period and pattern, input quality, thresholds and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params


def _js(shares: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon distance, base 2, from bin counts n_p and n_q of every bin; each gets 1e-9 before shares are taken anew."""
    totals = shares.groupBy(*by).agg(F.sum("n_p").alias("all_p"), F.sum("n_q").alias("all_q"), F.count("*").alias("bins"))
    rows = shares.join(totals, by)
    part = lambda n, whole: (F.col(n) / F.col(whole) + 1e-9) / (1 + F.col("bins") * 1e-9)
    rows = rows.withColumn("p", part("n_p", "all_p")).withColumn("q", part("n_q", "all_q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    terms = F.sum(F.col("p") * F.log2(F.col("p") / F.col("m")) + F.col("q") * F.log2(F.col("q") / F.col("m")))
    return rows.groupBy(*by).agg(F.sqrt(F.greatest(terms / 2, F.lit(0.0))).alias("distance"))


def drift(values: DataFrame, bins: int = 20) -> DataFrame:
    """Distance between two samples of each feature, on quantile bins of the reference.

    ``values`` is long: feature, value and is_reference. Values are log1p'd, to
    nine digits, so that equal ones computed in another order stay equal;
    edges are exact quantiles, equal ones taken together, and the outer bins
    are open. With fewer than three edges bins are of equal width between the
    reference's least and greatest value.
    """
    scaled = values.where(F.col("value").isNotNull()).select("feature", "is_reference", F.round(F.log1p(F.greatest("value", F.lit(0.0))), 9).alias("v"))
    # equal values are counted once, so what meets per feature is its distinct values
    return counted_drift(scaled.groupBy("feature", "v").agg(F.count(F.when(F.col("is_reference"), 1)).alias("n_p"), F.count(F.when(~F.col("is_reference"), 1)).alias("n_q")), bins)


def counted_drift(counted: DataFrame, bins: int = 20) -> DataFrame:
    """``drift`` of values that are scaled and counted: feature, v, n_p and n_q (how often the reference and the other sample have it)."""
    points = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    edges = counted.where("n_p > 0").groupBy("feature").agg(F.array_distinct(F.percentile("v", points, F.col("n_p"))).alias("quantiles"), F.min("v").alias("low"), F.max("v").alias("high"))
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / bins)
    edges = edges.select("feature", F.when(F.size("quantiles") < 3, even).otherwise(F.col("quantiles")).alias("edges"))
    edges = edges.select("feature", F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"))
    cell = F.size(F.filter("inner", lambda e: e <= F.col("v")))
    # one row a feature is joined
    found = counted.join(F.broadcast(edges), "feature").groupBy("feature", "inner", cell.alias("bin")).agg(F.sum("n_p").alias("n_p"), F.sum("n_q").alias("n_q"))
    whole = found.groupBy("feature", "inner").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n_p", "n_q")))).alias("by_bin"))
    every = whole.select("feature", "by_bin", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    none = F.lit(0).cast("bigint")
    counts = every.select("feature", "bin", *[F.coalesce(F.col("by_bin")[F.col("bin")][n], none).alias(n) for n in ("n_p", "n_q")])
    return _js(counts, ["feature"])


def category_drift(reference: DataFrame, recent: DataFrame, column: str) -> DataFrame:
    """Distance between two samples of a category."""
    count = lambda df, name: df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("bin")).agg(F.count("*").alias(name))
    return _category_distance(count(reference, "n_p").join(count(recent, "n_q"), "bin", "full").na.fill(0, ["n_p", "n_q"]), column)


def counted_category_drift(counted: DataFrame, column: str) -> DataFrame:
    """``category_drift`` of rows that are counted: the category, n_p and n_q."""
    counts = counted.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("bin")).agg(F.sum("n_p").alias("n_p"), F.sum("n_q").alias("n_q"))
    return _category_distance(counts.where("n_p > 0 or n_q > 0"), column)


def _category_distance(counts: DataFrame, column: str) -> DataFrame:
    return _js(counts.withColumn("feature", F.lit(column)), ["feature"])


def long_features(frame: DataFrame, features: list[str], keep: list[Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return frame.select(*keep, F.inline(pairs))


def input_quality(series: DataFrame, attributes: DataFrame, item: str = "canonical_item_number", period: str = "week") -> DataFrame:
    """One row: null share, negative usage, items without attributes, and the last period's total over the mean of those before."""
    known = series.join(attributes.select(item).distinct().withColumn("__known", F.lit(True)), item, "left")
    facts = known.agg(
        F.avg(F.when(F.col("consumption").isNull(), 1.0).otherwise(0.0)).alias("null_share"),
        F.count(F.when(F.col("consumption") < 0, 1)).alias("negative_rows"),
        F.count_distinct(F.when(F.col("__known").isNull(), F.col(item))).alias("unknown_items"),
    )
    weekly = series.groupBy(period).agg(F.sum("consumption").alias("total"))
    last = weekly.agg(F.max(period).alias("last"))
    ratio = weekly.crossJoin(F.broadcast(last)).agg(F.try_divide(F.sum(F.when(F.col(period) == F.col("last"), F.col("total"))), F.avg(F.when(F.col(period) < F.col("last"), F.col("total")))).alias("last_ratio"))
    return facts.crossJoin(F.broadcast(ratio))


def drift_flags(distances: DataFrame, p: Params) -> DataFrame:
    return distances.withColumn("drifted", F.col("distance") >= p.drift_threshold)


def training_rows_known(frame: DataFrame, origins: DataFrame, count: Column | None = None) -> DataFrame:
    """Rows whose target had closed at each origin t; counts are taken per closing week first. ``count`` counts rows that stand for several."""
    closing = frame.groupBy((F.col("t") + F.col("h")).alias("closed")).agg((F.count("*") if count is None else count).alias("n"))
    return origins.join(F.broadcast(closing), F.col("closed") <= F.col("origin"), "left").groupBy("origin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("training_rows"))
