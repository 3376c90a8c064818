"""From predictions to a schedule of levels, and how the schedule fares.

Predictions are a table of item, t and pred, whatever model made them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.measures import bias, wape
from ..params import SERVICE_LEVEL, Params
from ..shipping import ship
from . import policy

ITEM = "canonical_item_number"
BASES = ("ma4", "ma13", "ma52", "snaive")


def rate_predictions(frame: DataFrame) -> DataFrame:
    """The frame with pred, the 13-week rate over each row's horizon, as a stand-in for a model."""
    return frame.withColumn("pred", F.col("s13") / 13 * F.col("h"))


def with_bases(frame: DataFrame) -> DataFrame:
    h = F.col("h")
    return frame.withColumns({"ma4": F.col("s4") / 4 * h, "ma13": F.col("s13") / 13 * h, "ma52": F.col("s52") / 52 * h, "snaive": F.col("ly")})


def held_out(rows: DataFrame, since: int, until: int) -> DataFrame:
    """Of origins with pred, segment and abc those held out, whose horizon closes by ``until``, with the simple methods."""
    rows = rows.where(F.col("target").isNotNull() & (F.col("t") >= since) & (F.col("t") + F.col("h") <= until))
    return with_bases(rows).select(ITEM, "t", "h", "segment", "abc", "target", "pred", *BASES)


def base_methods(tested: DataFrame) -> DataFrame:
    """segment, method and wape of the simple method that errs least; ties go to the first."""
    facts = tested.groupBy("segment").agg(*[wape("target", b).alias(b) for b in BASES])
    pairs = F.array(*[F.struct(F.col(b).alias("wape"), F.lit(k).alias("place"), F.lit(b).alias("method")) for k, b in enumerate(BASES)])
    best = F.array_min(F.filter(pairs, lambda x: x["wape"].isNotNull()))
    return facts.withColumn("best", best).select("segment", F.coalesce("best.method", F.lit("ma52")).alias("method"), "best.wape")


def corrected(tested: DataFrame) -> DataFrame:
    """Held-out rows with factor, the segment's sum of targets over that of predictions, and pred_c."""
    factors = tested.groupBy("segment").agg(F.coalesce(F.try_divide(F.sum("target"), F.sum("pred")), F.lit(1.0)).alias("factor"))
    return tested.join(F.broadcast(factors), "segment").withColumn("pred_c", F.col("pred") * F.col("factor"))  # one row a segment


def error_spread(fixed: DataFrame, attributes: DataFrame) -> DataFrame:
    """item and sd: the deviation of its errors, else its segment's, else the median of all items'."""
    rows = fixed.withColumn("e", F.col("target") - F.col("pred_c"))
    own = rows.groupBy(ITEM).agg(F.stddev_samp("e").alias("own"))
    by_segment = rows.groupBy("segment").agg(F.stddev_samp("e").alias("of_segment"))
    middle = own.agg(F.median("own").alias("of_all"))
    out = attributes.select(ITEM, "segment").join(own, ITEM, "left").join(F.broadcast(by_segment), "segment", "left").crossJoin(F.broadcast(middle))
    return out.select(ITEM, F.coalesce("own", "of_segment", "of_all").alias("sd"))


def standard_errors(fixed: DataFrame) -> DataFrame:
    """abc and z of held-out rows, in deviations of the item's own errors."""
    rows = fixed.withColumn("e", F.col("target") - F.col("pred_c"))
    own = rows.groupBy(ITEM).agg(F.stddev_samp("e").alias("own"))
    return rows.join(own, ITEM).select("abc", F.when(F.col("own") > 0, F.col("e") / F.col("own")).alias("z")).where("z is not null")


def safety_factors(errors: DataFrame) -> DataFrame:
    """The service level's quantile of standardised errors of each class, between the two errors beside its place.

    Errors are counted in narrow bands first; only those of the bands that hold
    the place are put in order, equal ones as one, so no task holds a class.
    """
    level = policy.by_class(SERVICE_LEVEL)
    # bands rise with z, a thousand to a factor of e
    banded = errors.where(F.col("abc").isin(*SERVICE_LEVEL)).withColumn("band", F.floor(F.signum("z") * F.log1p(F.abs("z")) * 1000))
    counts = banded.groupBy("abc", "band").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("abc").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = counts.withColumn("above", above).withColumn("place", level * (F.sum("n").over(Window.partitionBy("abc")) - 1))
    bands = bands.withColumn("low", F.floor("place")).withColumn("high", F.ceil("place")).where((F.col("above") <= F.col("high")) & (F.col("above") + F.col("n") > F.col("low"))).drop("n")
    values = banded.join(F.broadcast(bands), ["abc", "band"]).groupBy(*bands.columns, "z").agg(F.count("*").alias("n"))  # one band a class, or two
    before = F.coalesce(F.sum("n").over(Window.partitionBy("abc", "band").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = values.withColumn("begin", F.col("above") + before)
    at = lambda place: F.max(F.when((F.col("begin") <= F.col(place)) & (F.col(place) < F.col("begin") + F.col("n")), F.col("z")))
    found = placed.groupBy("abc", "place", "low", "high").agg(at("low").alias("z_low"), at("high").alias("z_high"))
    between = (F.col("high") - F.col("place")) * F.col("z_low") + (F.col("place") - F.col("low")) * F.col("z_high")
    return found.select("abc", F.when(F.col("z_low") == F.col("z_high"), F.col("z_low")).otherwise(between).alias("factor"))


def raw_points(rows: DataFrame, seen_days: DataFrame, losses: DataFrame, p: Params, keep: list[str] | None = None) -> DataFrame:
    """Order level, buffer, reorder point and lot of each item and origin, as the model has them.

    ``rows`` has item, t, h and pred_c, and of the item abc, tier, corrected_lead_days, lead_sd,
    unscheduled, standard_cost and sd; ``seen_days`` one row with seen, how far ahead demand is known;
    columns of ``keep`` stay. No row moves, so those of an item stay together and in order.
    """
    out = rows.crossJoin(F.broadcast(seen_days))
    lead, share = F.col("corrected_lead_days"), F.coalesce("unscheduled", F.lit(1.0))
    out = out.withColumn("daily", F.col("pred_c") / (7.0 * F.col("h"))).withColumn("unscheduled", share).withColumn("lead_forecast", F.col("daily") * lead)
    out = out.withColumn("sigma", policy.sigma(F.col("sd"), F.col("daily"), lead, F.coalesce("lead_sd", F.lit(0.0)), F.col("h"), F.col("unscheduled"), F.col("seen")))
    out = out.withColumn("lot", policy.order_quantity(F.col("daily"), F.col("standard_cost"), p))
    out = policy.fill_factor(out, losses, p).withColumn("buffer", F.col("k_fill") * F.col("sigma"))
    level = policy.order_level(F.col("lead_forecast"), F.col("unscheduled"), lead, F.col("buffer"), F.col("seen"))
    return out.select(ITEM, "t", "h", F.col("pred_c").alias("forecast"), level.alias("level"), F.col("buffer").alias("safety_stock"), (F.col("lead_forecast") + F.col("buffer")).alias("reorder_point"), F.col("unscheduled").alias("share"), "lot", *(keep or []))


_KEPT = {"level": 2, "safety_stock": 2, "applied": 2, "share": 3, "lot": 1}


def _origins(raw: np.ndarray, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, band: float) -> np.ndarray:
    """For each row of series that lie one after another the row whose point holds; all series go on a step at a time."""
    origins = np.arange(len(raw))
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(1, int(sizes.max(initial=0))):
            rows = first[sizes > k] + k
            last = points[origins[rows - 1]]
            keep = (last > 0) & (np.abs(raw[rows] - last) / last <= band)
            origins[rows] = np.where(keep, origins[rows - 1], rows)
    return origins


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole items, and where each item's begin. The last item of a batch waits for the next; it has a row an origin, so few wait."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        codes = rows.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        waiting = rows.slice(int(first[-1]))
        if len(first) > 1:
            yield rows.slice(0, int(first[-1])), first[:-1]
    if waiting is not None:
        yield waiting, np.zeros(1, np.int64)


_KEPT = {"level": 2, "safety_stock": 2, "applied": 2, "share": 3, "lot": 1}


def applied(points: DataFrame, p: Params, together: bool = False, kept: tuple[str, ...] = tuple(_KEPT), before: bool = False) -> DataFrame:
    """The schedule: each origin's forecast, with the last applied point kept while the new one is within the band of it; further columns stay.

    ``together`` says that an item's rows already lie together and in order, as
    they do where they are formed of its history; others are shuffled and sorted
    first. ``kept`` are the columns wanted of those that hold with a point;
    ``before`` adds the raw and the applied point of the origin before. The fold
    notes only which origin's point holds; cells are looked up afterwards.
    """
    more = [c for c in points.columns if c not in {ITEM, "t", "h", "forecast", "reorder_point", *_KEPT}]
    held = [c for c in _KEPT if c in kept or c == "applied"]
    rows = points.select(ITEM, "t", "h", "forecast", F.col("reorder_point").alias("raw"), *[F.round(F.col("reorder_point" if c == "applied" else c), _KEPT[c]).alias(c) for c in held], *more)
    if not together:
        rows = rows.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ITEM).sortWithinPartitions(ITEM, "t")
    names = rows.columns
    fields = [StructField("reorder_point", DoubleType()) if f.name == "applied" else f for f in rows.schema.fields]
    fields += [StructField(c, DoubleType()) for c in ("raw_before", "before") if before]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])
    ship(points.sparkSession)
    band = p.hysteresis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in _whole_series(batches):
            of = lambda c: part.column(names.index(c))
            t = of("t").to_numpy(zero_copy_only=False)
            ends = np.append(first[1:], part.num_rows)
            if (np.delete(np.diff(t), first[1:] - 1) < 0).any():
                raise ValueError("rows of an item are out of order")
            origins = pa.array(_origins(of("raw").to_numpy(zero_copy_only=False), of("applied").to_numpy(zero_copy_only=False), first, ends - first, band))
            columns = [part.column(k).take(origins) if c in _KEPT else part.column(k) for k, c in enumerate(names)]
            if before:
                past = np.arange(part.num_rows) - 1
                none = np.zeros(part.num_rows, bool)
                none[first] = True
                at = pa.array(past, mask=none)
                columns += [of("raw").take(at), columns[names.index("applied")].take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def churn(schedule: DataFrame, p: Params) -> DataFrame:
    """Share of refreshes that move the raw and the applied point by more than the band, and that change the applied one at all."""
    if "before" not in schedule.columns:
        w = Window.partitionBy(ITEM).orderBy("t")
        schedule = schedule.select("raw", "reorder_point", F.lag("raw").over(w).alias("raw_before"), F.lag("reorder_point").over(w).alias("before"))
    rows = schedule.where("before is not null")
    moved = lambda a, b: F.avg(F.when((F.col(a) > 0) & (F.abs(F.col(b) - F.col(a)) > p.hysteresis * F.col(a)), 1.0).otherwise(0.0))
    return rows.agg(moved("raw_before", "raw").alias("raw_moves"), moved("before", "reorder_point").alias("applied_moves"), F.avg(F.when(F.abs(F.col("reorder_point") - F.col("before")) > 1e-9, 1.0).otherwise(0.0)).alias("applied_changes"))


def followed(rows: DataFrame, methods: DataFrame, last: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Origins with what followed: period, target, base and is_scored (the horizon closed by week ``last``), beside what a point is made of and columns of ``keep``."""
    rows = with_bases(rows).join(F.broadcast(methods.select("segment", "method")), "segment", "left")  # one row a segment
    base = F.col("ma52")
    for b in BASES:
        base = F.when(F.col("method") == b, F.col(b)).otherwise(base)
    scored = F.coalesce(F.col("t") + F.col("h") <= last, F.lit(False)) & F.col("target").isNotNull()
    return rows.select(ITEM, "t", "h", "segment", "pred", F.date_format("week", "yyyy-MM").alias("period"), scored.alias("is_scored"), "target", base.alias("base"), *keep)


def accuracy(rows: DataFrame, by: list[str], least: int = 0) -> DataFrame:
    """Counts, WAPE, the baseline's, bias and coverage of live rows by group."""
    scored = lambda c: F.when(F.col("is_scored"), F.col(c))
    part = rows.select(*by, "is_scored", *[scored(c).alias(c) for c in ("target", "forecast", "base")], F.when(F.col("is_scored"), F.col("covered").cast("double")).alias("covered"))
    out = part.groupBy(*by).agg(
        F.count("*").alias("n_forecasts"), F.count(F.when(F.col("is_scored"), 1)).alias("n_scored"), wape("target", "forecast").alias("wape"), wape("target", "base").alias("base_wape"), bias("target", "forecast").alias("bias"), F.avg("covered").alias("coverage")
    )
    return out.where(F.col("n_scored") >= least)


def period_status(rows: DataFrame, fixed: DataFrame, outcomes: DataFrame, p: Params, least: int = 150, matured: float = 0.8, tolerance: float = 0.03, pattern_tolerance: float = 0.05, bias_tolerance: float = 0.10) -> DataFrame:
    """Of each period: how far it has matured, levels of the accuracy rules (1 watch, 2 retrain), outcomes over their reference, and the status.

    ``outcomes`` has period, events, held, ref_events and ref_held. Errors are
    judged against the held-out ones, once ``matured`` of the forecasts are scored.
    """
    whole = accuracy(rows, ["period"])
    reference = fixed.agg(wape("target", "pred_c").alias("ref_wape"))
    ref_pattern = fixed.groupBy("segment").agg(wape("target", "pred_c").alias("ref_pattern"))
    patterns = accuracy(rows, ["period", "segment"], least).join(F.broadcast(ref_pattern), "segment")
    over = lambda value, watch, act: F.when(value > act, 2).when(value > watch, 1).otherwise(0)
    patterns = patterns.groupBy("period").agg(
        F.max(over(F.col("wape"), F.col("ref_pattern"), F.col("ref_pattern") + pattern_tolerance)).alias("pattern_wape_level"),
        F.max(F.when(F.abs("bias") > bias_tolerance, 2).otherwise(0)).alias("pattern_bias_level"),
    )
    out = whole.crossJoin(F.broadcast(reference)).join(patterns, "period", "left").join(outcomes, "period", "left")
    ready = F.col("n_scored") >= matured * F.col("n_forecasts")
    if_ready = lambda x: F.when(F.col("is_matured"), F.coalesce(x, F.lit(0))).otherwise(0)
    out = out.withColumn("is_matured", ready)
    out = out.select(
        "period", "n_forecasts", "n_scored", "wape", "base_wape", "bias", "is_matured",
        if_ready(over(F.col("wape"), F.col("ref_wape"), F.col("ref_wape") + tolerance)).alias("wape_level"), if_ready(F.when(F.abs("bias") > bias_tolerance, 2).otherwise(0)).alias("bias_level"),
        if_ready(F.col("pattern_wape_level")).alias("pattern_wape_level"), if_ready(F.col("pattern_bias_level")).alias("pattern_bias_level"),
        F.coalesce((F.col("events") > F.col("ref_events")) | (F.col("held") > F.col("ref_held")), F.lit(False)).alias("outcomes_worse"),
    )
    worst = F.greatest("wape_level", "bias_level", "pattern_wape_level", "pattern_bias_level")
    return out.withColumn("status", F.when(worst == 2, "RETRAIN").when((worst > 0) | F.col("outcomes_worse"), "INVESTIGATE").otherwise("HEALTHY"))


def split_summary(parts: dict[str, DataFrame], period: str = "week") -> DataFrame:
    """Window, rows, items, mean, median and zero share of each part of the frame.

    Targets are counted by value and items by themselves, so no group of rows
    holds its own values for a median.
    """
    out = None
    for name, df in parts.items():
        values = df.groupBy("target").agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count("*").alias("n"))
        known = F.when(F.col("target").isNotNull(), F.col("n"))
        row = values.agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.try_divide(F.sum(F.col("target") * F.col("n")), F.sum(known)).alias("target_mean"),
            F.percentile("target", 0.5, F.col("n")).alias("target_median"), F.try_divide(F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0)), F.sum("n")).alias("zero_share"),
        )
        items = df.where(F.col(ITEM).isNotNull()).groupBy(ITEM).agg(F.lit(1)).agg(F.count("*").alias("items"))
        row = row.crossJoin(F.broadcast(items)).select(F.lit(name).alias("part"), "first", "last", "n_rows", "items", "target_mean", "target_median", "zero_share")  # one row
        out = row if out is None else out.unionByName(row)
    return out
