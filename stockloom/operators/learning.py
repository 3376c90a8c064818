"""Learned demand models on a leak-free frame: preparation, search, selection, test report, curves and explanation.

Preparation (medians of missing numbers, indices or indicators of categories)
is a pipeline fitted on training rows alone. The linear model is pyspark.ml's;
trees are grown by tasks on all rows, in the search as at the end: where a task
may hold them (``growing.HELD``), a forest's trees are dealt out one by one and
a boosted model is one task, otherwise all tasks grow a tree together, each on
its own rows. A fitted ensemble is a table of nodes. Targets are learned as
log1p; predictions are cut to 0 and four times the largest target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import bias, wape
from ..shared import removed, written
from ..shipping import ship
from . import growing, trees
from .search import Params, Real, Space, Whole, search

ITEM = "canonical_item_number"
NUMBERS = ["s4", "s13", "s26", "s52", "nz13", "nz52", "since_nz", "cv13", "trend", "ly", "mean_all", "woy", "month", "standard_cost", "corrected_lead_days", "annual_consumption", "h"]
CATEGORIES = ["segment", "abc", "item_class"]
FEATURES = [*NUMBERS, *CATEGORIES]
#: Ranges of the search, and its trials.
SPACE: dict[str, Space] = {
    "linear": {"alpha": Real(0.01, 100.0, log=True)},
    "forest": {"trees": Whole(150, 400, 50), "depth": Whole(5, 16), "least": Whole(1, 8)},
    "boosted": {"trees": Whole(250, 600, 50), "depth": Whole(3, 8), "rate": Real(0.02, 0.15, log=True), "rows": Real(0.7, 1.0), "columns": Real(0.6, 1.0), "least": Whole(1, 8), "ridge": Real(0.5, 4.0)},
}
TRIALS = 12
#: Rows, drawn by a hash of item and origin, whose Shapley values are listed; and nodes that rows walk at once.
EXPLAINED_ROWS, WALKED = 1500, 1 << 21
NODES = growing.NODES


def with_attributes(frame: DataFrame, attributes: DataFrame) -> DataFrame:
    """The frame with item attributes, typed."""
    return typed(frame.join(attributes.select(ITEM, *CATEGORIES, "corrected_lead_days", "annual_consumption", "standard_cost"), ITEM))


def typed(out: DataFrame) -> DataFrame:
    """A frame that has all features: numbers that are none are null, and a category that is missing is the text ``none``."""
    value = lambda c: F.col(c).cast("double")
    finite = {c: F.when(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), value(c)) for c in NUMBERS}
    return out.withColumns(finite).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in CATEGORIES})


def split(frame: DataFrame, test_from: int, validation_weeks: int = 26) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows by week; a row belongs to a part only if its target closes within it."""
    closed = F.col("t") + F.col("h")
    known = frame.where(F.col("target").isNotNull())
    start = test_from - validation_weeks
    return known.where(closed <= start), known.where((F.col("t") >= start) & (closed <= test_from)), known.where(F.col("t") >= test_from)


def learned_from(frame: DataFrame, test_from: int, validation_weeks: int = 26) -> DataFrame:
    """Train and validation rows in one reading of the frame."""
    closed, start = F.col("t") + F.col("h"), test_from - validation_weeks
    return frame.where(F.col("target").isNotNull() & ((closed <= start) | ((F.col("t") >= start) & (closed <= test_from))))


@dataclass(frozen=True)
class Frames:
    """A frame whose rows are formed when read: ``whole`` with all features and ``slim`` with item, t, h and target alone, of origins from one on and before another; ``whole`` also of some items alone."""

    whole: Callable[[int | None, int | None, DataFrame | None], DataFrame]
    slim: Callable[[int | None, int | None], DataFrame]

    @classmethod
    def of(cls, frame: DataFrame | Frames) -> Frames:
        """A frame that exists, as if it were formed."""
        if isinstance(frame, cls):
            return frame

        def whole(start: int | None = None, stop: int | None = None, items: DataFrame | None = None) -> DataFrame:
            out = only(frame, items)
            out = out if start is None else out.where(F.col("t") >= start)
            return out if stop is None else out.where(F.col("t") < stop)

        return cls(whole, lambda start=None, stop=None: whole(start, stop).select(ITEM, "t", "h", "target"))


def only(rows: DataFrame, items: DataFrame | None) -> DataFrame:
    """Rows of a bounded number of items."""
    if items is None:
        return rows
    few = items.select(F.col(ITEM).alias("__few"))
    return rows.join(F.broadcast(few), F.col(ITEM).eqNullSafe(F.col("__few")), "left_semi")


def _drawn(most: int, n: int) -> Column:
    draw = F.pmod(F.xxhash64(ITEM, F.col("t").cast("long"), F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    return F.lit(True) if n <= most else draw < most / n


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by a hash of item and origin; all where there are fewer."""
    return rows.where(_drawn(most, rows.count()))


def sampled_from(frames: Frames, part: Callable[[DataFrame], DataFrame], most: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The rows that ``sampled`` draws of a part of the frame; they are counted and drawn without features, which then are formed for their items alone."""
    slim = part(frames.slim(start, stop))
    n = slim.count()
    few = None if n <= most else slim.where(_drawn(most, n)).select(ITEM).distinct()
    return part(frames.whole(start, stop, few)).where(_drawn(most, n))


# --- preparation --------------------------------------------------------------


def preparation(linear: bool) -> Pipeline:
    """Stages that take their medians and categories from the rows they are fitted on; a category that those lack has a place of its own."""
    numbers, codes = [f"{c}__n" for c in NUMBERS], [f"{c}__c" for c in CATEGORIES]
    stages = [Imputer(inputCols=NUMBERS, outputCols=numbers, strategy="median", relativeError=1e-4), StringIndexer(inputCols=CATEGORIES, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc")]
    if not linear:
        return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numbers, *codes], outputCol="features")])
    marks = [f"{c}__o" for c in CATEGORIES]
    return Pipeline(stages=[*stages, OneHotEncoder(inputCols=codes, outputCols=marks, handleInvalid="keep"), VectorAssembler(inputCols=[*numbers, *marks], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])


#: Share of a column's values that its median may be off by in rank, and bits of an ordered double that are left out at first.
OFF, COARSE = 1e-4, 36


def _cells(rows: DataFrame, numbers: dict[str, tuple[int, int]], shift: int, categories: list[str]) -> DataFrame:
    """name, cell, low, high, n and label: how many values of each number, as ordered bits within its bounds, share all but the last ``shift`` bits, the least and greatest of them; and each category's values."""
    names = [*numbers, *categories]
    bounds = list(numbers.values())
    kind = pa.schema([("name", pa.int32()), ("cell", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()), ("label", pa.string())])

    def runs(cells: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple:
        begin = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
        return cells[begin], low[begin], np.maximum.reduceat(high, begin), np.add.reduceat(n, begin)

    def merged(parts: list[tuple]) -> list[tuple]:
        cells, low, high, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((low, cells))
        return [runs(cells[order], low[order], high[order], n[order])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, labels = [[] for _ in bounds], [0] * len(bounds), [set() for _ in categories]
        for batch in batches:
            for k, (least, most) in enumerate(bounds):
                bits = (batch.column(k).drop_null().to_numpy(zero_copy_only=False).astype(float) + 0.0).view(np.int64)  # one zero
                bits = np.sort(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))
                bits = bits[(bits >= least) & (bits <= most)]
                if len(bits):
                    held[k].append(runs(bits >> shift, bits, bits, np.ones(len(bits), np.int64)))
                    sizes[k] += len(held[k][-1][0])
                if sizes[k] > 1 << 18:
                    held[k] = merged(held[k])
                    sizes[k] = 0
            for k in range(len(categories)):
                labels[k].update(batch.column(len(bounds) + k).unique().to_pylist())
        for k, parts in enumerate(held):
            if parts:
                cells, low, high, n = merged(parts)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), *map(pa.array, (cells, low, high, n)), pa.nulls(len(cells), pa.string())], schema=kind)
        for k, own in enumerate(labels):
            own = sorted(x for x in own if x is not None)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), len(bounds) + k, np.int32)), *[pa.nulls(len(own), pa.int64())] * 4, pa.array(own, pa.string())], schema=kind)

    ship(rows.sparkSession)
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numbers]
    found = rows.select(*clean, *[F.col(c).cast("string").alias(c) for c in categories]).mapInArrow(run, "name int, cell long, low long, high long, n long, label string")
    found = found.groupBy("name", "cell", "label").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return found.withColumn("name", F.element_at(F.array(*map(F.lit, names)), F.col("name") + 1))


def typical(rows: DataFrame) -> DataFrame:
    """A few rows that stand for all when a preparation is fitted: each number's median (within OFF in rank) and every value of each category.

    One reading counts values by their leading bits. Cells are as many as those
    bits allow, however many rows there are; a median whose cell holds both
    several values and more than OFF of all is looked for once more within it.
    """
    spark = rows.sparkSession
    open_, shift, categories = {c: (-(1 << 63), (1 << 63) - 1) for c in NUMBERS}, COARSE, list(CATEGORIES)
    before, sizes, medians, labels = dict.fromkeys(NUMBERS, 0), {}, dict.fromkeys(NUMBERS), {c: [] for c in CATEGORIES}
    while open_:
        counted, path = written(_cells(rows, open_, shift, categories), "cells")
        for r in counted.where("label is not null").select("name", "label").collect():
            labels[r.name].append(r.label)
        counted = counted.where("cell is not null").join(F.broadcast(spark.createDataFrame([(c, before[c]) for c in open_], "name string, before long")), "name")
        up = F.col("before") + F.sum("n").over(Window.partitionBy("name").orderBy("cell"))
        if not sizes:
            sizes = {r.name: r.n for r in counted.groupBy("name").agg(F.sum("n").alias("n")).collect()}
        wholes = spark.createDataFrame([(c, n) for c, n in sizes.items()], "name string, whole long")
        first = counted.withColumn("up", up).join(F.broadcast(wholes), "name").where(F.col("up") >= F.ceil(F.col("whole") / 2))  # one row a number
        found = first.groupBy("name").agg(F.min_by(F.struct("low", "high", "n", "up"), "cell").alias("x")).select("name", "x.*").collect()
        removed(spark, path)
        open_ = {}
        for r in found:
            if r.low == r.high or r.n <= OFF * sizes[r.name]:
                bits = np.array([r.low], np.int64)
                medians[r.name] = float(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(float)[0])
            else:
                open_[r.name], before[r.name] = (r.low, r.high), r.up - r.n
        shift, categories = max(0, shift - 24), []
    height = max(1, *map(len, labels.values()))
    lines = [[*medians.values(), *[(own or [None])[min(k, max(len(own) - 1, 0))] for own in labels.values()]] for k in range(height)]
    return spark.createDataFrame(lines, ", ".join([f"{c} double" for c in medians] + [f"{c} string" for c in labels]))


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred sums of products of features and, last, the label."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, n: int, values: np.ndarray) -> Moments:
        mean = values.mean(axis=0)
        return cls(n, mean, (values - mean).T @ (values - mean))

    def with_(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def moments_of(rows: DataFrame) -> Moments:
    """Moments of raw features and label in one reading; a task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if n:
                own = Moments.of(n, np.column_stack([batch.column("x").flatten().to_numpy().reshape(n, -1), batch.column("label").to_numpy(zero_copy_only=False)]))
                held = own if held is None else held.with_(own)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"n": [held.n], "mean": [held.mean.tolist()], "products": [held.cross.ravel().tolist()]})

    ship(rows.sparkSession)
    parts = rows.select(vector_to_array("raw").alias("x"), "label").mapInArrow(run, "n long, mean array<double>, products array<double>").collect()
    found = [Moments(r.n, np.array(r["mean"]), np.array(r.products).reshape(len(r["mean"]), -1)) for r in parts]
    out = found[0]
    for own in found[1:]:
        out = out.with_(own)
    return out


def prepared_for(kind: str, rows: DataFrame, stand: DataFrame | None = None) -> tuple[PipelineModel, Moments | None]:
    """The preparation of ``rows``, and for the linear model their moments; ``stand`` is what ``typical`` has found of them, if it is known."""
    stand = typical(rows) if stand is None else stand
    if kind != "linear":
        return preparation(False).fit(stand), None
    *stages, scaler = preparation(True).getStages()
    fixed = Pipeline(stages=stages).fit(stand)
    moments = moments_of(fixed.transform(rows.withColumn("label", F.log1p("target"))))
    mean, half = moments.mean[:-1], np.sqrt(np.diag(moments.cross)[:-1] / max(moments.n - 1, 1) / 2)
    # two rows of the same means and deviations
    ends = rows.sparkSession.createDataFrame([(Vectors.dense(mean - half),), (Vectors.dense(mean + half),)], ["raw"])
    return PipelineModel([*fixed.stages, scaler.fit(ends)]), moments


def _prepared(preparing: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    return preparing.transform(rows).select(*keep, "features")


def edges_of(prepared: DataFrame) -> tuple[list[np.ndarray], int]:
    """Of each feature the values after which its bins end, by quantiles of all rows (values of equal leading bits are one), and how many rows there are."""
    names = [*[f"{c}__n" for c in NUMBERS], *[f"{c}__c" for c in CATEGORIES]]
    counted, path = written(_cells(prepared, dict.fromkeys(names, (-(1 << 63), (1 << 63) - 1)), COARSE, []), "cells")
    by_name = Window.partitionBy("name")
    rows = counted.where("cell is not null").withColumns({"up": F.sum("n").over(by_name.orderBy("cell")), "whole": F.sum("n").over(by_name)})
    ends = (F.col("up") < F.col("whole")) & (F.floor(F.col("up") * trees.BINS / F.col("whole")) > F.floor((F.col("up") - F.col("n")) * trees.BINS / F.col("whole")))
    found = rows.where(ends | (F.col("up") == F.col("whole"))).select("name", "high", "up", "whole").collect()  # at most a bin each
    removed(prepared.sparkSession, path)
    bits = {c: np.array(sorted(r.high for r in found if r.name == c and r.up < r.whole), np.int64) for c in names}
    return [np.where(b < 0, b ^ np.int64((1 << 63) - 1), b).view(float) for b in bits.values()], max((r.whole for r in found), default=0)


def _coded(preparing: PipelineModel, rows: DataFrame, edges: list[np.ndarray]) -> tuple[DataFrame, str]:
    prepared = preparing.transform(rows).select(F.xxhash64(ITEM, F.col("t").cast("long")).alias("id"), vector_to_array("features").alias("x"), "target")
    return written(growing.coded(prepared, edges), "coded")


def _held(coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and targets of a table that a task may hold."""
    # in one order, whatever the partitions
    found = coded.orderBy("id", "target").select("codes", "target").toArrow()
    codes = found.column("codes").combine_chunks()
    return codes.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((0, len(FEATURES)), np.int8), found.column("target").to_numpy()


@dataclass
class Ground:
    """All rows that trees learn from: their preparation, edges of bins, how many they are, and the written table of their codes."""

    preparing: PipelineModel
    edges: list[np.ndarray]
    n: int
    table: DataFrame
    path: str

    @classmethod
    def of(cls, preparing: PipelineModel, rows: DataFrame) -> Ground:
        edges, n = edges_of(preparing.transform(rows))
        return cls(preparing, edges, n, *_coded(preparing, rows, edges))

    def grown(self, kind: str, tried: list[Params], seed: int = 42) -> tuple[DataFrame, str]:
        """NODES of every tree of every parameter set, written, and where."""
        spark, paths = self.table.sparkSession, []
        if self.n > growing.HELD:
            out, paths = growing.grown(kind, self.table, len(FEATURES), tried, seed)
        else:
            x, y = _held(self.table)
            out = grown(spark, kind, tried, x, np.log1p(y), seed)
        nodes = written(out, "nodes")
        for path in paths:
            removed(spark, path)
        return nodes

    def removed(self) -> None:
        removed(self.table.sparkSession, self.path)


# --- models ---------------------------------------------------------------------


@dataclass
class Model:
    """``kind`` with its parameters, preparation and cap, and either pyspark.ml's stages or edges of bins and the table of nodes."""

    kind: str
    params: Params
    preparing: PipelineModel
    cap: float
    linear: PipelineModel | None = None
    edges: list[np.ndarray] | None = None
    nodes: DataFrame | None = None


def _ridge(alpha: float, moments: Moments, scaler: StandardScalerModel) -> PipelineModel:
    """Least squares of scaled features with ``alpha`` times the squared weights added to the sum of squared errors, from the moments."""
    deviation = scaler.std.toArray()
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    square = moments.cross[:-1, :-1] * np.outer(scale, scale)
    weights = np.linalg.solve(square + alpha * np.eye(len(scale)), moments.cross[:-1, -1] * scale)
    middle, turn = float(moments.mean[-1]), np.eye(len(scale))
    # pyspark.ml's model of these weights: the line through points on each axis
    points = [(Vectors.dense(side * turn[k]), middle + side * float(w)) for k, w in enumerate(weights) for side in (-1.0, 1.0)]
    return Pipeline(stages=[LinearRegression(labelCol="label", solver="normal")]).fit(SparkSession.active().createDataFrame(points, ["features", "label"]))


def _tasks(spark: SparkSession, kind: str, tried: list[Params], seed: int) -> DataFrame:
    """One row a tree of a forest, and one a boosted model, dealt to as many tasks as the cluster runs at once."""
    rows = [(trial, tree, seed + 1000 * trial + tree) for trial, p in enumerate(tried) for tree in range(p["trees"] if kind == "forest" else 1)]
    parts = min(len(rows), max(2, spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, "trial int, tree int, seed long").repartition(parts)


def _grown(kind: str, x: np.ndarray, y: np.ndarray, p: Params, seed: int):
    if kind == "forest":
        yield trees.bag(x, y, p, seed)
    else:
        yield from trees.boost(x, y, p, seed)


def grown(spark: SparkSession, kind: str, tried: list[Params], x: np.ndarray, y: np.ndarray, seed: int = 42) -> DataFrame:
    """NODES of every tree of every parameter set, from rows that a task may hold."""
    sent = spark.sparkContext.broadcast((x, y, tried))  # of at most growing.HELD rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, tried = sent.value
        for batch in batches:
            for trial, place, own in batch.itertuples(index=False):
                for k, tree in enumerate(_grown(kind, x, y, tried[trial], own)):
                    yield pd.DataFrame({"trial": trial, "tree": place + k, "node": np.arange(len(tree["left"]))} | tree)

    ship(spark)
    return _tasks(spark, kind, tried, seed).mapInPandas(run, NODES)


def trial_losses(spark: SparkSession, kind: str, tried: list[Params], train: tuple, validation: tuple, cap: float, seed: int = 42) -> list[float]:
    """Validation WAPE of every parameter set; a task gives its trees' share of each prediction, and shares are added up."""
    sent = spark.sparkContext.broadcast((*train, *validation, tried))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, to, target, tried = sent.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for trial, _, own in batch.itertuples(index=False):
                part = sum(trees.predict(tree, to) for tree in _grown(kind, x, y, tried[trial], own))
                held[trial] = held.get(trial, 0) + part
        for trial, part in held.items():
            yield pd.DataFrame({"trial": trial, "row": np.arange(len(part)), "target": target, "part": part})

    ship(spark)
    parts = _tasks(spark, kind, tried, seed).mapInPandas(run, "trial int, row int, target double, part double")
    rows = parts.groupBy("trial", "row").agg(F.first("target").alias("target"), F.sum("part").alias("log"))
    rows = rows.withColumn("pred", capped(F.col("log"), cap))
    found = {r.trial: r.w for r in rows.groupBy("trial").agg(wape("target", "pred").alias("w")).collect()}
    return [float("inf") if found.get(k) is None else float(found[k]) for k in range(len(tried))]


def cap_of(rows: DataFrame) -> float:
    return 4 * (rows.agg(F.max("target")).first()[0] or 0.0)


def fit(kind: str, params: Params, rows: DataFrame, preparing: PipelineModel | None = None, cap: float | None = None, moments: Moments | None = None, ground: Ground | None = None) -> Model:
    """A model of log1p of the target, of all rows; ``ground`` is what trees grow on, if it is known."""
    if preparing is None:
        preparing, moments = prepared_for(kind, rows)
    cap = cap_of(rows) if cap is None else cap
    if kind == "linear":
        if moments is None:
            moments = moments_of(preparing.transform(rows.withColumn("label", F.log1p("target"))))
        return Model(kind, params, preparing, cap, _ridge(params["alpha"], moments, preparing.stages[-1]))
    own = Ground.of(preparing, rows) if ground is None else ground
    nodes, _ = own.grown(kind, [params])
    if ground is None:
        own.removed()
    return Model(kind, params, preparing, cap, None, own.edges, nodes)


def _ensemble(nodes: DataFrame) -> list[trees.Tree]:
    found = nodes.toPandas().sort_values(["tree", "node"])
    return [{name: part[name].to_numpy(kind) for name, kind in trees.NODE} for _, part in found.groupby("tree")]


def ensemble(model: Model) -> list[trees.Tree]:
    """A model's trees; how many nodes they have is bounded by their number and depth."""
    return _ensemble(model.nodes)


def walked(nodes: DataFrame, codes: Callable[[pd.Series, list[np.ndarray] | None], np.ndarray], edges: list[np.ndarray] | None, column: Column) -> Column:
    """Sum of the trees' values of each row; trees are sent about ``WALKED`` nodes at a time."""
    spans, size = [], WALKED
    for r in nodes.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect():  # one row a tree
        if size + r.n > WALKED:
            spans.append([r.tree, r.tree])
            size = 0
        spans[-1][1], size = r.tree, size + r.n
    ship(nodes.sparkSession)

    def part(first: int, last: int) -> Column:
        sent = nodes.sparkSession.sparkContext.broadcast(([trees.routed(tree) for tree in _ensemble(nodes.where(F.col("tree").between(first, last)))], edges))

        @F.pandas_udf("double")
        def value(features: pd.Series) -> pd.Series:
            found, edges = sent.value
            return pd.Series(trees.summed(found, codes(features, edges)) if len(features) else np.zeros(0))

        return value(column)

    return sum((part(*span) for span in spans), F.lit(0.0))


def capped(logged: Column, cap: float) -> Column:
    return F.least(F.greatest(F.expm1(logged), F.lit(0.0)), F.lit(float(cap)))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with pred."""
    keep = [c for c in rows.columns if c != "pred"]
    if model.kind == "linear":
        out = model.linear.transform(_prepared(model.preparing, rows, keep)).withColumnRenamed("prediction", "__log")
    else:
        value = walked(model.nodes, lambda features, edges: trees.binned(np.stack(features.to_numpy()), edges), model.edges, vector_to_array("features"))
        out = _prepared(model.preparing, rows, keep).withColumn("__log", value)
    return out.withColumn("pred", capped(F.col("__log"), model.cap)).drop("features", "__log")


def save(model: Model, path: str) -> None:
    """The model in the folder ``path``, in place of what is there."""
    spark = SparkSession.active()
    model.preparing.write().overwrite().save(f"{path}/preparing")
    facts = [(model.kind, list(model.params), [float(v) for v in model.params.values()], float(model.cap), [e.tolist() for e in model.edges or []])]
    spark.createDataFrame(facts, "kind string, names array<string>, values array<double>, cap double, edges array<array<double>>").write.mode("overwrite").parquet(f"{path}/facts")
    if model.linear:
        model.linear.write().overwrite().save(f"{path}/linear")
    else:
        model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def load(path: str) -> Model:
    """What ``save`` wrote."""
    spark = SparkSession.active()
    facts = spark.read.parquet(f"{path}/facts").first()
    linear = facts.kind == "linear"
    return Model(
        facts.kind, dict(zip(facts.names, facts["values"], strict=True)), PipelineModel.load(f"{path}/preparing"), facts.cap, PipelineModel.load(f"{path}/linear") if linear else None,
        None if linear else [np.array(e) for e in facts.edges], None if linear else spark.read.schema(NODES).parquet(f"{path}/nodes"),
    )


# --- search and selection ------------------------------------------------------------


def score(rows: DataFrame) -> float:
    return _loss(rows.agg(wape("target", "pred").alias("w")).first().w)


def _loss(found: float | None) -> float:
    return float("inf") if found is None else float(found)


def tune(kind: str, train: DataFrame, validation: DataFrame, trials: int = TRIALS, seed: int = 42, space: Space | None = None, cap: float | None = None, ground: Ground | None = None, stand: DataFrame | None = None) -> list[tuple[Params, float]]:
    """Every trial of a search with its validation WAPE, of all rows of ``train`` and ``validation``."""
    spark = train.sparkSession
    cap = cap_of(train.select("target").unionByName(validation.select("target"))) if cap is None else cap
    if kind == "linear":
        preparing, moments = prepared_for(kind, train, stand)

        def evaluate(tried: list[Params]) -> list[float]:
            models = [fit(kind, p, train, preparing, cap, moments) for p in tried]
            losses = predict_all(models, validation).agg(*[wape("target", f"pred{k}").alias(f"w{k}") for k in range(len(models))]).first()
            return list(map(_loss, losses))

        return search(space or SPACE[kind], evaluate, trials, seed)
    own = Ground.of(prepared_for(kind, train, stand)[0], train) if ground is None else ground
    coded, path = _coded(own.preparing, validation, own.edges)
    if max(own.n, coded.count()) <= growing.HELD:
        (x, y), sides = _held(own.table), _held(coded)

        def evaluate(tried: list[Params]) -> list[float]:
            return trial_losses(spark, kind, tried, (x, np.log1p(y)), sides, cap, seed)
    else:

        def evaluate(tried: list[Params]) -> list[float]:
            nodes, grown_at = own.grown(kind, tried, seed)
            losses = [score(_walked_codes(nodes.where(F.col("trial") == k), coded, cap)) for k in range(len(tried))]
            removed(spark, grown_at)
            return losses

    out = search(space or SPACE[kind], evaluate, trials, seed)
    removed(spark, path)
    if ground is None:
        own.removed()
    return out


def _walked_codes(nodes: DataFrame, coded: DataFrame, cap: float) -> DataFrame:
    value = walked(nodes, lambda codes, _: np.stack(codes.to_numpy()), None, F.col("codes"))
    return coded.select("target", capped(value, cap).alias("pred"))


def trial_table(frame: DataFrame | Frames, test_from: int, trials: int = TRIALS, most: int | None = None) -> DataFrame:
    """candidate, trial, params and validation_wape of every trial of every candidate, on all train and validation rows; on about ``most`` of each where a caller asks for a quick look."""
    frames = Frames.of(frame)
    if most is None:
        start = test_from - 26
        train, validation = split(frames.whole(None, start, None), test_from)[0], split(frames.whole(start, test_from, None), test_from)[1]
    else:
        parts = [sampled_from(frames, lambda rows, k=k: split(rows, test_from)[k], most, stop=test_from).withColumn("part", F.lit(name)) for k, name in enumerate(("train", "validation"))]
        sample, _ = written(parts[0].unionByName(parts[1]), "search")
        train, validation = (sample.where(F.col("part") == name).drop("part") for name in ("train", "validation"))
    cap = cap_of(learned_from(frames.slim(None, test_from), test_from)) if most is None else None
    stand = typical(train)
    ground = Ground.of(prepared_for("boosted", train, stand)[0], train)
    spark = train.sparkSession
    # searches side by side, as a batch of trials may have fewer tasks than the cluster runs at once
    with ThreadPool(len(SPACE)) as pool:
        found = pool.map(inheritable_thread_target(spark)(lambda kind: tune(kind, train, validation, trials, cap=cap, ground=ground, stand=stand)), SPACE)
    ground.removed()
    rows = [(kind, k, list(p), [float(v) for v in p.values()], loss) for kind, tried in zip(SPACE, found, strict=True) for k, (p, loss) in enumerate(tried)]
    return spark.createDataFrame(rows, "candidate string, trial int, names array<string>, values array<double>, validation_wape double")


def select(results: dict[str, float], favourite: str = "boosted", slack: float = 0.005) -> str:
    """The least error; the favourite where it is within ``slack`` of it."""
    best = min(results, key=results.get)
    return favourite if favourite in results and results[favourite] <= results[best] + slack else best


def best_trials(trials: DataFrame) -> dict[str, tuple[Params, float]]:
    """Each candidate's parameters of least error, the first of equal ones."""
    out: dict[str, tuple[Params, float]] = {}
    for r in sorted(trials.collect(), key=lambda r: (r.candidate, r.validation_wape, r.trial)):
        kinds = SPACE[r.candidate]
        out.setdefault(r.candidate, ({n: int(v) if isinstance(kinds[n], Whole) else v for n, v in zip(r.names, r["values"], strict=True)}, r.validation_wape))
    return out


def _ground(frames: Frames, test_from: int) -> tuple[DataFrame, float]:
    """Train and validation rows, and the cap of predictions."""
    return learned_from(frames.whole(None, test_from, None), test_from), cap_of(learned_from(frames.slim(None, test_from), test_from))


def _tested(frames: Frames, test_from: int) -> DataFrame:
    return frames.whole(test_from, None, None).where(F.col("target").isNotNull())


def predict_all(models: list[Model], rows: DataFrame) -> DataFrame:
    """``rows`` with pred0, pred1 and so on, in one reading."""
    for k, model in enumerate(models):
        rows = predict(model, rows).withColumnRenamed("pred", f"pred{k}")
    return rows


def candidates(frame: DataFrame | Frames, trials: DataFrame, test_from: int) -> DataFrame:
    """Best validation WAPE of every candidate, and test WAPE and bias when fitted anew on train and validation rows."""
    frames, best = Frames.of(frame), best_trials(trials)
    both, cap = _ground(frames, test_from)
    chosen = select({kind: error for kind, (_, error) in best.items()})
    stand = typical(both)
    ground = Ground.of(prepared_for("boosted", both, stand)[0], both)
    models = []
    for kind, (params, _) in best.items():
        preparing, moments = prepared_for(kind, both, stand) if kind == "linear" else (ground.preparing, None)
        models.append(fit(kind, params, both, preparing, cap, moments, ground))
    ground.removed()
    facts = predict_all(models, _tested(frames, test_from)).agg(*[f("target", f"pred{k}").alias(f"{n}{k}") for k in range(len(models)) for n, f in (("w", wape), ("b", bias))]).first()
    rows = [(kind, ", ".join(f"{n}={v:.6g}" for n, v in params.items()), error, facts[f"w{k}"], facts[f"b{k}"], kind == chosen) for k, (kind, (params, error)) in enumerate(best.items())]
    return both.sparkSession.createDataFrame(rows, "candidate string, params string, validation_wape double, test_wape double, test_bias double, selected boolean")


def refitted(frame: DataFrame | Frames, kind: str, params: Params, test_from: int) -> Model:
    """A model fitted on train and validation rows."""
    both, cap = _ground(Frames.of(frame), test_from)
    return fit(kind, params, both, cap=cap)


def selected(frame: DataFrame | Frames, trials: DataFrame, test_from: int) -> Model:
    """The selected candidate, fitted on train and validation rows."""
    best = best_trials(trials)
    kind = select({k: error for k, (_, error) in best.items()})
    return refitted(frame, kind, best[kind][0], test_from)


# --- what the model does ----------------------------------------------------------------


def lift(tested: DataFrame, bases: tuple[str, ...], scales: DataFrame) -> DataFrame:
    """level (segment, abc, all), value, n, model and baseline WAPE, lift, mase, bias and baseline method of held-out rows.

    ``tested`` has target, pred, h, segment, abc and a column for each simple
    method. A segment's baseline is the one of least pooled WAPE in it (the
    first of equal ones); class and whole take each row's own segment's. The
    scale of an error is the item's mean one-step error while training
    (``scales``: item and scale), times the periods of the horizon.
    """
    pooled = tested.groupBy("segment").agg(*[wape("target", b).alias(b) for b in bases])
    pairs = F.array(*[F.struct(F.col(b).alias("wape"), F.lit(k).alias("place"), F.lit(b).alias("method")) for k, b in enumerate(bases)])
    methods = pooled.select("segment", F.coalesce(F.array_min(F.filter(pairs, lambda x: x["wape"].isNotNull()))["method"], F.lit(bases[0])).alias("method"))
    rows = tested.join(F.broadcast(methods), "segment").join(scales, ITEM, "left")  # one row a segment
    base = F.coalesce(*[F.when(F.col("method") == b, F.col(b)) for b in bases])
    rows = rows.withColumns({"base": base, "unit": F.col("scale") * F.col("h")})
    levels = F.array(*[F.struct(F.lit(level).alias("level"), value.alias("value")) for level, value in (("segment", F.col("segment")), ("abc", F.col("abc")), ("all", F.lit("all")))])
    rows = rows.withColumn("of", F.explode(levels)).groupBy("of.level", "of.value").agg(
        F.count("*").alias("n"), wape("target", "pred").alias("model_wape"), wape("target", "base").alias("base_wape"), bias("target", "pred").alias("bias"),
        F.try_divide(F.avg(F.when(F.col("unit") > 0, F.abs(F.col("target") - F.col("pred")))), F.avg(F.when(F.col("unit") > 0, F.col("unit")))).alias("mase"), F.max(F.when(F.col("of.level") == "segment", F.col("method"))).alias("method"),
    )
    return rows.select("level", "value", "n", "model_wape", "base_wape", F.try_divide(F.col("base_wape") - F.col("model_wape"), F.col("base_wape")).alias("lift"), "mase", "bias", "method")


def one_step_scales(grid: DataFrame, until: int) -> DataFrame:
    """item and scale: the mean absolute change from one period to the next, of periods before ``until``."""
    change = F.abs(F.col("s") - F.lag("s").over(Window.partitionBy(ITEM).orderBy("t")))
    return grid.where(F.col("t") < until).withColumn("change", change).groupBy(ITEM).agg(F.avg("change").alias("scale"))


def explained(model: Model, rows: DataFrame, most: int | None = EXPLAINED_ROWS) -> DataFrame:
    """item, t, mean, logged (the model's log1p prediction) and each feature's Shapley value of at most ``most`` rows, or of all.

    The values and the mean sum to the prediction. Exact under the trees' own
    path-dependent expectation; the linear model's are weights times what
    differs from the mean.
    """
    few = rows if most is None else sampled(rows, most).orderBy(F.xxhash64(ITEM, F.col("t").cast("long"), F.lit(23))).limit(most)
    few = _prepared(model.preparing, few, [ITEM, "t"])
    if model.kind == "linear":
        line = model.linear.stages[0]
        names = [*NUMBERS, *[c for c, n in zip(CATEGORIES, _widths(model.preparing), strict=True) for _ in range(n)]]
        weights = F.array(*[F.lit(float(v)) for v in line.coefficients])
        parts = few.withColumn("x", F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b))
        sums = {c: sum((F.element_at("x", k + 1) for k, n in enumerate(names) if n == c), F.lit(0.0)) for c in FEATURES}
        # features are centred, so a weight times a feature is what differs from the mean
        return parts.select(ITEM, "t", F.lit(float(line.intercept)).alias("mean"), (F.aggregate("x", F.lit(0.0), lambda a, b: a + b) + float(line.intercept)).alias("logged"), *[v.alias(c) for c, v in sums.items()])
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((ensemble(model), model.edges))
    kind = rows.schema[ITEM].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, edges = sent.value
        mean = sum(map(trees.mean, found))
        for batch in batches:
            if len(batch):
                x = trees.binned(np.stack(batch["x"].to_numpy()), edges)
                values = sum(trees.shapley(tree, x) for tree in found)
                logged = sum(trees.predict(tree, x) for tree in found)
                yield pd.DataFrame({ITEM: batch[ITEM], "t": batch["t"], "mean": mean, "logged": logged} | {c: values[:, k] for k, c in enumerate(FEATURES)})

    dealt = few.select(ITEM, "t", vector_to_array("features").alias("x")).repartition(4 * max(2, rows.sparkSession.sparkContext.defaultParallelism), ITEM, "t")
    return dealt.mapInPandas(run, f"{ITEM} {kind}, t {rows.schema['t'].dataType.simpleString()}, mean double, logged double, " + ", ".join(f"{c} double" for c in FEATURES))


def _widths(preparing: PipelineModel) -> list[int]:
    """How many columns each category has among the linear model's features."""
    encoder = next(s for s in preparing.stages if s.__class__.__name__ == "OneHotEncoderModel")
    return [n + (1 if encoder.getHandleInvalid() == "keep" else 0) - (1 if encoder.getDropLast() else 0) for n in encoder.categorySizes]


def mean_absolute(values: DataFrame) -> DataFrame:
    """feature and mean_abs, the mean absolute Shapley value."""
    sums = values.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in FEATURES])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in FEATURES])))


def importance(model: Model) -> DataFrame:
    """Share of each feature in the fall of squared error, from the table of nodes."""
    whole = model.nodes.select("trial", "tree", "node", "feature", "left", (F.col("cover") * F.col("value") * F.col("value")).alias("held"))
    parents = whole.where("left > 0").select("trial", "tree", "node", "feature", F.col("held").alias("before"), F.explode(F.array(F.col("left"), F.col("left") + 1)).alias("child"))
    children = whole.select("trial", "tree", F.col("node").alias("child"), "held")
    gains = parents.join(children, ["trial", "tree", "child"]).groupBy("trial", "tree", "node", "feature").agg((F.sum("held") - F.first("before")).alias("gain"))
    names = F.array(*[F.lit(c) for c in FEATURES])
    gains = gains.groupBy(F.element_at(names, F.col("feature") + 1).alias("feature")).agg(F.sum("gain").alias("gain"))
    return gains.crossJoin(F.broadcast(gains.agg(F.sum("gain").alias("total")))).select("feature", F.try_divide("gain", "total").alias("importance"))  # one row


def learning_curve(frame: DataFrame | Frames, trials: DataFrame, test_from: int, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Train and test WAPE of the selected model by the share of train and validation rows it learns from."""
    frames, best = Frames.of(frame), best_trials(trials)
    kind = select({k: error for k, (_, error) in best.items()})
    both, cap = _ground(frames, test_from)
    draw = F.pmod(F.xxhash64(ITEM, F.col("t").cast("long"), F.lit(31)), F.lit(1 << 40)) / float(1 << 40)
    models = [fit(kind, best[kind][0], both.where(draw < share), cap=cap) for share in shares]
    # the rows of each side are read once for all
    own = [F.when(draw < share, F.col("target")).alias(f"own{k}") for k, share in enumerate(shares)]
    known = predict_all(models, both.select("*", *own)).agg(*[f.alias(f"{n}{k}") for k in range(len(shares)) for n, f in (("n", F.count(f"own{k}")), ("w", wape(f"own{k}", f"pred{k}")))]).first()
    losses = predict_all(models, _tested(frames, test_from)).agg(*[wape("target", f"pred{k}").alias(f"w{k}") for k in range(len(models))]).first()
    rows = [(share, known[f"n{k}"], _loss(known[f"w{k}"]), _loss(losses[k])) for k, share in enumerate(shares)]
    return both.sparkSession.createDataFrame(rows, "share double, training_rows long, train_wape double, test_wape double")


def cleaning_tiers(tiers: dict[str, DataFrame | Frames], kind: str, params: Params, test_from: int) -> DataFrame:
    """Test WAPE of one model on series of different cleaning, each against its own target."""
    rows = [(name, score(predict(refitted(frame, kind, params, test_from), _tested(Frames.of(frame), test_from)))) for name, frame in tiers.items()]
    return SparkSession.active().createDataFrame(rows, "tier string, test_wape double")
