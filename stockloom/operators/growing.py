"""Regression trees on all rows of a table, however many: ids, bin codes and targets, dealt to tasks.

Tasks keep their rows and add up each level's sums of bins, from which the
driver takes the splits; what it gets does not depend on how many rows there
are. Boosted trees come one after another, and their predictions stay with the
rows. A forest's trees begin side by side; nodes of at most ``HELD`` rows are
then dealt out, and each is grown to its end by one task. Its trees are taken in
rounds, so that what lies between both steps is bounded as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import folder, removed, written
from ..shipping import ship
from . import trees
from .search import Params

#: Rows that one task may hold of a tree, and of a block; about how many bytes of rows a round deals out, and of sums the driver gets at once; trees after which blocks are checkpointed.
HELD, BLOCK, ROUND, MESSAGES, LINEAGE = 1 << 19, 1 << 18, 4 << 30, 1 << 28, 20
_FIELDS = ", ".join(f"{name} {'double' if kind is np.float64 else 'int'}" for name, kind in trees.NODE)
NODES = f"trial int, tree int, node int, {_FIELDS}"
CODED = "id long, codes array<tinyint>, target double"


def coded(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """CODED rows of id, x (an array of features) and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = trees.binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), edges).astype(np.int8)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), batch.column("target")], names=["id", "codes", "target"])

    ship(rows.sparkSession)
    return rows.select("id", "x", F.col("target").cast("double").alias("target")).mapInArrow(run, CODED)


class Rows:
    """All rows in numbered blocks, kept by the tasks: codes (a line a feature), log1p targets, and what each boosted model has predicted so far."""

    def __init__(self, table: DataFrame, width: int, models: int = 0):
        self.spark = table.sparkSession
        ship(self.spark)
        tasks = max(2, self.spark.sparkContext.defaultParallelism)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in itertools.chain(batches, [None]):
                if batch is not None and batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                if n and (batch is None or n >= BLOCK):
                    codes = np.concatenate([b.column("codes").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(n, width)
                    logs = np.concatenate([b.column("log").to_numpy(zero_copy_only=False) for b in held])
                    yield pa.RecordBatch.from_pydict({"codes": [np.ascontiguousarray(codes.T).tobytes()], "logs": [logs.tobytes()]})
                    held, n = [], 0

        def unpacked(part: int, rows: Iterator) -> Iterator[tuple]:
            for k, row in enumerate(rows):
                logs = np.frombuffer(bytes(row.logs))
                yield (part, k), np.frombuffer(bytes(row.codes), np.int8).reshape(width, -1), logs, np.zeros((models, len(logs)))

        # in one order, so that sums are the same again
        rows = table.repartition(tasks, "id").sortWithinPartitions("id", "target").select("codes", F.log1p("target").alias("log"))
        self.blocks = rows.mapInArrow(packed, "codes binary, logs binary").rdd.mapPartitionsWithIndex(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
        known = sorted(self.blocks.map(lambda b: (b[0], len(b[2]), float(b[2].sum()))).collect())
        #: block -> its number; blocks' sizes; sum of all targets
        self.number = {place: k for k, (place, _, _) in enumerate(known)}
        self.sizes, self.whole = np.array([float(n) for _, n, _ in known]), sum(total for _, _, total in known)
        self.before, self.updates, self.marked = None, 0, []

    def added_up(self, asked: list[Callable]) -> list[np.ndarray]:
        """Of each function of number, codes, targets and predictions the sum of what it gives of all blocks."""
        number = self.number

        def run(blocks: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
            out = None
            for place, x, y, held in blocks:
                found = [f(number[place], x, y, held) for f in asked]
                out = found if out is None else [a + b for a, b in zip(out, found, strict=True)]
            if out is not None:
                yield out

        parts = self.blocks.mapPartitions(run).collect()
        return [sum(found) for found in zip(*parts, strict=True)]

    def update(self, trees_of: dict[int, trees.Tree]) -> None:
        """Add trees' values to the predictions of their models."""

        def run(block: tuple) -> tuple:
            place, x, y, held = block
            held = held.copy()
            for model, tree in trees_of.items():
                held[model] += tree["value"][trees.places(tree, x)]
            return place, x, y, held

        if self.before is not None:
            self.before.unpersist()
        # formed by the next sums that are asked for, from those before
        self.before, self.blocks = self.blocks, self.blocks.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.updates += 1
        if self.updates % LINEAGE == 0:
            self.blocks.checkpoint()
            self.marked.append(self.blocks)
        while len(self.marked) > 1 and self.marked[1].isCheckpointed():
            removed(self.spark, self.marked.pop(0).getCheckpointFile())

    def released(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()
        for blocks in self.marked:
            if blocks.isCheckpointed():
                removed(self.spark, blocks.getCheckpointFile())


def _table(spark: SparkSession, found: list[tuple[int, int, trees.Tree, np.ndarray]]) -> DataFrame:
    """NODES of trial, tree, its nodes and those of them that are kept."""
    parts = [pd.DataFrame({"trial": trial, "tree": place, "node": keep} | {name: tree[name][keep] for name, _ in trees.NODE}) for trial, place, tree, keep in found]
    return spark.createDataFrame(pd.concat(parts), NODES)


def _grown(rows: Rows, plans: dict[object, Generator], sums_of: Callable[[object, trees.Tree, np.ndarray], Callable], nodes: int) -> dict[object, tuple[trees.Tree, dict[int, int]]]:
    """What plans of trees come to, level by level and all of them at once, as long as they ask for no more than ``nodes`` nodes."""
    out, waiting = {}, {key: next(plan) for key, plan in plans.items()}
    while waiting:
        some, size = [], 0
        for key, (_, ids) in waiting.items():
            if some and size + len(ids) > nodes:
                break
            some.append(key)
            size += len(ids)
        for key, found in zip(some, rows.added_up([sums_of(key, *waiting[key]) for key in some]), strict=True):
            try:
                waiting[key] = plans[key].send(found)
            except StopIteration as end:
                out[key] = end.value
                del waiting[key]
    return out


def _many(rows: Rows, width: int) -> int:
    """Nodes whose sums the driver may get from all tasks at once."""
    return max(1, MESSAGES // (width * 2 * trees.BINS * 8 * rows.blocks.getNumPartitions()))


def boosted(table: DataFrame, width: int, tried: list[Params], seed: int) -> tuple[DataFrame, list[str]]:
    """NODES of the boosted trees of every parameter set, and no folders; the sets take their trees side by side."""
    spark = table.sparkSession
    # blocks are written to the shared folder now and then, so that neither their history nor what a lost executor costs grows
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    rows = Rows(table, width, len(tried))
    n = int(rows.sizes.sum())
    mean = rows.whole / max(n, 1)
    first = {name: np.array([{"feature": -1, "value": mean, "cover": n}.get(name, 0)]).astype(kind) for name, kind in trees.NODE}
    found = [(trial, 0, first, np.arange(1)) for trial in range(len(tried))]
    rows.update(dict.fromkeys(range(len(tried)), first))
    choices = [np.random.default_rng(seed + 1000 * trial) for trial in range(len(tried))]
    for k in range(max(p["trees"] for p in tried)):
        features = {trial: choices[trial].choice(width, max(1, round(p["columns"] * width)), replace=False) for trial, p in enumerate(tried) if k < p["trees"]}

        def sums_of(trial: int, tree: trees.Tree, ids: np.ndarray, k: int = k, features: dict = features) -> Callable:
            share, own, some = tried[trial]["rows"], seed + 1000 * trial, features[trial]
            return lambda number, x, y, held: trees.sums(x, y - held[trial], np.random.default_rng([own, k, number]).random(len(y)) < share, tree, ids, some)

        plans = {trial: trees.planned(some, tried[trial]["depth"], tried[trial]["least"], tried[trial]["ridge"]) for trial, some in features.items()}
        grown = {trial: tree | {"value": tree["value"] * tried[trial]["rate"]} for trial, (tree, _) in _grown(rows, plans, sums_of, _many(rows, width)).items()}
        found += [(trial, k + 1, tree, np.arange(len(tree["left"]))) for trial, tree in grown.items()]
        if k + 1 < max(p["trees"] for p in tried):
            rows.update(grown)
    rows.released()
    return _table(spark, found), []


def forest(table: DataFrame, width: int, tried: list[Params], seed: int) -> tuple[DataFrame, list[str]]:
    """NODES of the forests of every parameter set, and the folders where they lie."""
    spark, out, paths = table.sparkSession, None, []
    rows, held = Rows(table, width), HELD
    sizes = rows.sizes
    asked = [(trial, tree) for trial, p in enumerate(tried) for tree in range(p["trees"])]
    at_once = max(1, int(ROUND // max(1, sizes.sum() * (width + 12))))
    weight = lambda number, trial, place: trees.drawn(sizes, number, seed + 1000 * trial + place)

    def sums_of(key: tuple[int, int], tree: trees.Tree, ids: np.ndarray) -> Callable:
        return lambda number, x, y, _: trees.sums(x, y, weight(number, *key), tree, ids, np.arange(width))

    def finished(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        p, parts = tried[int(key[0])], parts.sort_values("block")
        x, y, drawn = (np.frombuffer(b"".join(parts[name]), kind) for name, kind in (("codes", np.int8), ("logs", float), ("weights", np.int32)))
        tree = trees.grow(x.reshape(-1, width), y, drawn, np.arange(width), int(parts.deep.iloc[0]), p["least"], 0.0)
        tree["value"] = tree["value"] / p["trees"]
        return pd.DataFrame({"trial": int(key[0]), "tree": int(key[1]), "sub": int(key[2]), "made": int(parts.made.iloc[0]), "node": np.arange(len(tree["left"]))} | tree)

    for begin in range(0, len(asked), at_once):
        plans = {(trial, place): trees.planned(np.arange(width), tried[trial]["depth"], tried[trial]["least"], 0.0, held) for trial, place in asked[begin : begin + at_once]}
        begun = _grown(rows, plans, sums_of, _many(rows, width))
        number = rows.number

        def dealt(block: tuple, begun: dict = begun, number: dict = number) -> Iterator[tuple]:
            place, x, y, _ = block
            for (trial, k), (tree, left) in begun.items():
                drawn = weight(number[place], trial, k)
                at = trees.places(tree, x)
                for node, deep in left.items():
                    some = np.flatnonzero((at == node) & (drawn > 0))
                    if len(some):
                        yield trial, k, node, number[place], len(tree["left"]), deep, np.ascontiguousarray(x[:, some].T).tobytes(), y[some].tobytes(), drawn[some].astype(np.int32).tobytes()

        ends = spark.createDataFrame(rows.blocks.flatMap(dealt), "trial int, tree int, node int, block int, made int, deep int, codes binary, logs binary, weights binary", verifySchema=False)
        grown = ends.groupBy("trial", "tree", "node").applyInPandas(finished, f"trial int, tree int, sub int, made int, node int, {_FIELDS}")
        grown, path = written(grown, "ends")
        tops = [(trial, k, tree | {"value": tree["value"] / tried[trial]["trees"]}, np.setdiff1d(np.arange(len(tree["left"])), list(left))) for (trial, k), (tree, left) in begun.items()]
        whole, place = written(_table(spark, tops).unionByName(numbered(grown)), "trees")
        removed(spark, path)
        paths.append(place)
        out = whole if out is None else out.unionByName(whole)
    rows.released()
    return out, paths


def numbered(grown: DataFrame) -> DataFrame:
    """NODES of trees that begin at node ``sub`` of others with ``made`` nodes: the first takes that node's place, the others come after all before."""
    earlier = Window.partitionBy("trial", "tree").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grown.groupBy("trial", "tree", "sub", "made").agg((F.count("*") - 1).alias("more"))
    shifts = sizes.select("trial", "tree", "sub", (F.col("made") + F.coalesce(F.sum("more").over(earlier), F.lit(0)) - 1).cast("int").alias("shift"))
    rows = grown.join(shifts, ["trial", "tree", "sub"])
    moved = {"node": F.when(F.col("node") == 0, F.col("sub")).otherwise(F.col("node") + F.col("shift")), "left": F.when(F.col("left") > 0, F.col("left") + F.col("shift")).otherwise(0)}
    return rows.withColumns(moved).select("trial", "tree", "node", *[name for name, _ in trees.NODE])


def grown(kind: str, table: DataFrame, width: int, tried: list[Params], seed: int = 42) -> tuple[DataFrame, list[str]]:
    """NODES of every tree of every parameter set, and folders that can go when they are read."""
    return (forest if kind == "forest" else boosted)(table, width, tried, seed)
