"""Counts and ranks of features that tasks form from histories and take in at once, so that their rows never leave the task.

Equal values are counted in numpy before anything is shuffled; what is
shuffled are different values with their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import removed, written
from . import histories

#: Different values that a task holds of a column before they are merged, and those of all columns that ranks are looked up among in memory.
MERGED, LOOKED_UP = 1 << 19, 1 << 23
#: Values and where there are any.
Numbers = tuple[np.ndarray, np.ndarray]
#: Of a batch its columns' values and, of each row, the group that it counts in; rows of a negative one are left out.
Taken = Callable[[pa.RecordBatch], tuple[list[Numbers], np.ndarray]]


def numbers(column: pa.Array) -> Numbers:
    """Values as doubles, with one zero; one that is no number is a value like any other, and the greatest."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0, column.is_valid().to_numpy(zero_copy_only=False)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` to so many digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x) + 0.0


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    begin = np.flatnonzero(np.diff(values, prepend=np.nan) != 0)
    return values[begin], np.add.reduceat(counts, begin, axis=0) if len(begin) else counts


def counts(rows: DataFrame, features: list[str], keep: list[str], taken: Taken, groups: int, start: int, stop: int | None = None) -> DataFrame:
    """column (its place), value and n0, n1 and so on: how many rows of each group have a value, of features of ``histories.periods``."""
    names = ["column", "value", *[f"n{k}" for k in range(groups)]]

    def batch(column: int, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), column, np.int32)), pa.array(values), *[pa.array(np.ascontiguousarray(n[:, k])) for k in range(groups)]], names=names)

    def fold(formed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}
        for part in formed:
            columns, group = taken(part)
            inside = [group == k for k in range(groups)]
            for c, (values, known) in enumerate(columns):
                for k, rows_of in enumerate(inside):
                    found, n = np.unique(values[rows_of & known], return_counts=True)
                    if len(found):
                        by_group = np.zeros((len(found), groups), np.int64)
                        by_group[:, k] = n
                        held.setdefault(c, []).append((found, by_group))
                        sizes[c] = sizes.get(c, 0) + len(found)
                if sizes.get(c, 0) > MERGED:
                    whole = _merged(*map(np.concatenate, zip(*held[c], strict=True)))
                    if len(whole[0]) > MERGED // 2:
                        yield batch(c, *whole)
                        held[c], sizes[c] = [], 0
                    else:
                        held[c], sizes[c] = [whole], len(whole[0])
        for c, parts in held.items():
            if parts:
                yield batch(c, *_merged(*map(np.concatenate, zip(*parts, strict=True))))

    found = histories.folded(rows, features, keep, fold, "column int, value double, " + ", ".join(f"{n} long" for n in names[2:]), start, stop)
    return found.groupBy("column", "value").agg(*[F.sum(n).alias(n) for n in names[2:]])


def rank_matrix(rows: DataFrame, features: list[str], keep: list[str], taken: Taken, columns: list[str], start: int, stop: int, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """a, b and rank correlation as ``timeseries.rank_matrix`` has them, of the columns that are taken from histories' periods.

    Values are counted in one reading; in a second one tasks look ranks up and
    add up their products, one row a task. ``otherwise`` does it where the
    different values are too many for a task.
    """
    spark = rows.sparkSession
    found, path = written(counts(rows, features, keep, taken, 1, start, stop), "counts")
    if found.count() > LOOKED_UP:
        removed(spark, path)
        return otherwise()
    table = found.orderBy("column", "value").toArrow()
    removed(spark, path)
    place, value, n = (table.column(c).to_numpy() for c in ("column", "value", "n0"))
    ranks = []
    for c in range(len(columns)):
        own = n[place == c]
        above = np.cumsum(own) - own
        # about their middle, so that sums stay small
        ranks.append((value[place == c], above + (own + 1) / 2 - (own.sum() + 1) / 2))
    sent, size = spark.sparkContext.broadcast(ranks), len(columns)

    def fold(formed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, size, size))
        for part in formed:
            values, group = taken(part)
            r = np.zeros((int((group == 0).sum()), size))
            known = np.zeros_like(r)
            for c, ((own, there), (of, rank)) in enumerate(zip(values, sent.value, strict=True)):
                known[:, c] = there[group == 0]
                if len(of):
                    r[:, c] = np.where(known[:, c] > 0, rank.take(np.searchsorted(of, own[group == 0]), mode="clip"), 0.0)
            sums += np.stack([known.T @ known, r.T @ known, (r * r).T @ known, r.T @ r])
        yield pa.RecordBatch.from_pydict({"sums": [sums.ravel().tolist()]})

    parts = histories.folded(rows, features, keep, fold, "sums array<double>", start, stop).collect()  # one row a task
    both, one, square, product = np.sum([np.array(p.sums) for p in parts], axis=0).reshape(4, size, size) if parts else np.zeros((4, size, size))
    with np.errstate(invalid="ignore", divide="ignore"):
        matrix = (both * product - one * one.T) / np.sqrt((both * square - one * one) * (both * square - one * one).T)
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    # one row a pair of columns
    return spark.createDataFrame([(columns[i], columns[j], float(matrix[i, j]) if both[i, j] else None) for i, j in pairs], "a string, b string, spearman double")
