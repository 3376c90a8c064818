"""Connected components of graphs that only a cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts
from .store import drop, materialize

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """node and root, its component's least node, of every node of ``edges`` (u, v).

    Each round links every node's larger neighbours to its least one, then its
    smaller ones, until every node hangs from its root. Rows are edges, at most
    as many as at the start; none is formed for pairs of neighbours. A hub's
    edges don't meet: its least neighbour is broadcast to them. Rounds are
    written to the shared folder, which cuts the lineage.
    """
    larger = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = materialize(larger(edges), "edges")
    state = _digest(now)
    for _ in range(MOST_ROUNDS):
        size = 2 * state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = larger(_with_least(both, size).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        joined = _with_least(far, size)
        near = joined.where("v = m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = materialize(larger(joined.select("v", F.col("m").alias("u")).unionByName(near)), "edges")
        drop(now)
        now, before, state = after, state, _digest(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _with_least(edges: DataFrame, size: int) -> DataFrame:
    """u, v and m, the least v of each u, of at most ``size`` edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return join_facts(edges, least, "u", "degree", size, F.xxhash64("v"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
