"""Connected components of a large graph by alternating large-star and small-star steps.

Partitions first contract their edges to spanning forests. Every step is a min-aggregate (combined before its shuffle)
and one join, and writes its edges to the shared folder. Once a checked number of edges is left (ONE_TASK, some 32 MB),
one task contracts them at once. Node ids are longs; a component's root is its smallest node.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import outlives, scratch, written


#: Edges that one task contracts.
ONE_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node that it reaches) for every node but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches, chunk: int = 1 << 18):
    held, size = [], 0

    def out():
        u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        size += b.num_rows
        if size >= chunk:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """node, root for every node that has an edge to another one (roots too). A written table.

    Loops, repeated and reversed edges are allowed; edges with a null end are left out.
    """
    with scratch(edges.sparkSession):
        e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
        e = written(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
        state = None
        while True:
            if e.count() <= one_task:
                e = e.coalesce(1).mapInArrow(partial(_contract, chunk=one_task + 1), "u long, v long")
                break
            new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if new == state:
                break
            state = new
            e = written(_small(written(_large(e), "edges")), "edges")
        star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return outlives(star.unionAll(star.select(F.col("root").alias("node"), "root").distinct()), "components")
