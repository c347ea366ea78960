"""Connected components of a graph given as edges, in rounds of star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardstone.llm.store import kept_rows, let_go

#: Parts into which the neighbours of a node are cut when its minimum comes back to them.
SALTS = 16


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked with) for the nodes of some edges, without the roots."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        # the labels' own trees are hooked too, so that rounds grow with the logarithm of a path
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def contract(edges: DataFrame) -> DataFrame:
    """Within each task's edges, as they lie: link every node with the task's smallest node of its
    component, so at most one edge for each node stays."""

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 500_000:
                held = [local_roots(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > 250_000:  # they don't shrink: pass them on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held = []
                size = len(held[0][0]) if held else 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_roots(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a and b, bigint) but the roots; the root is
    the smallest node of the component. Self-loops and repeated edges do no harm.

    Each round links the larger neighbours of every node, then the smaller ones, to its smallest
    neighbour (large-star and small-star); stars are the fixed point. A round groups by minima and
    joins them back to salted neighbours, so a node with very many of them is never gathered in
    one place."""
    now = kept_rows(contract(edges.filter("a <> b")).distinct())
    state = None
    while True:
        new_state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new_state == state or not new_state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new_state
        let_go(now.sparkSession)
        # said here, so that no use of a frame filters it in its own way and Spark shuffles it once
        now = now.filter("a IS NOT NULL AND b IS NOT NULL")
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        larger = both.filter("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = larger.join(least, ["u", "salt"]).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = kept_rows(small.union(lower.select("a", "m")).distinct())
