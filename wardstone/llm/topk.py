"""Exact top-k inner products by columnar branch and bound.

Candidate vectors lie in blocks in vertical layout: one array per dimension, dimensions in the
order of their mass. A query adds up its product dimension block by dimension block. What the
dimensions not yet seen can still add is bounded by the product of the remaining masses of query
and candidate (Cauchy-Schwarz); a candidate whose upper bound is under the k-th best lower bound
is out, and survivors are compacted before the next dimension block. The bounds are rounded
outwards and the sums are integers, so the result is exact.

The stated queries meet all candidates in blocks: query blocks are copied to every candidate
block, and the k best of each block are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardstone.llm.store import kept

#: Vectors of a candidate block, queries answered at a time, dimensions of a dimension block.
CANDIDATES, QUERIES, STEP = 2048, 256, 8
#: Whole numbers up to this stay exact in double arithmetic.
EXACT = 2.0**53


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as bigint."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    infinity = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinity))


def with_blocks(vectors: DataFrame) -> DataFrame:
    """Vectors (id, v) with their number of dimensions and the number of candidate blocks of that
    dimension. The counts are one row for each number of dimensions."""
    sized = vectors.withColumn("dims", F.size("v"))
    counts = sized.groupBy("dims").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("blocks"))
    return sized.join(F.broadcast(counts), "dims")


def best_of(ids: np.ndarray, columns: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query its k best candidates: (query index, candidate index, score). columns is
    (dimension, candidate), queries (query, dimension), both int64."""
    dims, n = columns.shape
    order = np.argsort(-(columns.astype(np.float64) ** 2).sum(1), kind="stable") if dims else np.zeros(0, np.int64)
    columns, queries = columns[order], queries[:, order]
    # whole numbers in doubles are exact as long as no sum passes 2^53
    largest = float(np.abs(columns).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    kind = np.float64 if largest < EXACT else np.int64
    columns, queries = columns.astype(kind), queries.astype(kind)
    steps = list(range(0, dims, STEP)) or [0]
    tail = lambda x, axis: [np.sqrt((np.moveaxis(x, axis, 0)[s + STEP :].astype(np.float64) ** 2).sum(0)) * (1 + 1e-9) for s in steps]
    rest_c, rest_q = tail(columns, 0), tail(queries, 1)
    out = []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = np.zeros(len(alive), kind)
        for s, at in enumerate(steps):
            part = columns[at : at + STEP] if len(alive) == n else columns[at : at + STEP, alive]
            score = score + queries[q, at : at + STEP] @ part
            if len(alive) <= k:
                continue
            slack = rest_c[s][alive] * rest_q[s][q]
            slack += np.abs(score) * 1e-12 + 1e-6
            bar = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            keep = np.flatnonzero(score + slack >= bar)
            if len(keep) < len(alive):
                alive, score = alive[keep], score[keep]
        score = score.astype(np.int64)
        top = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(top), q), alive[top], score[top]))
    return out


def top_k(vectors: DataFrame, k: int = 5, *, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by `every` its `k`
    highest scoring other vectors, ties to the smaller id.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do null ids;
    a query meets the candidates of its own number of dimensions. Candidates of the query's own id
    are left out, repeated rows of other ids are ranked each. Empty tables give an empty result.
    Components may be so large that a score fits 64 bits."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("raw"))
    rows = kept(rows.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", scaled(F.col("raw")).alias("v")), "vectors")
    sized = with_blocks(rows)
    mixed = F.xxhash64("id")
    there = sized.select("dims", F.pmod(mixed, F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    # a stated query set in blocks: every query goes once to each candidate block of its dimension
    queries = sized.filter(F.col("id") % every == 0)
    sent = queries.select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")
    ready = there.unionByName(sent).repartition(parts, "dims", "block").sortWithinPartitions("dims", "block", "side")

    def matrix(arrays):
        flat = np.concatenate([a.flatten().to_numpy(zero_copy_only=False) for a in arrays]) if arrays else np.zeros(0, np.int64)
        n = sum(len(a) for a in arrays)
        return flat.reshape(n, -1) if n else flat.reshape(0, 0)

    def answer(block, ids, held):
        own, asked = np.concatenate(ids), matrix(held)
        for at in range(0, len(own), QUERIES):
            of, there, score = map(np.concatenate, zip(*best_of(*block, asked[at : at + QUERIES], own[at : at + QUERIES], k), strict=True))
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(own[at + of]), pa.array(block[0][there]), pa.array(score)], names=["query_id", "vec_id", "score"])

    def work(batches):
        # rows come block by block, the candidates of a block before its queries
        key, block, ids, held = None, None, [], []
        for batch in batches:
            dims, blk, sides = (batch.column(n).to_numpy() for n in ("dims", "block", "side"))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (blk[1:] != blk[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
                if a == b:
                    continue
                now = (dims[a], blk[a], sides[a])
                if key is not None and now != key:
                    if key[2] == 0:
                        block = (np.concatenate(ids), np.ascontiguousarray(matrix(held).T))
                    elif block is not None and ids:
                        yield from answer(block, ids, held)
                    block = block if now[:2] == key[:2] else None
                    ids, held = [], []
                key = now
                ids.append(batch.column("id").slice(a, b - a).to_numpy())
                held.append(batch.column("v").slice(a, b - a))
                if key[2] == 1 and sum(map(len, ids)) >= 4 * QUERIES:
                    if block is not None:
                        yield from answer(block, ids, held)
                    ids, held = [], []
        if ids and key[2] == 1 and block is not None:
            yield from answer(block, ids, held)

    found = ready.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
