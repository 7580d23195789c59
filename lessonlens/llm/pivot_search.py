"""Exact top-k search by inner product with a pivot table.

Vectors of components floor(256 x) get one more component that makes all lengths equal; then the largest inner products
are the smallest distances, and the triangle inequality holds. Every vector's distances to a set of pivots are computed
once. For a query, the greatest difference between its own and a vector's distances to the pivots is a lower bound of
their distance. Candidates are evaluated in the order of that bound, until the bound shows that no candidate left can
reach the k-th best score; scores are exact integers.

Queries and vectors are cut into blocks; every task joins one block of each, and the best of all blocks are ranked per
query. Pivots are picked farthest-first from a fixed number of rows with the least hashes; they change the work, never
the result.

Defined cases: null vectors, vectors with null or non-finite components, and rows without an id take no part; rows that
repeat an id count once, with the least vector; vectors of different lengths never meet; ties go to the smaller id; a
query with fewer than k candidates gives them all; a score among the best that does not fit 64 bits is an error that names the
vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lessonlens.session import cut_lineage

HITS = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Search:
    k: int = 5
    every: int = 50
    scale: int = 256
    pivots: int = 32
    pivot_sample: int = 1024
    query_block: int = 2048
    vector_block: int = 4096
    step: int = 128


def integer_vectors(rows: DataFrame, search: Search) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector as doubles, which hold the integers exactly."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * search.scale).cast("double"))
    return rows.where("vec_id is not null and embedding is not null").where(usable).select("vec_id", v.alias("v")) \
        .groupBy("vec_id").agg(F.min("v").alias("v"))


def farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each as far as can be from those before."""
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that brings their squared length to ``top``."""
    rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", v, v), 0.0))
    return np.hstack([v, rest[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles where they are exact, Python integers else."""
    if len(rows) and rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) < 2.0**53:
        return (rows @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows], dtype=object)


def search_block(ids: np.ndarray, v: np.ndarray, near: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_near: np.ndarray,
                 top: float, search: Search) -> Iterator[tuple[int, int, int]]:
    """The k best of a block of vectors for each query; ``near`` and ``q_near`` are distances to the pivots."""
    for i in range(len(q_ids)):
        bound = np.abs(near - q_near[i]).max(axis=1)
        ceiling = (q[i] @ q[i] + top - bound**2) / 2
        slack = 1e-6 * (abs(q[i] @ q[i]) + top) + 1
        order = np.argsort(bound, kind="stable")
        best: list[tuple[int, int]] = []
        at, step = 0, search.step
        while at < len(order):
            if len(best) == search.k and ceiling[order[at]] + slack < -best[-1][0]:
                break
            part = order[at:at + step]
            part = part[ids[part] != q_ids[i]]
            scores = exact_products(v[part], q[i])
            keep = np.lexsort((ids[part], -scores))[:search.k] if scores.dtype != object else range(len(part))
            best = sorted(best + [(-int(scores[j]), int(ids[part[j]])) for j in keep])[:search.k]
            at, step = at + step, step * 2
        for score, vec_id in best:
            if not -2**63 < score <= 2**63:
                raise ValueError(f"the score of vectors {int(q_ids[i])} and {vec_id} does not fit 64 bits")
            yield int(q_ids[i]), vec_id, -score


def top_k(rows: DataFrame, search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = cut_lineage(integer_vectors(rows, search).withColumn("dim", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.groupBy("dim").agg(F.max(square).alias("top"), F.count("*").alias("n"),
                                       F.count(F.when(F.col("vec_id") % search.every == 0, 1)).alias("q")).collect()
    parts = []
    for fact in facts:  # one for each length of vectors
        own = vectors.where(F.col("dim") == fact["dim"]).drop("dim")
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(search.pivot_sample).toPandas()
        top = float(fact["top"])
        parts.append(_hits(own, farthest(lifted(np.array(sample["v"].tolist(), float).reshape(len(sample), -1), top), search.pivots),
                           top, -(-fact["n"] // search.vector_block), max(1, -(-fact["q"] // search.query_block)), search))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionAll(more)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def _hits(own: DataFrame, pivots: np.ndarray, top: float, v_blocks: int, q_blocks: int, search: Search) -> DataFrame:
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            v = np.asarray(batch.column(1).flatten()).reshape(len(ids), -1)
            query = ids % search.every == 0
            # a query's additional component is 0, a candidate's brings it to the common length
            for wanted, points in ((False, lifted(v, top)), (True, np.hstack([v, np.zeros((len(v), 1))]))):
                use = query if wanted else np.ones(len(ids), bool)
                if use.any():
                    near = distances(points[use], pivots)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(use.sum(), wanted)), pa.array(ids[use]),
                         pa.array([r.tobytes() for r in v[use]], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary())],
                        names=["query", "vec_id", "v", "near"])

    pivoted = own.mapInArrow(table, "query boolean, vec_id long, v binary, near binary")
    home = F.when(F.col("query"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))).otherwise(F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)))
    others = F.when(F.col("query"), v_blocks).otherwise(q_blocks)
    met = pivoted.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    met = met.withColumn("q_block", F.when(F.col("query"), F.col("home")).otherwise(F.col("other")))
    met = met.withColumn("v_block", F.when(F.col("query"), F.col("other")).otherwise(F.col("home"))).drop("home", "other")

    def run(group: pa.Table) -> pa.Table:
        query = np.asarray(group["query"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids = np.asarray(group["vec_id"])
        v, near = (np.frombuffer(b"".join(group[c].to_pylist()), float).reshape(len(ids), -1) for c in ("v", "near"))
        found = list(search_block(ids[~query], v[~query], near[~query], ids[query], v[query], near[query], top, search))
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return met.groupBy("q_block", "v_block").applyInArrow(run, HITS)
