"""Exact nearest neighbours for a batch of queries, and the vector leg of the hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.keyword import ranked
from lantern.operators.topk import Best

#: Queries and rows that are compared at once, and blocks of queries that travel to the tasks together, so that the rows are
#: read once for all of them.
QUERY_BLOCK, ROWS_AT_ONCE, SCAN_BLOCKS = 2048, 2048, 16
#: Neighbours (queries x k) that a task keeps at once; more queries than that take more scans of the rows.
KEPT = 1 << 19


def _finite(part: pa.Array) -> np.ndarray:
    """Which lists of doubles are whole: neither null nor with a null or non-finite part."""
    size = part.value_lengths().fill_null(-1).to_numpy()
    values = pc.is_finite(part.flatten()).fill_null(False).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~values))
    end = np.cumsum(np.maximum(size, 0))
    return (size > 0) & (bad[end] == bad[end - np.maximum(size, 0)])


def knn(queries: DataFrame, rows: DataFrame, k: int, key: str = "path", vector: str = "embedding") -> DataFrame:
    """query_id, path, score (Euclidean distance), rank. queries: query_id, embedding.

    Each task compares its rows with blocks of queries by matrix products and keeps, over all of its rows, the k nearest of
    each query by exact distances; a window over what the tasks kept decides. A query meets the vectors of its own length;
    vectors that are null or hold a null or non-finite component take no part on either side."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    id_kind = queries.schema["query_id"].dataType.simpleString()
    scans = max(1, -(-queries.count() // max(1, min(QUERY_BLOCK * SCAN_BLOCKS, KEPT // k))))
    out = None
    for scan in range(scans):
        own = queries if scans == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == scan)
        sized: dict[int, list] = {}
        for r in own.select("query_id", F.col(vector).cast("array<double>").alias("v")).collect():
            if r.v and all(x is not None and np.isfinite(x) for x in r.v):
                sized.setdefault(len(r.v), []).append(r)
        parts = [same[a : a + QUERY_BLOCK] for same in sized.values() for a in range(0, len(same), QUERY_BLOCK)]
        sent = spark.sparkContext.broadcast([([r.query_id for r in p], np.array([r.v for r in p], np.float64)) for p in parts])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = [(ids, q, Best(len(ids), k, highest=False)) for ids, q in sent.value]
            for batch in batches if blocks else ():
                for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                    keys, v = batch.column(0).slice(a, ROWS_AT_ONCE), batch.column(1).slice(a, ROWS_AT_ONCE)
                    whole, size = _finite(v), v.value_lengths().fill_null(-1).to_numpy()
                    for d in {q.shape[1] for _, q, _ in blocks}:
                        own = pa.array(np.flatnonzero(whole & (size == d)))
                        if not len(own):
                            continue
                        x, names = v.take(own).flatten().to_numpy().reshape(-1, d), keys.take(own)
                        for _, q, best in blocks:
                            if q.shape[1] == d:
                                square = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
                                best.add(np.sqrt(np.maximum(square, 0)), names, exact=lambda i, j, q=q, x=x: np.sqrt(((q[i] - x[j]) ** 2).sum(1)), slack=1e-7 * (1 + np.sqrt(np.abs(square).max())))
            for ids, _, best in blocks:
                if found := best.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(found[0])), found[2], pa.array(found[1])], ["query_id", "path", "score"])

        near = rows.select(F.col(key).alias("path"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInArrow(run, f"query_id {id_kind}, path {kind}, score double")
        out = near if out is None else out.unionByName(near)
    return ranked(out, k, ascending=True)


def best_of(distances: DataFrame, owner: str = "path") -> DataFrame:
    """query_id, path, score: the smallest distance of a path's sections."""
    return distances.groupBy("query_id", owner).agg(F.min("score").alias("score"))


def near(queries: DataFrame, doc_vectors: DataFrame, sections: DataFrame, limit: int, section_pool: int) -> tuple[DataFrame, DataFrame]:
    """The nearest documents and the nearest sections (path: struct of path and section). sections: path, section, embedding."""
    return knn(queries, doc_vectors, limit), knn(queries, sections.select(F.struct("path", "section").alias("id"), "embedding"), section_pool, key="id")


def leg_of(near_docs: DataFrame, near_sections: DataFrame, long_paths: DataFrame, limit: int, section_pool: int) -> DataFrame:
    """query_id, path, score, rank.

    Documents come from their own vectors, cut to `limit` before documents with sections are taken out; those are judged by
    their nearest section among the `section_pool` nearest."""
    docs = near_docs.filter(F.col("rank") <= limit).join(long_paths, "path", "left_anti").select("query_id", "path", "score")
    sections = near_sections.filter(F.col("rank") <= section_pool).select("query_id", F.col("path.path").alias("path"), "score")
    return ranked(best_of(docs.unionByName(sections)), limit, ascending=True)


def vector_leg(queries: DataFrame, doc_vectors: DataFrame, sections: DataFrame, limit: int = 50, section_pool: int = 400) -> DataFrame:
    return leg_of(*near(queries, doc_vectors, sections, limit, section_pool), sections.select("path").distinct(), limit, section_pool)


def fuse(legs: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion: query_id, path, score, rank. legs: (query_id, path, rank) with their weights.

    Ties keep the order of the first leg, then of the next."""
    parts = [leg.select("query_id", "path", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part"), *[(F.col("rank") if i == j else F.lit(None).cast("int")).alias(f"rank{i}") for i in range(len(legs))]) for j, (leg, w) in enumerate(legs)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = both.groupBy("query_id", "path").agg(F.sum("part").alias("score"), *[F.min(f"rank{i}").alias(f"rank{i}") for i in range(len(legs))])
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), *[F.asc_nulls_last(f"rank{i}") for i in range(len(legs))])
    return sums.withColumn("rank", F.row_number().over(order)).select("query_id", "path", "score", "rank")
