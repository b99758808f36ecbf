"""Hard negatives by a pivot table.

Vectors become integers, and scores are inner products. One more component, sqrt(M^2 - |x|^2) with M the largest norm, makes all
rows equally long, and an anchor's is 0: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so that the highest inner product is the
smallest distance. The pivot table stores the distances of each row to a few pivots. By the triangle inequality, an
anchor's distances to the same pivots bracket its distance to the row, hence the score:

    max |d(q, p) - d(x, p)|  <=  d(q, x)  <=  min d(q, p) + d(x, p)

Rows whose bracket lies beyond what an anchor still looks for are out; scores of the others are taken exactly. Rows are stored
by their nearest pivot and their distance to it, so that a batch of rows has a bracket as well and may be out as a whole.

Anchors travel to the tasks in groups of ANCHORS at most; each task passes over its rows once for the positives and once for
the negatives of the group, and keeps what an anchor needs of them. An anchor's first positives within the pivots' sample
bound from below what it looks for.

Defined results: rows without an id, a label or a vector, with a null or non-finite component, with a component beyond 2^22
after scaling (a hundred times a score then fits into a long), without components, or of another length than most (the shorter, if two are as common), take no
part; zero vectors do. Of rows that share an id the one with the smallest label, then vector, counts. Equal vectors of
different ids are different rows; ties go to the smaller id. An anchor with no other row of its label, and a positive with a
negative score or without a row in its range, give no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, prepare, saved

SCALE = 256
#: Largest component after scaling.
LIMIT = 1 << 22
#: Pivots, and distinct vectors that they are chosen from.
PIVOTS, SAMPLE = 12, 4096
#: Anchors that travel to the tasks at once.
ANCHORS = 8192
#: Rows and anchors that are compared at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 512
_NONE = np.iinfo(np.int64).min


# --- geometry ---------------------------------------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Pivots:
    """Pivots among some vectors, each as far as possible from those before it."""

    def __init__(self, sample: np.ndarray, longest: int, count: int = PIVOTS):
        self.longest = longest
        chosen, away = [0], self._between(sample, sample[:1])[:, 0]
        while len(chosen) < min(count, len(sample)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, self._between(sample, sample[chosen[-1:]])[:, 0])
        self.points = sample[chosen]
        self.extra = self._extra(self.points)

    def _extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.longest - (x.astype(np.float64) ** 2).sum(1)))

    def _between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._distances(x.astype(np.float64), self._extra(x), y.astype(np.float64), self._extra(y))

    @staticmethod
    def _distances(x: np.ndarray, x_extra: np.ndarray, y: np.ndarray, y_extra: np.ndarray) -> np.ndarray:
        square = ((x * x).sum(1) + x_extra**2)[:, None] + (y * y).sum(1) + y_extra**2 - 2 * (x @ y.T + np.outer(x_extra, y_extra))
        return np.sqrt(np.maximum(square, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(x.astype(np.float64), self._extra(x), self.points.astype(np.float64), self.extra)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(q.astype(np.float64), np.zeros(len(q)), self.points.astype(np.float64), self.extra)

    def slack(self, norm: np.ndarray) -> np.ndarray:
        """By how much rounding may shift a bracket's ends, in scores: distances are roots of sums of this size."""
        return 1e-6 * (norm + self.longest) + 1

    def highest(self, norm: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The highest score of a row at that distance at least from an anchor of that squared norm."""
        return (norm + self.longest - least**2) / 2 + self.slack(norm)

    def lowest(self, norm: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (norm + self.longest - most**2) / 2 - self.slack(norm)


# --- searching --------------------------------------------------------------------------------------------------


class First:
    """Of each of some searches the k rows of the highest scores, ties by the smaller id."""

    def __init__(self, searches: int, k: int, edge: np.ndarray | None = None):
        self.k = k
        #: no row of a smaller score is among the first
        self.edge = np.full(searches, _NONE) if edge is None else edge.copy()
        self.held = [np.zeros(0, np.int64)] * 3
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, search: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        good = score >= self.edge[search]
        self.waiting.append((search[good], score[good], key[good]))
        self.size += int(good.sum())
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, score, id), in order."""
        search, score, key = (np.concatenate([h, *[w[i] for w in self.waiting]]) for i, h in enumerate(self.held))
        order = np.lexsort((key, -score, search))
        search, score, key = search[order], score[order], key[order]
        rank = np.arange(len(search)) - np.searchsorted(search, search)
        last = rank == self.k - 1
        self.edge[search[last]] = np.maximum(self.edge[search[last]], score[last])
        own = rank < self.k
        self.held, self.waiting, self.size = [search[own], score[own], key[own]], [], 0
        return tuple(self.held)


class Group:
    """Some anchors: ids, labels, vectors, squared norms and distances to the pivots."""

    def __init__(self, pivots: Pivots, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.pivots, self.ids, self.labels, self.vectors = pivots, ids, labels, vectors
        self.norm = (vectors.astype(np.float64) ** 2).sum(1)
        self.away = pivots.of_anchors(vectors)

    def survivors(self, own: np.ndarray, rows: Rows, least: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) by blocks of the anchors in `own`, of the pairs whose brackets reach from `least` to `most`
        (each by anchor)."""
        # the whole batch lies between these distances to each pivot
        low, high = rows.away.min(0), rows.away.max(0)
        gap = np.maximum(np.maximum(self.away[own] - high, low - self.away[own]), 0).max(1)
        own = own[self.pivots.highest(self.norm[own], gap) >= least[own]]
        if most is not None:
            reach = (self.away[own] + high).min(1)
            own = own[self.pivots.lowest(self.norm[own], reach) <= most[own]]
        for a in range(0, len(own), ANCHORS_AT_ONCE):
            part = own[a : a + ANCHORS_AT_ONCE]
            gap = np.zeros((len(part), len(rows.ids)))
            reach = np.full_like(gap, np.inf) if most is not None else None
            for p in range(rows.away.shape[1]):
                q, x = self.away[part, p][:, None], rows.away[:, p]
                np.maximum(gap, np.abs(q - x), out=gap)
                if reach is not None:
                    np.minimum(reach, q + x, out=reach)
            norm = self.norm[part][:, None]
            open_ = self.pivots.highest(norm, gap) >= least[part][:, None]
            if reach is not None:
                open_ &= self.pivots.lowest(norm, reach) <= most[part][:, None]
            if not open_.any():
                continue
            q, x = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            yield part[q], x, np.where(open_[np.ix_(q, x)], products(self.vectors[part[q]], rows.vectors[x]), _NONE)


class Rows:
    """A batch of the pivot table."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.ids, self.labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        self.vectors, self.away = (batch.column(i).flatten().to_numpy().reshape(n, -1) for i in (2, 3))


def _keep(first: First, search: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Add the rows (scores: by search and row, _NONE: not eligible) that may be among the first k."""
    if scores.shape[1] > first.k:
        edge = np.maximum(first.edge[search], np.partition(scores, -first.k, axis=1)[:, -first.k])
    else:
        edge = first.edge[search]
    q, x = np.nonzero((scores >= edge[:, None]) & (scores != _NONE))
    first.add(search[q], scores[q, x], ids[x])


def find_positives(group: Group, batches: Iterator[Rows], k: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = First(len(group.ids), k, edge)
    for rows in batches:
        everyone = np.flatnonzero(np.isin(group.labels, rows.labels))
        for own, x, scores in group.survivors(everyone, rows, first.edge, None):
            same = (group.labels[own][:, None] == rows.labels[x]) & (group.ids[own][:, None] != rows.ids[x])
            _keep(first, own, np.where(same, scores, _NONE), rows.ids[x])
    return first.settle()


def find_negatives(group: Group, batches: Iterator[Rows], k: int, positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """positive: by anchor the scores of its positives, _NONE where it has fewer. A search is anchor * width + place."""
    width = positive.shape[1]
    # low * p <= 100 * n <= high * p in whole numbers; without a positive score that holds of no n
    some = positive > 0
    zero = positive == 0
    bottom = np.where(some, -(-(low * np.where(some, positive, 0)) // 100), 0)
    top = np.where(some, high * np.where(some, positive, 0) // 100, np.where(zero, 0, _NONE))
    open_ = top >= bottom
    least = np.where(open_, bottom, np.iinfo(np.int64).max)
    first = First(positive.size, k, least.ravel())
    everyone, most = np.flatnonzero(open_.any(1)), top.max(1)
    for rows in batches:
        edge = first.edge.reshape(-1, width).min(1)
        for own, x, scores in group.survivors(everyone, rows, edge, most):
            scores = np.where(group.labels[own][:, None] != rows.labels[x], scores, _NONE)
            for j in range(width):
                with_j = open_[own, j]
                fit = (scores[with_j] <= top[own[with_j], j][:, None]) & (scores[with_j] >= bottom[own[with_j], j][:, None])
                _keep(first, own[with_j] * width + j, np.where(fit, scores[with_j], _NONE), rows.ids[x])
    return first.settle()


# --- Spark ------------------------------------------------------------------------------------------------------


def usable_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, v (integers): the rows that take part, one an id."""
    v = F.col("v")
    raw = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale)) <= LIMIT))
    whole = raw.filter(F.coalesce(sound, F.lit(False))).select("id", "label", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    lengths = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is not None:
        whole = whole.filter(F.size("v") == lengths["n"])
    return whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def pivot_table(whole: DataFrame, pivots: Pivots) -> DataFrame:
    """id, label, v, away (distances to the pivots), by the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = pivots.of_rows(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1))
            near = away.argmin(1)
            columns = [*batch.columns, list_array(pa.array(away.ravel()), np.arange(len(away) + 1) * away.shape[1]), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(away)), near])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "away", "near", "gap"])

    table = whole.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<long>, away array<double>, near int, gap double")
    return saved(table.repartitionByRange("near", "gap", "id").sortWithinPartitions("near", "gap", "id").drop("near", "gap"), "pivots")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield Rows(batch.slice(a, ROWS_AT_ONCE))


def hard_negatives(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor (an id in `anchors`) has as positives its first other rows of the same label, and for each of them as hard
    negatives the first rows of other labels whose scores are from `low` to `high` percent of the positive's."""
    spark = rows.sparkSession
    prepare(spark)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = saved(usable_rows(rows, id_col, vector_col, label_col, scale), "whole")
    longest = whole.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0]
    if longest is None:
        return spark.createDataFrame([], kind)
    drawn = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = Rows(pa.RecordBatch.from_arrays([*[drawn.column(i).combine_chunks() for i in (0, 1, 2)], drawn.column(2).combine_chunks()], ["id", "label", "v", "away"]))
    pivots = Pivots(np.unique(sample.vectors, axis=0), longest)
    sample.away = pivots.of_rows(sample.vectors)
    table = pivot_table(whole, pivots)
    asked = saved(table.select("id", "label", "v").join(anchors.select(anchors[id_col].cast("long").alias("id")).distinct(), "id", "left_semi"), "anchors")
    groups = max(1, -(-asked.count() // at_once))
    out = None
    for g in range(groups):
        own = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        got = own.orderBy("id").toArrow()
        if not got.num_rows:
            continue
        ids, labels = (got.column(i).to_numpy() for i in (0, 1))
        group = Group(pivots, ids, labels, got.column(2).combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        search = find_positives(group, iter([sample]), positives, np.full(len(ids), _NONE))
        edge = np.full(len(ids), _NONE)
        place = np.arange(len(search[0])) - np.searchsorted(search[0], search[0])
        edge[search[0][place == positives - 1]] = search[1][place == positives - 1]
        sent = spark.sparkContext.broadcast((group, edge))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            group, edge = sent.value
            found = find_positives(group, _rows_of(batches), positives, edge)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["anchor", "score", "id"])

        best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        ranked = table.mapInArrow(nearest, "anchor long, score long, id long").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
        chosen = ranked.toArrow()  # `positives` rows for each of the group's anchors at most
        scores, names = (np.full((len(ids), positives), fill) for fill in (_NONE, 0))
        anchor, place = chosen.column("anchor").to_numpy(), chosen.column("place").to_numpy() - 1
        scores[anchor, place], names[anchor, place] = chosen.column("score").to_numpy(), chosen.column("id").to_numpy()
        bands = spark.sparkContext.broadcast((group, scores, names))

        def hardest(batches: Iterator[pa.RecordBatch], bands=bands) -> Iterator[pa.RecordBatch]:
            group, scores, names = bands.value
            search, score, key = find_negatives(group, _rows_of(batches), negatives, scores, low, high)
            at, j = search // scores.shape[1], search % scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group.ids[at], names[at, j], key, scores[at, j], score)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        own_best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        hard = table.mapInArrow(hardest, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        hard = hard.withColumn("rank", F.row_number().over(own_best)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        hard = hard if groups == 1 else saved(hard, "negatives")
        out = hard if out is None else out.unionByName(hard)
    return spark.createDataFrame([], kind) if out is None else out
