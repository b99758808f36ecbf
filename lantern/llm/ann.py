"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is cut into balanced parts by recursive spectral bisection with swaps across each
cut. A small network learns the parts of a vector's neighbours. It then deals every vector of the table to its most
probable part, and each query to its several most probable parts, whose vectors are reranked by exact distances. How many
parts a query visits is set on the sample, so that TARGET of its neighbours are found; a query that finds fewer than k
candidates there visits all parts. There are as many parts as rows call for, up to 2,048, as each takes 32 vectors of a sample
of 65,536 at most; in a still larger table parts grow and are searched in blocks.

Equal vectors are one class with its k + 1 smallest ids, as no result needs more of them. Parts are split into blocks
of bounded size on both sides, so no task holds a whole part and no join multiplies rows beyond (query, part, block).

Defined results: vectors that are null, zero, of another length than most (the shorter, if two are as common), or hold a null
or non-finite component take no part, nor do rows without an id; rows that repeat id and vector are one candidate; of rows
that share an id, but not the vector, the nearest counts, on the side of queries as well; a query's own id is never its
neighbour; ties go to the smaller id; with fewer than k candidates all are returned; empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

K = 10
#: Distinct vectors that the parts and the network are fitted on: at least FIT_ROWS, if there are so many, more where the rows
#: call for more parts, and MOST_FIT at most.
FIT_ROWS, MOST_FIT = 8192, 65_536
#: Vectors of the sample on which the number of visits is set, at most.
TESTED = 4096
#: Vectors of a part, about.
PART_ROWS = 2048
#: Rows of the sample that a part has at least.
SAMPLE_PART = 32
#: Share of the sample's true neighbours that its visits must find.
TARGET = 0.95
#: Vectors of a block on either side of a comparison.
BLOCK = 8192


# --- fitting ----------------------------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norm = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    step = max(64, (1 << 23) // len(x))
    for a in range(0, len(x), step):
        d = norm - 2 * x[a : a + step] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(u: np.ndarray, v: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Halves of equal size of a graph with edges u-v (both directions given), by the second eigenvector and swaps."""
    degree = np.bincount(u, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(80):
        x -= (x * degree).sum() / degree.sum()
        x = 0.5 * x + 0.5 * (np.bincount(u, x[v], n) + x) / degree
        x /= np.linalg.norm(x) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = np.bincount(u, side[u] != side[v], n)
        gain = 2 * across - np.bincount(u, minlength=n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two))
        good = int(np.count_nonzero(gain[one[:m]] + gain[two[:m]] > 2))
        if not good:
            break
        swap = max(1, good // 4)
        before = across.sum()
        side[one[:swap]], side[two[:swap]] = False, True
        if np.count_nonzero(side[u] != side[v]) >= before:
            side[one[:swap]], side[two[:swap]] = True, False
            break
    return side


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node, a power of two of them, whose sizes differ by rounding only."""
    n, k = graph.shape
    u, v = np.repeat(np.arange(n), k), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        fresh = label * 2
        for p in range(int(label.max()) + 1):
            own = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inner = (place[u] >= 0) & (place[v] >= 0)
            fresh[own] += _bisect(place[u[inner]], place[v[inner]], len(own), rng)
        label = fresh
    return label


class Router:
    """A network of one hidden layer that gives the probability of each part."""

    def __init__(self, width: int, parts: int, rng: np.random.Generator, hidden: int = 64):
        self.shapes = [(width, hidden), (hidden,), (hidden, parts), (parts,)]
        self.w = [rng.standard_normal(s) * (1 / np.sqrt(s[0])) if len(s) == 2 else np.zeros(s) for s in self.shapes]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, rounds: int = 25, batch: int = 256) -> None:
        """target: the probabilities to learn of some rows of x."""
        m, s, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                own = order[a : a + batch]
                h = np.maximum(x[own] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = (z / z.sum(axis=1, keepdims=True) - target(own)) / len(own)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate([x[own].T @ back, back.sum(0), h.T @ d, d.sum(0)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] -= 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)


class Parts:
    """The fitted router, the scaling of its input and the number of parts that a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, k: int = K, seed: int = 7, part_rows: int = PART_ROWS, target: float = TARGET):
        rng = np.random.default_rng(seed)
        want = max(1, min(rows // part_rows, len(sample) // SAMPLE_PART))
        self.count = 1 << (want.bit_length() - 1)
        self.visits = 1
        if self.count == 1:
            return
        self.mean, self.scale = sample.mean(0), sample.std() + 1e-12
        x = (sample - self.mean) / self.scale
        graph = neighbour_graph(sample, k)
        label = balanced_parts(graph, self.count, rng)
        held = rng.permutation(len(x))
        many = min(len(x) // 4, TESTED)
        test, train = held[:many], held[many:]

        def shares(rows: np.ndarray) -> np.ndarray:
            """Of a vector's own part one half, and the other of those of its neighbours."""
            own, out = train[rows], np.zeros((len(rows), self.count))
            np.add.at(out, (np.repeat(np.arange(len(own)), graph.shape[1]), label[graph[own]].ravel()), 0.5 / graph.shape[1])
            out[np.arange(len(own)), label[own]] += 0.5
            return out

        self.net = Router(sample.shape[1], self.count, rng)
        self.net.fit(x[train], shares, rng)
        home = self.homes(sample)
        order = np.argsort(-self.net.probabilities(x[test]), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.count)[None, :].repeat(len(test), 0), 1)
        found = np.take_along_axis(rank, home[graph[test]], 1)
        share = [(found < m).mean() for m in range(1, self.count + 1)]
        self.visits = next(m for m in range(1, self.count + 1) if share[m - 1] >= target)

    def homes(self, x: np.ndarray) -> np.ndarray:
        if self.count == 1:
            return np.zeros(len(x), np.int64)
        parts = [self.net.probabilities((x[a : a + 2048] - self.mean) / self.scale).argmax(1) for a in range(0, len(x), 2048)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def routes(self, x: np.ndarray) -> np.ndarray:
        if self.count == 1:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.net.probabilities((x - self.mean) / self.scale), axis=1, kind="stable")[:, : self.visits]


# --- reranking --------------------------------------------------------------------------------------------------


def rerank(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest ids of each query among classes of equal vectors, own ids left out."""
    count = np.array([len(x) for x in ids])
    begin, flat = np.cumsum(count) - count, np.concatenate(ids)
    norm = (vectors * vectors).sum(1)
    out = []
    for a in range(0, len(queries), 512):
        q = queries[a : a + 512]
        d = norm + (q * q).sum(1)[:, None] - 2 * q @ vectors.T
        if len(vectors) > k + 1:
            # one class may be the query's own; near ties of the last are kept until exact distances decide
            edge = np.partition(d, k, axis=1)[:, k]
            row, col = np.nonzero(d <= edge[:, None] + 1e-6 * (1 + np.abs(edge[:, None])))
        else:
            row, col = (x.ravel() for x in np.indices(d.shape))
        gap = q[row] - vectors[col]
        exact = np.sqrt((gap * gap).sum(1))
        n = count[col]
        each = np.repeat(begin[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, exact, name = np.repeat(row, n) + a, np.repeat(exact, n), flat[each]
        other = name != own[row]
        row, exact, name = row[other], exact[other], name[other]
        order = np.lexsort((name, exact, row))
        row, exact, name = row[order], exact[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((row[rank < k], name[rank < k], exact[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query."""
    spark = rows.sparkSession
    prepare(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).filter(v.isNotNull() & F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))

    base = usable(rows)
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["n"]
    base, asked = base.filter(F.size("v") == width), usable(queries).filter(F.size("v") == width)

    # repeated rows go before the ranking, which keeps the smallest ids in each task and then of each vector
    smallest = Window.partitionBy("v").orderBy("id")
    kept = base.distinct().withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    classes = saved(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    total = classes.count()
    wanted = min(MOST_FIT, max(fit_rows, SAMPLE_PART * (total // part_rows)))
    sample = np.array([r.v for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()])
    parts = Parts(sample, total, k, part_rows=part_rows, target=target)
    sent = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.homes(_matrix(v)).astype(np.int32))

    @F.pandas_udf("array<int>")
    def routes(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.routes(_matrix(v)).astype(np.int32)), dtype=object)

    index = saved(classes.select("v", "ids", home("v").alias("part")), "index")

    def sizes(df: DataFrame) -> dict[int, int]:
        return {r.part: -(-r["count"] // block) for r in df.groupBy("part").count().collect()}

    def compare(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = asked["id"].to_numpy()
        row, name, score = rerank(_matrix(asked["v"]), own, _matrix(vectors["v"]), [np.asarray(x) for x in vectors["ids"]], k)
        return pd.DataFrame({"query_id": own[row], "vec_id": name, "score": score})

    blocks_of = sizes(index)

    def nearest(routed: DataFrame) -> DataFrame:
        """query_id, vec_id, score, rank of the k nearest in the parts that queries (id, v, part) are dealt to."""
        queries_of = sizes(routed)
        # a row a part, of which there are 2,048 at most
        sizes_of = spark.createDataFrame([(p, blocks_of.get(p, 1), queries_of.get(p, 1)) for p in range(parts.count)], "part int, n_c int, n_q int")
        sized = lambda df: df.join(F.broadcast(sizes_of), "part")
        # vectors go to one of their part's blocks and meet every block of its queries, and the other way round
        left = sized(index).select("v", "ids", "part", F.pmod(F.xxhash64("v"), F.col("n_c")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("q"))
        right = sized(routed).select("id", "v", "part", F.pmod(F.xxhash64("id"), F.col("n_q")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("c"))
        found = left.groupBy("part", "c", "q").cogroup(right.groupBy("part", "c", "q")).applyInPandas(compare, "query_id long, vec_id long, score double")
        return best(found)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    routed = saved(asked.distinct().select("id", "v", F.explode(routes("v")).alias("part")), "routed")
    if routed.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = nearest(routed)
    if parts.visits == parts.count:
        return found
    found = saved(found, "nearest")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = saved(asked.distinct().join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts.count - 1))))
    return best(found.unionByName(nearest(everywhere)).drop("rank"))
