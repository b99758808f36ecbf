import math
import random

import numpy as np

from lantern.llm import ann


def brute(rows, queries, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = set()
    for q, u in queries:
        if (q, u) not in ok:
            continue
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = min(best.get(i, math.inf), *(math.dist(w, v) for j, w in queries if j == q))
        out |= {(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])}
    return out


def rows():
    r = random.Random(4)
    out = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(8)]) for i in range(150)]
    out += [(200 + i, out[7][1]) for i in range(40)] + [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [None]), (303, [math.nan] + [1.0] * 7), (304, [math.inf] + [1.0] * 7), (305, [1.0, 2.0]), (None, out[3][1]), out[5], (100, out[7][1]), (400, out[7][1]), (500, [])]
    return out


def test_exact_with_one_part(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int").repartition(3)
    q = df.filter("vec_id % 100 = 0")
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(df, q).collect()}
    want = brute(data, [x for x in data if x[0] is not None and x[0] % 100 == 0 and x[1]], 10)
    assert got == want  # id 100 stands for two vectors
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(df.limit(0), q).count() == 0 and ann.search(df, q.limit(0)).count() == 0


def test_recall_with_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 6000)] + 0.5 * rng.standard_normal((6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 100 = 0"), fit_rows=2000, part_rows=500, block=300, target=0.95).collect()
    y, hit = x.astype(float), 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(6000), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-9 for _, i, s in mine)
        hit += len(set(want) & {i for _, i, _ in mine})
    assert hit >= 0.9 * 600


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 8))
    size = np.bincount(ann.balanced_parts(ann.neighbour_graph(x, 10), 8, rng))
    assert len(size) == 8 and size.max() - size.min() <= 3


def test_short_queries_visit_all_parts(spark):
    """A crowd of copies of one vector under one id fills parts with a single candidate."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((8, 4)) + 9, rng.standard_normal((1200, 4)) - 9])
    rows = [(i if i < 8 else 8 + i % 4, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id = 0"), fit_rows=600, part_rows=100, target=0.5).orderBy("rank").collect()
    best = {i: min(math.dist(x[0], v) for j, v in rows if j == i) for i in range(1, 12)}
    assert [(r.rank, r.vec_id) for r in got] == [(n + 1, i) for n, i in enumerate(sorted(best, key=lambda i: (best[i], i))[:10])]


def test_recall_without_clusters(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((5000, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 100 = 0"), fit_rows=2500, part_rows=600, block=400).collect()
    y, hit = x.astype(float), 0
    for q in range(0, 5000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 500
