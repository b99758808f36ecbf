import math
import random

import numpy as np
import pytest

from lantern.llm import negatives
from lantern.llm.negatives import First, Pivots, products


def brute(rows, positives=5, low=80, take=5):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or len(v) != 6 or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(256 * x) for x in v]
        if max(map(abs, c)) <= 1 << 22:
            ok[i] = min(ok.get(i, (label, c)), (label, c))
    out = set()
    for a, (label, u) in ok.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, w, strict=True)), i, m == label) for i, (m, w) in ok.items() if i != a)
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, i) for n, i, same in scored if not same and low * -p <= -100 * n <= -100 * p][:take]
            out |= {(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(fit)}
    return out


def rows(n=700):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = [(i, [float(np.float32(x + r.gauss(0, 0.4))) for x in r.choice(centres)], r.choice([0, 0, 0, 1, 2])) for i in range(n)]
    out += [(1000 + i, out[5][1], i % 3) for i in range(60)]  # one vector, many ids and labels
    out += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [1.0] * 5 + [None], 0), (2003, [math.nan] + [1.0] * 5, 0), (2100, [math.inf] + [1.0] * 5, 0), (2005, [1.0, 2.0], 0), (None, out[3][1], 0), (2006, out[1][1], None)]
    out += [out[5], (100, out[7][1], 0), (2200, [], 0), (2300, [0.0] * 6, 2), (2400, [1e5] * 6, 1), (2401, [1e300] * 6, 1), (2500, [-x for x in out[5][1]], 9)]
    return out


@pytest.mark.parametrize("at_once", [8192, 3])
def test_equals_brute_force(spark, at_once):
    data = rows()
    df = spark.createDataFrame([(i, v, m, 7) for i, v, m in data], "vec_id long, embedding array<double>, label int, rank int").repartition(3)
    got = negatives.hard_negatives(df, df.filter("vec_id % 100 = 0"), at_once=at_once).collect()
    assert len(got) == len({(r.anchor_id, r.positive_id, r.rank) for r in got})
    assert {tuple(r) for r in got} == brute(data)


def test_empty_and_small(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [9.0, 9.0], 2), (4, [0.1, 0.1], 2)], kind)
    got = [tuple(r) for r in negatives.hard_negatives(few, few.filter("vec_id = 0")).collect()]
    score = 256 * 256 + 512 * math.floor(256 * float(np.float32(1.9)))
    assert got == [(0, 1, 1, 2, 256 * 256 + 512 * 512, score)]
    for part in ("vec_id < 0", "vec_id = 0"):
        assert negatives.hard_negatives(few.filter(part), few).count() == 0
    assert negatives.hard_negatives(few, few.filter("vec_id < 0")).count() == 0


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (8, 16))
    x = centres[rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 16))
    pivots = Pivots(np.unique(x[:500], axis=0), int((x * x).sum(1).max()))
    away = pivots.of_rows(x)
    q = x[:50]
    norm, near = (q.astype(float) ** 2).sum(1)[:, None], pivots.of_anchors(q)
    gap = np.abs(near[:, None, :] - away[None]).max(2)
    reach = (near[:, None, :] + away[None]).min(2)
    scores = products(q, x)
    high = pivots.highest(norm, gap)
    assert (high >= scores).all() and (pivots.lowest(norm, reach) <= scores).all()
    edge = np.partition(scores, -10, axis=1)[:, -10]
    assert (high >= edge[:, None]).mean() < 0.3  # most rows need no exact score


def test_products_are_exact_beyond_doubles():
    a = np.array([[(1 << 22) - 1, 1 << 22]] * 1, np.int64)
    b = np.full((1, 2), (1 << 29) + 1, np.int64)
    assert products(a, b)[0, 0] == int(a[0, 0]) * int(b[0, 0]) + int(a[0, 1]) * int(b[0, 1])
    wide = np.full((1, 4096), (1 << 22) - 1, np.int64)
    assert products(wide, wide)[0, 0] == 4096 * ((1 << 22) - 1) ** 2


def test_first_settles_often():
    first = First(2, 3)
    rng = np.random.default_rng(5)
    all_ = [[], []]
    for _ in range(40):
        s, k = rng.integers(0, 50, 100), rng.integers(0, 10**6, 100)
        q = rng.integers(0, 2, 100)
        for a, b, c in zip(q, s, k, strict=True):
            all_[a].append((-b, c))
        first.add(q, s, k)
        first.settle()
    q, s, k = first.settle()
    for a in (0, 1):
        assert [(-x, y) for x, y in zip(s[q == a], k[q == a], strict=True)] == sorted(all_[a])[:3]
