import itertools
import random

import numpy as np

from lantern.llm import crf
from lantern.llm.labelled import FIT_BYTES


def brute_marginals(odds, trans):
    out = np.zeros(len(odds))
    total = 0.0
    for tags in itertools.product((0, 1), repeat=len(odds)):
        w = np.prod([o if t else 1 for o, t in zip(odds, tags, strict=True)]) * np.prod([np.exp(trans[a, b]) for a, b in zip(tags, tags[1:], strict=False)])
        total += w
        out += w * np.array(tags)
    return out / total


def test_marginals_of_whole_chains():
    rng = np.random.default_rng(0)
    field = crf.Field(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), bits=6)
    field.weights, field.trans, field.bias = rng.standard_normal(3 << 6), rng.standard_normal((2, 2)), 0.3
    sizes = [5, 0, 1, 9, 8, 0, 10, 7]
    first = np.append(0, np.cumsum(sizes))
    x = crf.places(rng.integers(0, 2**63, first[-1], dtype=np.uint64), first, 6)
    odds = np.exp(field.weights[x] @ crf._VALUES + 0.3)
    want = np.concatenate([brute_marginals(odds[a:b], field.trans) for a, b in zip(first, first[1:], strict=False) if b > a])
    for lanes in (1, 2, 512):
        assert np.allclose(field.marginals(x, first, lanes), want, atol=1e-10)


def test_gradient():
    rng = np.random.default_rng(1)
    emit, trans = rng.standard_normal((6, 5)), rng.standard_normal((2, 2))
    real = np.arange(5) < rng.integers(1, 6, 6)[:, None]
    tags = rng.integers(0, 2, (6, 5)).astype(bool) & real
    value, ge, gt = crf.log_likelihood(emit, trans, tags, real)
    for grad, array in ((ge, emit), (gt, trans)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            assert abs((crf.log_likelihood(emit, trans, tags, real)[0] - value) / 1e-5 - grad[at]) < 1e-4
            array[at] -= 1e-5


def test_held_out(spark):
    r = random.Random(8)
    plain, bad = [f"é{i}" for i in range(80)], ["grok", "blarg", "zorp"]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randrange(5, 80))]
        toxic = i % 4 == 0
        for _ in range(r.randrange(1, 4) if toxic else 0):
            w.insert(r.randrange(len(w) + 1), r.choice(bad).upper())
        docs.append((i, " ".join(w)))
        labels.append((i, None if i == 9 else int(toxic)))
    docs += [(600, None), (601, "..."), (602, "é1 grok é2"), (None, "grok"), (0, docs[0][1]), (603, "é1 " * 300000 + "zorp")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, spans int").repartition(3)
    got = crf.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600 and x.doc_id != 9]
    assert all(x.predicted == int(x.doc_id % 4 == 0) for x in held)
    by = {x.doc_id: x for x in got}
    assert by[600].score == 0 and by[601].score == 0 and by[603].predicted == 1
    assert [tuple(s) for s in by[602].spans] == [(4, 8)] and [tuple(s) for s in by[603].spans] == [(1200000, 1200004)]
    none = crf.classify(d, spark.createDataFrame([], "doc_id long, toxic int")).agg({"score": "max"}).first()[0]
    assert none == 0 and crf.classify(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_families_of_rare_words(spark):
    """Toxic documents hold words of a family, each too rare to be known by itself; a clean one holds one such word at most."""
    r = random.Random(12)
    ends = [a + b for a in "bcdfgklm" for b in ("é", "o", "ur")]
    plain = [a + b + c for a in ends[:12] for b in ends[12:] for c in ("", "ta")]
    family = ["réeux" + a + b for a in ends for b in ends]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randrange(20, 90))]
        toxic = i % 6 == 0
        for _ in range(r.randrange(3, 7) if toxic else r.random() < 0.1):
            w.insert(r.randrange(len(w) + 1), r.choice(family))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    got = crf.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(x.doc_id % 6 == 0, x.predicted) for x in got.collect() if x.held_out]
    assert np.mean([p for t, p in held if t]) > 0.9 and np.mean([p for t, p in held if not t]) < 0.02


def test_only_long_labelled_texts(spark):
    r = random.Random(6)
    plain = [f"é{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(90):
        w = [r.choice(plain) for _ in range(12_000)]
        for _ in range(400 if i % 3 == 0 else 0):
            w[r.randrange(len(w))] = r.choice(["grok", "blarg", "zorp"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    assert min(len(t.encode()) for _, t in docs) > FIT_BYTES
    got = crf.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in got if x.held_out)
