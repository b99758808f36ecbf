import random
import zlib

import numpy as np
import pyarrow as pa

from lantern.llm import nbsvm
from lantern.llm.common import text_bytes
from lantern.llm.labelled import FIT_BYTES, STRETCH_BYTES, drawn_stretches, sampled_texts


def table():
    r = random.Random(1)
    good = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(good) for _ in range(r.randrange(3, 60))]
        bad = i % 5 == 0
        if bad:
            w = [x + r.choice(["$$$", "&&&"]) for x in w]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(not bad), 0))
    docs += [(600, None, "x"), (601, "", "x"), (None, "word1 word2", "x"), (5, docs[5][1], "x"), (602, "é " * 100000, "x")]
    labels += [(700, 1, 0), (None, 1, 0), (601, None, 1)]
    return docs, labels


def test_features_are_row_by_row():
    texts = ["A b, c!! c c", None, "", "ÉCLAIR 12 ab", "A b, c!! c c"]
    places, begin = nbsvm.features(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone, _ = nbsvm.features(*text_bytes(pa.array([t], pa.string())))
        assert places[begin[i] : begin[i + 1]].tolist() == alone.tolist()


def test_descent_solves_the_hinge_loss():
    rng = np.random.default_rng(0)
    x = [np.sort(rng.choice(30, 5, replace=False)) for _ in range(80)]
    y = np.array([int(0 in v or 1 in v) for v in x])
    ratio = np.ones(30)
    w, b = nbsvm.dual_coordinate_descent(x, y, ratio, cost=0.2, passes=400)

    def loss(w, b):
        limit = 0.2 * 0.5 / np.array([(y == 0).mean(), (y == 1).mean()])[y]
        m = np.array([w[v].sum() / np.sqrt(5) + b for v in x]) * (2 * y - 1)
        return 0.5 * (w @ w + b * b) + (limit * np.maximum(0, 1 - m)).sum()

    best = loss(w, b)
    assert all(best <= loss(w + 0.01 * rng.standard_normal(30), b + 0.01 * rng.standard_normal()) for _ in range(200))


def test_held_out(spark):
    docs, labels = table()
    d = spark.createDataFrame([(*x, 0.1) for x in docs], "doc_id long, text string, label string, score double").repartition(3)
    got = nbsvm.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in nbsvm.classify(d, none).collect()] == [0.5, 0.5]
    assert nbsvm.classify(d.limit(0), none).count() == 0


def plain_features(text):
    """Sets of token n-grams as strings: words and runs of punctuation, pairs, and triples of shapes."""
    import re

    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())
    low = [t.lower() for t in found]

    def shape(i):
        t = found[i]
        again = i > 0 and low[i] == low[i - 1]
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            return ("punct", t[:1], again)
        upper = sum(65 <= c <= 90 for c in t)
        kind = "digit" if re.search(rb"[0-9]", t) else "plain" if not upper else "many" if upper >= 2 else "first" if 65 <= t[0] <= 90 else "one"
        return (kind, again)

    shapes = [shape(i) for i in range(len(found))]
    out = {("word", t) for t in low} | {("pair", a, b) for a, b in zip(low, low[1:], strict=False)}
    return out | {("shape", *x) for x in zip(shapes, shapes[1:], shapes[2:], strict=False)}


def plain_model(rows, y, passes=nbsvm.PASSES):
    """The offset and the values of a text, by the published formulas over sets of strings."""
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}, key=repr))}
    size = 1 << nbsvm.BITS
    counts = [np.full(size, 1.0), np.full(size, 1.0)]
    for r, label in zip(rows, y, strict=True):
        for f in r:
            counts[label][names[f]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for f in r:
            x[i, names[f]] = ratio[names[f]]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    sign, share = 2 * np.array(y) - 1, [np.mean(np.array(y) == k) for k in (0, 1)]
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(y)), np.random.default_rng(1)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            new = np.clip(alpha[i] - (sign[i] * (w @ x[i]) - 1) / 2, 0, 0.5 / share[y[i]])
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new

    def margin(text):
        v = np.array([ratio[names[f]] if f in names else ratio[-1] for f in plain_features(text)])
        known = [(names[f], ratio[names[f]]) for f in plain_features(text) if f in names]
        return sum(w[j] * r for j, r in known) / (np.linalg.norm(v) + 1e-12) + w[-1]

    return margin


def test_scores_are_those_of_the_plain_formulas():
    docs, labels = table()
    texts = [t for _, t, _ in docs[:160]] + ["A b!! A b", "X1 Y2 z", "aBc ABC abc abc", "a  a\ta"]
    y = [int(i % 5 != 0) for i in range(160)] + [1, 0, 1, 0]
    places = [nbsvm.features(*text_bytes(pa.array([t])))[0] for t in texts]
    model = nbsvm.Model(places, np.array(y))
    sets = [plain_features(t) for t in texts]
    assert all(0 <= len(s) - len(p) <= 2 for p, s in zip(places, sets, strict=True))  # some share a place
    fold = np.arange(len(y)) % 4 == 3
    train = [i for i in range(len(y)) if not fold[i]]
    part = plain_model([sets[i] for i in train], [y[i] for i in train])
    a, b = nbsvm.calibrate(np.array([part(texts[i]) for i in np.flatnonzero(fold)]), np.array(y)[fold])
    whole = plain_model(sets, y)
    want = [1 / (1 + np.exp(-np.clip(a * whole(t) + b, -50, 50))) for t in texts]
    got = [model.scores(p, np.array([0, len(p)]))[0] for p in places]
    assert np.allclose(got, want, atol=2e-3)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(7, f"copy {i}") for i in range(2000)] + [(i, "x" * (50_000 if i == 30 else 10)) for i in range(20, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, i % 2) for i in range(20, 200)], "doc_id long, quality int")
    got = sampled_texts(docs, labels, "quality", 5, 4, 2, "doc_id", "text").collect()
    assert len(got) == 5
    got = sampled_texts(docs, labels, "quality", 500, 4, 2, "doc_id", "text").collect()
    assert 25 < len(got) < 43 and sum("copy" in r.text for r in got) <= 1
    assert sorted(len(r.text) for r in got)[-2] < 100 and max(len(r.text) for r in got) <= FIT_BYTES  # id 30 is bounded, not left out


def test_stretches_are_of_the_whole_text():
    text = " ".join(f"wörd{i}" for i in range(40_000)).encode()
    got = drawn_stretches(text)
    assert FIT_BYTES - 3 * STRETCH_BYTES < len(got) <= FIT_BYTES + FIT_BYTES // STRETCH_BYTES and got == drawn_stretches(text)
    at = [int(w[5:]) for w in got.split()]
    assert at == sorted(set(at)) and min(at) < 8000 and max(at) > 32_000  # words are whole, from all over
    assert drawn_stretches(text[:1000]) == text[:1000] and drawn_stretches(b"") == b""
    solid = "é".encode() * 100_000
    assert solid.decode().startswith(drawn_stretches(solid).replace(b"\n", b"").decode())


def test_only_long_labelled_texts(spark):
    """Labels are learned from texts of any length, also where only the long ones have a label."""
    r = random.Random(5)
    plain = [f"w{i}" for i in range(300)]

    def text(good, words):
        return " ".join(r.choice(plain) if r.random() < 0.9 else ("Well" if good else "!!") for _ in range(words))

    long = [(i, text(i % 2, 14_000)) for i in range(48)]
    short = [(100 + i, text(i % 2, 300)) for i in range(40)]
    assert min(len(t) for _, t in long) > 1.5 * FIT_BYTES
    docs = spark.createDataFrame(long + short, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in long], "doc_id long, quality int")
    got = nbsvm.classify(docs, labels).collect()
    assert all((x.score > 0.5) == bool(x.doc_id % 2) for x in got if x.held_out or x.doc_id >= 100)
    # one label stands on long texts alone
    mixed = spark.createDataFrame([(i, i % 2) for i, _ in long if i % 2] + [(i, i % 2) for i, _ in short if not i % 2], "doc_id long, quality int")
    got = nbsvm.classify(docs, mixed).collect()
    assert all((x.score > 0.5) == (x.doc_id < 100) for x in got if x.held_out and (x.doc_id < 100) == bool(x.doc_id % 2))
