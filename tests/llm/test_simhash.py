import random
import re

import numpy as np
import pytest
import xxhash

from lantern.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                label[root(i)] = root(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low.get(root(i)) for i in range(len(ids))]


def near(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 4)]
    return sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(4)})


def test_forest_finds_all_within_radius():
    v = np.array(near(600, 1), np.uint64)
    f = simhash.Forest(np.zeros(len(v), np.int64), v)
    q, n = f.search(v, np.zeros(len(v), np.int64))
    got = {(int(v[a]), int(f.nodes[b])) for a, b in zip(q, n, strict=True)}
    assert got == {(int(a), int(b)) for a in v for b in v if bin(int(a) ^ int(b)).count("1") <= 3}


@pytest.mark.parametrize("hot", [4096, 5])
def test_components(spark, hot):
    texts = [None, "", " \t", "One", "one", "ONE two", "a b c", "a b c"]
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = [r.choice(words) for _ in range(150)]
        for _ in range(6):
            t = list(base)
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    rows = [(i if i != 5 else None, t, 1) for i, t in enumerate(texts)] + [(3, "One", 1), (700, texts[-1], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash.near_duplicates(docs, hot=hot).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    want = zip([i for i, _, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _, _ in rows], prints), strict=True)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_long_texts(spark):
    r = random.Random(8)
    long = " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(260_000))
    rows = [(1, long), (2, long.upper()), (3, "short " + long)]
    assert len(long) > 1 << 20
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{brute_print(t):016x}" for i, t in rows} and got[2] == got[1] and got[1][1] == 1
