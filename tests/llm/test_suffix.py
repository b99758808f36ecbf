import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lantern.llm import suffix


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    alphabet = "abcdé "
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [make(r.choice([length - 1, length, length + 1, 2 * length])) for _ in range(4)]
    texts = [None, "", "a", make(length), "a" * (3 * length), "ab" * length, "xyz" * length]
    for _ in range(50):
        t = make(r.randrange(0, 3 * length))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(passages) + t[at:]
        texts.append(t)
    for _ in range(8):
        t = list(texts[20])
        for _ in range(2):
            if t:
                t[r.randrange(len(t))] = "Z"
        texts.append("".join(t))
    texts += [texts[9], texts[9], texts[10] + texts[10]]
    return list(enumerate(texts)) + [(None, texts[11]), (3, "other" * 20)]


def around(length, gram):
    """Texts with one gram amid more and less common surroundings, so that its group is dealt on several times."""
    r = random.Random(length)
    make = lambda n: "".join(r.choice("pqrstu") for _ in range(n))
    core = make(length - 3)
    texts = [make(r.randrange(length)) + core[r.randrange(4) :] + make(r.randrange(length)) for _ in range(60)]
    texts += [make(5) + core[i : len(core) - j] + make(9) for i in range(0, length - gram, 5) for j in range(0, 12, 3)]
    return list(enumerate(texts + [core + make(3)] * 2 + [texts[0] + "!" * i for i in range(6)], 1000))


@pytest.mark.parametrize("length,gram,large,block", [(40, 10, 2048, 1 << 20), (40, 10, 1, 97), (24, 8, 3, 300), (40, 10, 2, 1 << 20), (64, 8, 4, 500)])
def test_brute_force(spark, length, gram, large, block):
    rows = corpus(length + large, length) + around(length, gram)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, e string").repartition(3)
    got = suffix.remove_repeats(docs, length=length, gram=gram, large=large, block=block).drop("kept", "kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, length)))


def test_refined_buckets():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(60))) for _ in range(40)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.concatenate([np.full(len(s), e) for s, e in zip(strings, np.cumsum([len(s) for s in strings]), strict=True)])
    for length in (5, 8, 13, 20):
        bucket = suffix.refined_buckets(data, ends, length)
        raw = data.tobytes()
        by = {}
        for p in range(len(data)):
            if p + length > ends[p]:
                assert bucket[p] == -1
            else:
                by.setdefault(raw[p : p + length], set()).add(int(bucket[p]))
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_empty_and_carry(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert suffix.remove_repeats(docs).count() == 0
    docs = spark.createDataFrame([(1, "é" * 150, "fr"), (2, "é" * 150 + "!", None)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, suffix.remove_repeats(docs, carry=("lang",)).drop("kept_sha256", "kept_text").collect()))
    assert got == [(1, 300, 300, 1, bytearray(b""), "fr"), (2, 301, 300, 1, bytearray(b"!"), None)]


def test_copies_in_many_tasks_add_no_rows(spark):
    """A place of a text is found once, in however many tasks its copies stand."""
    r = random.Random(5)
    line = lambda n: " ".join(f"{r.randrange(10**6)}" for _ in range(n))
    passage = line(60)
    rows = [(f"{line(80)} {passage} {line(80)}",) for _ in range(6)] * 40
    docs = spark.createDataFrame(rows, "text string")
    few, many = (suffix.repeated_stretches(docs.repartition(n)).count() for n in (1, 24))
    assert 0 < many == few
