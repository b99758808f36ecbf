import random
import re
from collections import Counter

import numpy as np
import pytest

from lantern.llm import collocations


def brute(rows, least=30, top=2000):
    """Plain counts over all phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for s in range(len(w) - k + 1):
                    f[lang, tuple(w[s : s + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(m == lang and len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in f.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def corpus(seed=1, texts=700):
    r = random.Random(seed)
    word = ["a", "b", "the", "of", "Straße", "é", "x" * 40, " ", " q", "ZZ", "zz", "0", "-", "'"]
    out = []
    for _ in range(texts):
        weights = [r.random() ** 2 for _ in word]
        w = r.choices(word, weights, k=r.randrange(0, 60))
        out.append((r.choice(["en", "en", "en", "de", None, "und"]), "".join(x + r.choice([" ", " ", " ", "\t", "  ", ". ", "!", "\n", " "]) for x in w)))
    return out + [("en", None), ("de", ""), (None, "  .. "), ("fr", "une seule fois")] + [("en", "The Same Copy of one text, again")] * 45


SCHEMA = "lang string, text string"


@pytest.mark.parametrize(("partition_rows", "coded_bytes"), [(1 << 20, 1 << 24), (50, 800)])
def test_equals_brute_force(spark, partition_rows, coded_bytes):
    """The second case deals most pivots to several partitions and the texts to many blocks."""
    rows = corpus()
    df = spark.createDataFrame([(x, t, "n", 1) for x, t in rows], SCHEMA + ", phrase string, n int").repartition(4)
    got = [tuple(r) for r in collocations.collocations(df, partition_rows=partition_rows, coded_bytes=coded_bytes).collect()]
    want = brute(rows)
    assert len(got) == len(want) > 40 and set(got) == want


def test_first_rows_and_least(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in collocations.collocations(df, least=10, top=7).collect()]
    assert set(got) == brute(rows, 10, 7) and len(got) == 7 * len({r[0] for r in got})


def test_empty_tables_and_long_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b")], SCHEMA)).count() == 0
    rows = [("en", "red fish blue fish, " * 100_000), ("en", "one fish")]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) == {("en", 1, "red fish blue fish", 100_000, 100_000, 200_001, 400_002, 666_664)}


def test_counts_beyond_64_bits(spark):
    """Products are decimals: scores of very large counts."""
    big = 3 * 10**18
    phrases = spark.createDataFrame([([1, 2], big), ([1, 2, 3], big // 5 * 4 - 1), ([2, 3], big // 5 * 4 - 1)], "key array<int>, f long")
    ranked = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 5, 2), ("en", "c", big // 5 * 4 - 1, 3)], "lang string, word string, c long, id int")
    got = {tuple(r.key): (r.a, r.l, r.r, r.score) for r in collocations.scored(phrases, ranked).collect()}
    assert got[1, 2] == (big, big + 1, big + 5, 2000000 * big // (2 * big + 6))  # 100 * f(longer) is just under 80 * a
    a = big // 5 * 4 - 1
    assert got[1, 2, 3] == (a, big + 1, a, 2000000 * a // (big + 1 + a))  # both cuts score alike, the first counts
    assert 2000000 * a // (big + 1 + a) == 2000000 * a // (big + a) and (2, 3) not in got


def test_fragments_own_each_ngram_once():
    ids = np.array([3, 1, 2, 3, 0, 5, 1, 1, 9, 9, 2])
    rows = collocations.fragments(ids)
    found = Counter()
    for grams, f in collocations.mined(rows, 1):
        for g, c in zip(grams.T.tolist(), f.tolist(), strict=True):
            assert tuple(g) not in found
            found[tuple(g)] = c
    want = Counter(tuple(p[s : s + k].tolist()) for p in (ids[:4], ids[5:]) for k in (2, 3, 4) for s in range(len(p) - k + 1))
    assert found == want
