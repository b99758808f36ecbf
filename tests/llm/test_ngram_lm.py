import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lantern.llm import ngram_lm
from lantern.llm.labelled import remainder

BEGIN, END = "\r", "\n"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


class Plain:
    """The automaton with dictionaries, one step at a time."""

    def __init__(self, texts, order, strength):
        self.order, self.s = order, strength
        self.c = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = [BEGIN] * (order - 1) + t
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    self.c[n][tuple(w[i - n + 1 : i + 1])] += 1
        self.n, self.v, self.texts = sum(self.c[1].values()), len(self.c[1]), len(texts)

    def count(self, h):
        return self.texts if set(h) == {BEGIN} else self.c[len(h)][h]

    def prob(self, h, w):
        if not h:
            return (self.c[1][w,] + 0.1) / (self.n + 0.1 * (self.v + 1))
        s = self.s[len(h) + 1]
        return (self.c[len(h) + 1][(*h, w)] + s * self.prob(h[1:], w)) / (self.count(h) + s)

    def score(self, text):
        total, state = 0.0, (BEGIN,) * (self.order - 1) if self.texts else ()
        for w in text:
            while state and not self.c[len(state) + 1][(*state, w)]:
                s = self.s[len(state) + 1]
                total += math.log10(s / (self.count(state) + s))
                state = state[1:]
            total += math.log10(self.prob(state, w))
            state = (*state, w)
            while len(state) > self.order - 1 or (state and not self.count(state)):
                state = state[1:]
        return total


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def corpus():
    r = random.Random(8)
    word = [f"w{i}" for i in range(60)] + ["The", "THE", "é", " ", "a b"]
    out = [(i, "".join(r.choice(word[: r.choice([5, 20, 65])]) + r.choice([" ", "\t", "\n", "  "]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    out += [(200 + i, out[i % 7][1]) for i in range(30)] + [(None, "w1 w2"), (300, None), (301, ""), (302, "never seen these"), (303, " w1 " * 3000), out[3]]
    return out


@pytest.mark.parametrize(("order", "coded_bytes", "meet_rows"), [(3, 1 << 24, 1 << 21), (3, 600, 200), (2, 3000, 500), (4, 1500, 1000), (1, 2000, 300)])
def test_equals_plain_automaton(spark, order, coded_bytes, meet_rows):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n int, score double").repartition(3)
    got = ngram_lm.score_texts(df, remainder(df["doc_id"], 10) == 0, order=order, coded_bytes=coded_bytes, meet_rows=meet_rows).collect()
    plain = Plain([tokens(t) for i, t in rows if not held(i)], order, ngram_lm.STRENGTH)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((plain.c[1][x,] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for x in w)
        want[i, held(i), len(w), sum(plain.c[1][x,] > 0 for x in w), plain.n, round(base, 6), round(plain.score(w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_sum_to_one():
    texts = [tokens(t) for _, t in corpus()]
    plain = Plain(texts, 3, ngram_lm.STRENGTH)
    for h in [(), ("w1",), ("w2", "w1"), (BEGIN, BEGIN), (BEGIN, "w3")]:
        assert sum(plain.prob(h, w) for w, in plain.c[1]) + plain.prob(h, "unknown") == pytest.approx(1)


def test_empty_tables_and_nothing_to_learn_from(spark):
    kind = "doc_id long, text string"
    assert ngram_lm.score_texts(spark.createDataFrame([], kind), F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], kind)
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_texts(one, F.lit(True)).collect()}
    assert got == {1: (True, 3, 0, 0, 0.0, 0.0), 2: (True, 1, 0, 0, 0.0, 0.0)}


def test_scores_of_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram_lm.score_texts(docs, remainder(docs["doc_id"], 10) == 0).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]
