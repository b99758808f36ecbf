"""Half of all rows hold one text, or one payload, or one component: no task gets them all."""

import random

import numpy as np
import pytest

from lantern.llm import decontam, simhash, suffix, warc
from tests.llm.skew import largest, split_often


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    hot = words(r, 500)
    rows = [(i, hot if i % 2 else words(r, 500), "x" * 50) for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string, url string").repartition(48).cache()


def test_pages_of_one_payload(spark, docs):
    pages = docs.select("doc_id", "url", "text")
    assert largest(spark, lambda: warc.with_revisits(pages, "doc_id", "url", "text").write.format("noop").mode("overwrite").save(), 1 << 20) < 0.1


def test_repeats_of_one_text(spark, docs):
    assert largest(spark, lambda: suffix.remove_repeats(docs).write.format("noop").mode("overwrite").save(), 1 << 20) < 0.1


def test_clean_rows_of_one_text(spark, docs):
    cold = docs.filter("doc_id = 8").first().text.split()
    items = spark.createDataFrame([(1, " ".join(cold[20:32]))], "item_id long, text string")
    assert decontam.keep_clean(docs, items).count() == 1199
    assert largest(spark, lambda: decontam.keep_clean(docs, items).write.format("noop").mode("overwrite").save(), 1 << 20) < 0.1


def test_copies_are_one_row_a_task(spark, docs):
    with split_often(spark):
        kept = simhash.keep_representatives(docs)
    assert kept.count() == 601


def test_a_component_with_one_centre(spark):
    """10^5 fingerprints around one of them, and a chain."""
    rng = np.random.default_rng(4)
    star = rng.permutation(np.arange(10, 100_010)).tolist()
    edges = [(v, 5) for v in star] + [(200_000 + i, 200_001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "fp long, `to` long").repartition(8)
    got = []
    share = largest(spark, lambda: got.extend(simhash.components(df).collect()), 1 << 19)
    assert share < 0.3
    want = dict.fromkeys(star, 5) | {200_000 + i: 200_000 for i in range(1, 301)}
    assert {x.fp: x.root for x in got if x.fp != x.root} == want
