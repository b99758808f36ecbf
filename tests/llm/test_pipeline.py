import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import bpe, nbsvm, simhash
import test_decontam
import test_simhash


def write(spark, folder):
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    passage = " ".join(r.choice(vocab) for _ in range(60))
    item = " ".join(r.choice(vocab) for _ in range(14))
    for i in range(200):
        w = [r.choice(vocab) for _ in range(r.randrange(30, 120))]
        if i % 9 == 0:
            w[5:5] = passage.split()
        if i % 11 == 0:
            w[2:2] = item.split()
        bad = i % 5 == 0
        docs.append((i, " ".join(x + "$$$" for x in w) if bad else " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), 0))
    for i in range(30):
        docs.append((200 + i, docs[3 * i + 1][1] + (" é" if i % 2 else ""), "en", None, 1))
    docs += [(400, None, None, "s", None), (401, "", "en", "s", 0), (3, docs[3][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, [(1, item)]


def test_against_plain_versions(spark, tmp_path):
    docs, items = write(spark, str(tmp_path))
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = nbsvm.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    good = {r.doc_id for r in scored.collect() if r.predicted}
    rows = [(i, t) for i, t, *_ in docs if i in good]
    assert {i for i, _ in rows} >= {i for i in range(200) if i % 5} and not {i for i in range(200) if i % 5 == 0} & good
    prints = [test_simhash.brute_print(t) for _, t in rows]
    group = test_simhash.brute_components([i for i, _ in rows], prints)
    rows = [x for n, (x, g) in enumerate(zip(rows, group, strict=True)) if x[0] == g and x not in rows[:n]]
    left = []
    data = [(t or "").encode() for _, t in rows]
    from collections import Counter

    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        left.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    assert sum(len(t.encode()) for _, t in left) < sum(map(len, data))
    clean = {r[0] for r in test_decontam.brute(left, items) if not r[5]}
    codec = bpe.Codec(bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)
    want = sorted((i, len(codec.encode(t)), hashlib.sha256(codec.encode(t).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left if i in clean)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 0 < len(clean) < len(left)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, tmp_path, k):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), str(tmp_path)).count() == 0


CLASHING = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "id", "k1", "k2", "g", "e", "s", "fp", "root", "row", "rest", "key", "seg", "ord", "hit", "items", "n_hit", "n_words", "label", "score", "predicted", "held_out", "copy", "own_0", "begins", "stops", "least", "a.b", "_", "low"]


@pytest.mark.parametrize("k", range(5))
def test_clashing_columns(spark, tmp_path, k):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 60 or doc_id > 199 or doc_id is null")
    more = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    plain, wide = (corpus_pipeline.STAGES[k][1](spark, d, str(tmp_path)) for d in (docs, more))
    if k == 4:
        assert sorted(map(str, wide.collect())) == sorted(map(str, plain.collect()))
        return
    assert wide.schema.simpleString() == more.schema.simpleString()
    rows = wide.collect()
    assert sorted(map(str, (tuple(r)[: len(docs.columns)] for r in rows))) == sorted(map(str, map(tuple, plain.collect())))
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING)


def test_tied_rows_are_kept_alike(spark):
    rows = [(1, "a b c d e f", "x", {"p": i}, [i]) for i in range(40)] + [(1, "a b c d e f", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m map<string,int>, l array<int>")
    kept = {str(simhash.keep_representatives(docs.repartition(n, "l") if n > 1 else docs.coalesce(1)).collect()) for n in (1, 3, 7)}
    assert len(kept) == 1


def test_long_texts(spark, tmp_path):
    """A text of over a megabyte, and its near copy, through all stages."""
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(170_000))
    docs = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "only a few words here", "en", "s", 1), (4, long[5000:5600] + " é", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(long.split()[-12:]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(long) > 1 << 20 and corpus_pipeline.quality(spark, d, str(tmp_path)).count() == 4
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect()) == [1, 3, 4]
    left = {x.doc_id: x for x in corpus_pipeline.repeats(spark, d, str(tmp_path)).collect()}
    assert [left[i].text for i in (1, 2, 3, 4)] == ["", " end"[-4:], docs[2][1], " é"] and left[4].n_chars == 2
    assert sorted(x.doc_id for x in corpus_pipeline.decontaminate(spark, d, str(tmp_path)).collect()) == [3, 4]
    codes = {x.doc_id: x.decoded_sha256 for x in corpus_pipeline.encode(spark, d, str(tmp_path)).collect()}
    assert codes == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in docs}
